"""Exact Jaccard self-join of word shingles by a token-group matrix.

Texts with equal shingle sets are one node. Nodes are partitioned into groups of similar ones: nodes that
share a band of minhashes are compared with the most typical of them, its head, and go to its group.
The matrix then holds, for each group, the union of its members' tokens, of which the rarest few of each
member are enough: two sets with an overlap of at least o share `DEPTH` of the n - o + DEPTH tokens that
come first in any common order. A node is compared with another group only if its tokens meet the group's
union often enough, counting tokens of members whose size allows a link; tokens in one group only leave the
matrix at once. Opened groups are compared by
exact overlap: small ones by pairs of allowed sizes, large ones block against block, which passes on only
links that connect something new. Within a group, members not linked with the head are compared with
all. So no link that components depend on is lost, and families of near copies are never paired off.

The common order puts frequent tokens last, so that a passage shared by many texts makes no candidates.
It is counted over all texts; it decides how much work there is, never what is linked.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import drop, frugal, materialise
from basalt.llm.components import components
from basalt.llm.shingles import mix, shingle_sets

BANDS, ROWS, DEPTH = 8, 3, 3
#: Frequent tokens whose order is told apart: the number bounds what is broadcast.
FREQUENT = 400_000
#: Groups of more members are opened block by block, BLOCK queries against BLOCK members.
SMALL, BLOCK = 16, 256
#: Texts hashed at a time.
TEXTS = 64
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_id(tokens: np.ndarray) -> np.uint64:
    """A number for a whole set: equal for equal sets."""
    return mix(mix(np.array([tokens.sum(dtype=np.uint64) ^ np.uint64(len(tokens))])) + np.bitwise_xor.reduce(tokens, initial=np.uint64(0)))[0]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, batch.num_rows, TEXTS):
        yield at, batch.column(column).slice(at, TEXTS).to_pylist()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """A row a text: doc_id, n (set size), sid (set id), bands. Besides, rows with n null: tok and times, tokens frequent in a task."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, met = [], 0, set()
        tokens, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def gather():
            nonlocal seen, held, tokens, times
            u, c = np.unique(np.concatenate([tokens, *seen]), return_counts=True)
            c[np.searchsorted(u, tokens)] += times - 1
            often = c > 1
            tokens, times, seen, held = u[often], c[often], [], 0

        for batch in batches:
            n, sid, bands = [], [], []
            for _, texts in slices(batch, 1):
                for tok in shingle_sets(texts, width):
                    n.append(len(tok))
                    sid.append(set_id(tok))
                    if len(tok):
                        low = np.minimum.reduce(tok[:, None] * SEEDS, axis=0).reshape(BANDS, ROWS)
                        bands.append(mix(low[:, 0] ^ mix(low[:, 1] ^ mix(low[:, 2] + np.arange(BANDS, dtype=np.uint64)))).view(np.int64))
                    else:
                        bands.append(np.zeros(0, np.int64))
                    if sid[-1] not in met:  # copies don't make a token frequent
                        met.add(sid[-1])
                        seen.append(tok)
                        held += len(tok)
                if held > 2_000_000:
                    gather()
            nothing = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), signed(np.array(sid, np.uint64)), pa.array(bands, pa.list_(pa.int64())), nothing, nothing], names=["doc_id", "n", "sid", "bands", "tok", "times"])
        gather()
        top = np.argsort(-times, kind="stable")[:FREQUENT]
        nothing = pa.nulls(len(top), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.nulls(len(top), pa.list_(pa.int64())), signed(tokens[top]), pa.array(times[top])], names=["doc_id", "n", "sid", "bands", "tok", "times"])

    return docs.mapInArrow(frugal(sketch), "doc_id bigint, n bigint, sid bigint, bands array<bigint>, tok bigint, times bigint")


def frequent_tokens(marks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The (at most FREQUENT) most frequent tokens, sorted, and their counts."""
    rows = marks.groupBy("tok").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "tok").limit(FREQUENT).toArrow()
    tok = rows.column("tok").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tok)
    return tok[order], rows.column("times").to_numpy().astype(np.int64)[order]


def prefixes(docs: DataFrame, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """sid, n, need (how many tokens a partner must share), toks: each set's first tokens, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for batch in batches:
            for at, texts in slices(batch, 1):
                sid, n, need, toks = [], [], [], []
                for tok in shingle_sets(texts, width):
                    least = -(-percent * len(tok) // 100)
                    deep = min(DEPTH, least)
                    length = len(tok) - least + deep
                    if len(often) and len(tok):
                        place = np.minimum(np.searchsorted(often, tok), len(often) - 1)
                        count = np.where(often[place] == tok, times[place], 0)
                        first = tok[np.argsort(count, kind="stable")[:length]]
                    else:
                        first = tok[:length]
                    sid.append(set_id(tok))
                    n.append(len(tok))
                    need.append(deep)
                    toks.append(first.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, TEXTS), signed(np.array(sid, np.uint64)), pa.array(n, pa.int64()), pa.array(need, pa.int64()), pa.array(toks, pa.list_(pa.int64()))], names=["doc_id", "sid", "n", "need", "toks"])

    return docs.mapInArrow(frugal(run), "doc_id bigint, sid bigint, n bigint, need bigint, toks array<bigint>")


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """sid, text of the wanted nodes, one row each."""

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, 1):
                sid = signed(np.array([set_id(t) for t in shingle_sets(texts, width)], np.uint64))
                part = batch.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays([sid, part.column(1)], names=["sid", "text"]).filter(pa.compute.equal(sid, part.column(0)))

    where = nodes.join(wanted, "sid").select("sid", F.col("rep").alias("doc_id"))
    return docs.join(where, "doc_id").select("sid", "text").mapInArrow(right, "sid bigint, text binary").dropDuplicates(["sid"])


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least percent / 100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                new = {}
                for ids, column in ((a, 2), (b, 3)):
                    for k, sid in enumerate(ids):
                        if sid not in known and sid not in new:
                            new[sid] = part.column(column)[k].as_py()
                known.update(zip(new, shingle_sets(list(new.values()), width), strict=True))
                keep = []
                for x, y in zip(a, b, strict=True):
                    p, q = known[x], known[y]
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                while len(known) > 4 * TEXTS:
                    known.popitem(last=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(frugal(run), "a bigint, b bigint")


def linked_blocks(queries: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect queries (other, sid) and members (other, sid) of a group as all their links do.

    Rows are dealt to blocks by hash, so that no task holds a group. Every query of a block meets every
    member, but only links that join what the block hadn't joined yet are passed on, fewer than it has rows.
    """
    asked, told = queries.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rows")), members.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("columns"))
    plan = asked.join(told, "other")
    spot = F.xxhash64("sid")
    q = queries.join(plan, "other").select("sid", "other", F.pmod(spot, F.col("rows")).cast("int").alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"), F.lit(True).alias("asks"))
    m = members.join(plan, "other").select("sid", "other", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), F.pmod(spot, F.col("columns")).cast("int").alias("j"), F.lit(False).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        asks, sid = np.array(table.column("asks").to_pylist(), bool), table.column("sid").to_numpy()
        sets = shingle_sets(table.column("text").to_pylist(), width)
        inside = np.flatnonzero(~asks)
        size = np.array([len(sets[k]) for k in inside])
        tokens, owner = np.concatenate([sets[k] for k in inside]), np.repeat(np.arange(len(inside)), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        up = {x: x for x in sid.tolist()}
        a, b = [], []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for k in np.flatnonzero(asks):
            low, high = np.searchsorted(tokens, sets[k]), np.searchsorted(tokens, sets[k], side="right")
            runs = high - low
            ends = np.cumsum(runs)
            both = np.bincount(owner[np.arange(ends[-1]) + np.repeat(low - (ends - runs), runs)], minlength=len(inside))
            for other in sid[inside[100 * both >= percent * (len(sets[k]) + size - both)]].tolist():
                x, y = top(int(sid[k])), top(other)
                if x != y:
                    up[x] = y
                    a.append(int(sid[k]))
                    b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return q.union(m).join(texts, "sid").groupBy("other", "i", "j").applyInArrow(run, "a bigint, b bigint")


def sizes_allow(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def check_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b) of nodes, materialised."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    texts = materialise(texts_of(docs, nodes, wanted, width), "texts")
    found = materialise(linked(pairs, texts, width, percent), "linked")
    drop(texts)
    return found


def open_groups(queries: DataFrame, placed: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect queries (sid, n, other) with members of the groups `other`. Materialised."""
    members = placed.join(queries.select(F.col("other").alias("grp")).distinct(), "grp").select(F.col("grp").alias("other"), F.col("sid").alias("b"), F.col("n").alias("m"))
    members = materialise(members, "members")
    large = members.groupBy("other").count().where(F.col("count") > SMALL).select("other")
    small = members.join(large, "other", "left_anti")
    pairs = materialise(queries.join(small, "other").where(F.col("sid") != F.col("b")).where(sizes_allow("n", "m", percent)).select(F.col("sid").alias("a"), "b").distinct(), "opened")
    asking, inside = queries.select("other", "sid").join(large, "other"), members.join(large, "other").select("other", F.col("b").alias("sid"))
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(asking.select("sid")).union(inside.select("sid")).distinct()
    texts = materialise(texts_of(docs, nodes, wanted, width), "texts")
    found = materialise(linked(pairs, texts, width, percent).union(linked_blocks(asking, inside, texts, width, percent)), "linked")
    drop(members, pairs, texts)
    return found


def shingle_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: every document with the smallest doc_id that links lead to.

    Documents link when 100 * intersection >= percent * union of their shingle sets. Empty and null texts
    have no shingles and link with nothing, each its own component. Repeated rows come out as often. A
    null doc_id counts as larger than any and is its own component's id only if nothing else is in it.
    Whole texts are compared however long. Empty table: no rows. Other columns are dropped.
    """
    nobody = F.lit((1 << 63) - 1)
    docs = docs.select(F.coalesce(F.col(id_col).cast("bigint"), nobody).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = materialise(sketches(docs, width), "sketch")
    frequent = frequent_tokens(found.where("n is null"))
    rows = found.where("n is not null").select("doc_id", "n", "sid", "bands")
    nodes = materialise(rows.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nodes")

    # groups: stars around the node of each band that shares most bands with others, the likely original
    banded = materialise(nodes.select("sid", "n", F.posexplode("bands").alias("band", "key")), "bands")
    crowds = banded.groupBy("band", "key").count().where("count > 1")
    crowded = materialise(banded.join(crowds, ["band", "key"]), "crowds")
    weights = crowded.groupBy("sid").agg(F.sum("count").alias("weight"))
    heads = crowded.join(weights, "sid").groupBy("band", "key").agg(F.max(F.struct("weight", "sid", "n")).alias("head"))
    stars = crowded.join(heads, ["band", "key"]).where(F.col("sid") != F.col("head.sid")).where(sizes_allow("n", "head.n", percent))
    stars = materialise(stars.groupBy(F.col("sid").alias("a"), F.col("head.sid").alias("b")).agg(F.max("head.weight").alias("weight")), "stars")
    star_links = check_pairs(stars.select("a", "b"), docs, nodes, width, percent)
    linked_sets = components(star_links)
    hubs = stars.groupBy(F.col("a").alias("component")).agg(F.max(F.struct("weight", "b")).alias("hub"))
    placed = nodes.join(linked_sets.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "n", F.col("rep").alias("doc_id"), F.coalesce("component", "sid").alias("component"))
    placed = materialise(placed.join(hubs, "component", "left").select("sid", "n", "doc_id", "component", F.coalesce("hub.b", "component").alias("grp")), "placed")
    drop(stars, banded, crowded)

    # within a group: whatever isn't linked to its head yet against all members
    head_sets = placed.where("sid = grp").select("grp", F.col("component").alias("head_set"))
    apart = placed.join(head_sets, "grp", "left").where(F.coalesce(F.col("component") != F.col("head_set"), F.col("component") != F.col("grp")))
    inner_links = open_groups(apart.select("sid", "n", F.col("grp").alias("other")), placed, docs, nodes, width, percent)

    # the matrix of tokens and groups, without tokens of a single group
    first = prefixes(docs, width, percent, frequent).join(placed, ["sid", "n", "doc_id"]).dropDuplicates(["sid"])
    first = materialise(first.select(F.explode("toks").alias("tok"), "sid", "n", "need", "grp"), "tokens")
    several = first.groupBy("tok").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x < y").select("tok")
    cells = materialise(first.join(several, "tok"), "matrix")
    drop(first)
    matrix = cells.groupBy("tok", F.col("grp").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)  # some member with the token has a size that allows a link
    bound = materialise(cells.join(matrix, "tok").where("grp > other").where(fits).groupBy("sid", "n", "need", "other").count().where(F.col("count") >= F.col("need")).select("sid", "n", "other"), "bound")
    drop(cells)
    cross_links = open_groups(bound, placed, docs, nodes, width, percent)
    drop(bound, placed)

    # components of nodes, then the smallest document of each
    whole = components(star_links.union(inner_links).union(cross_links)).withColumnRenamed("id", "sid")
    drop(star_links, inner_links, cross_links)
    named = materialise(nodes.select("sid", "rep").join(whole, "sid", "left").select("sid", "rep", F.coalesce("component", "sid").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("sid", "component_id")
    return (
        rows.where("n > 0").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .union(rows.where("n = 0").select("doc_id", F.lit(0).cast("bigint"), "doc_id"))
        .select(F.nullif("doc_id", nobody).alias("doc_id"), "n_shingles", F.nullif("component_id", nobody).alias("component_id"))
    )


def op7_shingle_join(spark, sf_dir: str) -> DataFrame:
    """shingle_components over all documents; its cases hold."""
    return shingle_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
