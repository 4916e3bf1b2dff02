"""Ranked lexical search by Block-Max WAND over an inverted index that Spark builds.

Documents are dealt to segments as tasks read them. A segment's postings are a row a term: places of documents (in order
of id) and what the term adds to each one's score, before the term's weight, in blocks of `BLOCK` postings, as gaps
and numbers of seven bits a byte. Beside them stand each block's last document, the greatest of its numbers (its
maximum impact) and where its bytes end; these are read without the block.

A search meets the rows of its terms by a join and groups them by segment and by some queries. In a group the last
documents of all terms' blocks cut a segment into ranges within which no pointer leaves its block, so that the sum of the blocks'
maxima bounds the scores of a whole range. Shallow moves look these up for all ranges; a range whose bound is below the score
of the k-th best so far is skipped, and a block is decompressed only for ranges that are left. The best
bounds go first, so that the threshold rises at once. All numbers are integers and bounds are sums of maxima that occur,
so the results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import drop, frugal, materialise
from basalt.llm.terms import LETTERS, LOWER, by_bytes, hashed, pieces, runs

#: Postings of a block; bytes of text and documents of a segment, about.
BLOCK, SEGMENT_BYTES, SEGMENT_DOCS = 128, 1 << 24, 1 << 15
#: Queries and their terms that meet a segment in one task, about.
QUERIES, QUERY_TERMS = 64, 4096
#: Documents looked at before the first threshold; each later round takes four times as many.
FIRST_LOOK = 256


def impact(times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term adds for each thousandth of its weight: by its occurrences and the document's relative length."""
    return (1_000_000_000 * times) // (1000 * times + 8 * length)


def relative_lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 for the mean length; a tenth of that for no term at all."""
    values, which = np.unique(n, return_inverse=True)
    return np.array([100 - 90 + 90 * int(x) * documents // max(1, terms) for x in values], np.int64)[which]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value): seven bits a byte, lowest first, the last byte below 128."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >> bits > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[(ends - size)[has] + k] = ((values[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    start = np.append(0, ends[:-1])
    values = np.zeros(len(ends), np.int64)
    for k in range(int((ends - start).max()) if len(ends) else 0):
        has = start + k < ends
        values[has] |= (data[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return values


def binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


def postings_of(texts: list[bytes], documents: int, terms: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """term, n (documents that hold it), blocks (last document, maximum impact, end of bytes), data: of texts in order."""
    h, place = hashed(texts, LETTERS, LOWER)
    length = relative_lengths(np.bincount(place, minlength=len(texts)), documents, terms)
    order = np.argsort(h, kind="stable")  # places ascend within a term
    h, place = h[order], place[order]
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (place[1:] != place[:-1]))) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(h)))
    h, place = h[head], place[head]
    gain = impact(times, length[place])
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(h)))
    within = np.arange(len(h)) - np.repeat(first, n)
    opens = within % BLOCK == 0
    gap = np.where(opens, place, place - np.append(0, place[:-1]))
    values = np.empty(2 * len(h), np.int64)
    values[::2], values[1::2] = gap, gain
    data, ends = pack(values)
    start = np.flatnonzero(opens)
    stop = np.append(start[1:], len(h))[: len(start)]
    top = np.maximum.reduceat(gain, start) if len(start) else start
    blocks_before = np.searchsorted(start, np.append(first, len(h)))
    byte_before = np.append(0, ends)[2 * np.append(first, len(h))]
    until = np.append(0, ends)[2 * stop] - np.repeat(byte_before[:-1], np.diff(blocks_before))
    heads = np.stack([place[stop - 1], top, until], 1).astype("<i4")
    return h[first], n, binaries(heads.tobytes(), 12 * blocks_before[1:]), binaries(data.tobytes(), byte_before[1:])


@dataclass(frozen=True)
class Index:
    """rows: of documents (seg, place, doc_id) and, where term isn't null, of postings (seg, term, n, blocks, data)."""

    rows: DataFrame
    documents: int
    terms: int

    @property
    def postings(self) -> DataFrame:
        return self.rows.where("term is not null").select("seg", "term", "n", "blocks", "data")

    @property
    def places(self) -> DataFrame:
        return self.rows.where("term is null").select("seg", "place", "doc_id")


def counted(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = all_ = 0
        for batch in batches:
            for text in batch.column(0):
                n = sum(len(runs(np.frombuffer(x, np.uint8), LETTERS)[0]) for x in pieces(text.as_py(), LETTERS))
                some, all_ = some + (n > 0), all_ + n
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([all_])], names=["some", "terms"])

    row = docs.select("text").mapInArrow(frugal(run), "some bigint, terms bigint").agg(F.sum("some"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of all terms of all documents, in the shared folder.

    Terms are the maximal runs of ASCII letters and digits and of all other scripts' characters in the whole text, A-Z as a-z; two terms are
    one if their 64-bit hashes are. Null and empty texts have none. Rows with null or repeated ids are documents
    of their own. A very long text is a segment of its own. Empty table: an empty index. Other columns are dropped.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    documents, terms = counted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        segment = TaskContext.get().partitionId() << 24

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, segment
            table = pa.concat_tables(held)
            table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            k = table.num_rows
            ids = table.column("doc_id").combine_chunks()
            term, n, blocks, data = postings_of(table.column("text").to_pylist(), documents, terms)
            held, size = [], 0
            nothing = pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, segment)), pa.array(np.arange(k)), ids, nothing[0], nothing[0], nothing[1], nothing[1]], names=names)
            for a in range(0, len(term), 1 << 16):
                b = min(len(term), a + (1 << 16))
                nothing = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, segment)), nothing, nothing, pa.array(term[a:b].view(np.int64)), pa.array(n[a:b]), blocks.slice(a, b - a), data.slice(a, b - a)], names=names)
            segment += 1

        names = ["seg", "place", "doc_id", "term", "n", "blocks", "data"]
        for batch in batches:
            for a, b in by_bytes(pc.binary_length(batch.column(1)).to_pylist(), SEGMENT_BYTES // 8):
                part = pa.table(batch.slice(a, b - a)).cast(pa.schema([("doc_id", pa.int64()), ("text", pa.binary())]))
                more = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if held and (size + more > SEGMENT_BYTES or sum(x.num_rows for x in held) + part.num_rows > SEGMENT_DOCS):
                    yield from close()
                held.append(part)
                size += more
        if held:
            yield from close()

    found = docs.mapInArrow(frugal(run), "seg bigint, place bigint, doc_id bigint, term bigint, n bigint, blocks binary, data binary")
    return Index(materialise(found, "index"), documents, terms)


class Postings:
    """A term's row in a segment: its blocks are opened when they are asked for."""

    def __init__(self, weight: int, blocks: bytes, data: bytes):
        head = np.frombuffer(blocks, "<i4").reshape(-1, 3).astype(np.int64)
        self.weight, self.last, self.top, self.end = weight, head[:, 0], head[:, 1] * weight, head[:, 2]
        self.data, self.open = data, {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            values = unpack(np.frombuffer(self.data, np.uint8, int(self.end[k]) - (start := int(self.end[k - 1]) if k else 0), start))
            self.open[k] = np.cumsum(values[::2]), values[1::2] * self.weight
        return self.open[k]


def best_of(terms: list[Postings], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores): the k best documents of a segment by descending score, then place; scores are above 0."""
    size = max(int(t.last[-1]) for t in terms) + 1
    start = np.unique(np.concatenate([[0], *(t.last + 1 for t in terms)]))[:-1]  # ranges within which no term changes its block
    stop = np.append(start[1:], size)
    bound, at = np.zeros(len(start), np.int64), []
    for t in terms:
        block = np.searchsorted(t.last, start)
        at.append(block)
        bound += np.append(t.top, 0)[block]
    order = np.argsort(-bound, kind="stable")
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    threshold, look, done = 1, FIRST_LOOK, 0
    reach = np.cumsum((stop - start)[order])
    while done < len(order) and bound[order[done]] >= threshold:
        until = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + look, side="right")))
        chosen = order[done:until]
        chosen = chosen[bound[chosen] >= threshold]
        wanted = np.zeros(size + 1, np.int64)
        np.add.at(wanted, start[chosen], 1)
        np.add.at(wanted, stop[chosen], -1)
        wanted = np.cumsum(wanted[:-1]) > 0
        total = np.zeros(size, np.int64)
        for t, block in zip(terms, at, strict=True):
            for b in np.unique(block[chosen]):
                if b < len(t.last):
                    where, gain = t.block(int(b))
                    total[where] += gain
        met = np.flatnonzero(wanted & (total >= threshold))
        places, scores = np.append(places, met), np.append(scores, total[met])
        keep = np.lexsort((places, -scores))[:k]
        places, scores = places[keep], scores[keep]
        threshold = int(scores[-1]) if len(scores) == k else 1
        done, look = until, 4 * look
    return places, scores


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each query the k best documents with a score above 0, all if there are fewer.

    A score sums weight * ((10^9 tf) div (1000 tf + 8 m)) over the query's distinct terms, where weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))) and m the document's relative length. Ties go by ascending id, null last; documents
    of equal id each have their rank. A query without terms, null or empty, has no rows. A query row that is fully
    repeated counts once; different texts under one id, a null one too, are ranked as one query each. Very long queries go whole.
    Empty tables: no rows. Other columns are dropped.
    """
    asked = queries.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).distinct().withColumn("qid", F.xxhash64("item_id", "text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, owner = hashed(batch.column(1).to_pylist(), LETTERS, LOWER)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(h.view(np.int64))], names=["qid", "term"])

    pairs = materialise(asked.select("qid", "text").mapInArrow(frugal(words), "qid bigint, term bigint").distinct(), "asked")
    n_queries, n_terms = pairs.agg(F.count_distinct("qid"), F.count(F.lit(1))).first()
    chunks = max(1, -(-n_queries // QUERIES), -(-n_terms // QUERY_TERMS))
    df = index.postings.select("term", "n").join(materialise(pairs.select("term").distinct(), "terms"), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weights = df.select("term", weight.alias("weight")).where("weight > 0")
    asks = pairs.join(weights, "term").groupBy(F.pmod(F.xxhash64("qid"), F.lit(chunks)).alias("chunk"), "term", "weight").agg(F.collect_list("qid").alias("qids"))  # of one chunk
    asks = materialise(asks, "weights")
    hits = index.postings.join(asks, "term").select("seg", "chunk", "weight", "qids", "blocks", "data")

    def best(table: pa.Table) -> pa.Table:
        terms = [Postings(*x) for x in zip(*(table.column(c).to_pylist() for c in ("weight", "blocks", "data")), strict=True)]
        of: dict[int, list[Postings]] = {}
        for t, qids in zip(terms, table.column("qids").to_pylist(), strict=True):
            for q in qids:
                of.setdefault(q, []).append(t)
        found = [(q, *best_of(mine, k)) for q, mine in of.items()]
        sizes = [len(p) for _, p, _ in found]
        qid, seg = np.repeat([q for q, _, _ in found], sizes), np.full(sum(sizes), table.column("seg")[0].as_py())
        return pa.table({"qid": qid, "seg": seg, "place": np.concatenate([p for _, p, _ in found]), "score": np.concatenate([x for _, _, x in found])})

    local = hits.groupBy("seg", "chunk").applyInArrow(best, "qid bigint, seg bigint, place bigint, score bigint")
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "seg", "place")
    found = local.join(index.places, ["seg", "place"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.join(asked.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item; the cases of build_index and search hold."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = materialise(search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "ranked")
    drop(index.rows)
    return found


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY 1
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM counts
), lengths AS (
  SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM counts, totals
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2
), weights AS (
  SELECT term, floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE)))::BIGINT AS w FROM tfs, totals GROUP BY 1
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id) GROUP BY 1, 2
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
