"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits its vectors again and again by random directions at the median; vectors near a split
go to both sides, so that near pairs part rarely. Branches too large for a task are split `LEVELS` levels at
a time: the splits are laid out on a bounded sample of the branch, in the cluster, and all its vectors follow
them, until no branch is too large; the levels below are split within a branch. A branch that no direction
parts is compared block by block. Vectors of a leaf are compared with each other by exact cosine, and a
leaf passes on which of them its links connect. Linked vectors of all trees are united. Last, the links of each
vector are counted exactly within its component, block by block, so that a dense family is never written
out pair by pair. Only ids go through the rounds; vectors join them where they are needed.

Labels keep vectors apart: each label has trees of its own. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import drop, materialise
from basalt.llm.components import components

TREES, LEAF, SPILL, BRANCH, LEVELS, SAMPLE, BLOCK = 12, 256, 0.08, 4096, 6, 4096, 512
#: Vectors routed by a task at a time, and parts that the rows of a hot component are dealt to for a join.
ROUTED, SALTS = 4096, 64


def unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1. The lists' values are taken as one array: as Python objects they cost more than all comparisons."""
    x = pa.concat_arrays([c.flatten() for c in vectors.chunks]).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True, initial=0)  # squares of very large or small ones have no place in a double
    return x / np.sqrt((x * x).sum(1))[:, None]


def direction(seed: tuple[int, ...], dim: int) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=dim)
    return x / np.linalg.norm(x)


def code(label: str) -> int:
    return int.from_bytes(label.encode()[-7:], "big") if label else 0


def sides(x: np.ndarray, at: float, spread: float) -> tuple[np.ndarray, np.ndarray]:
    return x <= at + spread, x >= at - spread


def halve(x: np.ndarray, spill: float) -> tuple[float, float]:
    """Where projections are split, and how far on either side rows go both ways."""
    low, mid, high = np.quantile(x, [0.5 - spill, 0.5, 0.5 + spill])
    return float(mid), float(min(high - mid, mid - low))


def lay_out(vectors: np.ndarray, label: str, tree: int, root: int, depth: int) -> dict[int, tuple[float, float]]:
    """Splits of `depth` levels below root, heap-numbered, fitted on a sample; none where nothing is parted."""
    plan, todo = {}, [(root, vectors, 0)]
    while todo:
        node, own, level = todo.pop()
        if level == depth or len(own) < 8:
            continue
        x = own @ direction((tree, node, code(label)), own.shape[1])
        a, b = sides(x, *halve(x, SPILL))
        if max(a.sum(), b.sum()) > 0.9 * len(own):
            continue
        plan[node] = halve(x, SPILL)
        todo += [(2 * node, own[a], level + 1), (2 * node + 1, own[b], level + 1)]
    return plan


def leaves(vectors: np.ndarray, seed: tuple[int, ...], size: int) -> Iterator[np.ndarray]:
    """Row numbers of each leaf of the lower levels; a split that parts nothing is made by rank."""
    todo = [(1, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= size:
            yield rows
            continue
        x = vectors[rows] @ direction((*seed, node), vectors.shape[1])
        a, b = sides(x, *halve(x, SPILL))
        if max(a.sum(), b.sum()) > 0.9 * len(rows):
            order = np.argsort(x, kind="stable")
            half, over = len(rows) // 2, int(SPILL * len(rows))
            a, b = order[: half + over], order[half - over :]
        todo += [(2 * node, rows[a]), (2 * node + 1, rows[b])]


def spanning(vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, row): each row of a leaf that pairs of cosine >= least connect to an earlier one, and the first that they lead to.

    Every row goes to its earliest neighbour, and on to that one's. What came together is then one row
    with the neighbours of all, until no two are near.
    """
    near = vectors @ vectors.T >= least
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(1))
    near = near[np.ix_(rows, rows)]
    own = at = np.arange(len(rows))  # the group of each row, the first row of each group
    while near.any():
        np.fill_diagonal(near, True)
        to = near.argmax(1)
        while (to[to] != to).any():
            to = to[to]
        kept, place = np.unique(to, return_inverse=True)
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(kept)))
        near = np.logical_or.reduceat(np.logical_or.reduceat(near[order], starts, 0)[:, order], starts, 1)
        np.fill_diagonal(near, False)
        own, at = place[own], at[kept]
    first = rows[at[own]]
    return first[first != rows], rows[first != rows]


def valid(vectors: DataFrame, vec_col: str):
    """Not null, of finite components that aren't all zero."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def forest_links(nodes: DataFrame, cosine: float, trees: int, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs (a, b) of nodes (label, node, vector) that links within a leaf of some tree connect, tables to drop once they are written).

    A branch is (tree << 56) | place in its tree, 0 for all vectors of a label, in all trees at once; a
    negative one can't be parted further.
    """
    vectors = nodes.select("node", "vector")
    kind = ["label", "dim", "branch"]
    rows = nodes.select("label", F.size("vector").alias("dim"), F.lit(0).cast("bigint").alias("branch"), "node")
    spot = F.shiftrightunsigned(F.xxhash64("node"), 1) / F.lit(float(1 << 63))
    ready, scrap = [], []
    while True:
        sizes = materialise(rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("n")), "sizes")
        scrap.append(sizes)
        large = sizes.where((F.col("n") > BRANCH) & (F.col("branch") >= 0)).withColumn("depth", F.least(F.lit(LEVELS), F.ceil(F.log(F.col("n") / BRANCH) / -math.log(0.5 + SPILL)).cast("int")))  # a side of a split holds more than half
        ready.append(rows.join(sizes.join(large, kind, "left_anti"), kind).select(*kind, "node", "n"))
        if large.isEmpty():
            break
        sample = rows.join(large, kind).where(spot < SAMPLE / F.col("n")).join(vectors, "node").select(*kind, "depth", "vector")

        def fit(table: pa.Table) -> pa.Table:
            label, branch, depth = (table.column(c)[0].as_py() for c in ("label", "branch", "depth"))
            own = unit(table.column("vector"))
            roots = [(t, 1) for t in range(trees)] if branch == 0 else [(branch >> 56, branch & ((1 << 56) - 1))]
            plan = {(t, root): lay_out(own, label, t, root, depth) for t, root in roots}
            return pa.table({"label": [label], "dim": pa.array([own.shape[1]], pa.int32()), "branch": [branch], "plan": pa.array([pickle.dumps(plan)], pa.binary())})

        def route(table: pa.Table, plan: pa.Table) -> pa.Table:
            """A row for each branch that a vector reaches."""
            if not len(table) or not len(plan):
                return table.select(["label", "dim", "branch", "node"]).slice(0, 0)
            label, splits = table.column("label")[0].as_py(), pickle.loads(plan.column("plan")[0].as_py())
            x, out_row, out_branch = unit(table.column("vector")), [], []
            for (tree, root), split in splits.items():
                todo = [(root, np.arange(len(x)))]
                while todo:
                    node, own = todo.pop()
                    if node in split:
                        a, b = sides(x[own] @ direction((tree, node, code(label)), x.shape[1]), *split[node])
                        todo += [(2 * node, own[a]), (2 * node + 1, own[b])]
                    else:
                        place = (tree << 56) | node
                        out_row.append(own)
                        out_branch.append(np.full(len(own), -place - 1 if node == root else place))
            out = table.select(["label", "dim", "node"]).take(pa.array(np.concatenate(out_row)))
            return pa.table([out.column("label"), out.column("dim"), pa.array(np.concatenate(out_branch).astype(np.int64)), out.column("node")], names=["label", "dim", "branch", "node"])

        plans = sample.groupBy(*kind).applyInArrow(fit, "label string, dim int, branch bigint, plan binary").join(large, kind)
        salts = F.ceil(F.col("n") / ROUTED).cast("int")
        told = plans.select(*kind, "plan", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        moving = rows.join(large, kind).select(*kind, "node", F.pmod(F.xxhash64("node", "branch"), salts).cast("int").alias("salt")).join(vectors, "node")
        by = [*kind, "salt"]
        rows = materialise(moving.groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(route, "label string, dim int, branch bigint, node bigint"), "routed")
        scrap.append(rows)

    def compare(table: pa.Table) -> pa.Table:
        """Pairs that links connect within a leaf of a branch; of one that can't be parted, within its blocks i and j."""
        ids = table.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = unit(table.column("vector"))[order]
        ids, branch, name = ids[order], table.column("branch")[0].as_py(), code(table.column("label")[0].as_py())
        if branch < 0:
            parts = [np.arange(len(x))]
        elif branch == 0:
            parts = (rows for tree in range(trees if len(x) > leaf else 1) for rows in leaves(x, (tree, 1, name), leaf))
        else:
            parts = leaves(x, (branch >> 56, branch & ((1 << 56) - 1), name), leaf)
        found = [rows[np.stack(spanning(x[rows], cosine))] for rows in parts]
        a, b = ids[np.unique(np.concatenate(found, axis=1), axis=1)]
        return pa.table({"a": a, "b": b})

    branches = ready[0]
    for other in ready[1:]:
        branches = branches.union(other)
    blocks = F.when(F.col("branch") < 0, F.ceil(F.col("n") / (BRANCH // 2))).otherwise(1).cast("int")
    mine = branches.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = mine.select(*kind, "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(vectors, "node")
    return placed.groupBy(*kind, "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct(), scrap


def link_counts(nodes: DataFrame, labels: DataFrame, cosine: float) -> DataFrame:
    """node, n_near: the weight of other nodes in its component with cosine >= the bound, counted by blocks."""
    sizes = labels.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, SALTS - 1).otherwise(0))))
    sized = labels.withColumnRenamed("id", "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    several = sizes.where("blocks > 1")
    sized = sized.join(several, ["component", "salt"], "left").select("component", "node", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = nodes.join(sized, "node").select("component", "node", "weight", "vector", "blocks").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ask = placed.select("component", "node", "weight", "vector", F.col("block").alias("left"), every).withColumnRenamed("other", "right").withColumn("asks", F.lit(True))
    told = placed.select("component", "node", "weight", "vector", every, "block").select("component", "node", "weight", "vector", F.col("other").alias("left"), F.col("block").alias("right")).withColumn("asks", F.lit(False))

    def count(table: pa.Table) -> pa.Table:
        asks, ids, weight = (table.column(c).to_numpy() for c in ("asks", "node", "weight"))
        x = unit(table.column("vector"))
        near = x[asks] @ x[~asks].T >= cosine
        near &= ids[asks][:, None] != ids[~asks][None, :]
        return pa.table({"node": pa.array(ids[asks]), "n_near": pa.array((near * weight[~asks][None, :]).sum(1).astype(np.int64))})

    return ask.unionByName(told).groupBy("component", "left", "right").applyInArrow(count, "node bigint, n_near bigint").groupBy("node").agg(F.sum("n_near").alias("n_near"))


def dedup_vectors(vectors: DataFrame, cosine: float = 0.93, trees: int = TREES, leaf: int = LEAF, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id linked to), kept.

    Only vectors of equal, non-null labels and equal length link. Vectors that are null, empty, zero, or hold
    a null or non-finite component link with nothing, and are their own component. A null id counts as larger
    than any, and is kept if nothing else is in its component. Repeated rows link with each other like other
    equal vectors. Rows meet their vector by 128 bits of hashes. Empty table: no rows. Other columns are dropped.
    """
    nobody = F.lit((1 << 63) - 1)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), nobody).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vector"))
    usable = valid(rows, "vector") & F.col("label").isNotNull()
    some = rows.where(usable)
    hashes = {"hash_a": F.xxhash64("label", "vector"), "hash_b": F.xxhash64(F.lit("b"), "vector", "label")}
    nodes = materialise(some.groupBy("label", "vector").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("weight")).withColumns({"node": F.monotonically_increasing_id(), **hashes}), "vectors")
    found, scrap = forest_links(nodes, cosine, trees, leaf)
    links = materialise(found, "near")
    labels = materialise(components(links), "labels")
    drop(links, *scrap)
    counts = link_counts(nodes, labels, cosine)
    named = nodes.select("node", "smallest", "weight", *hashes).join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = named.join(smallest, "component").join(counts, "node", "left").select(*hashes, (F.col("weight") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_links"), "component_id")
    named = materialise(named, "named")
    drop(nodes, labels)
    linked = some.select("vec_id", *[h.alias(k) for k, h in hashes.items()]).join(named, list(hashes)).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(F.nullif("vec_id", nobody).alias("vec_id"), "n_links", F.nullif("component_id", nobody).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_vectors over all embeddings; its cases hold."""
    return dedup_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
