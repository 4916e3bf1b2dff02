"""Exact nearest chunks for any number of queries, opening only what can hold them.

Chunks are put with the nearest of some pivots, and each pivot keeps the least and the greatest distance of its chunks. By
the triangle inequality no chunk of a pivot is nearer to a query than the query's distance to that ring. Queries look
first where their own pivots are; the k-th distance found there says which other pivots can still hold something.
Chunks of a pivot and the queries that open it meet block by block, so that neither a crowded pivot nor many queries gather in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.sources.shared import stored

#: Pivots, taken from so many chunks of least hash: the bound of what is broadcast and collected.
PIVOTS = 256
#: Chunks and queries of a block.
ROWS, ASKED = 4096, 1024
#: What rounding may cost a bound, relative to the numbers compared.
SLACK = 1e-9


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, by one product; where that cancels, to about 1e-8 of the vectors' length."""
    square = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None] - b[None]) ** 2).sum(2))
    return out


def k_least(group: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k least of their group, ties with the k-th included."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(g)))
    kth = np.repeat(v[first + np.minimum(size, k) - 1], size) if len(g) else v
    return np.sort(order[v <= kth])


@dataclass(frozen=True)
class PivotIndex:
    """chunks: chunk_id, carried columns, embedding, pivot, block. rings: pivot, low, high, n, blocks, a row a pivot."""

    chunks: DataFrame
    rings: DataFrame
    pivots: np.ndarray
    dim: int
    columns: tuple[str, ...]


def usable(dim: int, column: str):
    """Vectors of that length without null, NaN or infinite members."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (F.size(column) == dim) & ~bad


def build(chunks: DataFrame, columns: tuple[str, ...] = (), pivots: int = PIVOTS) -> PivotIndex:
    """An index of all chunks (chunk_id, embedding). Null vectors, those with members that are no numbers and those of another length than the first by hash are near nothing.

    Pivots are chosen from 16 times as many vectors of least hash: each the farthest from those chosen before.
    """
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", *columns, F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0")
    by_hash = rows.select("embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    first = by_hash.limit(1).collect()
    dim = len(first[0][0]) if first else 1
    rows = rows.where(usable(dim, "embedding"))
    some = rows.select("embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(16 * pivots).toArrow()
    seen = matrix(some.column(0), dim)
    chosen = [0] if len(seen) else []
    if chosen:
        near = distances(seen, seen[:1])[:, 0]
        while len(chosen) < pivots and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(seen, seen[chosen[-1:]])[:, 0])
    held = seen[chosen] if chosen else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(held)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(batch.num_columns - 1), dim)
                pivot = distances(v, shared.value).argmin(1)
                radius = np.sqrt(((v - shared.value[pivot]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(radius)], names=[*batch.schema.names, "pivot", "radius"])

    schema = T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    placed = stored(rows.mapInArrow(place, schema), "placed")
    rings = placed.groupBy("pivot").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / ROWS).cast("int"))
    return PivotIndex(placed, stored(rings.coalesce(1), "rings"), held, dim, columns)


def searched(index: PivotIndex, opened: DataFrame, k: int, kind: T.DataType) -> DataFrame:
    """query_id, chunk_id, columns, distance: of each pivot opened (query_id, query_vector, pivot, blocks, limit) the k nearest chunks within the limit."""
    size = opened.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("rows"))
    asks = opened.join(size, "pivot").withColumn("i", F.pmod(F.xxhash64("query_id"), F.col("rows")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
    told = index.chunks.join(F.broadcast(index.rings.select("pivot", "blocks")), "pivot").join(F.broadcast(size), "pivot")  # a row a pivot each
    told = told.withColumn("j", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, rows - 1)")))
    dim, columns = index.dim, index.columns
    schema = T.StructType([T.StructField("query_id", kind), *[index.chunks.schema[c] for c in ("chunk_id", *columns)], T.StructField("distance", T.DoubleType())])

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, c = matrix(asked.column("query_vector"), dim), matrix(rows.column("embedding"), dim)
        limit = asked.column("limit").to_numpy()
        if not len(q) or not len(c):
            a = b = np.zeros(0, np.int64)
        else:
            d = distances(q, c)
            slack = 1e-7 * (1 + np.sqrt((q * q).sum(1)) + np.sqrt((c * c).sum(1)).max())
            kth = np.partition(d, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
            a, b = np.nonzero(d <= np.minimum(kth, limit)[:, None] + slack[:, None])
        exact = ((q[a] - c[b]) ** 2).sum(1) if len(a) else np.zeros(0)
        keep = k_least(a, exact, k)
        a, b, exact = a[keep], b[keep], exact[keep]
        which, there = pa.array(a), pa.array(b)
        return pa.table([asked.column("query_id").take(which), *[rows.column(x).take(there) for x in ("chunk_id", *columns)], pa.array(exact)], names=["query_id", "chunk_id", *columns, "distance"])

    return asks.select("pivot", "i", "j", "query_id", "query_vector", "limit").groupBy("pivot", "i", "j").cogroup(told.select("pivot", "i", "j", "chunk_id", *columns, "embedding").groupBy("pivot", "i", "j")).applyInArrow(meet, schema)


def rings_of(index: PivotIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, query_vector, pivot, blocks, bound, enough: each pivot's least possible distance to each query, and a distance within which k chunks lie for sure."""
    rings = index.rings.orderBy("pivot").toArrow()  # a row a pivot
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, *(rings.column(c).to_numpy() for c in ("pivot", "low", "high", "n", "blocks"))))
    dim, kind = index.dim, queries.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, which, low, high, n, blocks = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                d = exact_distances(matrix(part.column(1), dim), pivots[which])
                slack = SLACK * (d + high)
                bound = np.maximum(0, np.maximum(d - high, low - d) - slack)
                far = d + high + slack
                order = np.argsort(far, axis=1)
                have = np.cumsum(n[order], axis=1)
                place = np.minimum((have < k).sum(1), len(which) - 1)
                enough = np.where(have[:, -1] >= k, far[np.arange(len(d)), order[np.arange(len(d)), place]], np.inf)
                x, y = np.nonzero(bound <= enough[:, None])
                take = pa.array(x)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(which[y]), pa.array(blocks[y]), pa.array(bound[x, y]), pa.array(enough[x])], names=["query_id", "query_vector", "pivot", "blocks", "bound", "limit"])

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("query_vector", T.ArrayType(T.DoubleType())), T.StructField("pivot", T.IntegerType()), T.StructField("blocks", T.IntegerType()), T.StructField("bound", T.DoubleType()), T.StructField("limit", T.DoubleType())])
    return queries.mapInArrow(run, schema)


def nearest(index: PivotIndex, queries: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, columns, distance (squared), rank; query_id, opened, n_pivots): the k nearest chunks of each query (query_id, query_vector), and how many pivots it opened.

    Ties go by chunk_id. Query vectors that are null, of another length or hold what is no number find nothing, as any
    do in an empty index. A query_id that is repeated is ranked as one query. Other columns are dropped.
    """
    if k <= 0:
        raise ValueError("top_k must be greater than zero")
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).where(usable(index.dim, "query_vector"))
    kind = queries.schema["query_id"].dataType
    rings = stored(rings_of(index, asked, k), "rings")
    order = Window.partitionBy("query_id").orderBy("bound", "pivot")
    # first the likeliest pivot alone
    first = rings.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    found = stored(searched(index, first, k, kind), "found")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    kth = found.withColumn("nth", best).where(F.col("nth") == k).select("query_id", (F.sqrt("distance") * (1 + SLACK)).alias("kth"))
    # then those whose rings come nearer than the k-th found there
    rest = rings.join(first.select("query_id", "pivot"), ["query_id", "pivot"], "left_anti").join(kth, "query_id", "left")
    rest = rest.withColumn("limit", F.least("limit", "kth")).where(F.col("bound") <= F.col("limit")).drop("kth")
    both = found.unionByName(searched(index, rest, k, kind))
    out = both.withColumn("rank", best).where(F.col("rank") <= k)
    opened = first.select("query_id").unionAll(rest.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("opened"))
    return out.select("query_id", "chunk_id", *index.columns, "distance", "rank"), opened.withColumn("n_pivots", F.lit(len(index.pivots)))
