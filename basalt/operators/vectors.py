"""Vector store operators: exact nearest chunks, upsert, delete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.operators import nearest as nn
from basalt.operators.lookup import delete, upsert


def squared_distance(a: str, b: str) -> Column:
    """Squared Euclidean distance, summed in double precision."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def top_k(chunks: DataFrame, query: list[float], k: int = 5, source_document: str | None = None) -> DataFrame:
    """The k chunks nearest to one query vector; ties go by chunk_id. A source is filtered before."""
    if k <= 0:
        raise ValueError("top_k must be greater than zero")
    rows = chunks if source_document is None else chunks.where(F.col("source_document") == source_document)
    rows = rows.withColumn("__q", F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("distance", squared_distance("embedding", "__q")).drop("__q").orderBy("distance", "chunk_id").limit(k)


#: Query vectors that are broadcast, at most.
BLOCK = 1000


def top_k_many(chunks: DataFrame, queries: DataFrame, k: int = 5, columns: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, distance, rank for each query (query_id, query_vector). Null vectors and vectors of another length are near nothing.

    Up to BLOCK queries are broadcast: a batch of chunks meets them by one matrix product, those that can be among a task's k
    nearest are measured exactly, and only they are shuffled. More queries meet the chunks in a grid of tasks, by
    nearest.nearest, which reads the chunks a fixed number of times, and tells vectors by the length that chunks have.
    """
    if queries.count() > BLOCK:
        return nn.nearest(nn.build(chunks, columns), queries, k)[0]
    nearest = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    kinds = {f.name: f.dataType for f in chunks.schema}
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *[T.StructField(c, kinds[c]) for c in ("chunk_id", *columns)], T.StructField("distance", T.DoubleType())])
    asked = queries.where("query_vector is not null").select("query_id", "query_vector").toArrow()  # BLOCK rows at most
    near = chunks.where("embedding is not null").select("chunk_id", *columns, "embedding").mapInArrow(nearest_of(chunks.sparkSession.sparkContext.broadcast(asked), k), schema)
    return near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "chunk_id", *columns, "distance", "rank")


def nearest_of(shared, k: int):
    """A function of batches (chunk_id, ..., embedding) to those of each batch that are among its k nearest of some query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.column("query_id").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        asked: dict[int, list[int]] = {}
        vectors = shared.value.column("query_vector").to_pylist()
        for i, v in enumerate(vectors):
            asked.setdefault(len(v), []).append(i)
        for batch in batches:
            rows: dict[int, list[int]] = {}
            told = batch.column(batch.num_columns - 1).to_pylist()
            for i, v in enumerate(told):
                rows.setdefault(len(v), []).append(i)
            for size in asked.keys() & rows.keys():
                q, c = (np.array([of[i] for i in at], np.float64) for of, at in ((vectors, asked[size]), (told, rows[size])))
                square = (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None, :]
                kth = np.partition(square, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
                a, b = np.nonzero(square <= kth[:, None] + 1e-9 * (1 + np.abs(square).max(1))[:, None])
                d = ((q[a] - c[b]) ** 2).sum(1)
                take = pa.array(np.array(rows[size])[b])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(asked[size])[a])), *[x.take(take) for x in batch.columns[:-1]], pa.array(d)], names=["query_id", *batch.schema.names[:-1], "distance"])

    return run


def upsert_chunks(store: DataFrame, chunks: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """The store with chunks replaced or added by chunk_id; chunks of a document that has shrunk stay.

    Of a chunk_id repeated in the batch, the last by `order` counts, or any.
    """
    return upsert(store, chunks, "chunk_id", order)


def pair_chunks(chunks: DataFrame, embeddings: DataFrame, key: str = "source_document", nth: str = "chunk_index") -> tuple[DataFrame, DataFrame]:
    """(chunks with their embedding by key and place, keys whose numbers of chunks and embeddings differ, with error)."""
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((chunks, "n_chunks"), (embeddings, "n_embeddings")))
    counts = a.join(b, key, "full").select(key, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_embeddings", F.lit(0)).alias("n_embeddings"))
    apart = counts.where("n_chunks <> n_embeddings").withColumn("error", F.lit("Number of chunks must match number of embeddings."))
    return chunks.join(apart.select(key), key, "left_anti").join(embeddings.select(key, nth, "embedding"), [key, nth]), apart


def zip_hits(rows: DataFrame, keep: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """A row for each place of parallel lists, in order: keep, position, and the members named like their lists."""
    return rows.select(*keep, F.posexplode(F.arrays_zip(*lists)).alias("position", "hit")).select(*keep, "position", *[F.col(f"hit.{c}").alias(c) for c in lists])


def delete_chunks(store: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(store, gone, "chunk_id")
