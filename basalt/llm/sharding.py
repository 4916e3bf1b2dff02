"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations.

Every shard owns `vnodes` points of a ring of 64-bit hashes. A row walks clockwise from its own hash
to the next point. Shards hold n // shards rows, the first n % shards one more; a row that finds its
shard full walks on to the next point. Rows that have walked less far are placed first, then in ring
order. So counts differ by one at most, and a change of the number of shards moves few rows.

Only counts per arc (shards * vnodes numbers, a bound that doesn't depend on the data) come to the
driver, which lays out the overflow; rows are placed by a join with that layout.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import materialise, number_equal_rows

SLOT_BITS = 12


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order. A shard's points don't depend on how many shards there are."""
    return sorted(
        (int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards)
        for v in range(vnodes)
    )


def lay_out(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first) for every run of rows of an arc that goes to one shard."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    size, filled, pieces = list(room), [0] * shards, []
    waiting = [(a, 0, n) for a, n in sorted(counts.items()) if n]
    walked = 0
    while waiting:
        left = []
        for arc, start, end in waiting:
            s = points[(arc + walked) % len(points)][1]
            if take := min(end - start, size[s] - filled[s]):
                pieces.append((arc, start, start + take, s, filled[s]))
                filled[s] += take
            if start + take < end:
                left.append((arc, start + take, end))
        waiting, walked = left, walked + 1
    return pieces


def ring_shards(docs: DataFrame, shards: int = 24, vnodes: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('rows'), shard, slot (gapless from 0 in a shard), grown_shard (null).

    Null text: size 8, crc32 of the empty text. Null ids: hashed as such. Repeated rows: each gets a
    place of its own on the ring, so a hot row is spread. Empty table: no rows. Other columns are dropped.
    """
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes must be positive")
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    at = [p for p, _ in points]
    width = 1 << (64 - SLOT_BITS)
    slots = []
    for k in range(1 << SLOT_BITS):
        low = -(1 << 63) + k * width
        first = bisect_left(at, low)
        slots.append((k - (1 << (SLOT_BITS - 1)), first, at[first : bisect_left(at, low + width)]))
    slots = spark.createDataFrame(slots, "slot_key int, first_arc int, bounds array<bigint>")

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = number_equal_rows(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    # the copy's number as two integers, of which the higher is null, and so not hashed, but for rows that are repeated 2^31 times
    low, high = F.expr("cast(copy % 2147483648 as int)"), F.expr("nullif(copy div 2147483648, 0)")
    rows = (
        rows.withColumn("position", F.xxhash64("doc_id", "size", "text_crc32", low, high))
        .withColumn("slot_key", F.shiftright("position", 64 - SLOT_BITS).cast("int"))
        .join(F.broadcast(slots), "slot_key")
        .withColumn("arc", (F.col("first_arc") + F.expr("size(filter(bounds, b -> b < position))")) % len(points))
        .select("doc_id", "size", "text_crc32", "copy", "position", "arc")
    )
    rows = materialise(rows, "ring")
    counts = {r[0]: r[1] for r in rows.groupBy("arc").count().collect()}  # at most shards * vnodes numbers
    pieces = spark.createDataFrame(lay_out(counts, points, shards), "arc int, first_rank long, end_rank long, shard int, first_slot long")
    in_arc = Window.partitionBy("arc").orderBy("position", "doc_id", "size", "text_crc32", "copy")
    return (
        rows.withColumn("rank", F.row_number().over(in_arc).cast("long") - 1)
        .join(F.broadcast(pieces), "arc")
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("first_slot") + F.col("rank") - F.col("first_rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_ring_shards(spark, sf_dir: str) -> DataFrame:
    """ring_shards over all documents; its cases hold."""
    return ring_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
