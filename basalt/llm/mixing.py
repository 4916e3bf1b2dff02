"""Mixing of sources to target weights by a time-varying curriculum, as DataFrame operations.

A source's share of the mix follows its weight over training time t in 0..1. Its schedule is linear,
target * (1 + ramp * (2 t - 1)) words per unit of time, and integrates to its target. The running sum
of a source's words in a fixed pseudo-random order is demand already met; inverting the integrated
schedule at that sum gives the position at which a document is due, and the mix is sorted by position. A source
that is read several times goes on with its demand: each pass gives a document a position of its own.

Running sums take two steps, so that no task sees a whole source: sums of 4096 hash buckets of each
source are added up first, then the rows within one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import WORD, known, materialise, number_equal_rows


def source_targets(sizes: DataFrame, weights=(1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """source, source_size -> with turn (index of its weight), weight and target.

    Sources in code point order, null last, weigh `weights` in turn. Targets are shares of the sum of
    all sizes by weight, at most cap * source_size; what a capped source leaves is shared again by
    weight. The level at which that ends is found directly: with sources sorted by cap / weight, it is
    the rest over the weights left, at the first source whose cap lies above it.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    return (
        sizes.withColumn("turn", (F.row_number().over(ordered) - 1) % len(weights))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("limit", F.col("most") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("limit") >= F.col("level"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("most"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "turn", "weight", "target")
    )


def due(demand, target, ramp):
    """The time at which a source whose schedule is target * (1 + ramp * (2 t - 1)) has asked for `demand` words."""
    u = demand / target
    curved = ((ramp - 1) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)) / (2 * ramp)
    return F.when(target > 0, F.when(ramp == 0, u).otherwise(curved))


def mix_sources(docs: DataFrame, weights=(1.0, 2.0, 3.0), ramps=(-0.5, 0.0, 0.5), cap: float = 3.0, keep=()) -> DataFrame:
    """One row per document, sorted by position: doc_id, source, size, source_size, target, taken, position, last_position, positions.

    size counts words. taken counts the words the mix takes, repeats included: whole passes over the
    source, then the documents first in order until the target is met; of the last one only the words
    still wanted. positions are when each pass over the document is due, position and last_position the first and
    last of them, null (and positions empty) for one that is never taken.
    Null text: size 0. Null source: a source of its own, last. Null ids and repeated rows count like
    others; rows equal in all columns read are told apart by a running number, ties of the order go by it. Long texts
    are counted whole. Empty table: no rows. keep names further columns to carry, none of them that of a result;
    whatever else they are called, they come back as they are.
    """
    keep = [c for c in keep if c not in ("doc_id", "source")]
    known(tuple(keep), "size", "source_size", "target", "taken", "position", "last_position", "positions")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    carried = [F.struct(*[F.col(c) for c in keep]).alias("carried")] if keep else []  # a struct, so that names can't clash with ours
    rows = number_equal_rows(docs.select("doc_id", "source", size.alias("size"), *carried))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string")).cast("binary"))
    rows = materialise(rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3)), "mix")

    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("bucket_start", F.sum("bucket_size").over(in_source) - F.col("bucket_size"))
    s, b = targets.alias("s"), buckets.alias("b")
    buckets = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.*", "b.bucket", "b.bucket_start")

    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum("size").over(in_bucket) - F.col("size")).alias("r")
    b = buckets.alias("b")
    ramp = F.element_at(F.array(*[F.lit(float(x)) for x in ramps]), (F.col("turn") % len(ramps) + 1).cast("int"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    rest = F.round(F.col("target") - passes * F.col("source_size")).cast("long")
    return (
        rows.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
        .select("r.doc_id", "r.source", "r.size", *(["r.carried"] if keep else []), "b.source_size", "b.target", "b.turn", (F.col("b.bucket_start") + F.col("r.within")).alias("start"))
        .withColumn("taken", passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start"))))
        .withColumn("ramp", ramp)
        .withColumn("passes", F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
        .withColumn("positions", F.transform(F.sequence(F.lit(1), F.col("passes")), lambda k: F.round(due((k - 1) * F.col("source_size") + F.col("start"), F.col("target"), F.col("ramp")), 9)))
        .withColumn("positions", F.when(F.col("passes") > 0, F.col("positions")).otherwise(F.array().cast("array<double>")))
        .withColumn("position", F.try_element_at("positions", F.lit(1))).withColumn("last_position", F.try_element_at("positions", F.lit(-1)))
        .select("doc_id", "source", "size", *[F.col("carried").getField(c).alias(c) for c in keep], "source_size", "target", "taken", "position", "last_position", "positions")
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mix_sources over all documents; its cases hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "position", "last_position")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM sized
), keyed AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS k FROM numbered
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sources
), limits AS (
  SELECT *, CAST(turn + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / CAST(turn + 1 AS DOUBLE) AS lim FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM limits WINDOW w AS (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, turn, least(most, weight * max(CASE WHEN lim >= level THEN level END) OVER ()) AS target FROM levels
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.turn,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS BIGINT) AS start,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, CAST(round(target - passes * source_size) AS BIGINT) - start)) AS BIGINT) AS taken FROM placed
)
SELECT doc_id, size, source_size, target, taken, POSITION(start) AS position, POSITION((ceil(taken / size) - 1) * source_size + start) AS last_position
FROM counted
"""
for at in ("start", "(ceil(taken / size) - 1) * source_size + start"):
    OP4_SQL = OP4_SQL.replace(f"POSITION({at})", f"""CASE WHEN taken > 0 AND target > 0 THEN round(CASE turn
    WHEN 0 THEN (-1.5 + sqrt(2.25 - 2.0 * (({at}) / target))) / -1.0
    WHEN 1 THEN ({at}) / target
    ELSE (-0.5 + sqrt(0.25 + 2.0 * (({at}) / target))) / 1.0 END, 9) + 0.0 END""")
