"""Joins by time: the last row before each, and rows whose intervals meet. No key is ranked whole, however many rows it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400


def micros(rows: DataFrame, at: str) -> Column:
    """Microseconds of a time; of one without a zone by its own fields, so that no zone's summer time disorders it."""
    x = F.col(at)
    if isinstance(rows.select(at).schema[0].dataType, T.TimestampNTZType):
        return (F.unix_date(x.cast("date")).cast("bigint") * DAY + F.hour(x) * 3600 + F.minute(x) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("bigint")
    return F.unix_micros(x.cast("timestamp"))


def bucket_of(rows: DataFrame, at: str, seconds: int, less: int = 0) -> Column:
    return F.floor((micros(rows, at) - less) / F.lit(seconds * 1_000_000)).cast("bigint")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, columns: list[str], right_at: str | None = None, tie: str | None = None, within: int | None = None, seconds: int = DAY) -> DataFrame:
    """left with the columns, and the time as `found_at`, of the last right row of its key at or before its own time.

    Both sides are cut into buckets of `seconds`. The last right row of each bucket is carried to the key's later buckets as
    a row at their beginning; then one window a bucket finds the last row before each. A key's window over buckets has a row a
    bucket, so `seconds` bounds what meets in a task. With `within`, rows older than so many seconds don't count.

    Ties: of right rows of one time the one with the largest `tie`, without one any. A null key matches a null key; a null
    time on either side matches nothing. Left rows come out once each, repeated ones too. Empty tables: as a left join.
    """
    right_at = right_at or at
    clash = {c for c in columns if c in left.columns} | {"found_at"} & set(left.columns)
    if clash:
        raise ValueError(f"columns to add are there already: {', '.join(sorted(clash))}")
    value = F.struct(F.col(right_at).alias("found_at"), (F.col(tie) if tie else F.lit(0)).alias("__tie"), *columns)
    told = right.where(F.col(right_at).isNotNull()).select(F.col(key).alias("__key"), F.col(right_at).alias("__at"), value.alias("__value"))
    told = told.withColumn("__bucket", bucket_of(told, "__at", seconds))
    rows = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.struct(*left.columns).alias("__row"))
    rows = rows.withColumn("__bucket", bucket_of(rows, "__at", seconds))
    timed = rows.where("__at is not null")

    last = told.groupBy("__key", "__bucket").agg(F.max_by("__value", F.struct("__value.found_at", "__value.__tie")).alias("__last"))
    asked = timed.select("__key", "__bucket").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType))
    buckets = last.unionByName(asked).groupBy("__key", "__bucket").agg(F.first("__last", True).alias("__last"))
    before = F.last("__last", True).over(Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = buckets.withColumn("__carried", before).where("__carried is not null").select("__key", "__bucket", F.col("__carried").alias("__value"))

    nothing = F.lit(None).cast(rows.schema["__row"].dataType)
    both = timed.select("__key", "__bucket", "__at", F.lit(2).alias("__side"), F.lit(None).cast(told.schema["__value"].dataType).alias("__value"), "__row")
    both = both.unionByName(told.select("__key", "__bucket", "__at", F.lit(1).alias("__side"), "__value", nothing.alias("__row")))
    both = both.unionByName(carried.select("__key", "__bucket", F.lit(None).cast(told.schema["__at"].dataType).alias("__at"), F.lit(0).alias("__side"), "__value", nothing.alias("__row")))
    upto = Window.partitionBy("__key", "__bucket").orderBy(F.asc_nulls_first("__at"), "__side", "__value.__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__found", F.last("__value", True).over(upto)).where("__side = 2").select("__row", "__found")
    out = found.unionByName(rows.where("__at is null").select("__row", F.lit(None).cast(told.schema["__value"].dataType).alias("__found")))
    if within is not None:
        old = micros(out, f"__row.{at}") - micros(out, "__found.found_at") > within * 1_000_000
        out = out.withColumn("__found", F.when(old, None).otherwise(F.col("__found")))
    return out.select("__row.*", "__found.found_at", *[f"__found.{c}" for c in columns])


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, end: str, columns: list[str], right_start: str | None = None, right_end: str | None = None, seconds: int = DAY) -> DataFrame:
    """left with the columns of each right row of its key whose interval [start, end) meets its own; left rows that meet none go.

    Intervals are put into the buckets of time that they touch, and meet within these; a pair counts in the first bucket that both
    touch, so it comes out once. `seconds` should be about as long as intervals are. Null keys and times, and intervals that end
    where or before they start, meet nothing.
    """
    right_start, right_end = right_start or start, right_end or end

    def dealt(rows: DataFrame, a: str, b: str, names: list[str], prefix: str) -> DataFrame:
        rows = rows.where(F.col(key).isNotNull() & (F.col(a) < F.col(b)))
        rows = rows.select(F.col(key).alias("__key"), F.col(a).alias(f"__{prefix}a"), F.col(b).alias(f"__{prefix}b"), F.struct(*names).alias(f"__{prefix}"))
        first, last = bucket_of(rows, f"__{prefix}a", seconds), bucket_of(rows, f"__{prefix}b", seconds, 1)
        return rows.withColumn(f"__{prefix}first", first).withColumn("__bucket", F.explode(F.sequence(first, last)))

    a, b = dealt(left, start, end, left.columns, "l"), dealt(right, right_start, right_end, columns, "r")
    met = a.join(b, ["__key", "__bucket"]).where((F.col("__la") < F.col("__rb")) & (F.col("__ra") < F.col("__lb")) & (F.col("__bucket") == F.greatest("__lfirst", "__rfirst")))
    return met.select("__l.*", *[f"__r.{c}" for c in columns])
