"""Stored tables that change: Parquet in buckets of a key, of which a change rewrites only those it touches.

A table is a folder with a subfolder a bucket; the bucket is a hash of the key. A change finds the buckets of its keys,
makes their new rows, writes these aside, and only then puts them in the place of the old ones, by dynamic
partition overwrite. Until then the old rows stand, and a lost executor costs a task. What was written aside
goes when it is in place; a driver that dies in between leaves it there, and `resume` puts it in place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.operators import lookup as lk
from basalt.sources.shared import exists, remove

BUCKET = "bucket"
#: Buckets of a table, and rows of a file, unless told otherwise.
BUCKETS, FILE_ROWS = 64, 1_000_000


@dataclass(frozen=True)
class KeyedTable:
    """A stored table with one row a key. `schema` is DDL and doesn't name the bucket."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    buckets: int

    @property
    def kinds(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema)

    def bucket(self) -> Column:
        """Keys are hashed as text, so equal keys of different types share a bucket."""
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def in_buckets(self, wanted: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return rows if wanted is None else rows.where(F.col(BUCKET).isin(wanted))

    def read(self) -> DataFrame:
        return self.in_buckets().drop(BUCKET)

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        return self.in_buckets(self.touched(keys)).drop(BUCKET).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys in rows, at most as many as the table has."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def change(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Give each bucket that a key of `rows` falls in the rows that merge makes of its old ones. Returns these buckets."""
        wanted = self.touched(rows)
        if wanted:
            names = [f.name for f in self.kinds]
            old = self.in_buckets(wanted).drop(BUCKET)
            fresh = merge(old).select(*[F.col(f.name).cast(f.dataType) for f in self.kinds]).withColumn(BUCKET, self.bucket())
            aside = f"{self.path}/_aside"
            remove(self.spark, aside)
            fresh.select(*names, BUCKET).write.parquet(f"{aside}/rows")
            self.spark.createDataFrame([(b,) for b in wanted], f"{BUCKET} int").coalesce(1).write.parquet(f"{aside}/{BUCKET}s")  # now it may be put in place
            self.resume()
        return wanted

    def resume(self) -> bool:
        """Put in place what a change had written aside when it stopped; a change that hadn't come so far is dropped."""
        aside = f"{self.path}/_aside"
        ready = exists(self.spark, f"{aside}/{BUCKET}s/_SUCCESS")
        if ready:
            fresh = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(f"{aside}/rows")
            full = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
            fresh = fresh.hint("rebalance", BUCKET)  # a task a bucket, more for a large one
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy(BUCKET).parquet(self.path)
            for r in self.spark.read.schema(f"{BUCKET} int").parquet(f"{aside}/{BUCKET}s").collect():
                if r[0] not in full:  # all its rows went
                    remove(self.spark, f"{self.path}/{BUCKET}={r[0]}")
        remove(self.spark, aside)
        return ready

    def upsert(self, rows: DataFrame, order: tuple[str, ...] = ()) -> list[int]:
        """Put rows in, in place of those of their keys; of a key repeated in `rows` the last by `order`, or any."""
        return self.change(rows, lambda old: lk.upsert(old, rows.select(*old.columns, *[c for c in order if c not in old.columns]), self.key, order))

    def delete(self, gone: DataFrame) -> list[int]:
        """Take the rows of some keys out; a key that isn't there is no error."""
        return self.change(gone, lambda old: lk.delete(old, gone, self.key))

    def patch(self, changes: DataFrame, columns: list[str], set_column: str = "set_fields") -> list[int]:
        """Assign the columns that each change names in set_fields, nulls too, of the rows that are there."""
        return self.change(changes, lambda old: lk.patch(old, changes, self.key, columns, set_column))


def open_table(spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
    """The table at a path, made empty if it isn't there; one that is there keeps its number of buckets."""
    if key not in (kinds := T.StructType.fromDDL(schema).names) or BUCKET in kinds:
        raise ValueError(f"a table needs its key {key!r} as a column, and none named {BUCKET!r}")
    path = path.rstrip("/")
    told = f"{path}/_{BUCKET}s"
    if not exists(spark, told):
        spark.createDataFrame([], f"{schema}, {BUCKET} int").write.mode("ignore").partitionBy(BUCKET).parquet(path)
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(told)
    table = KeyedTable(spark, path, schema, key, spark.read.schema("buckets int").parquet(told).first().buckets)
    if exists(spark, f"{path}/_aside"):
        table.resume()
    return table
