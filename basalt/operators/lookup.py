"""Lookups, latest rows, joins with rejects, and changes of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.sources.shared import new_path


def by_value(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the values given; a value of None sets no condition."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def first_or_none(df: DataFrame, *order) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(1)


def history(df: DataFrame, key: str, at: str = "created_at", tie: str = "id") -> DataFrame:
    """Rows with `nth`, 1 for the newest of each key; equal times go by the larger id."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())))


def latest(df: DataFrame, key: str, at: str = "created_at", tie: str = "id") -> DataFrame:
    return history(df, key, at, tie).where("nth = 1").drop("nth")


def with_latest(left: DataFrame, attempts: DataFrame, key: str, at: str = "created_at", tie: str = "id") -> DataFrame:
    """left with the newest attempt of each key, nulls where there is none."""
    return left.join(latest(attempts, key, at, tie), key, "left")


def accept(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, the others)."""
    ids = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def accept_new(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose natural key is neither stored nor taken by an earlier row, conflicts). A null in a key never conflicts."""
    full = None
    for k in keys:
        full = F.col(k).isNotNull() if full is None else full & F.col(k).isNotNull()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    stored = existing.select(*keys).distinct().withColumn("__stored", F.lit(True))
    marked = rows.where(full).withColumn("__nth", nth).join(stored, keys, "left")
    fresh = marked.where("__stored is null and __nth = 1").drop("__nth", "__stored").select(*rows.columns)
    conflicts = marked.where("__stored is not null or __nth > 1").drop("__nth", "__stored").select(*rows.columns)
    return fresh.union(rows.where(~full)), conflicts


REQUIREMENT_KEY = ["tender_id", "requirement_type", "requirement_name"]


def new_requirements(candidates: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Candidates that are neither stored nor repeated: same tender, type, name and, if the candidate names one, source."""
    same = [F.col(f"c.{k}") == F.col(f"e.{k}") for k in REQUIREMENT_KEY]
    match = same[0] & same[1] & same[2] & (F.col("c.source_document").isNull() | (F.col("c.source_document") == F.col("e.source_document")))
    fresh = candidates.alias("c").join(existing.select(*REQUIREMENT_KEY, "source_document").distinct().alias("e"), match, "left_anti")
    by_source = Window.partitionBy(*REQUIREMENT_KEY, "source_document").orderBy(*order)
    by_key = Window.partitionBy(*REQUIREMENT_KEY).orderBy(*order)
    # of a source, the first; without a source, only if nothing of that key came before
    return fresh.withColumn("__a", F.row_number().over(by_source)).withColumn("__b", F.row_number().over(by_key)).where((F.col("__a") == 1) & (F.col("source_document").isNotNull() | (F.col("__b") == 1))).drop("__a", "__b")


def upsert(old: DataFrame, new: DataFrame, key: str, order: tuple = ()) -> DataFrame:
    """new rows, and old rows whose key isn't among them; of a key repeated in `new` the last by `order` stays, or any."""
    if order:
        last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
        new = new.withColumn("__last", last).where("__last = 1").drop("__last")
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with a gapless number above `start` in the column `name`, in order of the columns told (the rest breaks ties).

    The rows are range-partitioned by that order and written to the shared folder first; a number is the place of a row
    within its file and the rows of the files before. Both are facts of stored data, so they stay whatever is selected
    later, and whichever task is run again. Nothing but a count a file meets in one task.
    """
    spark = rows.sparkSession
    rest = [f.name for f in rows.schema if f.name not in order and isinstance(f.dataType, T.AtomicType)]
    by = [F.asc_nulls_last(c) for c in [*order, *rest]]
    path = new_path(spark, "numbered")
    (rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows).write.parquet(path)
    told = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__nth"))
    files = told.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))  # a row a file; their names are in order of the partitions
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = told.join(files.select("__file", before.alias("__before")), "__file")
    return out.withColumn(name, F.col("__before") + F.col("__nth") + F.lit(start + 1)).select(*[c for c in rows.columns if c != name], name)


def ranked(rows: DataFrame, key: str, order: list[str], name: str = "nth") -> DataFrame:
    """rows with their place from 1 within their key, in order of the columns told (the rest breaks ties).

    All rows are numbered in order of key, as numbered() does, and a key's first number is taken off: so a key with most of the
    rows is spread over many tasks. Nulls of the order come last; a null key is one like others.
    """
    told = numbered(rows, [key, *order], "__number")
    first = told.groupBy(key).agg(F.min("__number").alias("__first")).withColumnRenamed(key, "__key")
    return told.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col("__number") - F.col("__first") + 1).drop("__number", "__first", "__key")


def append(stored: DataFrame, rows: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """stored and rows, which get the keys that follow the largest stored one, in `order` (by default that of the key they came with)."""
    top = stored.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    fresh = numbered(rows, [key] if order is None and key in rows.columns else order or [], key, top)
    return stored.unionByName(fresh.withColumn(key, F.col(key).cast(stored.schema[key].dataType)).select(*stored.columns))


def create(rows: DataFrame, stored: DataFrame, keys: list[str], order: list[str], parents: DataFrame | None = None, parent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored with the rows that may be put in, those that may not, with error): parents must exist, natural keys be new."""
    faults = []
    if parents is not None:
        rows, orphans = accept(rows, parents, parent)
        faults.append(orphans.withColumn("error", F.concat(F.lit(f"{parent} not found: "), F.col(parent).cast("string"))))
    fresh, conflicts = accept_new(rows, stored, keys, order) if keys else (rows, rows.limit(0))
    faults.append(conflicts.withColumn("error", F.lit("already exists: " + ", ".join(keys))))
    rejected = faults[0] if len(faults) == 1 else faults[0].unionByName(faults[1])
    return append(stored, fresh, order=order), rejected


def begin(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Extraction attempts as they start: PROCESSING, started_at now or `at`."""
    return rows.withColumns({"extraction_status": F.lit("PROCESSING"), "error_message": F.lit(None).cast("string"), "started_at": F.current_timestamp() if at is None else at})


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], set_column: str = "set_fields") -> DataFrame:
    """rows with the columns named in each change's set_fields assigned, nulls too; others stay."""
    c = changes.select(key, set_column, *[F.col(x).alias(f"__{x}") for x in columns])
    out = rows.join(c, key, "left")
    for x in columns:
        out = out.withColumn(x, F.when(F.array_contains(set_column, x), F.col(f"__{x}")).otherwise(F.col(x)))
    return out.select(*rows.columns)


def transition(rows: DataFrame, error: Column) -> DataFrame:
    """Extraction attempts as they end: COMPLETED, or FAILED with the error kept."""
    return rows.withColumn("error_message", error).withColumn("extraction_status", F.when(F.col("error_message").isNull(), "COMPLETED").otherwise("FAILED"))


def progress(rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """key, total, completed, processed (COMPLETED or PROCESSED), open."""
    done = F.col(status).isin("COMPLETED", "PROCESSED")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "COMPLETED").alias("completed"), F.count_if(done).alias("processed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("open"))


def cross_verify(rows: DataFrame, columns: list[str]) -> DataFrame:
    """match: MATCH if all values are there and equal, INCOMPLETE if one is missing and the rest agree, else MISMATCH."""
    values = F.array_compact(F.array(*[F.nullif(F.col(c), F.lit("")) for c in columns]))
    return rows.withColumn("match", F.when(F.size(F.array_distinct(values)) > 1, "MISMATCH").when(F.size(values) == len(columns), "MATCH").otherwise("INCOMPLETE"))


def update_latest(rows: DataFrame, values: DataFrame, key: str, column: str, at: str = "created_at", tie: str = "id") -> DataFrame:
    """rows with `column` of each key's newest row set from values (key, column); other rows stay."""
    fresh = values.select(key, F.col(column).alias("__value"), F.lit(True).alias("__has"))
    out = history(rows, key, at, tie).join(fresh, key, "left")
    return out.withColumn(column, F.when((F.col("nth") == 1) & F.col("__has"), F.col("__value")).otherwise(F.col(column))).select(*rows.columns)
