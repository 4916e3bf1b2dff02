"""Helpers shared by the operators: shared scratch tables and row numbering."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows that are dealt from one array.
DEALT = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="basalt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/basalt-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the files behind materialised frames that nothing reads any more, and shuffles that nothing holds."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for file in df.inputFiles():
            if "/basalt-" in file:
                folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
                with contextlib.suppress(Exception):  # cleaning is optional
                    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
                break
    for df in frames[:1]:  # shuffle files go only when the driver collects its garbage, which on a large heap may take hours while disks fill
        df.sparkSession.sparkContext._jvm.System.gc()


def number_equal_rows(df: DataFrame, name: str = "copy") -> DataFrame:
    """Add a number from 0 that tells fully equal rows apart.

    Equal rows are counted (a partial aggregate), then dealt out again, so one row that is repeated
    a third of the time doesn't gather in one task as a window would make it. They are dealt in two steps,
    tens of thousands and then ones, so that no array is as long as a row is often. The number is a long.
    """
    n, tens = f"__n_{name}", f"__tens_{name}"
    zero, last = F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long")
    return (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n))
        .withColumn(tens, F.explode(F.sequence(zero, F.expr(f"(`{n}` - 1) div {DEALT}"))))
        .withColumn(name, F.explode(F.sequence(zero, F.least(last, F.col(n) - 1 - F.col(tens) * DEALT))))
        .withColumn(name, F.col(name) + F.col(tens) * DEALT)
        .drop(n, tens)
    )


def known(keep: tuple[str, ...], *made: str) -> None:
    """Columns to carry may not bear the name of one that is made."""
    if clash := sorted({x.lower() for x in keep} & {x.lower() for x in made}):
        raise ValueError(f"columns to keep are named like results: {', '.join(clash)}")


def hash_fold(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def give_back() -> None:
    """Hand memory that this process has freed back to the system.

    Python workers live on between stages, several beside each executor, and the C library keeps what they freed:
    on executors of small memory that sum, not what a task needs, is what runs out.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """A function of batches that gives its worker's free memory back at the end: workers idle on between stages."""

    def and_give_back(batches):
        yield from run(batches)
        give_back()

    return and_give_back
