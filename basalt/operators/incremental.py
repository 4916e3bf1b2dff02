"""Latest rows and tallies that are kept in stored tables, into which batches are merged instead of ranking all history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.sources.tables import KeyedTable


@dataclass(frozen=True)
class LatestRows:
    """The newest row of each key, as lookup.latest gives it: of equal times that of the larger tie breaker, null times oldest.

    A batch reads itself and the buckets of its keys. A batch merged again changes nothing, and batches may come in any order.
    """

    table: KeyedTable
    at: str = "created_at"
    tie: str = "id"

    def newest(self, rows: DataFrame) -> DataFrame:
        """By a partial aggregate, so that a key with most of the rows is cut down before any shuffle."""
        row = F.struct(*[f.name for f in self.table.kinds])
        return rows.groupBy(self.table.key).agg(F.max_by(row, F.struct(self.at, self.tie)).alias("row")).select("row.*")

    def merge(self, batch: DataFrame) -> list[int]:
        fresh = self.newest(batch.select(*[f.name for f in self.table.kinds]))
        return self.table.change(fresh, lambda old: self.newest(old.unionByName(fresh)))


#: Statuses that are counted, and the names of their counts.
STATUSES = {"passed": "PASS", "failed": "FAIL", "review": "REVIEW", "pending": "PENDING"}
COUNTS = ("total_checks", *STATUSES)


def tallies_schema(key: str, kind: str = "bigint") -> str:
    return f"{key} {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, batch bigint"


@dataclass(frozen=True)
class Tallies:
    """Counts of statuses by key, as assess.tally gives them. Batches are numbered upwards; of one merged again each key takes part once."""

    table: KeyedTable

    def counted(self, rows: DataFrame, sign: int) -> DataFrame:
        status = F.upper("status")
        return rows.select(F.col(self.table.key), F.lit(sign).alias("total_checks"), *[F.when(status == s, sign).otherwise(0).alias(n) for n, s in STATUSES.items()])

    def merge(self, batch: int, rows: DataFrame, undone: DataFrame | None = None) -> list[int]:
        """Add the statuses of rows (key, status), and take off those of rows that they replace."""
        key = self.table.key
        all_ = self.counted(rows, 1)
        if undone is not None:
            all_ = all_.unionByName(self.counted(undone, -1))
        fresh = all_.groupBy(key).agg(*[F.sum(c).alias(c) for c in COUNTS])

        def add(old: DataFrame) -> DataFrame:
            o, n = old.alias("o"), fresh.alias("n")
            told = F.col("n.total_checks").isNotNull() & ~F.coalesce(F.col("o.batch") >= batch, F.lit(False))
            sums = [(F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.when(told, F.col(f"n.{c}")).otherwise(0)).alias(c) for c in COUNTS]
            return o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *sums, F.when(told, batch).otherwise(F.col("o.batch")).alias("batch"))

        return self.table.change(fresh, add)

    def read(self) -> DataFrame:
        return self.table.read().where("total_checks > 0").select(self.table.key, *COUNTS)
