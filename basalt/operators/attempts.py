"""Attempts at documents as committed states: begun, ended, and taken up again where a driver was lost in between."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators import lookup as lk
from basalt.sources.shared import stored
from basalt.sources.tables import KeyedTable

SCHEMA = "id bigint, extraction_status string, error_message string, started_at timestamp, completed_at timestamp, tries int"
#: Times that an attempt is begun in all before it counts as failed.
TRIES = 2
# Fixed value: the text as it is reported.
GAVE_UP = "The attempt was begun {} times and never ended."


@dataclass(frozen=True)
class Attempts:
    """Attempts by id in a stored table. Each step is a write of its own, so the next process finds where the last one stopped."""

    table: KeyedTable

    def begin(self, ids: DataFrame, at: Column | None = None) -> None:
        """Commit attempts (id) as PROCESSING. One that is there already stays as it is."""
        rows = lk.begin(ids.select("id").distinct(), at).withColumns({"completed_at": F.lit(None).cast("timestamp"), "tries": F.lit(1)})
        self.table.change(rows, lambda old: old.unionByName(rows.join(old.select("id"), "id", "left_anti").select(*old.columns)))

    def end(self, results: DataFrame, at: Column | None = None) -> None:
        """Commit the ends of attempts that are PROCESSING: COMPLETED, or FAILED with error_message (id, error_message); one result an id."""
        told = results.select("id", F.col("error_message").alias("__error"), F.lit(True).alias("__told")).dropDuplicates(["id"])
        now = F.current_timestamp() if at is None else at

        def ended(old: DataFrame) -> DataFrame:
            rows = old.join(told, "id", "left").withColumn("__ends", F.col("__told") & (F.col("extraction_status") == "PROCESSING"))
            done = lk.transition(rows.where("__ends"), F.col("__error")).withColumn("completed_at", now)
            return done.select(*old.columns).unionByName(rows.where("not coalesce(__ends, false)").select(*old.columns))

        self.table.change(told, ended)

    def left_open(self, before: Column | None = None) -> DataFrame:
        """Attempts that were begun and never ended; with `before`, only those begun earlier."""
        rows = self.table.read().where("extraction_status = 'PROCESSING'")
        return rows if before is None else rows.where(F.col("started_at") < before)

    def take_up(self, before: Column | None = None, at: Column | None = None) -> DataFrame:
        """Commit that attempts left open are begun once more, and return their ids; those begun TRIES times fail instead."""
        now = F.current_timestamp() if at is None else at
        rows = stored(self.left_open(before), "open")
        again = rows.where(F.col("tries") < TRIES)
        spent = rows.where(F.col("tries") >= TRIES).withColumns({"extraction_status": F.lit("FAILED"), "error_message": F.lit(GAVE_UP.format(TRIES)), "completed_at": now})
        self.table.upsert(again.withColumns({"started_at": now, "tries": F.col("tries") + 1}).unionByName(spent))
        return again.select("id")

    def run(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], at: Column | None = None) -> DataFrame:
        """Begin attempts at rows (id, ...), do the work, commit the ends; returns what the work gave (id, error_message, ...)."""
        self.begin(rows, at)
        return self.finish(rows, work, at)

    def recover(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], before: Column | None = None, at: Column | None = None) -> DataFrame:
        """The same for those of rows whose attempts were left open."""
        return self.finish(rows.join(self.take_up(before, at), "id", "left_semi"), work, at)

    def finish(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], at: Column | None = None) -> DataFrame:
        results = stored(work(rows), "results")  # done once, whatever reads it
        self.end(results, at)
        return results
