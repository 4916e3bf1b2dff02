"""Vector collections: a stored table of chunks each, opened or created by name. And settings with defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import vectors as ve
from basalt.sources.tables import BUCKETS, KeyedTable, open_table

SCHEMA = "chunk_id string, text string, source_document string, chunk_index int, embedding array<float>"


@dataclass(frozen=True)
class Collection:
    """A named collection under a folder that driver and executors share: one row a chunk_id."""

    name: str
    table: KeyedTable

    @property
    def path(self) -> str:
        return self.table.path

    def read(self) -> DataFrame:
        return self.table.read()

    def count(self) -> int:
        return self.table.read().agg(F.count(F.lit(1))).first()[0]

    def add(self, rows: DataFrame, order: tuple[str, ...] = ()) -> None:
        """Put chunks in, in place of those of their ids; further chunks of a document that has shrunk stay."""
        self.table.upsert(rows, order)

    def add_embedded(self, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
        """Put chunks in with their embeddings, by document and place. Documents whose numbers differ are left out whole, and returned with an error."""
        paired, faults = ve.pair_chunks(chunks, embeddings)
        self.add(paired)
        return faults

    def delete(self, gone: DataFrame) -> None:
        """Take the chunks of some ids (chunk_id) out; no ids, nothing to do."""
        self.table.delete(gone)


def open_collection(spark: SparkSession, root: str, name: str, schema: str = SCHEMA, buckets: int = BUCKETS) -> Collection:
    """The collection of that name, made empty if it isn't there."""
    if not name.strip():
        raise ValueError("a collection needs a name")
    return Collection(name, open_table(spark, f"{root.rstrip('/')}/{name}.parquet", schema, "chunk_id", buckets))


@dataclass(frozen=True)
class Settings:
    """Settings of the library; a Spark setting basalt.<name> takes the place of a default."""

    chunk_size: int = 1000
    chunk_overlap: int = 200
    top_k: int = 5
    ocr_dpi: int = 300
    ocr_language: str = "eng"
    collection: str = "tender_chunks"

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        told = {f.name: spark.conf.get(f"basalt.{f.name}", None) for f in fields(Settings)}
        return Settings(**{f.name: type(f.default)(told[f.name]) for f in fields(Settings) if told[f.name] is not None})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.name, str(getattr(self, f.name))) for f in fields(self)], "name string, value string")
