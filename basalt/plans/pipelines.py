"""The three pipelines end to end: requirements out of tenders, documents to fields, checks to recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as tx
from basalt.operators import assess as asm
from basalt.operators import lookup as lk
from basalt.operators import rules as ru
from basalt.operators import validate as va
from basalt.operators import vectors as ve
from basalt.schemas import RECORD_FIELDS
from basalt.sources import providers as pv

Provider = Callable[[DataFrame], DataFrame]


def ingest(store: DataFrame | None, documents: DataFrame, embed: Provider = pv.embed, size: int = 1000, overlap: int = 200) -> DataFrame:
    """The store (chunk_id, text, source_document, chunk_index, embedding) with the chunks of documents put in."""
    chunks = embed(tx.chunk(documents, size=size, overlap=overlap))
    return chunks if store is None else ve.upsert_chunks(store, chunks)


# The texts of faults as they are reported.
NO_TENDER, NO_QUESTION, NO_SOURCE = "tender_id must be greater than zero.", "Query cannot be empty.", "source_document cannot be empty."
NO_DOCUMENT, NO_PATH, NO_TEXT = "bid_document_id must be greater than zero.", "file_path cannot be empty.", "Document texts cannot contain empty values."


def above_zero(column: str) -> Column:
    return F.coalesce(F.col(column) > 0, F.lit(False))


def document_faults(requests: DataFrame) -> DataFrame:
    """requests (bid_document_id, file_path) with error: a bad id or a blank path; null if the document can be processed."""
    return requests.withColumn("error", F.when(~above_zero("bid_document_id"), NO_DOCUMENT).when(tx.is_blank(F.col("file_path")), NO_PATH))


def embed_checked(rows: DataFrame, key: str, embed: Provider = pv.embed) -> tuple[DataFrame, DataFrame]:
    """(rows (key, text) with embedding, rejects with error): a batch, that is the rows of one key, with a blank text is rejected whole."""
    bad = rows.groupBy(key).agg(F.bool_or(tx.is_blank(F.col("text"))).alias("__bad")).where("__bad").select(key)
    same = rows[key].eqNullSafe(bad[key])
    return embed(rows.join(bad, same, "left_anti")), rows.join(bad, same, "left_semi").withColumn("error", F.lit(NO_TEXT))


def question_faults(questions: DataFrame) -> DataFrame:
    """questions (query_id, tender_id, text, source_document) with error: a bad tender, a blank question or source."""
    error = F.when(~above_zero("tender_id"), NO_TENDER).when(tx.is_blank(F.col("text")), NO_QUESTION).when(tx.is_blank(F.col("source_document")), NO_SOURCE)
    return questions.withColumn("error", error)


def retrieve(store: DataFrame, questions: DataFrame, k: int = 5, embed: Provider = pv.embed) -> DataFrame:
    """query_id, chunk_id, source_document, text, distance, rank: the k chunks nearest to each question (query_id, text).

    A question may name a source_document, to which its search is then limited. Blank questions find nothing here;
    question_faults() tells of them.
    """
    if not 1 <= k <= 20:
        raise ValueError("top_k must be between 1 and 20")
    asked = embed(questions).where("embedding is not null").select("query_id", F.col("embedding").alias("query_vector"), *[F.col(c).alias("__only") for c in ("source_document",) if c in questions.columns])
    if "__only" not in asked.columns:
        return ve.top_k_many(store, asked, k, ("source_document", "text"))
    anywhere = ve.top_k_many(store, asked.where("__only is null").drop("__only"), k, ("source_document", "text"))
    pairs = store.join(asked.where("__only is not null"), F.col("source_document") == F.col("__only"))
    pairs = pairs.withColumn("distance", ve.squared_distance("embedding", "query_vector"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return anywhere.union(pairs.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "chunk_id", "source_document", "text", "distance", "rank"))


def add_requirements(stored: DataFrame, questions: DataFrame, hits: DataFrame, generate: Provider = pv.extract_requirements) -> tuple[DataFrame, DataFrame]:
    """(all requirements found, those of them to append): questions (query_id, tender_id), hits as of retrieve()."""
    found = generate(hits.select("chunk_id", "source_document", "text").distinct())
    rows = hits.select("query_id", "chunk_id").join(found, "chunk_id").join(questions.select("query_id", "tender_id"), "query_id")
    rows = rows.withColumn("source_chunk_ids", F.array("chunk_id"))
    return rows, lk.new_requirements(rows, stored, ["chunk_id", "ordinal"])


def process_documents(native: DataFrame, ocr: DataFrame, classify: Provider = pv.classify, extract: Provider = pv.extract_fields) -> DataFrame:
    """An attempt for each document (document_id): extraction_status, extracted_data (JSON), extracted_text, confidence_score, error_message.

    Text is the native pages' where there is any, else that of OCR. Failures are rows, not exceptions.
    """
    totals = tx.page_totals(native.unionByName(ocr.join(native.select("document_id").distinct(), "document_id", "left_anti")))
    rows = extract(classify(tx.choose_text(native, ocr).join(totals, "document_id").withColumnRenamed("combined", "text")))
    known = {k: [f for f in v if f in rows.columns] for k, v in RECORD_FIELDS.items()}
    fields = F.lit(None).cast("map<string,string>")
    for kind, names in known.items():
        own = F.create_map(*[x for f in RECORD_FIELDS[kind] for x in (F.lit(f), F.col(f) if f in names else F.lit(None).cast("string"))])
        fields = F.when(F.col("document_type") == kind, own).otherwise(fields)
    rows = rows.withColumn("fields", fields).withColumn("classification_confidence", F.col("confidence"))
    rows = lk.transition(rows, F.coalesce("error", F.when(F.col("fields").isNull(), F.lit("unsupported document type"))))
    done = F.col("extraction_status") == "COMPLETED"
    return rows.select("document_id", "extraction_status", F.when(done, va.extraction_json()).alias("extracted_data"), F.col("text").alias("extracted_text"), F.when(done, F.col("confidence")).alias("confidence_score"), "error_message")


def decide(requests: DataFrame, submissions: DataFrame, requirements: DataFrame, registry: ru.Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(checks, with those that failed to be made carrying an error; an assessment with recommendation for each submission)."""
    checks = ru.record_checks(requests, submissions, requirements, registry)
    made = checks.where("error is null").select("bid_submission_id", "status")
    latest = asm.assess(submissions.select(F.col("id").alias("bid_submission_id")), made)
    return checks, asm.recommend(latest, made)
