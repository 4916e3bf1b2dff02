"""The procurement domain derived from the benchmark tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABSENT = "l_partkey % 17 = 0"


def signal(good: str, bad: str) -> str:
    return f"CASE WHEN {ABSENT} THEN NULL WHEN l_linestatus = 'O' THEN '{good}' WHEN l_tax < 0.02 THEN '{bad}' WHEN l_tax < 0.05 THEN NULL ELSE 'UNKNOWN' END"


#: One row a check to be made: evidence as columns.
CHECK_INPUTS = f"""
SELECT l_orderkey AS bid_submission_id, (l_orderkey % 100) * 10 + l_linenumber % 4 AS tender_requirement_id,
  CASE l_linenumber % 4 WHEN 1 THEN 'GST' WHEN 2 THEN 'UDYAM' WHEN 3 THEN 'INCOME_TAX' ELSE 'EPFO' END AS requirement_type,
  {ABSENT} AS no_evidence,
  CASE WHEN {ABSENT} OR l_partkey % 11 = 0 THEN NULL ELSE concat('ID', CAST(l_suppkey AS varchar)) END AS document_id,
  CASE WHEN {ABSENT} OR (l_returnflag = 'R' AND l_partkey % 5 = 0) THEN NULL ELSE concat('ID', CAST(l_suppkey + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS varchar)) END AS verified_id,
  CASE WHEN {ABSENT} THEN NULL WHEN l_returnflag = 'N' THEN 'VERIFIED' WHEN l_returnflag = 'A' THEN CASE WHEN l_discount >= 0.08 THEN 'INVALID' ELSE 'VERIFIED' END WHEN l_tax >= 0.06 THEN 'PENDING' END AS verification_status,
  {signal('COMPLIANT', 'NON_COMPLIANT')} AS compliance_signal,
  {signal('ACTIVE', 'INACTIVE')} AS active_signal,
  CASE WHEN {ABSENT} THEN NULL WHEN l_partkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS pan_status,
  CASE l_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'WAIVED' ELSE 'REVIEW' END AS manual_status
FROM lineitem
"""
SUBMISSIONS = "SELECT o_orderkey AS id, CAST(o_orderkey % 100 AS int) AS tender_id, o_custkey AS bidder_id, 'SUBMITTED' AS status, o_orderdate AS submitted_at FROM orders"
BIDDERS = "SELECT c_custkey AS id, c_name AS company_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('GSTIN', CAST(c_custkey % 700 AS varchar)) END AS gstin FROM customer"
TENDERS = "SELECT CAST(p_partkey AS int) AS id, p_name AS title, concat('REF', CAST(p_partkey AS varchar)) AS reference_number, 'DRAFT' AS status FROM part"
REQUIREMENTS = "SELECT t.id * 10 + k.k AS id, t.id AS tender_id, CASE k.k WHEN 1 THEN 'GST' WHEN 2 THEN 'UDYAM' WHEN 3 THEN 'INCOME_TAX' ELSE 'EPFO' END AS requirement_type, concat('Requirement ', CAST(k.k AS varchar)) AS requirement_name FROM (" + TENDERS + ") t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k"
EXTRACTIONS = "SELECT event_id AS id, user_id AS bid_document_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING' WHEN 'signup' THEN 'PROCESSED' ELSE 'COMPLETED' END AS extraction_status, value / 200.0 AS confidence_score, ts AS created_at FROM events"
PAGES = "SELECT conv_id AS document_id, CAST(turn + 1 AS int) AS page_number, CASE WHEN turn % 3 = 2 THEN concat(' ', chr(9)) ELSE concat(chr(10), text, ' ') END AS text FROM conversations"
CHUNKS = "SELECT concat('v', CAST(vec_id AS varchar)) AS chunk_id, concat('source', CAST(label AS varchar)) AS source_document, vec_id, embedding FROM embeddings"
TABLES = ("customer", "part", "orders", "lineitem", "events", "documents", "conversations", "embeddings")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the texts above over the tables in sf_dir."""
    for t in TABLES:
        if f" {t}" in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text.replace("varchar", "string"))


#: The columns of CHECK_INPUTS in which the rules find their evidence.
EVIDENCE = {
    kind: {"document": "document_id", "verified": "verified_id", "nothing": "no_evidence", "status": "verification_status", **signals}
    for kind, signals in (("GST", {"return_filing_status": "compliance_signal"}), ("UDYAM", {"enterprise_status": "active_signal"}), ("INCOME_TAX", {"pan_status": "pan_status", "income_tax_compliance": "compliance_signal"}))
}


def check_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHECK_INPUTS with the name of each requirement; the rules read it with EVIDENCE."""
    return sql(spark, sf_dir, CHECK_INPUTS).withColumn("requirement_name", F.concat(F.lit("Requirement "), (F.col("tender_requirement_id") % 10).cast("string")))


def check_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHECK_INPUTS with the evidence in maps, as the rules read it."""
    rows = sql(spark, sf_dir, CHECK_INPUTS)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    doc = ver = none
    for kind, key, pairs in (("GST", "gstin", {"return_filing_status": "compliance_signal"}), ("UDYAM", "udyam_number", {"enterprise_status": "active_signal"}), ("INCOME_TAX", "pan", {"pan_status": "pan_status", "income_tax_compliance": "compliance_signal"})):
        has = (F.col("requirement_type") == kind) & ~F.col("no_evidence")
        doc = F.when(has, F.create_map(F.lit(key), F.col("document_id"))).otherwise(doc)
        told = {"status": "verification_status", key: "verified_id"} | pairs
        ver = F.when(has, F.create_map(*[x for k, v in told.items() for x in (F.lit(k), F.col(v))])).otherwise(ver)
    return rows.withColumns({"extracted_data": doc, "verification_data": ver, "requirement_name": F.concat(F.lit("Requirement "), (F.col("tender_requirement_id") % 10).cast("string"))})
