"""Queries over the derived domain, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt import schemas
from basalt.functions import text as tx
from basalt.operators import assess as asm
from basalt.operators import lookup as lk
from basalt.operators import rules as ru
from basalt.operators import validate as va
from basalt.operators import vectors as ve
from basalt.plans import domain as dm
from basalt.sources import providers as pv

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- rules -----------------------------------------------------------------------------------------

SETS = {
    "GST": (ru.GST, "gstin", (("return_filing_status", "compliance_signal", "NON_COMPLIANT"),), ("compliance_signal", "COMPLIANT")),
    "UDYAM": (ru.UDYAM, "udyam_number", (("enterprise_status", "active_signal", "INACTIVE"),), ("active_signal", "ACTIVE")),
    "INCOME_TAX": (ru.INCOME_TAX, "pan", (("pan_status", "pan_status", "INACTIVE"), ("income_tax_compliance", "compliance_signal", "NON_COMPLIANT")), ("compliance_signal", "COMPLIANT")),
}


def said(pairs: list[tuple[str, str]]) -> str:
    return " || ';' || ".join(f"'{k}=' || coalesce({v}, 'null')" for k, v in pairs) or "''"


def rule_sql(kind: str) -> str:
    """The decision list of one type, as SQL over the input columns."""
    rules, key, bad, (good_column, good) = SETS[kind]
    reasons = [r.reason.replace("'", "''") for r in rules.rules]
    ident = "coalesce(verified_id, document_id)"
    full = [(key, ident), ("verification_status", "verification_status"), *[(s, c) for s, c, _ in bad]]
    cases = [("no_evidence", "REVIEW", []), ("document_id <> verified_id", "REVIEW", [(f"document_{key}", "document_id"), (f"verified_{key}", "verified_id")]), ("verification_status = 'INVALID'", "FAIL", full[:2])]
    for n, (_, column, value) in enumerate(bad):
        cases.append((f"{column} = '{value}'", "FAIL", [(key, ident), *[(s, c) for s, c, _ in bad[: n + 1]]]))
    cases += [("verification_status IS DISTINCT FROM 'VERIFIED'", "REVIEW", full), (f"{good_column} IS NULL OR {good_column} = '{good}'", "PASS", full), ("true", "REVIEW", full)]
    chain = lambda f: "CASE " + " ".join(f"WHEN {c} THEN {f(n, s, e)}" for n, (c, s, e) in enumerate(cases)) + " END"
    return f"SELECT bid_submission_id, tender_requirement_id, {chain(lambda n, s, e: f"'{s}'")} AS status, {chain(lambda n, s, e: f"'{reasons[n]}'")} AS reason, {chain(lambda n, s, e: said(e))} AS evidence_text FROM ({dm.CHECK_INPUTS}) WHERE requirement_type = '{kind}'"


DEFAULT_SQL = f"SELECT bid_submission_id, tender_requirement_id, 'REVIEW' AS status, '{ru.NO_RULES}' || requirement_type AS reason, 'requirement_type=' || requirement_type || ';requirement_name=Requirement ' || CAST(tender_requirement_id % 10 AS varchar) AS evidence_text FROM ({dm.CHECK_INPUTS}) WHERE requirement_type NOT IN ('GST', 'UDYAM', 'INCOME_TAX')"
ALL_SQL = " UNION ALL ".join([*[rule_sql(k) for k in SETS], DEFAULT_SQL])
#: Checks as they are stored: rule results, and statuses set by hand where no rules apply.
CHECKS_SQL = f"SELECT e.bid_submission_id, e.status FROM ({' UNION ALL '.join(rule_sql(k) for k in SETS)}) e UNION ALL SELECT bid_submission_id, manual_status FROM ({dm.CHECK_INPUTS}) WHERE requirement_type = 'EPFO'"


def evaluated(spark, sf_dir: str, kind: str | None = None) -> DataFrame:
    rows = dm.check_columns(spark, sf_dir)
    return ru.evaluate(rows if kind is None else rows.where(F.col("requirement_type") == kind), columns=dm.EVIDENCE)


def checks(spark, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).withColumn("status", F.when(F.col("requirement_type") == "EPFO", F.col("manual_status")).otherwise(F.col("status")))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("bid_submission_id", "tender_requirement_id", "status", "reason", ru.evidence_text().alias("evidence_text"))


@query(rule_sql("GST"))
def evaluate_gst(spark, sf_dir):
    return shown(evaluated(spark, sf_dir, "GST"))


@query(rule_sql("UDYAM"))
def evaluate_udyam(spark, sf_dir):
    return shown(evaluated(spark, sf_dir, "UDYAM"))


@query(rule_sql("INCOME_TAX"))
def evaluate_income_tax(spark, sf_dir):
    return shown(evaluated(spark, sf_dir, "INCOME_TAX"))


@query(DEFAULT_SQL)
def evaluate_default(spark, sf_dir):
    return shown(evaluated(spark, sf_dir, "EPFO"))


@query(ALL_SQL)
def evaluate_all(spark, sf_dir):
    return shown(evaluated(spark, sf_dir))


@query(f"""
WITH i AS ({dm.CHECK_INPUTS}), s AS ({dm.SUBMISSIONS}), r AS ({dm.REQUIREMENTS})
SELECT coalesce(CASE WHEN s.id IS NULL THEN 'no submission' WHEN r.id IS NULL THEN 'no requirement' WHEN s.tender_id <> r.tender_id THEN 'other tender' END, 'ok') AS outcome, count(*) AS n
FROM (SELECT bid_submission_id + CASE WHEN tender_requirement_id % 7 = 0 THEN 1 ELSE 0 END AS bid_submission_id, tender_requirement_id FROM i) i
LEFT JOIN s ON s.id = i.bid_submission_id LEFT JOIN r ON r.id = i.tender_requirement_id GROUP BY 1
""")
def record_checks(spark, sf_dir):
    """Requests against stored rows, some for a submission that isn't there or of another tender."""
    moved = F.col("bid_submission_id") + F.when(F.col("tender_requirement_id") % 7 == 0, 1).otherwise(0)
    requests = dm.check_inputs(spark, sf_dir).withColumn("bid_submission_id", moved)  # evidence as maps, as callers send it
    out = ru.record_checks(requests, dm.sql(spark, sf_dir, dm.SUBMISSIONS), dm.sql(spark, sf_dir, dm.REQUIREMENTS))
    outcome = F.when(F.col("error").isNull(), "ok").when(F.col("error").startswith("Bid"), "no submission").when(F.col("error").startswith("Tender requirement not"), "no requirement").otherwise("other tender")
    return out.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# --- assessment ------------------------------------------------------------------------------------

TALLY_SQL = f"SELECT bid_submission_id, count(*) AS total_checks, count(*) FILTER (upper(status) = 'PASS') AS passed, count(*) FILTER (upper(status) = 'FAIL') AS failed, count(*) FILTER (upper(status) = 'REVIEW') AS review, count(*) FILTER (upper(status) = 'PENDING') AS pending FROM ({CHECKS_SQL}) GROUP BY 1"
ASSESS_SQL = f"""
SELECT s.id AS bid_submission_id, coalesce(total_checks, 0) AS total_checks, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(review, 0) AS review, coalesce(pending, 0) AS pending,
  round_even(passed / total_checks * 100, 2) AS score,
  CASE WHEN total_checks IS NULL THEN NULL WHEN failed > 0 THEN 'HIGH' WHEN review > 0 OR pending > 0 THEN 'MEDIUM' WHEN round_even(passed / total_checks * 100, 2) >= 80 THEN 'LOW' ELSE 'MEDIUM' END AS risk_level,
  CASE WHEN total_checks IS NULL THEN 'PENDING' WHEN failed > 0 THEN 'NON_COMPLIANT' WHEN review > 0 OR pending > 0 THEN 'REVIEW' WHEN passed = total_checks THEN 'COMPLIANT' ELSE 'REVIEW' END AS status,
  CASE WHEN total_checks IS NULL THEN '{asm.NO_CHECKS}' ELSE 'Compliance assessment completed for ' || total_checks || ' requirement(s): ' || passed || ' passed, ' || failed || ' failed, ' || review || ' under review, ' || pending || ' pending.' END AS summary
FROM ({dm.SUBMISSIONS}) s LEFT JOIN ({TALLY_SQL}) t ON t.bid_submission_id = s.id
"""


@query(TALLY_SQL)
def tally_status(spark, sf_dir):
    return asm.tally(checks(spark, sf_dir))


@query(f"SELECT bid_submission_id, round_even(passed / total_checks * 100, 2) AS score FROM ({TALLY_SQL})")
def score_submissions(spark, sf_dir):
    return asm.tally(checks(spark, sf_dir)).select("bid_submission_id", asm.score().alias("score"))


@query(ASSESS_SQL)
def assess_submissions(spark, sf_dir):
    submissions = dm.sql(spark, sf_dir, dm.SUBMISSIONS).select(F.col("id").alias("bid_submission_id"))
    return asm.assess(submissions, checks(spark, sf_dir))


RECOMMEND_SQL = f"""
SELECT bid_submission_id, status, CASE WHEN failed > 0 THEN '{asm.DO_NOT_PROCEED}' WHEN review > 0 OR pending > 0 THEN '{asm.MANUAL_REVIEW}' WHEN status = 'COMPLIANT' THEN '{asm.MAY_PROCEED}' ELSE '{asm.FURTHER_REVIEW}' END AS recommendation
FROM ({ASSESS_SQL})
"""


@query(RECOMMEND_SQL)
def recommend_submissions(spark, sf_dir):
    out = asm.recommend(assess_submissions(spark, sf_dir).select("bid_submission_id", "status"), checks(spark, sf_dir))
    return out.select("bid_submission_id", "status", "recommendation")


# --- lookups, latest rows, joins -------------------------------------------------------------------


@query(f"SELECT * FROM ({dm.BIDDERS})")
def scan_bidders(spark, sf_dir):
    return dm.sql(spark, sf_dir, dm.BIDDERS)


@query(f"SELECT * FROM ({dm.TENDERS})")
def scan_tenders(spark, sf_dir):
    return dm.sql(spark, sf_dir, dm.TENDERS)


@query(f"SELECT id, company_name, gstin FROM ({dm.BIDDERS}) WHERE gstin = 'GSTIN7'")
def bidder_by_gstin(spark, sf_dir):
    return lk.by_value(dm.sql(spark, sf_dir, dm.BIDDERS), gstin="GSTIN7")


@query(f"SELECT id, title, reference_number, status FROM ({dm.TENDERS}) WHERE reference_number = 'REF42'")
def tender_by_reference(spark, sf_dir):
    return lk.by_value(dm.sql(spark, sf_dir, dm.TENDERS), reference_number="REF42")


@query(f"SELECT * FROM ({dm.REQUIREMENTS}) WHERE tender_id = 42")
def requirements_by_tender(spark, sf_dir):
    return lk.by_value(dm.sql(spark, sf_dir, dm.REQUIREMENTS), tender_id=42)


@query(f"SELECT id, bidder_id, status FROM ({dm.SUBMISSIONS}) WHERE tender_id = 42")
def submissions_by_tender(spark, sf_dir):
    return lk.by_value(dm.sql(spark, sf_dir, dm.SUBMISSIONS), tender_id=42, bidder_id=None).select("id", "bidder_id", "status")


@query(f"SELECT id, tender_id, status FROM ({dm.SUBMISSIONS}) WHERE bidder_id = 7")
def submissions_by_bidder(spark, sf_dir):
    return lk.by_value(dm.sql(spark, sf_dir, dm.SUBMISSIONS), bidder_id=7).select("id", "tender_id", "status")


@query(f"SELECT * FROM ({dm.EXTRACTIONS}) QUALIFY row_number() OVER (PARTITION BY bid_document_id ORDER BY created_at DESC, id DESC) = 1")
def latest_extraction(spark, sf_dir):
    return lk.latest(dm.sql(spark, sf_dir, dm.EXTRACTIONS), "bid_document_id")


@query(f"SELECT *, row_number() OVER (PARTITION BY bid_document_id ORDER BY created_at DESC, id DESC) AS nth FROM ({dm.EXTRACTIONS})")
def extraction_history(spark, sf_dir):
    return lk.history(dm.sql(spark, sf_dir, dm.EXTRACTIONS), "bid_document_id")


@query(f"SELECT d.bid_document_id, e.id, e.extraction_status FROM (SELECT c_custkey AS bid_document_id FROM customer) d LEFT JOIN (SELECT * FROM ({dm.EXTRACTIONS}) QUALIFY row_number() OVER (PARTITION BY bid_document_id ORDER BY created_at DESC, id DESC) = 1) e USING (bid_document_id)")
def documents_with_latest(spark, sf_dir):
    documents = dm.sql(spark, sf_dir, "SELECT c_custkey AS bid_document_id FROM customer")
    return lk.with_latest(documents, dm.sql(spark, sf_dir, dm.EXTRACTIONS), "bid_document_id").select("bid_document_id", "id", "extraction_status")


@query(f"SELECT bid_submission_id, status, row_number() OVER (PARTITION BY bid_submission_id ORDER BY tender_requirement_id, status) AS nth FROM ({ALL_SQL})")
def checks_by_submission(spark, sf_dir):
    w = Window.partitionBy("bid_submission_id").orderBy("tender_requirement_id", "status")
    return evaluated(spark, sf_dir).select("bid_submission_id", "status", F.row_number().over(w).alias("nth"))


@query(f"SELECT tender_requirement_id, count(*) AS n_checks, min(bid_submission_id) AS first_submission FROM ({ALL_SQL}) GROUP BY 1")
def checks_by_requirement(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("tender_requirement_id").agg(F.count(F.lit(1)).alias("n_checks"), F.min("bid_submission_id").alias("first_submission"))


@query(f"SELECT s.id, s.status, t.title, b.company_name FROM ({dm.SUBMISSIONS}) s JOIN ({dm.TENDERS}) t ON t.id = s.tender_id JOIN ({dm.BIDDERS}) b ON b.id = s.bidder_id")
def submission_detail(spark, sf_dir):
    s = dm.sql(spark, sf_dir, dm.SUBMISSIONS).alias("s")
    t, b = dm.sql(spark, sf_dir, dm.TENDERS).alias("t"), dm.sql(spark, sf_dir, dm.BIDDERS).alias("b")
    return s.join(t, F.col("t.id") == F.col("s.tender_id")).join(b, F.col("b.id") == F.col("s.bidder_id")).select("s.id", "s.status", "t.title", "b.company_name")


@query(f"SELECT id, tender_id FROM ({dm.SUBMISSIONS}) WHERE tender_id IN (SELECT id FROM ({dm.TENDERS}))")
def accept_existing(spark, sf_dir):
    return lk.accept(dm.sql(spark, sf_dir, dm.SUBMISSIONS), dm.sql(spark, sf_dir, dm.TENDERS), "tender_id")[0].select("id", "tender_id")


@query(f"SELECT id, tender_id FROM ({dm.SUBMISSIONS}) WHERE tender_id NOT IN (SELECT id FROM ({dm.TENDERS}))")
def reject_orphans(spark, sf_dir):
    return lk.accept(dm.sql(spark, sf_dir, dm.SUBMISSIONS), dm.sql(spark, sf_dir, dm.TENDERS), "tender_id")[1].select("id", "tender_id")


FRESH_SQL = f"WITH s AS ({dm.SUBMISSIONS}), old AS (SELECT DISTINCT tender_id, bidder_id FROM s WHERE id % 5 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY tender_id, bidder_id ORDER BY id) AS nth FROM s WHERE id % 5 <> 0) SELECT n.id, n.tender_id, n.bidder_id FROM n LEFT JOIN old ON old.tender_id = n.tender_id AND old.bidder_id = n.bidder_id WHERE "


def natural_keys(spark, sf_dir):
    s = dm.sql(spark, sf_dir, dm.SUBMISSIONS)
    return lk.accept_new(s.where("id % 5 <> 0"), s.where("id % 5 = 0"), ["tender_id", "bidder_id"], ["id"])


@query(FRESH_SQL + "old.tender_id IS NULL AND nth = 1")
def accept_submissions(spark, sf_dir):
    return natural_keys(spark, sf_dir)[0].select("id", "tender_id", "bidder_id")


@query(FRESH_SQL + "NOT (old.tender_id IS NULL AND nth = 1)")
def conflict_submissions(spark, sf_dir):
    return natural_keys(spark, sf_dir)[1].select("id", "tender_id", "bidder_id")


CANDIDATES = "SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS ordinal, CAST(l_orderkey % 100 AS int) AS tender_id, CASE l_linenumber % 4 WHEN 1 THEN 'GST' WHEN 2 THEN 'UDYAM' WHEN 3 THEN 'INCOME_TAX' ELSE 'EPFO' END AS requirement_type, concat('Requirement ', CAST(l_linenumber AS varchar)) AS requirement_name, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('tender_', CAST(l_suppkey % 3 AS varchar), '.pdf') END AS source_document, l_partkey FROM lineitem"


@query(f"""
WITH c AS (SELECT * FROM ({CANDIDATES}) QUALIFY row_number() OVER (PARTITION BY tender_id, requirement_type, requirement_name, source_document ORDER BY ordinal, l_partkey) = 1),
e AS (SELECT id, tender_id, requirement_type, requirement_name, 'tender_1.pdf' AS source_document FROM ({dm.REQUIREMENTS}) WHERE id % 2 = 0),
f AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.tender_id = c.tender_id AND e.requirement_type = c.requirement_type AND e.requirement_name = c.requirement_name AND (c.source_document IS NULL OR c.source_document = e.source_document)))
SELECT tender_id, requirement_type, requirement_name, source_document FROM f
WHERE source_document IS NOT NULL OR NOT EXISTS (SELECT 1 FROM f g WHERE g.tender_id = f.tender_id AND g.requirement_type = f.requirement_type AND g.requirement_name = f.requirement_name AND (g.ordinal, g.l_partkey) < (f.ordinal, f.l_partkey))
""")
def requirement_dedupe(spark, sf_dir):
    stored = dm.sql(spark, sf_dir, dm.REQUIREMENTS).where("id % 2 = 0").withColumn("source_document", F.lit("tender_1.pdf"))
    return lk.new_requirements(dm.sql(spark, sf_dir, CANDIDATES), stored, ["ordinal", "l_partkey"]).select("tender_id", "requirement_type", "requirement_name", "source_document")


@query(f"""
WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS reason FROM orders), p AS (SELECT o_orderkey AS id, 'PASS' AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'patched' END AS reason FROM orders WHERE o_orderkey % 3 = 0)
SELECT c.id, CASE WHEN p.id % 2 = 0 THEN p.status ELSE c.status END AS status, CASE WHEN p.id IS NOT NULL THEN p.reason ELSE c.reason END AS reason FROM c LEFT JOIN p ON p.id = c.id
""")
def patch_checks(spark, sf_dir):
    rows = dm.sql(spark, sf_dir, "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS reason FROM orders")
    changes = dm.sql(spark, sf_dir, "SELECT o_orderkey AS id, 'PASS' AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'patched' END AS reason, CASE WHEN o_orderkey % 2 = 0 THEN array('status', 'reason') ELSE array('reason') END AS set_fields FROM orders WHERE o_orderkey % 3 = 0")
    return lk.patch(rows, changes, "id", ["status", "reason"])


# --- text and pages --------------------------------------------------------------------------------

WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{WHITE}+', ''), '{WHITE}+$', '')"
CHUNKED = rf"""
WITH n AS (SELECT source_document, trim(regexp_replace(text, '{WHITE}+', ' ', 'g')) AS t FROM (SOURCE)),
i AS (SELECT source_document, t, CAST(unnest(range(0, CAST(greatest(0, ceil((length(t) - 1000) / 800.0)) AS BIGINT) + 1)) AS INT) AS chunk_index FROM n WHERE t <> '')
SELECT concat(source_document, ':chunk:', chunk_index) AS chunk_id, trim(substring(t, chunk_index * 800 + 1, 1000)) AS text, source_document, chunk_index FROM i WHERE trim(substring(t, chunk_index * 800 + 1, 1000)) <> ''
"""


CHUNK_SQL = CHUNKED.replace("SOURCE", "SELECT concat('doc', doc_id) AS source_document, text FROM documents")


def source_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_document"), "text")


@query(CHUNK_SQL)
def chunk_documents(spark, sf_dir):
    return tx.chunk(source_documents(spark, sf_dir))


@query(f"SELECT source_document, count(*) AS n_chunks, sum(length(text)) AS n_characters FROM ({CHUNK_SQL}) GROUP BY 1")
def chunk_stats(spark, sf_dir):
    return tx.chunk(source_documents(spark, sf_dir)).groupBy("source_document").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.char_length("text")).alias("n_characters"))


COMBINE_SQL = f"SELECT document_id, coalesce(string_agg({STRIP('text')}, chr(10) || chr(10) ORDER BY page_number, {STRIP('text')}) FILTER ({STRIP('text')} <> ''), '') AS combined FROM ({dm.PAGES}) GROUP BY 1"


@query(COMBINE_SQL)
def combine_pages(spark, sf_dir):
    return tx.combine_pages(dm.sql(spark, sf_dir, dm.PAGES))


@query(f"SELECT document_id, count(*) AS total_pages, sum(length(text)) AS total_characters, bool_or({STRIP('text')} <> '') AS has_text FROM ({dm.PAGES}) GROUP BY 1")
def page_totals(spark, sf_dir):
    return tx.page_totals(dm.sql(spark, sf_dir, dm.PAGES))


@query(f"WITH a AS ({COMBINE_SQL}) SELECT document_id, CASE WHEN document_id % 3 <> 0 AND combined <> '' THEN 'NATIVE_PDF' ELSE 'OCR' END AS extraction_method, combined FROM a")
def text_source_choice(spark, sf_dir):
    """Documents of every third id have blank native pages."""
    pages = dm.sql(spark, sf_dir, dm.PAGES)
    return tx.choose_text(pages.withColumn("text", F.when(F.col("document_id") % 3 == 0, " ").otherwise(F.col("text"))), pages)


# --- vectors ---------------------------------------------------------------------------------------

DISTANCE = "round(list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))), 6)"


def query_vector(spark, sf_dir) -> list[float]:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").select("embedding").first()[0]


@query(f"WITH c AS ({dm.CHUNKS}), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT chunk_id, source_document, {DISTANCE} AS distance FROM c, q ORDER BY distance, chunk_id LIMIT 5")
def vector_topk(spark, sf_dir):
    return ve.top_k(dm.sql(spark, sf_dir, dm.CHUNKS), query_vector(spark, sf_dir)).select("chunk_id", "source_document", F.round("distance", 6).alias("distance"))


@query(f"WITH c AS ({dm.CHUNKS}), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT chunk_id, source_document, {DISTANCE} AS distance FROM c, q WHERE source_document = 'source3' ORDER BY distance, chunk_id LIMIT 5")
def vector_topk_filtered(spark, sf_dir):
    return ve.top_k(dm.sql(spark, sf_dir, dm.CHUNKS), query_vector(spark, sf_dir), 5, "source3").select("chunk_id", "source_document", F.round("distance", 6).alias("distance"))


MULTI_SQL = f"WITH c AS ({dm.CHUNKS}), q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, chunk_id, {DISTANCE} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {DISTANCE}, chunk_id) AS rank FROM c, q QUALIFY rank <= 5"


def nearest(spark, sf_dir):
    chunks = dm.sql(spark, sf_dir, dm.CHUNKS)
    queries = chunks.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return ve.top_k_many(chunks, queries, 5, columns=("source_document",))


@query(MULTI_SQL)
def vector_topk_multi(spark, sf_dir):
    return nearest(spark, sf_dir).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT count(*) AS n FROM ({dm.CHUNKS})")
def vector_count(spark, sf_dir):
    return dm.sql(spark, sf_dir, dm.CHUNKS).agg(F.count(F.lit(1)).alias("n"))


UPSERT = "SELECT concat('v', CAST(vec_id + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1000000 END AS varchar)) AS chunk_id, 'fresh' AS source_document FROM embeddings WHERE vec_id % 10 < 2"


@query(f"WITH old AS ({dm.CHUNKS}), fresh AS ({UPSERT}) SELECT chunk_id, source_document FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT * FROM fresh")
def vector_upsert(spark, sf_dir):
    return ve.upsert_chunks(dm.sql(spark, sf_dir, dm.CHUNKS).select("chunk_id", "source_document"), dm.sql(spark, sf_dir, UPSERT))


@query(f"SELECT chunk_id, source_document FROM ({dm.CHUNKS}) WHERE vec_id % 10 <> 3")
def vector_delete(spark, sf_dir):
    chunks = dm.sql(spark, sf_dir, dm.CHUNKS)
    return ve.delete_chunks(chunks, chunks.where("vec_id % 10 = 3")).select("chunk_id", "source_document")


@query(f"SELECT query_id, string_agg('[CONTEXT ' || rank || ']' || chr(10) || 'Source document: unknown' || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || 'Chunk text:' || chr(10), chr(10) || chr(10) ORDER BY rank) AS context FROM ({MULTI_SQL}) GROUP BY 1")
def context_blocks(spark, sf_dir):
    hits = nearest(spark, sf_dir).withColumn("distance", F.round("distance", 6)).withColumns({"source_document": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    return tx.context_blocks(hits)


# --- validation ------------------------------------------------------------------------------------

REPLIES = """
SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'PAN' WHEN 1 THEN 'GST_CERTIFICATE' WHEN 2 THEN 'INCOME_TAX' WHEN 3 THEN 'UDYAM_CERTIFICATE' WHEN 4 THEN 'UNKNOWN' ELSE 'OTHER' END AS document_type,
  CASE WHEN event_id % 7 = 0 THEN 'no json' WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN '{"fields":{"gstin":"X"}}' WHEN event_id % 17 = 0 THEN '{"fields":{"secret":"X"},"confidence":0.5}'
  ELSE concat('{"fields":{"', CASE event_id % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'gstin' WHEN 2 THEN 'pan_number' ELSE 'udyam_number' END, '":"A', CAST(user_id AS varchar), '"},"confidence":', CAST(event_id % 12 AS varchar), 'e-1}') END AS reply
FROM events
"""


@query(f"""
WITH r AS ({REPLIES}), p AS (SELECT *, json_valid(reply) AS ok FROM r),
q AS (SELECT *, CASE WHEN ok THEN CAST(json_extract_string(reply, '$.confidence') AS DOUBLE) END AS c, CASE WHEN ok THEN json_keys(reply, '$.fields')[1] END AS k FROM p)
SELECT id, CASE WHEN document_type IN ('UNKNOWN', 'OTHER') THEN 'unsupported document type' WHEN trim(reply) = '' THEN 'empty reply' WHEN NOT ok THEN 'invalid JSON' WHEN c IS NULL THEN 'no confidence' WHEN c > 1 THEN 'confidence out of bounds'
  WHEN k <> CASE document_type WHEN 'PAN' THEN 'name' WHEN 'GST_CERTIFICATE' THEN 'gstin' WHEN 'INCOME_TAX' THEN 'pan_number' ELSE 'udyam_number' END THEN 'unknown field' END AS error FROM q
""")
def validate_fields(spark, sf_dir):
    return va.validate_fields(dm.sql(spark, sf_dir, REPLIES)).select("id", "error")


CLASSES = """
SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'no json' WHEN event_id % 11 = 0 THEN '' ELSE concat('{"document_type":"', CASE event_id % 4 WHEN 0 THEN 'PAN' WHEN 1 THEN 'GST_CERTIFICATE' WHEN 2 THEN 'UNKNOWN' ELSE 'CERTIFICATE' END, '","confidence":', CAST(event_id % 12 AS varchar), 'e-1}') END AS reply FROM events
"""


@query(f"""
WITH r AS ({CLASSES}), q AS (SELECT *, json_valid(reply) AS ok FROM r), t AS (SELECT *, CASE WHEN ok THEN json_extract_string(reply, '$.document_type') END AS k, CASE WHEN ok THEN CAST(json_extract_string(reply, '$.confidence') AS DOUBLE) END AS c FROM q)
SELECT id, k AS document_type, CASE WHEN reply = '' THEN 'empty reply' WHEN NOT ok THEN 'invalid JSON' WHEN k = 'CERTIFICATE' THEN 'unknown document type' WHEN c > 1 THEN 'confidence out of bounds' END AS error FROM t
""")
def validate_classification(spark, sf_dir):
    return va.validate_classification(dm.sql(spark, sf_dir, CLASSES)).select("id", "document_type", "error")


# --- displays --------------------------------------------------------------------------------------

#: Tenths of a score by its exact binary value, ties up.
TENTHS = "((CAST(floor(score) AS BIGINT) * 10 + ((CAST((score - floor(score)) * pow(2, 59) AS BIGINT) * 10 + 288230376151711744) >> 59)) {op} 10)"

@query(f"SELECT bid_submission_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'warning' ELSE 'danger' END AS score_class, CASE WHEN score IS NULL THEN '—' ELSE {TENTHS.format(op='//')} || '.' || {TENTHS.format(op='%')} END AS score_label, CASE risk_level WHEN 'LOW' THEN 'low' WHEN 'MEDIUM' THEN 'medium' WHEN 'HIGH' THEN 'high' ELSE 'unknown' END AS risk_class, replace(status, '_', ' ') AS status_label FROM ({ASSESS_SQL})")
def assessment_display(spark, sf_dir):
    a = assess_submissions(spark, sf_dir)
    return a.select("bid_submission_id", tx.score_class(F.col("score")).alias("score_class"), tx.score_label(F.col("score")).alias("score_label"), tx.risk_class(F.col("risk_level")).alias("risk_class"), tx.status_label(F.col("status")).alias("status_label"))


@query(f"SELECT id, CASE WHEN confidence_score IS NULL THEN '—' ELSE CAST(CAST(floor(confidence_score * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS confidence_label FROM ({dm.EXTRACTIONS})")
def confidence_display(spark, sf_dir):
    return dm.sql(spark, sf_dir, dm.EXTRACTIONS).select("id", tx.percent_label(F.col("confidence_score")).alias("confidence_label"))


@query(f"SELECT bid_document_id, count(*) AS total, count(*) FILTER (extraction_status = 'COMPLETED') AS completed, count(*) FILTER (extraction_status IN ('COMPLETED', 'PROCESSED')) AS processed, count(*) FILTER (extraction_status NOT IN ('COMPLETED', 'PROCESSED')) AS open FROM ({dm.EXTRACTIONS}) GROUP BY 1")
def doc_progress(spark, sf_dir):
    return lk.progress(dm.sql(spark, sf_dir, dm.EXTRACTIONS), "bid_document_id", "extraction_status")


@query(f"SELECT match, count(*) AS n FROM (SELECT CASE WHEN document_id <> verified_id THEN 'MISMATCH' WHEN document_id IS NOT NULL AND verified_id IS NOT NULL THEN 'MATCH' ELSE 'INCOMPLETE' END AS match FROM ({dm.CHECK_INPUTS})) GROUP BY 1")
def cross_verify(spark, sf_dir):
    rows = dm.sql(spark, sf_dir, dm.CHECK_INPUTS).withColumn("submitted_id", F.coalesce("document_id", "verified_id"))
    return lk.cross_verify(rows, ["submitted_id", "document_id", "verified_id"]).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


# --- providers -------------------------------------------------------------------------------------


def noted(spark, sf_dir):
    """Documents with a line that tells their kind."""
    line = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Goods and Services Tax GSTIN 29ABCDE1234F1Z5' WHEN 1 THEN 'UDYAM-UP-00-1234567 enterprise name' WHEN 2 THEN 'Income Tax Return assessment year 2024-25' WHEN 3 THEN 'Permanent Account Number ABCDE1234F' ELSE 'nothing' END")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws("\n", line, "text").alias("text"))


NOTED_SQL = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Goods and Services Tax GSTIN 29ABCDE1234F1Z5' WHEN 1 THEN 'UDYAM-UP-00-1234567 enterprise name' WHEN 2 THEN 'Income Tax Return assessment year 2024-25' WHEN 3 THEN 'Permanent Account Number ABCDE1234F' ELSE 'nothing' END || chr(10) || text AS text FROM documents"


@query(f"""
WITH h AS (SELECT doc_id, {', '.join('(' + ' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + f') AS {k}' for k, words in pv.DOCUMENT_WORDS.items())} FROM ({NOTED_SQL})), b AS (SELECT *, greatest({', '.join(pv.DOCUMENT_WORDS)}) AS best FROM h)
SELECT doc_id, CASE WHEN best = 0 THEN 'UNKNOWN' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in pv.DOCUMENT_WORDS)} END AS document_type, best / 3 AS confidence FROM b
""")
def classify_documents(spark, sf_dir):
    return pv.classify(noted(spark, sf_dir)).select("doc_id", "document_type", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '') AS {n}" for n, p in pv.FIELD_PATTERNS.items()) + f" FROM ({NOTED_SQL})")
def extract_fields(spark, sf_dir):
    return pv.extract_fields(noted(spark, sf_dir)).select("doc_id", *pv.FIELD_PATTERNS)


NOTED_CHUNKS = CHUNKED.replace("SOURCE", f"SELECT CAST(doc_id AS VARCHAR) AS source_document, 'The bidder must have GST registration. ' || text AS text FROM ({NOTED_SQL})")


@query(rf"""
WITH s AS (SELECT source_document, chunk_id, string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM ({NOTED_CHUNKS})),
r AS (SELECT source_document, chunk_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS ordinal, unnest(parts) AS description FROM s)
SELECT *, CASE {' '.join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{k}'" for k, p in pv.REQUIREMENT_WORDS.items())} ELSE 'OTHER' END AS requirement_type,
  CASE WHEN length(trim(description)) <= 255 THEN trim(description) ELSE substring(trim(description), 1, 222) || ' ' || md5(trim(description)) END AS requirement_name, regexp_matches(lower(description), '\b(must|shall|required|mandatory)\b') AS is_required
FROM r WHERE regexp_matches(lower(description), '\b(must|shall|should|required|mandatory)\b')
""")
def extract_requirements(spark, sf_dir):
    docs = noted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_document"), F.concat(F.lit("The bidder must have GST registration. "), "text").alias("text"))
    return pv.extract_requirements(tx.chunk(docs))


EMBED_SQL = """
WITH w AS (SELECT chunk_id, unnest(string_split(lower(text), ' ')) AS word FROM (CHUNKS)), h AS (SELECT chunk_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS code FROM w),
p AS (SELECT chunk_id, (code >> k) & 63 AS place, CASE WHEN (code >> (k + 9)) & 1 = 1 THEN 1 ELSE -1 END AS sign FROM h, (VALUES (0), (10), (20)) t(k)),
s AS (SELECT chunk_id, place, sum(sign) AS v FROM p GROUP BY 1, 2 HAVING sum(sign) <> 0), n AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM s GROUP BY 1)
SELECT chunk_id, string_agg(place || ':' || CAST(floor(CAST(CAST(v / n AS FLOAT) AS DOUBLE) * 10000 + 0.5) AS INT), ' ' ORDER BY place) AS embedding FROM s JOIN n USING (chunk_id) GROUP BY 1
"""


@query(EMBED_SQL.replace("CHUNKS", CHUNK_SQL))
def embed_documents(spark, sf_dir):
    """Embeddings as text: the places that aren't zero, in ten-thousandths."""
    told = F.transform("embedding", lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), F.floor(x.cast("double") * 10000 + 0.5).cast("string"))))
    return pv.embed(tx.chunk(source_documents(spark, sf_dir))).select("chunk_id", F.array_join(told, " ").alias("embedding"))


@query("SELECT 1 AS ok")
def health(spark, sf_dir):
    return spark.sql("SELECT 1 AS ok")


@query(f"SELECT id, company_name, gstin FROM ({dm.BIDDERS})")
def bidder_response(spark, sf_dir):
    """Bidders as callers see them: defaults filled, columns kept back left out."""
    rows = schemas.response(schemas.with_defaults(dm.sql(spark, sf_dir, dm.BIDDERS), "bidders"), "bidders")
    return rows.select(F.col("id").cast("long").alias("id"), "company_name", "gstin")


# --- pipelines -------------------------------------------------------------------------------------


ASKED_CHUNKS = CHUNKED.replace("SOURCE", f"SELECT concat('doc', doc_id) AS source_document, 'The bidder must have GST registration. ' || text AS text FROM ({NOTED_SQL})")
#: Embeddings as lists of 64 places, from texts (id, text).
PLACES = """
words AS (SELECT id, unnest(string_split(lower(text), ' ')) AS word FROM texts), codes AS (SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS code FROM words),
signs AS (SELECT id, (code >> k) & 63 AS place, CASE WHEN (code >> (k + 9)) & 1 = 1 THEN 1 ELSE -1 END AS sign FROM codes, (VALUES (0), (10), (20)) t(k)),
sums AS (SELECT id, place, sum(sign) AS v FROM signs GROUP BY 1, 2), lengths AS (SELECT id, sqrt(sum(v * v)) AS n FROM sums GROUP BY 1),
vectors AS (SELECT l.id, list(CASE WHEN s.v IS NULL THEN 0.0::DOUBLE ELSE CAST(CAST(s.v / l.n AS FLOAT) AS DOUBLE) END ORDER BY r.place) AS x FROM lengths l CROSS JOIN (SELECT unnest(range(64)) AS place) r LEFT JOIN sums s ON s.id = l.id AND s.place = r.place WHERE l.n > 0 GROUP BY 1)
"""


@query(rf"""
WITH chunks AS ({ASKED_CHUNKS}), asks AS (SELECT * FROM (VALUES (1, 42, 'GST registration', NULL), (2, 43, 'enterprise name', 'doc1')) t(query_id, tender_id, text, source_document)),
texts AS (SELECT chunk_id AS id, text FROM chunks UNION ALL SELECT 'ask' || query_id, text FROM asks), {PLACES},
near AS (SELECT a.query_id, a.tender_id, c.* FROM asks a JOIN vectors q ON q.id = 'ask' || a.query_id JOIN chunks c ON a.source_document IS NULL OR c.source_document = a.source_document JOIN vectors v ON v.id = c.chunk_id
  QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY list_sum(list_transform(list_zip(v.x, q.x), lambda z: pow(z[1] - z[2], 2))), c.chunk_id) <= 5),
s AS (SELECT *, string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM near), r AS (SELECT *, generate_subscripts(parts, 1) AS ordinal, unnest(parts) AS description FROM s),
f AS (SELECT tender_id, chunk_id, ordinal, source_document, CASE {' '.join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{k}'" for k, p in pv.REQUIREMENT_WORDS.items())} ELSE 'OTHER' END AS requirement_type,
  CASE WHEN length(trim(description)) <= 255 THEN trim(description) ELSE substring(trim(description), 1, 222) || ' ' || md5(trim(description)) END AS requirement_name, regexp_matches(lower(description), '\b(must|shall|required|mandatory)\b') AS is_required
  FROM r WHERE regexp_matches(lower(description), '\b(must|shall|should|required|mandatory)\b'))
SELECT tender_id, requirement_type, requirement_name, source_document, is_required FROM f
QUALIFY row_number() OVER (PARTITION BY tender_id, requirement_type, requirement_name, source_document ORDER BY chunk_id, ordinal) = 1
""")
def retrieve_requirements(spark, sf_dir):
    """Questions to the chunks of all documents, and what the hits oblige to."""
    from basalt.plans import pipelines as pl

    docs = noted(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_document"), F.concat(F.lit("The bidder must have GST registration. "), "text").alias("text"))
    questions = spark.createDataFrame([(1, 42, "GST registration", None), (2, 43, "enterprise name", "doc1")], "query_id int, tender_id int, text string, source_document string")
    hits = pl.retrieve(pl.ingest(None, docs), questions)
    found, fresh = pl.add_requirements(dm.sql(spark, sf_dir, dm.REQUIREMENTS).withColumn("source_document", F.lit("x")), questions, hits)
    return fresh.select("tender_id", "requirement_type", "requirement_name", "source_document", "is_required")


PAN_LINE = "CASE WHEN document_id % 2 = 0 THEN 'Permanent Account Number ABCDE1234F ' ELSE '' END"
HITS = {k: " + ".join(f"CAST(contains(lower(combined), '{w}') AS INT)" for w in words) for k, words in pv.DOCUMENT_WORDS.items()}


def fields_sql(kind: str) -> str:
    """The JSON of a record's fields that patterns find in the text."""
    told = [f"""'"{f}":' || coalesce('"' || nullif(regexp_extract(combined, '{pv.FIELD_PATTERNS[f]}', 1), '') || '"', 'null')""" for f in schemas.RECORD_FIELDS[kind]]
    return "'{' || " + " || ',' || ".join(told) + " || '}'"


@query(f"""
WITH p AS (SELECT document_id, page_number, {PAN_LINE} || text AS text FROM ({dm.PAGES})),
b AS (SELECT *, 'NATIVE_PDF' AS method FROM p UNION ALL SELECT document_id + 5, page_number, text, 'OCR' FROM ({dm.PAGES}) WHERE document_id + 5 NOT IN (SELECT document_id FROM p)),
t AS (SELECT document_id, any_value(method) AS method, count(*) AS n, sum(length(text)) AS size, coalesce(string_agg({STRIP('text')}, chr(10) || chr(10) ORDER BY page_number, {STRIP('text')}) FILTER ({STRIP('text')} <> ''), '') AS combined FROM b GROUP BY 1),
h AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in HITS.items())} FROM t), g AS (SELECT *, greatest({', '.join(HITS)}) AS best FROM h),
k AS (SELECT *, CASE WHEN combined = '' THEN NULL WHEN best = 0 THEN 'UNKNOWN' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in HITS)} END AS kind FROM g)
SELECT document_id, CASE WHEN kind IN ({', '.join(f"'{k}'" for k in HITS)}) THEN 'COMPLETED' ELSE 'FAILED' END AS extraction_status,
  CASE {' '.join(f"WHEN kind = '{k}' THEN fields_{k}" for k in HITS)} END AS extracted_data, combined AS extracted_text,
  CASE WHEN kind <> 'UNKNOWN' THEN best / 3 END AS confidence_score, CASE WHEN kind IS NULL THEN 'text cannot be empty' WHEN kind = 'UNKNOWN' THEN 'unsupported document type' END AS error_message
FROM (SELECT *, {', '.join(f"""'{{"document_type":"{k}","classification_confidence":' || best / 3 || ',"extraction_method":"' || method || '","total_pages":' || n || ',"total_characters":' || size || ',"fields":' || {fields_sql(k)} || '}}' AS fields_{k}""" for k in HITS)} FROM k)
""")
def process_documents(spark, sf_dir):
    from basalt.plans import pipelines as pl

    pages = dm.sql(spark, sf_dir, dm.PAGES)
    line = F.when(F.col("document_id") % 2 == 0, "Permanent Account Number ABCDE1234F ").otherwise("")
    return pl.process_documents(pages.withColumn("text", F.concat(line, "text")), pages.withColumn("document_id", F.col("document_id") + 5))


@query(f"""
WITH i AS ({dm.CHECK_INPUTS}), s AS ({dm.SUBMISSIONS}), r AS ({dm.REQUIREMENTS}), e AS ({ALL_SQL}),
c AS (SELECT e.bid_submission_id, e.status FROM e JOIN s ON s.id = e.bid_submission_id JOIN r ON r.id = e.tender_requirement_id AND r.tender_id = s.tender_id),
t AS (SELECT bid_submission_id, count(*) AS n, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'REVIEW') AS v, count(*) FILTER (status = 'PASS') AS p FROM c GROUP BY 1)
SELECT s.id AS bid_submission_id, CASE WHEN n IS NULL THEN 'PENDING' WHEN f > 0 THEN 'NON_COMPLIANT' WHEN v > 0 THEN 'REVIEW' ELSE 'COMPLIANT' END AS status,
  CASE WHEN f > 0 THEN '{asm.DO_NOT_PROCEED}' WHEN v > 0 THEN '{asm.MANUAL_REVIEW}' WHEN n = p THEN '{asm.MAY_PROCEED}' ELSE '{asm.FURTHER_REVIEW}' END AS recommendation
FROM s LEFT JOIN t ON t.bid_submission_id = s.id
""")
def decide_submissions(spark, sf_dir):
    from basalt.plans import pipelines as pl

    _, out = pl.decide(dm.check_inputs(spark, sf_dir), dm.sql(spark, sf_dir, dm.SUBMISSIONS), dm.sql(spark, sf_dir, dm.REQUIREMENTS))
    return out.select("bid_submission_id", "status", "recommendation")


@query(f"SELECT id, bid_document_id, CASE WHEN row_number() OVER (PARTITION BY bid_document_id ORDER BY created_at DESC, id DESC) = 1 AND bid_document_id % 2 = 0 THEN 'CHECKED' ELSE extraction_status END AS extraction_status FROM ({dm.EXTRACTIONS})")
def update_latest(spark, sf_dir):
    rows = dm.sql(spark, sf_dir, dm.EXTRACTIONS)
    values = rows.where("bid_document_id % 2 = 0").select("bid_document_id").distinct().withColumn("extraction_status", F.lit("CHECKED"))
    return lk.update_latest(rows, values, "bid_document_id", "extraction_status").select("id", "bid_document_id", "extraction_status")


from basalt.plans import changing as _changing  # noqa: E402, F401 (their queries register themselves)
from basalt.plans import stored as _stored  # noqa: E402, F401
