"""Queries over stored tables and small operators: creating rows, looking them up, states, adapters, displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt import schemas
from basalt.functions import text as tx
from basalt.operators import assess as asm
from basalt.operators import lookup as lk
from basalt.operators import rules as ru
from basalt.operators import validate as va
from basalt.operators import vectors as ve
from basalt.plans import domain as dm
from basalt.plans import pipelines as pl
from basalt.plans import queries as qs
from basalt.plans.queries import query
from basalt.sources import collections as cs
from basalt.sources import providers as pv
from basalt.sources.shared import shared_folder

DOCUMENTS = "SELECT c_custkey AS id, c_custkey * 11 AS bid_submission_id, concat('file', CAST(c_custkey AS varchar), CASE WHEN c_custkey % 4 = 0 THEN '.PDF' WHEN c_custkey % 4 = 1 THEN '.pdf' WHEN c_custkey % 4 = 2 THEN '.txt' ELSE '/' END) AS file_name, CASE c_custkey % 5 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'COMPLETED' ELSE 'ARCHIVED' END AS status FROM customer"
ASSESSMENTS = "SELECT o_orderkey AS id, o_custkey AS bid_submission_id, CASE o_orderstatus WHEN 'F' THEN 'NON_COMPLIANT' WHEN 'O' THEN 'COMPLIANT' ELSE 'REVIEW' END AS status, o_orderdate AS created_at FROM orders"


def table(spark, sf_dir, sql):
    return dm.sql(spark, sf_dir, sql)


# --- creating rows ---------------------------------------------------------------------------------

NEW_BIDDERS = f"SELECT id, company_name, gstin FROM ({dm.BIDDERS}) WHERE id % 3 = 0"
OLD_BIDDERS = f"SELECT id, company_name, gstin FROM ({dm.BIDDERS}) WHERE id % 3 <> 0"
BIDDERS_SQL = f"SELECT n.*, n.gstin IS NOT NULL AND (n.gstin IN (SELECT gstin FROM ({OLD_BIDDERS}) WHERE gstin IS NOT NULL) OR row_number() OVER (PARTITION BY n.gstin ORDER BY n.id) > 1) AS clash FROM ({NEW_BIDDERS}) n"


def created_bidders(spark, sf_dir):
    return lk.create(table(spark, sf_dir, NEW_BIDDERS), table(spark, sf_dir, OLD_BIDDERS), ["gstin"], ["id"])


@query(f"SELECT company_name, gstin FROM ({OLD_BIDDERS}) UNION ALL SELECT company_name, gstin FROM ({BIDDERS_SQL}) WHERE NOT clash")
def create_bidders(spark, sf_dir):
    return created_bidders(spark, sf_dir)[0].select("company_name", "gstin")


@query(f"WITH c AS (SELECT count(*) FILTER (NOT clash) AS fresh FROM ({BIDDERS_SQL})), o AS (SELECT count(*) AS old, max(id) AS top FROM ({OLD_BIDDERS})) SELECT old + fresh AS n_rows, old + fresh AS n_ids, top + fresh AS largest FROM c, o")
def created_ids(spark, sf_dir):
    """Keys dealt to rows that are put in: unique, and gapless above the largest stored one."""
    return created_bidders(spark, sf_dir)[0].agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.max("id").alias("largest"))


@query(f"SELECT id, gstin, 'already exists: gstin' AS error FROM ({BIDDERS_SQL}) WHERE clash")
def conflict_bidders(spark, sf_dir):
    return created_bidders(spark, sf_dir)[1].select("id", "gstin", "error")


NEW_TENDERS = "SELECT CAST(p_partkey AS int) AS id, p_name AS title, concat('REF', CAST(p_partkey % 700 AS varchar)) AS reference_number, 'DRAFT' AS status FROM part WHERE p_partkey % 2 = 1"
OLD_TENDERS = "SELECT CAST(p_partkey AS int) AS id, p_name AS title, concat('REF', CAST(p_partkey AS varchar)) AS reference_number, 'OPEN' AS status FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 1"
TENDERS_SQL = f"SELECT n.*, n.reference_number IN (SELECT reference_number FROM ({OLD_TENDERS})) OR row_number() OVER (PARTITION BY n.reference_number ORDER BY n.id) > 1 AS clash FROM ({NEW_TENDERS}) n"


@query(f"SELECT title, reference_number, status FROM ({OLD_TENDERS}) UNION ALL SELECT title, reference_number, status FROM ({TENDERS_SQL}) WHERE NOT clash")
def create_tenders(spark, sf_dir):
    return lk.create(table(spark, sf_dir, NEW_TENDERS), table(spark, sf_dir, OLD_TENDERS), ["reference_number"], ["id"])[0].select("title", "reference_number", "status")


@query(f"SELECT id, reference_number FROM ({TENDERS_SQL}) WHERE clash")
def conflict_tenders(spark, sf_dir):
    return lk.create(table(spark, sf_dir, NEW_TENDERS), table(spark, sf_dir, OLD_TENDERS), ["reference_number"], ["id"])[1].select("id", "reference_number")


NEW_REQUIREMENTS = f"SELECT id, tender_id + CASE WHEN id % 7 = 0 THEN 100000000 ELSE 0 END AS tender_id, requirement_type, concat('New ', requirement_name) AS requirement_name FROM ({dm.REQUIREMENTS})"


def created_requirements(spark, sf_dir):
    old = table(spark, sf_dir, dm.REQUIREMENTS)
    new = table(spark, sf_dir, NEW_REQUIREMENTS).select(*[F.col(f.name).cast(f.dataType) for f in old.schema])
    return lk.create(new, old, [], ["id"], table(spark, sf_dir, dm.TENDERS), "tender_id")


@query(f"SELECT tender_id, requirement_type, requirement_name FROM ({dm.REQUIREMENTS}) UNION ALL SELECT tender_id, requirement_type, requirement_name FROM ({NEW_REQUIREMENTS}) WHERE tender_id < 100000000")
def create_requirements(spark, sf_dir):
    return created_requirements(spark, sf_dir)[0].select("tender_id", "requirement_type", "requirement_name")


@query(f"SELECT tender_id, requirement_name, 'tender_id not found: ' || tender_id AS error FROM ({NEW_REQUIREMENTS}) WHERE tender_id >= 100000000")
def reject_requirements(spark, sf_dir):
    return created_requirements(spark, sf_dir)[1].select("tender_id", "requirement_name", "error")


def created_documents(spark, sf_dir):
    rows = table(spark, sf_dir, DOCUMENTS)
    return lk.create(rows, rows.limit(0), [], ["id"], table(spark, sf_dir, dm.SUBMISSIONS), "bid_submission_id")


@query(f"SELECT bid_submission_id, file_name, status FROM ({DOCUMENTS}) WHERE bid_submission_id IN (SELECT id FROM ({dm.SUBMISSIONS}))")
def create_documents(spark, sf_dir):
    return created_documents(spark, sf_dir)[0].select("bid_submission_id", "file_name", "status")


@query(f"SELECT bid_submission_id, file_name, 'bid_submission_id not found: ' || bid_submission_id AS error FROM ({DOCUMENTS}) WHERE bid_submission_id NOT IN (SELECT id FROM ({dm.SUBMISSIONS}))")
def reject_documents(spark, sf_dir):
    return created_documents(spark, sf_dir)[1].select("bid_submission_id", "file_name", "error")


@query(f"SELECT id, tender_id + CASE WHEN id % 9 = 0 THEN 100000000 ELSE 0 END AS tender_id FROM ({dm.SUBMISSIONS}) WHERE id % 9 = 0")
def reject_unknown_tenders(spark, sf_dir):
    rows = table(spark, sf_dir, dm.SUBMISSIONS).withColumn("tender_id", F.col("tender_id") + F.when(F.col("id") % 9 == 0, 100000000).otherwise(0))
    return lk.accept(rows, table(spark, sf_dir, dm.TENDERS), "tender_id")[1].select("id", "tender_id")


@query(f"SELECT id, 'gstin' AS columns FROM ({dm.BIDDERS}) b WHERE gstin IS NOT NULL AND (SELECT count(*) FROM ({dm.BIDDERS}) c WHERE c.gstin = b.gstin) > 1 UNION ALL SELECT id, 'pan' FROM ({dm.BIDDERS}) WHERE id % 500 < 2")
def unique_faults(spark, sf_dir):
    rows = table(spark, sf_dir, dm.BIDDERS).withColumns({"pan": F.when(F.col("id") % 500 < 2, "SAME"), "udyam_number": F.col("id").cast("string")})
    return schemas.unique_faults(rows, "bidders")


# --- lookups ---------------------------------------------------------------------------------------

BY_ID = {"bidder": dm.BIDDERS, "tender": dm.TENDERS, "requirement": dm.REQUIREMENTS, "submission": dm.SUBMISSIONS, "document": DOCUMENTS, "extraction": dm.EXTRACTIONS, "assessment": ASSESSMENTS}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(id AS BIGINT) AS id FROM ({sql}) WHERE id = {n + 40}" for n, (k, sql) in enumerate(BY_ID.items())))
def rows_by_id(spark, sf_dir):
    out = None
    for n, (kind, sql) in enumerate(BY_ID.items()):
        found = lk.first_or_none(lk.by_value(table(spark, sf_dir, sql), id=n + 40)).select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"))
        out = found if out is None else out.union(found)
    return out


@query(f"SELECT id, file_name FROM ({DOCUMENTS}) WHERE bid_submission_id = 77")
def documents_by_submission(spark, sf_dir):
    return lk.by_value(table(spark, sf_dir, DOCUMENTS), bid_submission_id=77).select("id", "file_name")


@query(f"SELECT id FROM ({dm.BIDDERS}) WHERE gstin = 'GSTIN7' ORDER BY id DESC LIMIT 1")
def first_bidder(spark, sf_dir):
    return lk.first_or_none(lk.by_value(table(spark, sf_dir, dm.BIDDERS), gstin="GSTIN7"), F.desc("id")).select("id")


@query(f"SELECT id, bid_submission_id, status, row_number() OVER (PARTITION BY bid_submission_id ORDER BY created_at DESC, id DESC) AS nth FROM ({ASSESSMENTS})")
def assessment_history(spark, sf_dir):
    return lk.history(table(spark, sf_dir, ASSESSMENTS), "bid_submission_id").select("id", "bid_submission_id", "status", "nth")


@query(f"SELECT id, bid_submission_id, status FROM ({ASSESSMENTS}) QUALIFY row_number() OVER (PARTITION BY bid_submission_id ORDER BY created_at DESC, id DESC) = 1")
def latest_assessment(spark, sf_dir):
    return lk.latest(table(spark, sf_dir, ASSESSMENTS), "bid_submission_id").select("id", "bid_submission_id", "status")


@query(f"SELECT tender_requirement_id, bid_submission_id, status, row_number() OVER (PARTITION BY tender_requirement_id ORDER BY bid_submission_id, status, reason) AS nth FROM ({qs.ALL_SQL})")
def checks_in_order(spark, sf_dir):
    rows = qs.evaluated(spark, sf_dir).select("tender_requirement_id", "bid_submission_id", "status", "reason")
    return lk.ranked(rows, "tender_requirement_id", ["bid_submission_id", "status", "reason"]).drop("reason")


@query(f"SELECT bid_submission_id, total_checks, passed, failed, review, pending, total_checks > 0 AS timed FROM ({qs.ASSESS_SQL})")
def stamped_assessments(spark, sf_dir):
    """Metadata and time of assessments; the time itself can't be compared."""
    out = asm.stamped(qs.assess_submissions(spark, sf_dir).select("bid_submission_id", "total_checks", "passed", "failed", "review", "pending"))
    return out.select("bid_submission_id", "assessment_metadata.*", F.col("assessed_at").isNotNull().alias("timed"))


# --- checks with every outcome ---------------------------------------------------------------------

MOVED = f"SELECT bid_submission_id + CASE WHEN tender_requirement_id % 7 = 0 THEN 1 WHEN l_partkey % 31 = 0 THEN 900000000 ELSE 0 END AS bid_submission_id, tender_requirement_id + CASE WHEN l_partkey % 23 = 0 THEN 900000000 ELSE 0 END AS tender_requirement_id, * EXCLUDE (bid_submission_id, tender_requirement_id) FROM ({dm.CHECK_INPUTS.replace(' AS bid_submission_id,', ' AS bid_submission_id, l_partkey,')})"


@query(f"""
WITH i AS ({MOVED}), s AS ({dm.SUBMISSIONS}), r AS ({dm.REQUIREMENTS})
SELECT i.bid_submission_id, i.tender_requirement_id, CASE WHEN s.id IS NULL THEN 'Bid submission not found: ' || i.bid_submission_id WHEN r.id IS NULL THEN 'Tender requirement not found: ' || i.tender_requirement_id WHEN s.tender_id <> r.tender_id THEN 'Tender requirement does not belong to the tender of the submission' END AS error,
  CASE WHEN s.id IS NOT NULL AND r.id IS NOT NULL AND s.tender_id = r.tender_id THEN 'COMPLIANCE_ENGINE' END AS timed_by
FROM i LEFT JOIN s ON s.id = i.bid_submission_id LEFT JOIN r ON r.id = i.tender_requirement_id
""")
def recorded_checks(spark, sf_dir):
    """Every check with its outcome: made, no submission, no requirement, other tender."""
    rows = table(spark, sf_dir, dm.CHECK_INPUTS.replace(" AS bid_submission_id,", " AS bid_submission_id, l_partkey,"))
    rows = rows.withColumns({
        "bid_submission_id": F.col("bid_submission_id") + F.when(F.col("tender_requirement_id") % 7 == 0, 1).when(F.col("l_partkey") % 31 == 0, 900000000).otherwise(0),
        "tender_requirement_id": F.col("tender_requirement_id") + F.when(F.col("l_partkey") % 23 == 0, 900000000).otherwise(0),
    })
    out = ru.record_checks(rows, table(spark, sf_dir, dm.SUBMISSIONS), table(spark, sf_dir, dm.REQUIREMENTS), columns=dm.EVIDENCE)
    return out.select("bid_submission_id", "tender_requirement_id", "error", F.when(F.col("checked_at").isNotNull(), F.col("checked_by")).alias("timed_by"))


@query(f"SELECT bid_submission_id, document_id, verified_id, CASE WHEN document_id <> verified_id THEN 'MISMATCH' WHEN document_id IS NOT NULL AND verified_id IS NOT NULL THEN 'MATCH' ELSE 'INCOMPLETE' END AS match FROM ({dm.CHECK_INPUTS})")
def cross_verify_rows(spark, sf_dir):
    rows = table(spark, sf_dir, dm.CHECK_INPUTS).withColumn("submitted_id", F.coalesce("document_id", "verified_id"))
    return lk.cross_verify(rows, ["submitted_id", "document_id", "verified_id"]).select("bid_submission_id", "document_id", "verified_id", "match")


@query("SELECT event_id AS id, 'No automated evaluator is available for requirement type: ' || CASE event_id % 3 WHEN 0 THEN 'ESIC' WHEN 1 THEN 'OEM' ELSE 'nsic' END AS reason FROM events")
def future_types(spark, sf_dir):
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'ESIC' WHEN 1 THEN 'OEM' ELSE 'nsic' END")
    none = F.lit(None).cast("map<string,string>")
    rows = table(spark, sf_dir, "SELECT event_id FROM events").select(F.col("event_id").alias("id"), kind.alias("requirement_type"), F.lit("x").alias("requirement_name"), none.alias("extracted_data"), none.alias("verification_data"))
    return ru.evaluate(rows).select("id", "reason")


# --- records of providers and adapters --------------------------------------------------------------

RESULTS = "SELECT event_id AS id, event_id % 2 = 0 AS success, CASE event_id % 5 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'ERROR' ELSE 'OTHER' END AS verification_status, concat('ID', CAST(user_id AS varchar)) AS identifier FROM events"


@query(f"SELECT id, coalesce(CASE WHEN success THEN verification_status IN ('VERIFIED', 'NOT_FOUND', 'INVALID') ELSE verification_status IN ('PENDING', 'ERROR') END, false) AS in_order FROM ({RESULTS})")
def provider_results(spark, sf_dir):
    return table(spark, sf_dir, RESULTS).select("id", va.provider_status().alias("in_order"))


@query(f"SELECT id, verification_status AS status, identifier AS gstin, 'COMPLIANT' AS filing FROM ({RESULTS})")
def verification_inputs(spark, sf_dir):
    rows = table(spark, sf_dir, RESULTS).withColumn("verified_data", F.create_map(F.lit("return_filing_status"), F.lit("COMPLIANT"), F.lit("status"), F.lit("stale")))
    v = F.col("verification_data")
    return va.verification_input(rows, "gstin").select("id", v["status"].alias("status"), v["gstin"].alias("gstin"), v["return_filing_status"].alias("filing"))


@query("SELECT event_id AS id, 'A' || user_id AS pan, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'B' || user_id END AS other FROM events")
def extraction_inputs(spark, sf_dir):
    rows = table(spark, sf_dir, "SELECT event_id AS id, concat('A', CAST(user_id AS varchar)) AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('B', CAST(user_id AS varchar)) END AS b FROM events")
    stored = F.to_json(F.struct(F.struct(F.col("a").alias("pan_number"), F.col("b").alias("name")).alias("fields")), {"ignoreNullFields": "false"})
    d = F.col("extracted_data")
    return va.extraction_input(rows.withColumn("extracted_data", stored)).select("id", d["pan"].alias("pan"), d["name"].alias("other"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 OR event_id % 6 = 1 THEN 'FAILED' WHEN event_id % 3 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS processing FROM events")
def processing_states(spark, sf_dir):
    rows = table(spark, sf_dir, "SELECT event_id AS id, event_id FROM events").withColumns({
        "error": F.when(F.col("id") % 4 == 0, "broken"),
        "fields": F.when(F.col("id") % 6 == 1, F.create_map(F.lit("a"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.when(F.col("id") % 3 != 0, "y"))),
    })
    return rows.select("id", va.processing_status().alias("processing"))


@query("SELECT event_id AS id, 1 AS step, 'PROCESSING' AS extraction_status, NULL AS error_message FROM events UNION ALL SELECT event_id, 2, CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END, CASE WHEN event_id % 3 = 0 THEN 'unreadable' END FROM events")
def attempt_states(spark, sf_dir):
    """Every attempt as it starts and as it ends."""
    started = lk.begin(table(spark, sf_dir, "SELECT event_id AS id FROM events"))
    ended = lk.transition(started, F.when(F.col("id") % 3 == 0, "unreadable"))
    return started.select("id", F.lit(1).alias("step"), "extraction_status", "error_message").union(ended.select("id", F.lit(2), "extraction_status", "error_message"))


REQUIREMENT_REPLIES = """
SELECT event_id AS query_id, CASE WHEN event_id % 7 = 0 THEN 'no json' WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN '{"x":1}'
  ELSE concat('{"requirements":[{"requirement_type":"GST","requirement_name":"', CASE WHEN event_id % 5 = 0 THEN '' ELSE 'GST' END, '","description":"d","is_required":', CASE WHEN event_id % 9 = 0 THEN 'null' ELSE 'true' END, ',"source_document":"s","source_chunk_ids":', CASE WHEN event_id % 8 = 0 THEN '[]' ELSE '["c1"]' END, '},{"requirement_type":"PAN","requirement_name":"PAN","description":"d","is_required":false,"source_document":"s","source_chunk_ids":["c2","c3"]}]}') END AS reply FROM events
"""


@query(f"""
SELECT query_id, NULL AS ordinal, CASE WHEN trim(reply) = '' THEN 'empty reply' WHEN reply = 'no json' THEN 'invalid JSON' ELSE 'no requirements' END AS error, 0 AS n_chunks FROM ({REQUIREMENT_REPLIES}) WHERE reply NOT LIKE '%requirements%'
UNION ALL SELECT query_id, 0, CASE WHEN query_id % 9 = 0 THEN 'is_required' WHEN query_id % 5 = 0 THEN 'requirement_name' WHEN query_id % 8 = 0 THEN 'source_chunk_ids' END, CASE WHEN query_id % 8 = 0 THEN 0 ELSE 1 END FROM ({REQUIREMENT_REPLIES}) WHERE reply LIKE '%requirements%'
UNION ALL SELECT query_id, 1, NULL, 2 FROM ({REQUIREMENT_REPLIES}) WHERE reply LIKE '%requirements%'
""")
def validate_requirements(spark, sf_dir):
    return va.validate_requirements(table(spark, sf_dir, REQUIREMENT_REPLIES)).select("query_id", "ordinal", "error", F.coalesce(F.size("source_chunk_ids"), F.lit(0)).alias("n_chunks"))


# --- displays ---------------------------------------------------------------------------------------


def tag_sql(kind, column):
    tags, rest = tx.TAGS[kind]
    value = f"upper({column})" if kind in tx.ANY_CASE else column
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tags.items()) + f" ELSE '{rest}' END"


TAGGED = "SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'open' WHEN 2 THEN 'PROCESSED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'Submitted' WHEN 5 THEN 'PROCESSING' WHEN 6 THEN 'DISQUALIFIED' WHEN 7 THEN 'UPLOADED' END AS status, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS seen_at FROM events"


@query(f"SELECT id, {', '.join(f'{tag_sql(k, 'status')} AS {k}_tag' for k in tx.TAGS)} FROM ({TAGGED})")
def status_tags(spark, sf_dir):
    return table(spark, sf_dir, TAGGED).select("id", *[tx.status_tag(k, F.col("status")).alias(f"{k}_tag") for k in tx.TAGS])


@query(f"SELECT id, coalesce(strftime(seen_at, '%-m/%-d/%Y'), '—') AS day, coalesce(strftime(seen_at, '%-m/%-d/%Y, %-I:%M:%S %p'), 'Not available') AS moment FROM ({TAGGED})")
def date_labels(spark, sf_dir):
    return table(spark, sf_dir, TAGGED).select("id", tx.date_label(F.col("seen_at")).alias("day"), tx.date_label(F.col("seen_at"), "Not available", time=True).alias("moment"))


@query("SELECT event_id AS id, 0 AS position, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def listed_values(spark, sf_dir):
    return tx.listing(table(spark, sf_dir, "SELECT event_id AS id, props FROM events"), "props", ("id",)).select("id", "position", "key", "value")


@query(f"SELECT bid_submission_id, position, key, CAST(value AS VARCHAR) AS value FROM (SELECT bid_submission_id, unnest([0, 1, 2, 3, 4]) AS position, unnest(['total_checks', 'passed', 'failed', 'review', 'pending']) AS key, unnest([total_checks, passed, failed, review, pending]) AS value FROM ({qs.ASSESS_SQL}))")
def listed_metadata(spark, sf_dir):
    """The members of each assessment's metadata, as they are displayed."""
    rows = qs.assess_submissions(spark, sf_dir).select("bid_submission_id", F.to_json(asm.metadata()).alias("metadata"))
    return tx.listing(rows, "metadata", ("bid_submission_id",))


RECORDS = "SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 2 = 0 END AS success, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'GST' END AS provider, concat('ID', CAST(user_id AS varchar)) AS identifier, CASE event_id % 5 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'ERROR' ELSE 'OTHER' END AS verification_status, CASE WHEN event_id % 3 = 0 THEN 'told' END AS message, CASE WHEN event_id % 7 = 0 THEN 'broken' END AS problem, event_id % 4 = 0 AS has_data FROM events"


@query(f"""
WITH r AS (SELECT *, coalesce(success, false) AS worked FROM ({RECORDS}))
SELECT id, concat_ws(',', CASE WHEN success IS NULL THEN 'success' END, CASE WHEN provider = ' ' THEN 'provider' END,
  CASE WHEN NOT coalesce(CASE WHEN success THEN verification_status IN ('VERIFIED', 'NOT_FOUND', 'INVALID') ELSE verification_status IN ('PENDING', 'ERROR') END, false) THEN 'verification_status' END,
  CASE WHEN has_data AND verification_status <> 'VERIFIED' THEN 'data' END, CASE WHEN NOT worked AND message IS NULL AND problem IS NULL THEN 'message' END, CASE WHEN worked AND problem IS NOT NULL THEN 'errors' END) AS faults,
  verification_status AS status, CASE WHEN has_data THEN 1 ELSE 0 END AS n_data, CASE WHEN problem IS NULL THEN 0 ELSE 1 END AS n_errors FROM r
""")
def provider_records(spark, sf_dir):
    rows = table(spark, sf_dir, RECORDS).withColumns({"data": F.when(F.col("has_data"), F.create_map(F.lit("legal_name"), F.lit("x"))), "errors": F.when(F.col("problem").isNotNull(), F.array("problem", F.lit(" ")))})
    out = va.provider_record(rows)
    return out.select("id", F.array_join("faults", ",").alias("faults"), F.col("record.verification_status").alias("status"), F.size("record.data").alias("n_data"), F.size("record.errors").alias("n_errors"))


REQUESTS = "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 7 - 1 END AS bid_document_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN chr(10) ELSE 'a.pdf' END AS file_path FROM events"


@query(f"SELECT id, CASE WHEN coalesce(bid_document_id, 0) <= 0 THEN 'bid_document_id must be greater than zero.' WHEN file_path IS NULL OR file_path = chr(10) THEN 'file_path cannot be empty.' END AS error FROM ({REQUESTS})")
def document_faults(spark, sf_dir):
    return pl.document_faults(table(spark, sf_dir, REQUESTS)).select("id", "error")


BATCHES = "SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN ' ' ELSE props END AS text FROM events"


@query(f"SELECT event_id, 'Document texts cannot contain empty values.' AS error FROM ({BATCHES}) WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 97 = 0) UNION ALL SELECT event_id, NULL FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def embedded_batches(spark, sf_dir):
    """Batches of texts that are embedded, and those rejected whole for a blank member."""
    good, bad = pl.embed_checked(table(spark, sf_dir, BATCHES), "user_id")
    return bad.select("event_id", "error").union(good.where("embedding is not null").select("event_id", F.lit(None).cast("string")))


@query(f"SELECT id, lower(file_name) LIKE '%_.pdf' AND file_name NOT LIKE '%/' AS is_pdf FROM ({DOCUMENTS})")
def pdf_names(spark, sf_dir):
    return table(spark, sf_dir, DOCUMENTS).select("id", tx.is_pdf(F.col("file_name")).alias("is_pdf"))


@query(f"SELECT file_name AS path, CASE WHEN id % 6 = 0 THEN 'PDF file not found: ' || file_name WHEN file_name LIKE '%/' THEN 'PDF path is not a file: ' || file_name WHEN id % 4 = 2 THEN 'File must have a .pdf extension.' END AS fault FROM ({DOCUMENTS})")
def page_faults(spark, sf_dir):
    rows = table(spark, sf_dir, DOCUMENTS)
    files = rows.where("id % 6 <> 0").select(F.col("file_name").alias("path"), (~F.col("file_name").endswith("/")).alias("is_file"))
    return pv.page_faults(rows.select(F.col("file_name").alias("path")), files)


@query(f"SELECT count(*) AS n_documents, count(*) FILTER (status IN ('COMPLETED', 'PROCESSED')) AS processed, (SELECT count(*) FROM ({dm.TENDERS})) AS n_tenders, (SELECT count(*) FROM ({dm.REQUIREMENTS})) AS n_requirements FROM ({DOCUMENTS})")
def dashboard_counts(spark, sf_dir):
    done = lk.progress(table(spark, sf_dir, DOCUMENTS).withColumn("all", F.lit(1)), "all").select(F.col("total").alias("n_documents"), "processed")
    n = lambda sql, name: table(spark, sf_dir, sql).agg(F.count(F.lit(1)).alias(name))
    return done.crossJoin(n(dm.TENDERS, "n_tenders")).crossJoin(n(dm.REQUIREMENTS, "n_requirements"))  # a row each


VISIBLE = {"tenders": ("id", "title", "reference_number", "description", "status", "created_at", "updated_at"), "bid_submissions": ("id", "tender_id", "bidder_id", "status", "submitted_at", "created_at")}


@query(f"SELECT id, title, reference_number, status, '{','.join(VISIBLE['tenders'])}' AS columns FROM ({dm.TENDERS})")
def tender_response(spark, sf_dir):
    out = schemas.response(schemas.with_defaults(table(spark, sf_dir, dm.TENDERS).drop("status"), "tenders"), "tenders")
    return out.select("id", "title", "reference_number", "status", F.lit(",".join(out.columns)).alias("columns"))


@query(f"SELECT id, tender_id, bidder_id, 'SUBMITTED' AS status, '{','.join(VISIBLE['bid_submissions'])}' AS columns FROM ({dm.SUBMISSIONS})")
def submission_response(spark, sf_dir):
    out = schemas.response(schemas.with_defaults(table(spark, sf_dir, dm.SUBMISSIONS).drop("status"), "bid_submissions"), "bid_submissions")
    return out.select(F.col("id").cast("bigint").alias("id"), "tender_id", F.col("bidder_id").cast("bigint").alias("bidder_id"), "status", F.lit(",".join(out.columns)).alias("columns"))


# --- questions, prompts, collections, settings ------------------------------------------------------

QUESTIONS = "SELECT event_id AS query_id, event_id % 5 AS tender_id, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'What?' END AS text, CASE event_id % 3 WHEN 0 THEN chr(9) ELSE 'a.pdf' END AS source_document FROM events"


@query(f"SELECT query_id, CASE WHEN tender_id <= 0 THEN 'tender_id must be greater than zero.' WHEN coalesce(trim(text), '') = '' THEN 'Query cannot be empty.' WHEN source_document = chr(9) THEN 'source_document cannot be empty.' END AS error FROM ({QUESTIONS})")
def question_faults(spark, sf_dir):
    return pl.question_faults(table(spark, sf_dir, QUESTIONS)).select("query_id", "error")


ASK = "Answer from the text alone."


@query(f"SELECT query_id, '{ASK}' || chr(10) || chr(10) || 'Question:' || chr(10) || 'Q' || query_id || chr(10) || chr(10) || 'Text:' || chr(10) || context AS prompt FROM ({qs.ORACLE_SQL['context_blocks']})")
def prompts(spark, sf_dir):
    return qs.context_blocks(spark, sf_dir).select("query_id", tx.prompt(F.concat(F.lit("Q"), F.col("query_id").cast("string")), F.col("context"), ASK).alias("prompt"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{','.join(v)}', 'Read the {k} below and give its fields: {', '.join(v)}. Leave out what it doesn''t say. Reply in JSON with fields and confidence.')" for k, v in schemas.RECORD_FIELDS.items()) + ") t(document_type, fields, instruction)")
def reply_schemas(spark, sf_dir):
    rows = [(k, ",".join(pv.reply_schema(k)["properties"]["fields"]["properties"]), pv.instruction(k)) for k in schemas.RECORD_FIELDS]
    return spark.createDataFrame(rows, "document_type string, fields string, instruction string")


@query(f"WITH h AS ({qs.MULTI_SQL}) SELECT query_id, CAST(rank - 1 AS INT) AS position, chunk_id FROM h")
def zipped_hits(spark, sf_dir):
    """Hits as parallel lists, and row by row again in their order."""
    hits = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    lists = qs.vector_topk_multi(spark, sf_dir).groupBy("query_id").agg(hits.alias("h")).select("query_id", F.transform("h", lambda x: x["chunk_id"]).alias("chunk_id"), F.transform("h", lambda x: x["rank"]).alias("rank"))
    return ve.zip_hits(lists, ("query_id",), ("chunk_id", "rank")).select("query_id", "position", "chunk_id")


@query("SELECT 'source' || label AS source_document, count(*) AS n_chunks, count(*) FILTER (label % 3 <> 0 OR vec_id % 7 <> 0) AS n_embeddings, 'Number of chunks must match number of embeddings.' AS error FROM embeddings GROUP BY label HAVING count(*) <> count(*) FILTER (label % 3 <> 0 OR vec_id % 7 <> 0)")
def unpaired_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, dm.CHUNKS).withColumn("chunk_index", F.col("vec_id"))
    some = rows.where("source_document not in ('source0', 'source3', 'source6', 'source9') or vec_id % 7 <> 0")
    return ve.pair_chunks(rows.select("source_document", "chunk_index", "chunk_id"), some)[1]


@query("SELECT 'v' || vec_id AS chunk_id, embedding[1] AS first FROM embeddings WHERE label % 3 <> 0")
def paired_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, dm.CHUNKS).withColumn("chunk_index", F.col("vec_id"))
    some = rows.where("source_document not in ('source0', 'source3', 'source6', 'source9')")
    return ve.pair_chunks(rows.select("source_document", "chunk_index", "chunk_id"), some)[0].select("chunk_id", F.col("embedding")[0].alias("first"))


@query("SELECT 'v' || vec_id AS chunk_id, list_count(embedding) AS dim FROM embeddings")
def collection_rows(spark, sf_dir):
    """Chunks put into a collection of the shared folder, and read back."""
    import uuid

    root = shared_folder(spark)
    store = cs.open_collection(spark, root, f"chunks-{uuid.uuid4().hex[:12]}", buckets=8)
    rows = table(spark, sf_dir, dm.CHUNKS)
    store.add(rows.select("chunk_id", F.lit("").alias("text"), "source_document", F.lit(0).alias("chunk_index"), "embedding"))
    again = cs.open_collection(spark, root, store.name).read()
    return again.select("chunk_id", F.size("embedding").cast("bigint").alias("dim"))


@query("SELECT * FROM (VALUES ('chunk_size', '1000'), ('chunk_overlap', '200'), ('top_k', '5'), ('ocr_dpi', '300'), ('ocr_language', 'eng'), ('collection', 'tender_chunks')) t(name, value)")
def settings(spark, sf_dir):
    return cs.Settings.of(spark).table(spark)
