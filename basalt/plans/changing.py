"""Queries over stored tables that change: collections, latest rows, tallies and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.operators import attempts as at
from basalt.operators import incremental as inc
from basalt.operators import learned as ln
from basalt.operators import nearest as nn
from basalt.operators import rollups as rl
from basalt.operators import temporal as tm
from basalt.plans import domain as dm
from basalt.plans import made
from basalt.plans import queries as qs
from basalt.plans.queries import query
from basalt.sources import collections as cs
from basalt.sources import pdf
from basalt.sources.shared import new_path, shared_folder, stored
from basalt.sources.tables import open_table
from basalt.streaming import stateful as sf

#: Buckets of the tables here; they are made anew for each query.
BUCKETS = 8


def fresh_table(spark, schema: str, key: str):
    return open_table(spark, new_path(spark, key), schema, key, BUCKETS)


@query("SELECT 'v' || vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'moved' ELSE 'source' || label END AS source_document, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS chunk_index, embedding[1] AS first FROM embeddings WHERE vec_id % 5 <> 0")
def changed_collection(spark, sf_dir):
    """A collection into which all chunks are put, then a third of them anew, and from which a fifth is taken."""
    rows = dm.sql(spark, sf_dir, dm.CHUNKS).withColumns({"text": F.lit(""), "chunk_index": F.lit(0)})
    store = cs.open_collection(spark, shared_folder(spark), new_path(spark, "changed").rpartition("/")[2], buckets=BUCKETS)
    store.add(rows)
    store.add(rows.where("vec_id % 3 = 0").withColumns({"source_document": F.lit("moved"), "chunk_index": F.lit(1)}))
    store.delete(rows.where("vec_id % 5 = 0").select("chunk_id"))
    return store.read().select("chunk_id", "source_document", "chunk_index", F.col("embedding")[0].alias("first"))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL WHEN vec_id % 4 = 1 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 4 = 1 THEN NULL ELSE 'old' END AS note FROM embeddings")
def patched_table(spark, sf_dir):
    """Rows of a stored table patched in place: a null that is set differs from one that isn't."""
    table = fresh_table(spark, "vec_id bigint, label bigint, note string", "vec_id")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("bigint").alias("label"))
    table.upsert(rows.withColumn("note", F.lit("old")))
    changes = rows.where("vec_id % 4 < 2").select("vec_id", F.when(F.col("vec_id") % 4 == 1, F.col("label") + 100).alias("label"), F.lit(None).cast("string").alias("note"), F.when(F.col("vec_id") % 4 == 0, F.array(F.lit("label"))).otherwise(F.array(F.lit("label"), F.lit("note"))).alias("set_fields"))
    table.patch(changes, ["label", "note"])
    return table.read()


@query(f"SELECT bid_document_id, id, extraction_status, confidence_score FROM ({dm.EXTRACTIONS}) QUALIFY row_number() OVER (PARTITION BY bid_document_id ORDER BY created_at DESC, id DESC) = 1")
def merged_latest(spark, sf_dir):
    """The latest extraction of each document, from four batches merged one after the other."""
    rows = dm.sql(spark, sf_dir, dm.EXTRACTIONS)
    names = ["bid_document_id", "id", "extraction_status", "confidence_score", "created_at"]
    kept = inc.LatestRows(fresh_table(spark, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), "bid_document_id"))
    for n in range(4):
        kept.merge(rows.where(F.pmod("id", F.lit(4)) == n))
    return kept.table.read().drop("created_at")


@query(f"SELECT bid_submission_id, count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status = 'PENDING') AS pending FROM (SELECT bid_submission_id, CASE WHEN tender_requirement_id % 10 = 1 THEN 'PENDING' ELSE status END AS status FROM ({qs.ALL_SQL})) GROUP BY 1")
def merged_tallies(spark, sf_dir):
    """Tallies of checks that come in two batches, one of them twice, and of which some are then made anew."""
    rows = stored(qs.evaluated(spark, sf_dir).select(F.col("bid_submission_id").cast("bigint").alias("bid_submission_id"), "tender_requirement_id", "status"), "checks")
    kept = inc.Tallies(fresh_table(spark, inc.tallies_schema("bid_submission_id"), "bid_submission_id"))
    for batch, n in ((1, 0), (2, 1), (2, 1)):
        kept.merge(batch, rows.where(F.pmod("tender_requirement_id", F.lit(2)) == n))
    anew = rows.where("tender_requirement_id % 10 = 1")
    kept.merge(3, anew.withColumn("status", F.lit("PENDING")), anew)
    return kept.read()


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS extraction_status, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN 'unreadable' END AS error_message, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS tries FROM customer")
def recovered_attempts(spark, sf_dir):
    """Attempts at all documents, of which a third had ended when the process was lost; the others are taken up once more."""
    ids = dm.sql(spark, sf_dir, "SELECT c_custkey AS id FROM customer").select(F.col("id").cast("bigint").alias("id"))
    tried = at.Attempts(fresh_table(spark, at.SCHEMA, "id"))
    tried.begin(ids)
    tried.end(ids.where("id % 3 = 0").withColumn("error_message", F.lit(None).cast("string")))
    tried.recover(ids, lambda rows: rows.withColumn("error_message", F.when(F.col("id") % 4 == 0, "unreadable")))
    return tried.table.read().select("id", "extraction_status", "error_message", "tries")


@query(f"SELECT concat('document', CAST(document_id AS varchar), '.pdf') AS path, page_number, text, NULL AS error FROM ({dm.PAGES})".replace("varchar", "VARCHAR"))
def native_pages(spark, sf_dir):
    """The text of all pages of PDF files, which are made of the conversations' turns."""
    return pdf.pages(made.pdf_files(dm.sql(spark, sf_dir, dm.PAGES)))


@query(qs.ORACLE_SQL["vector_topk_multi"])
def nearest_pruned(spark, sf_dir):
    """The same hits as vector_topk_multi, by pivots and the triangle inequality."""
    chunks = dm.sql(spark, sf_dir, dm.CHUNKS)
    queries = chunks.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits, _ = nn.nearest(nn.build(chunks), queries)
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM documents) AS n_documents, 5 AS n_types, true AS accurate, true AS calibrated")
def trained_types(spark, sf_dir):
    """A classifier learned from certificates made of all customers and from all documents, and how it does on those held back."""
    customers = dm.sql(spark, sf_dir, "SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS varchar) AS phone FROM customer")
    others = dm.sql(spark, sf_dir, "SELECT doc_id AS id, text FROM documents")
    rows = stored(ln.featured(ln.dealt(made.certificates(customers, others))), "certificates").withColumn("wanted", F.col("document_type"))
    model = ln.fit_types(rows, vectors="features")
    out = model.classify(rows.withColumn("held_out", ln.held_out()), vectors="features")
    right = F.when(F.col("held_out"), (F.col("document_type") == F.col("wanted")).cast("double"))
    told = out.agg(F.count(F.lit(1)).alias("n_documents"), F.avg(right).alias("share"), F.avg(F.when(F.col("held_out"), F.col("confidence"))).alias("sure"))
    return told.select("n_documents", F.lit(len(model.types)).alias("n_types"), (F.col("share") >= 0.95).alias("accurate"), (F.abs(F.col("share") - F.col("sure")) < 0.1).alias("calibrated"))


@query("SELECT (SELECT count(*) FROM part) AS n_sentences, true AS precise, true AS complete")
def trained_sentences(spark, sf_dir):
    """A ranker of sentences learned from tender sentences made of all parts, and its precision and recall on those held back."""
    rows = made.tender_sentences(dm.sql(spark, sf_dir, "SELECT p_partkey AS id, p_name AS name FROM part"))
    _, told = ln.fit_sentences(rows)
    return told.select((F.col("precision") >= 0.95).alias("precise"), (F.col("recall") >= 0.95).alias("complete")).crossJoin(rows.agg(F.count(F.lit(1)).alias("n_sentences")))  # a row each


@query("""
WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), e AS (SELECT user_id, ts, event_id AS other, event_type, value FROM events WHERE event_type <> 'view')
SELECT v.event_id, v.user_id, e.ts AS found_at, e.other, e.event_type, e.value FROM v ASOF LEFT JOIN e ON v.user_id = e.user_id AND v.ts >= e.ts
""")
def events_before_views(spark, sf_dir):
    """The last other event of a user before each view."""
    rows = dm.sql(spark, sf_dir, "SELECT event_id, user_id, ts, event_type, value FROM events")
    others = rows.where("event_type <> 'view'").withColumnRenamed("event_id", "other")
    out = tm.as_of(rows.where("event_type = 'view'").select("event_id", "user_id", "ts"), others, "user_id", "ts", ["other", "event_type", "value"], tie="other")
    return out.drop("ts")


SESSIONS = "SELECT event_id, user_id, ts AS starts, ts + INTERVAL 30 MINUTE AS ends, event_type FROM events"


@query(f"SELECT a.event_id, b.event_id AS other FROM ({SESSIONS}) a JOIN ({SESSIONS}) b ON a.user_id = b.user_id AND a.starts < b.ends AND b.starts < a.ends WHERE a.event_type = 'error' AND b.event_type <> 'error'")
def errors_meeting_others(spark, sf_dir):
    """Pairs of an error and another event of the same user within half an hour of each other."""
    rows = dm.sql(spark, sf_dir, SESSIONS)
    others = rows.where("event_type <> 'error'").select("user_id", "starts", "ends", F.col("event_id").alias("other"))
    return tm.overlapping(rows.where("event_type = 'error'"), others, "user_id", "starts", "ends", ["other"], seconds=3600).select("event_id", "other")


ORDER_CELLS = "SELECT CAST(o_orderkey % 100 AS int) AS tender_id, o_orderstatus AS status, year(o_orderdate) AS year, o_custkey, o_totalprice FROM orders"


@query(f"SELECT tender_id, status, year, CASE WHEN grouping(tender_id) = 0 THEN 'tender_id,' ELSE '' END || CASE WHEN grouping(status) = 0 THEN 'status,' ELSE '' END || CASE WHEN grouping(year) = 0 THEN 'year,' ELSE '' END AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, true AS distinct_near, true AS median_near FROM ({ORDER_CELLS}) GROUP BY CUBE (tender_id, status, year)")
def rolled_up_orders(spark, sf_dir):
    """Submissions rolled up by all sets of tender, status and year from stored cells, with sketches held against exact figures."""
    rows = dm.sql(spark, sf_dir, ORDER_CELLS)
    keys = ["tender_id", "status", "year"]
    cells = stored(rl.measured(rows, keys, "o_custkey", "o_totalprice"), "cells")
    told = rl.read_off(rl.grouping_sets(cells, keys), (0.5,))
    exact = rows.cube(*keys).agg(F.count_distinct("o_custkey").alias("people"), F.percentile("o_totalprice", F.array(F.lit(0.4), F.lit(0.6))).alias("middle"), F.grouping_id().alias("g"))
    exact = exact.withColumn("level", F.array_join(F.array_compact(F.array(*[F.when(F.expr(f"g & {4 >> n} = 0"), k) for n, k in enumerate(keys)])), ",")).alias("x")
    same = F.col("t.level") == F.col("x.level")
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"x.{k}"))
    near = (F.abs(F.col("n_distinct") - F.col("people")) <= 1 + 0.08 * F.col("people")).alias("distinct_near")
    middle = ((F.col("n") < 20) | F.col("q50").between(F.col("middle")[0] - 1, F.col("middle")[1] + 1)).alias("median_near")
    level = F.when(F.col("t.level") == "", "").otherwise(F.concat("t.level", F.lit(","))).alias("level")
    return told.alias("t").join(exact, same).select(*[f"t.{k}" for k in keys], level, "n", F.round(F.col("total").cast("double"), 2).alias("total"), "least", "most", near, middle)


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - n * INTERVAL 15 MINUTE AS window_start, upper(event_type) AS status FROM events, (SELECT unnest([0, 1, 2, 3]) AS n))
SELECT window_start, status, count(*) AS n_checks FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2
""")
def streamed_windows(spark, sf_dir):
    """Sliding windows over the stream of all events, as they close; written to the shared folder by the stream's own commits."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    files = new_path(spark, "arrived")
    events.write.parquet(files)
    rows = spark.readStream.schema(events.schema).parquet(files)
    told = sf.sliding_tallies(rows.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("status")), "at")
    out = new_path(spark, "windows")
    told.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(out)
