import datetime
import random

import pytest
from pyspark.sql import functions as F

from basalt import schemas
from basalt.functions import text as tx
from basalt.operators import assess as asm
from basalt.operators import lookup as lk
from basalt.operators import validate as va
from basalt.operators import vectors as ve
from basalt.sources import providers as pv
from basalt.streaming import checks as st


@pytest.mark.parametrize(("statuses", "want"), [
    ([], (None, None, "PENDING")), (["PASS"] * 3, (100.0, "LOW", "COMPLIANT")), (["PASS", "review", "PASS"], (66.67, "MEDIUM", "REVIEW")),
    (["PASS", "FAIL", "PASS", "PASS"], (75.0, "HIGH", "NON_COMPLIANT")), (["PASS", "PENDING", "pass"], (66.67, "MEDIUM", "REVIEW")), (["PASS"] * 4 + ["WAIVED"], (80.0, "LOW", "REVIEW")), (["WAIVED"], (0.0, "MEDIUM", "REVIEW")),
])
def test_assessment(spark, statuses, want):
    checks = spark.createDataFrame([(1, s) for s in statuses], "bid_submission_id int, status string")
    r = asm.assess(spark.createDataFrame([(1,)], "bid_submission_id int"), checks).first()
    assert (r.score, r.risk_level, r.status) == want
    assert r.total_checks == len(statuses) and (r.summary == asm.NO_CHECKS) == (not statuses)


def test_scores_round_like_python(spark):
    counts = [(t, p) for t in range(1, 120) for p in range(t + 1)]
    df = spark.createDataFrame(counts, "total_checks long, passed long")
    assert all(r.score == round(r.passed / r.total_checks * 100, 2) for r in df.withColumn("score", asm.score()).collect())


def test_recommendation(spark):
    latest = spark.createDataFrame([(1, "COMPLIANT"), (2, "COMPLIANT"), (3, "COMPLIANT"), (4, "compliant"), (5, None)], "bid_submission_id int, status string")
    checks = spark.createDataFrame([(1, "pass"), (2, "PENDING"), (3, "FAIL"), (3, "REVIEW")], "bid_submission_id int, status string")
    out = {r.bid_submission_id: r for r in asm.recommend(latest, checks).collect()}
    assert [out[k].recommendation for k in (1, 2, 3, 4, 5)] == [asm.MAY_PROCEED, asm.MANUAL_REVIEW, asm.DO_NOT_PROCEED, asm.FURTHER_REVIEW, None]
    assert out[5].error.endswith(": 5")


def chunks_in_python(text, size, overlap):
    t, out, start, k = " ".join(text.split()), [], 0, 0
    while t:
        piece = t[start : start + size].strip()
        if piece:
            out.append((k, piece))
        if start + size >= len(t):
            break
        start, k = start + size - overlap, k + 1
    return out


def test_chunks_match_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\t \n\x0b\x1c\x85 \xa0é") for _ in range(rng.randrange(400))) for _ in range(120)] + ["", "   ", None, "x" * 1000]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "source_document string, text string")
    for size, overlap in ((10, 3), (50, 0), (1000, 200)):
        got = {}
        for r in tx.chunk(df, size=size, overlap=overlap).collect():
            assert r.chunk_id == f"{r.source_document}:chunk:{r.chunk_index}"
            got.setdefault(int(r.source_document), []).append((r.chunk_index, r.text))
        for k, t in enumerate(texts):
            assert sorted(got.get(k, [])) == chunks_in_python(t or "", size, overlap)
    for bad in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            tx.chunk(df, size=bad[0], overlap=bad[1])


def test_pages(spark):
    pages = spark.createDataFrame([(1, 2, " b\n"), (1, 1, "a "), (1, 3, "\t"), (2, 1, " ")], "document_id int, page_number int, text string")
    assert {r.document_id: r.combined for r in tx.combine_pages(pages).collect()} == {1: "a\n\nb", 2: ""}
    assert {r.document_id: (r.total_pages, r.total_characters, r.has_text) for r in tx.page_totals(pages).collect()} == {1: (3, 6, True), 2: (1, 1, False)}
    ocr = spark.createDataFrame([(2, 1, "seen"), (3, 1, "only")], "document_id int, page_number int, text string")
    assert {r.document_id: (r.extraction_method, r.combined) for r in tx.choose_text(pages, ocr).collect()} == {1: ("NATIVE_PDF", "a\n\nb"), 2: ("OCR", "seen"), 3: ("OCR", "only")}


def test_labels(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("NON_COMPLIANT", 0.975, 80.0, "Moderate risk", "/a/B.PDF"), ("", 0.005, 59.99, "CRITICAL", ".pdf"), ("X", 1.0, 60.0, "odd", "a.pdf.txt")], "s string, c double, v double, r string, p string")
    rows = df.select(tx.status_label(F.col("s")), tx.percent_label(F.col("c")), tx.score_class(F.col("v")), tx.risk_class(F.col("r")), tx.is_pdf(F.col("p")), tx.score_label(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [("UNKNOWN", "—", "unknown", "unknown", False, "—"), ("NON COMPLIANT", "98%", "good", "medium", True, "80.0"), ("UNKNOWN", "1%", "danger", "high", False, "60.0"), ("X", "100%", "warning", "unknown", False, "60.0")]


def test_latest_and_history(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 7, t), (2, 7, t), (3, 8, t)], "id int, doc int, created_at timestamp_ntz")
    assert sorted(r.id for r in lk.latest(df, "doc").collect()) == [2, 3]
    docs = spark.createDataFrame([(7,), (9,)], "doc int")
    assert sorted((r.doc, r.id) for r in lk.with_latest(docs, df, "doc").collect() if r.id) == [(7, 2)]


def test_natural_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, gstin string")
    fresh, conflicts = lk.accept_new(rows, spark.createDataFrame([("b",)], "gstin string"), ["gstin"], ["id"])
    assert sorted(r.id for r in fresh.collect()) == [1, 4, 5] and sorted(r.id for r in conflicts.collect()) == [2, 3]


def test_new_requirements_match_one_by_one(spark):
    rng = random.Random(3)
    cands = [(k, rng.randrange(2), rng.choice("GU"), rng.choice("xy"), rng.choice(["p", "q", None])) for k in range(60)]
    stored = [(0, "G", "x", "p"), (1, "U", "y", None)]
    have, want = list(stored), []
    for k, t, a, b, s in cands:
        if not any((t, a, b) == h[:3] and (s is None or s == h[3]) for h in have):
            have.append((t, a, b, s))
            want.append(k)
    cols = "tender_id int, requirement_type string, requirement_name string, source_document string"
    out = lk.new_requirements(spark.createDataFrame(cands, "k int, " + cols), spark.createDataFrame(stored, cols), ["k"])
    assert sorted(r.k for r in out.collect()) == want


def test_patch_sets_nulls(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "id int, status string, reason string")
    changes = spark.createDataFrame([(1, None, None, ["reason"])], "id int, status string, reason string, set_fields array<string>")
    assert sorted(map(tuple, lk.patch(rows, changes, "id", ["status", "reason"]).collect())) == [(1, "a", None), (2, "a", "b")]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")
    assert sorted(map(tuple, ve.upsert_chunks(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert [r.chunk_id for r in ve.delete_chunks(old, new).collect()] == ["a"]
    assert ve.upsert_chunks(old, new.limit(0)).count() == 2


def test_top_k(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"c{k}", "s" if k % 2 else "t", [rng.random() for _ in range(4)]) for k in range(50)]
    df = spark.createDataFrame(rows, "chunk_id string, source_document string, embedding array<double>")
    q = [0.1, 0.2, 0.3, 0.4]
    dist = lambda v: sum((a - b) ** 2 for a, b in zip(v, q, strict=True))
    want = [c for c, _, _ in sorted(rows, key=lambda r: (dist(r[2]), r[0]))]
    assert [r.chunk_id for r in ve.top_k(df, q, 7).collect()] == want[:7]
    assert [r.chunk_id for r in ve.top_k(df, q, 99, "s").collect()] == [c for c in want if int(c[1:]) % 2]
    monkeypatch.setattr(ve, "BLOCK", 1)
    many = ve.top_k_many(df, spark.createDataFrame([(1, q), (2, rows[3][2])], "query_id int, query_vector array<double>"), 7)
    assert [r.chunk_id for r in many.where("query_id = 1").orderBy("rank").collect()] == want[:7]
    assert many.where("query_id = 2 and rank = 1").first().chunk_id == "c3"
    with pytest.raises(ValueError):
        ve.top_k(df, q, 0)


def test_replies(spark):
    rows = [(1, "PAN", '{"fields": {"name": "N"}, "confidence": 0.9}', None), (2, "PAN", '{"fields": {"nam": "N"}, "confidence": 0.9}', "unknown field"), (3, "PAN", '{"confidence": 1.2}', "confidence out of bounds"), (4, "PAN", '{"fields": {}}', "no confidence"), (5, "PAN", "[1]", "invalid JSON"), (6, "PAN", "{", "invalid JSON"), (7, "PAN", None, "empty reply"), (8, "UNKNOWN", "{}", "unsupported document type"), (9, None, "{}", "unsupported document type")]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, document_type string, reply string")
    out = {r.id: r for r in va.validate_fields(df).collect()}
    assert {k: out[k].error for k in out} == {r[0]: r[3] for r in rows} and out[1].fields == {"name": "N"}
    pairs = spark.createDataFrame([("PAN", "PAN"), ("PAN", "INCOME_TAX"), ("PAN", None), ("UNKNOWN", None), ("UNKNOWN", "PAN")], "document_type string, record_type string")
    assert [r.error is None for r in va.validate_record_type(pairs).collect()] == [True, False, False, True, False]


def test_requirement_replies(spark):
    good = '{"requirement_type":"GST","requirement_name":"n","description":"d","is_required":true,"source_document":"s","source_chunk_ids":["c"]}'
    replies = spark.createDataFrame([(1, f'{{"requirements":[{good},{good.replace(chr(34) + "c" + chr(34), "")},{good.replace("true", "null")}]}}'), (2, "no")], "query_id int, reply string")
    assert [r.error for r in va.validate_requirements(replies).orderBy("ordinal").collect()] == ["invalid JSON", None, "source_chunk_ids", "is_required"]


def test_adapters(spark):
    v = spark.createDataFrame([("VERIFIED", "ID1", {"pan_status": "ACTIVE", "status": "no"}), ("ERROR", "ID2", None)], "verification_status string, identifier string, verified_data map<string,string>")
    assert [r.verification_data for r in va.verification_input(v, "pan").collect()] == [{"status": "VERIFIED", "pan": "ID1", "pan_status": "ACTIVE"}, {"status": "ERROR", "pan": "ID2"}]
    e = spark.createDataFrame([('{"fields": {"pan_number": "P", "x": null}}',)], "extracted_data string")
    assert va.extraction_input(e).first().extracted_data == {"pan": "P", "x": None}
    p = spark.createDataFrame([({"a": "1"}, None), ({"a": None, "b": "1"}, None), ({"a": None}, None), ({"a": "1"}, "x")], "fields map<string,string>, error string")
    assert [r[0] for r in p.select(va.processing_status()).collect()] == ["SUCCESS", "PARTIAL", "FAILED", "FAILED"]
    s = spark.createDataFrame([(True, "NOT_FOUND"), (True, "ERROR"), (False, "PENDING"), (False, "VERIFIED"), (None, None)], "success boolean, verification_status string")
    assert [r[0] for r in s.select(va.provider_status()).collect()] == [True, False, True, False, False]


def test_transitions_and_cross_verification(spark):
    rows = spark.createDataFrame([(1, None), (2, "broken")], "id int, fault string")
    assert [(r.extraction_status, r.error_message) for r in lk.transition(rows, F.col("fault")).collect()] == [("COMPLETED", None), ("FAILED", "broken")]
    ids = spark.createDataFrame([("a", "a", "a"), ("a", "b", "a"), ("a", None, "a"), ("a", "", "b"), (None, None, None)], "x string, y string, z string")
    assert [r.match for r in lk.cross_verify(ids, ["x", "y", "z"]).collect()] == ["MATCH", "MISMATCH", "INCOMPLETE", "MISMATCH", "INCOMPLETE"]


def test_schemas(spark):
    for table in schemas.TABLES:
        assert schemas.schema(table).names[0] == "id"
    df = schemas.with_defaults(spark.createDataFrame([(1, 2, "GST", "x" * 300)], "id int, tender_id int, requirement_type string, requirement_name string"), "tender_requirements")
    r = df.withColumn("faults", schemas.faults("tender_requirements")).first()
    assert r.is_required is True and r.faults == ["requirement_name", "created_at", "updated_at"]
    users = spark.createDataFrame([], schemas.schema("users"))
    assert "hashed_password" not in schemas.response(users, "users").columns


def test_providers(spark):
    docs = spark.createDataFrame([(1, "GSTIN 29ABCDE1234F1Z5, Goods and Services Tax"), (2, "nothing"), (3, " "), (4, None)], "id int, text string")
    assert [(r.document_type, r.error is None) for r in pv.classify(docs).orderBy("id").collect()] == [("GST_CERTIFICATE", True), ("UNKNOWN", True), (None, False), (None, False)]
    assert pv.extract_fields(docs).orderBy("id").first().gstin == "29ABCDE1234F1Z5"
    vectors = pv.embed(docs).orderBy("id").collect()
    assert abs(sum(x * x for x in vectors[0].embedding) - 1) < 1e-5 and vectors[2].embedding is None and vectors[3].embedding is None
    chunk = spark.createDataFrame([("c", "s", "A bidder must hold GST. It rains. Turnover should be high.")], "chunk_id string, source_document string, text string")
    assert [(r.requirement_type, r.is_required) for r in pv.extract_requirements(chunk).orderBy("ordinal").collect()] == [("GST", True), ("FINANCIAL", False)]


def test_pdf_pages_report_faults(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"no pdf")
    (tmp_path / "b.txt").write_bytes(b"")
    rows = pv.pdf_pages(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].error and rows[0].text is None
    for bad in ({"dpi": 0}, {"language": " "}):
        with pytest.raises(ValueError):
            pv.pdf_pages(spark, str(tmp_path), **bad)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 5), "GST", "n", None, {"status": "VERIFIED"}), (2, datetime.datetime(2024, 1, 1, 6), "X", "n", None, None)], "id int, at timestamp, requirement_type string, requirement_name string, extracted_data map<string,string>, verification_data map<string,string>")
    rows.write.parquet(str(tmp_path / "in"))
    checks = st.evaluate_stream(st.read_inputs(spark, str(tmp_path / "in"), rows.schema))
    for name, df, mode in (("checks", checks.select("id", "status"), "append"), ("tally", st.tally_stream(checks, "at"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("checks").collect())) == [(1, "PASS"), (2, "REVIEW")]
    assert spark.table("tally").count() == 2
