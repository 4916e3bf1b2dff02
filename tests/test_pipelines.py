import json

import pytest
from pyspark.sql import functions as F

from basalt.plans import pipelines as pl


def test_requirements_pipeline(spark):
    docs = spark.createDataFrame([("t1.pdf", "The bidder must hold GST registration. The sky is blue."), ("t2.pdf", "Turnover should exceed a limit. Udyam is required.")], "source_document string, text string")
    store = pl.ingest(None, docs)
    again = pl.ingest(store, docs.where("source_document = 't1.pdf'"))
    assert sorted(r.chunk_id for r in again.collect()) == ["t1.pdf:chunk:0", "t2.pdf:chunk:0"]
    questions = spark.createDataFrame([(1, 7, "gst registration", None), (2, 7, "gst registration", "t2.pdf"), (3, 7, " ", None)], "query_id int, tender_id int, text string, source_document string")
    hits = pl.retrieve(store, questions, k=1)
    assert {r.query_id: r.source_document for r in hits.collect()} == {1: "t1.pdf", 2: "t2.pdf"}
    stored = spark.createDataFrame([(7, "GST", "The bidder must hold GST registration.", "t1.pdf")], "tender_id int, requirement_type string, requirement_name string, source_document string")
    found, fresh = pl.add_requirements(stored, questions, hits)
    assert found.count() == 3 and sorted(r.requirement_type for r in fresh.collect()) == ["FINANCIAL", "UDYAM"]
    with pytest.raises(ValueError):
        pl.retrieve(store, questions, k=21)


def test_document_pipeline(spark):
    native = spark.createDataFrame([(1, 1, "GSTIN 29ABCDE1234F1Z5"), (2, 1, " "), (4, 1, "no kind of paper")], "document_id int, page_number int, text string")
    ocr = spark.createDataFrame([(2, 1, "Permanent Account Number ABCDE1234F"), (3, 1, "")], "document_id int, page_number int, text string")
    out = {r.document_id: r for r in pl.process_documents(native, ocr).collect()}
    first = json.loads(out[1].extracted_data)
    assert first["document_type"] == "GST_CERTIFICATE" and first["extraction_method"] == "NATIVE_PDF" and first["fields"]["gstin"] == "29ABCDE1234F1Z5" and "legal_name" in first["fields"]
    assert json.loads(out[2].extracted_data)["extraction_method"] == "OCR"
    assert [out[k].extraction_status for k in (1, 2, 3, 4)] == ["COMPLETED", "COMPLETED", "FAILED", "FAILED"]
    assert out[4].error_message == "unsupported document type" and out[3].extracted_data is None


def test_decisions(spark):
    submissions = spark.createDataFrame([(1, 10), (2, 10)], "id int, tender_id int")
    requirements = spark.createDataFrame([(5, 10, "GST", "n")], "id int, tender_id int, requirement_type string, requirement_name string")
    requests = spark.createDataFrame([(1, 5, None, {"status": "VERIFIED"})], "bid_submission_id int, tender_requirement_id int, extracted_data map<string,string>, verification_data map<string,string>")
    checks, out = pl.decide(requests, submissions, requirements)
    assert checks.count() == 1 and {r.bid_submission_id: r.status for r in out.collect()} == {1: "COMPLIANT", 2: "PENDING"}
    assert out.where(F.col("recommendation").contains("may proceed")).count() == 1
