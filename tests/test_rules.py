import pytest

from basalt.operators import rules as ru

SCHEMA = "id int, requirement_type string, requirement_name string, extracted_data map<string,string>, verification_data map<string,string>"

# one case for each row of each decision list: (type, document, verification) -> status, start of the reason, evidence
CASES = [
    ("GST", None, {}, "REVIEW", "No GST evidence", {}),
    ("GST", {"gstin": "A"}, {"gstin": "B", "status": "INVALID"}, "REVIEW", "GSTIN mismatch", {"document_gstin": "A", "verified_gstin": "B"}),
    ("GST", {"gstin": "A"}, {"status": "INVALID"}, "FAIL", "GST registration could not", {"gstin": "A", "verification_status": "INVALID"}),
    ("GST", None, {"gstin": "B", "status": "VERIFIED", "return_filing_status": "NON_COMPLIANT"}, "FAIL", "GST return filing is non", {"gstin": "B", "return_filing_status": "NON_COMPLIANT"}),
    ("GST", {"gstin": "A"}, None, "REVIEW", "GST registration verification evidence", {"gstin": "A", "verification_status": None, "return_filing_status": None}),
    ("GST", {"gstin": None}, None, "REVIEW", "GST registration verification evidence", {"gstin": None, "verification_status": None, "return_filing_status": None}),
    ("gst", {"gstin": ""}, {"gstin": "B", "status": "VERIFIED"}, "PASS", "GST registration is verified", {"gstin": "B", "verification_status": "VERIFIED", "return_filing_status": None}),
    ("GST", {}, {"gstin": "B", "status": "VERIFIED", "return_filing_status": "compliant"}, "REVIEW", "GST return filing status requires", {"gstin": "B", "verification_status": "VERIFIED", "return_filing_status": "compliant"}),
    ("UDYAM", {}, None, "REVIEW", "No Udyam/MSME evidence", {}),
    ("UDYAM", {"udyam_number": "A"}, {"udyam_number": "B"}, "REVIEW", "Udyam number mismatch", {"document_udyam_number": "A", "verified_udyam_number": "B"}),
    ("UDYAM", {"udyam_number": "A"}, {"udyam_number": "A", "status": "INVALID"}, "FAIL", "Udyam/MSME registration could not", {"udyam_number": "A", "verification_status": "INVALID"}),
    ("UDYAM", None, {"status": "VERIFIED", "enterprise_status": "INACTIVE"}, "FAIL", "Udyam/MSME enterprise is not active", {"udyam_number": None, "enterprise_status": "INACTIVE"}),
    ("UDYAM", None, {"status": "PENDING"}, "REVIEW", "Udyam/MSME verification evidence", {"udyam_number": None, "verification_status": "PENDING", "enterprise_status": None}),
    ("UDYAM", None, {"status": "VERIFIED", "enterprise_status": "ACTIVE"}, "PASS", "Udyam/MSME registration is verified", {"udyam_number": None, "verification_status": "VERIFIED", "enterprise_status": "ACTIVE"}),
    ("UDYAM", None, {"status": "VERIFIED", "enterprise_status": "?"}, "REVIEW", "Udyam/MSME enterprise status", {"udyam_number": None, "verification_status": "VERIFIED", "enterprise_status": "?"}),
    ("INCOME_TAX", {"pan": "A"}, {"status": "VERIFIED", "pan_status": "INACTIVE", "income_tax_compliance": "NON_COMPLIANT"}, "FAIL", "PAN is not active", {"pan": "A", "pan_status": "INACTIVE"}),
    ("INCOME_TAX", {"pan": "A"}, {"status": "VERIFIED", "income_tax_compliance": "NON_COMPLIANT"}, "FAIL", "Income Tax compliance requirements are not", {"pan": "A", "pan_status": None, "income_tax_compliance": "NON_COMPLIANT"}),
    ("INCOME_TAX", {"pan": "A"}, {"status": "VERIFIED", "pan_status": "odd"}, "PASS", "PAN is verified", {"pan": "A", "verification_status": "VERIFIED", "pan_status": "odd", "income_tax_compliance": None}),
    ("INCOME_TAX", {"pan": "A"}, {"status": "VERIFIED", "income_tax_compliance": "odd"}, "REVIEW", "Income Tax compliance status", {"pan": "A", "verification_status": "VERIFIED", "pan_status": None, "income_tax_compliance": "odd"}),
    ("EPFO", {"x": "y"}, None, "REVIEW", ru.NO_RULES + "EPFO", {"requirement_type": "EPFO", "requirement_name": "name"}),
]


def test_decision_lists(spark):
    df = spark.createDataFrame([(k, c[0], "name", c[1], c[2]) for k, c in enumerate(CASES)], SCHEMA)
    for r in ru.evaluate(df).collect():
        assert (r.status, r.reason[: len(CASES[r.id][4])], r.evidence) == CASES[r.id][3:], r


def test_evaluation_is_one_projection(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = ru.evaluate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_registry():
    r = ru.default_registry()
    assert r.get("gst") is r.get("GST") and r.get("OEM") is None
    with pytest.raises(ValueError):
        r.register(ru.GST)
    r.register(ru.shape("OEM", "oem", dict.fromkeys(("nothing", "differ", "invalid", "unverified", "pass", "else"), "x"), ("s",), (("s", "BAD", "bad"),), ("s", "GOOD")))
    assert r.get("oem").id_key == "oem"


def test_record_checks(spark):
    submissions = spark.createDataFrame([(1, 10), (2, 20)], "id int, tender_id int")
    requirements = spark.createDataFrame([(5, 10, "GST", "stored")], "id int, tender_id int, requirement_type string, requirement_name string")
    requests = spark.createDataFrame([(1, 5, None, {"status": "VERIFIED"}, "UDYAM"), (9, 5, None, None, "GST"), (1, 6, None, None, "GST"), (2, 5, None, None, "GST")], "bid_submission_id int, tender_requirement_id int, extracted_data map<string,string>, verification_data map<string,string>, requirement_type string")
    out = {(r.bid_submission_id, r.tender_requirement_id): r for r in ru.record_checks(requests, submissions, requirements).collect()}
    assert out[1, 5].status == "PASS" and out[1, 5].requirement_name == "stored" and out[1, 5].checked_by == "COMPLIANCE_ENGINE"
    assert out[9, 5].error == "Bid submission not found: 9" and out[9, 5].status is None
    assert out[1, 6].error == "Tender requirement not found: 6" and "does not belong" in out[2, 5].error
