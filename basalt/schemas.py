"""Table schemas, vocabularies and column defaults of the procurement domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"int": T.IntegerType(), "str": T.StringType(), "text": T.StringType(), "bool": T.BooleanType(), "float": T.DoubleType(), "ts": T.TimestampNTZType(), "json": T.MapType(T.StringType(), T.StringType()), "list": T.ArrayType(T.StringType())}

# The tables of the domain. A question mark marks a nullable column, a number a length limit.
TABLES = {
    "users": "id int, full_name str 255, email str 255, hashed_password str 255, role str 50, created_at ts, updated_at ts",
    "bidders": "id int, company_name str 255, gstin str? 15, pan str? 10, udyam_number str? 50, contact_email str? 255, contact_phone str? 20, created_at ts, updated_at ts",
    "tenders": "id int, title str 500, reference_number str 100, description text?, status str 50, created_at ts, updated_at ts",
    "tender_requirements": "id int, tender_id int, requirement_type str 100, requirement_name str 255, description text?, is_required bool, validation_config text?, source_document str? 255, source_chunk_ids list?, created_at ts, updated_at ts",
    "bid_submissions": "id int, tender_id int, bidder_id int, status str 50, submitted_at ts, created_at ts, updated_at ts",
    "bid_documents": "id int, bid_submission_id int, document_type str 100, file_name str 500, file_path str 1000, content_type str? 100, file_size int?, status str 50, uploaded_at ts, created_at ts, updated_at ts",
    "document_extractions": "id int, bid_document_id int, extraction_status str 50, extracted_data json?, extracted_text text?, confidence_score float?, extractor_name str? 100, extractor_version str? 50, error_message text?, started_at ts?, completed_at ts?, created_at ts",
    "verification_results": "id int, bid_submission_id int, bid_document_id int?, provider str 100, verification_type str 100, identifier str 255, verification_status str 50, verified_data json?, message text?, error_message text?, checked_at ts, created_at ts",
    "compliance_checks": "id int, bid_submission_id int, tender_requirement_id int, status str 50, reason text?, evidence json?, checked_by str? 100, checked_at ts?, created_at ts, updated_at ts",
    "compliance_assessments": "id int, bid_submission_id int, score float?, risk_level str? 50, recommendation text?, status str 50, summary text?, assessment_metadata json?, assessed_at ts?, created_at ts, updated_at ts",
    "audit_logs": "id int, user_id int?, action str 100, entity_type str 100, entity_id int?, old_value json?, new_value json?, details text?, ip_address str? 45, created_at ts",
}
UNIQUE = {"users": [("email",)], "bidders": [("gstin",), ("pan",), ("udyam_number",)], "tenders": [("reference_number",)], "bid_submissions": [("tender_id", "bidder_id")]}
DEFAULTS = {
    "users": {"role": "PROCUREMENT_OFFICER"}, "tenders": {"status": "DRAFT"}, "tender_requirements": {"is_required": True}, "bid_submissions": {"status": "SUBMITTED"},
    "bid_documents": {"status": "UPLOADED"}, "document_extractions": {"extraction_status": "PENDING"}, "compliance_checks": {"status": "PENDING"}, "compliance_assessments": {"status": "PENDING"},
}
#: What a table shows to callers: all columns but these.
HIDDEN = {"users": ["hashed_password"], "bidders": ["updated_at"], "bid_submissions": ["updated_at"], "bid_documents": ["created_at", "updated_at"]}

# Vocabularies.
DOCUMENT_TYPES = ("GST_CERTIFICATE", "UDYAM_CERTIFICATE", "PAN", "INCOME_TAX", "UNKNOWN")
TEXT_METHODS = ("NATIVE_PDF", "OCR")
EXTRACTION_STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
CHECK_STATUSES = ("PASS", "FAIL", "REVIEW", "PENDING")
VERIFICATION_STATUSES = ("VERIFIED", "NOT_FOUND", "INVALID", "PENDING", "ERROR")
OFFICER_DECISIONS = ("QUALIFIED", "DISQUALIFIED", "MANUAL_REVIEW")
REQUIREMENT_TYPES = ("GST", "UDYAM", "PAN", "INCOME_TAX", "EPFO", "ESIC", "STARTUP_INDIA", "NSIC", "OEM", "LOCAL_CONTENT", "BLACKLISTING", "EXPERIENCE", "FINANCIAL", "DOCUMENT", "OTHER")
RECORD_FIELDS = {
    "GST_CERTIFICATE": ("gstin", "legal_name", "trade_name", "registration_date", "status"),
    "UDYAM_CERTIFICATE": ("udyam_number", "enterprise_name", "organisation_type", "major_activity", "registration_date"),
    "PAN": ("pan_number", "name", "date_of_birth_or_incorporation"),
    "INCOME_TAX": ("pan_number", "assessment_year", "acknowledgement_number", "filing_date", "gross_total_income", "total_income"),
}


def columns_of(table: str) -> list[tuple[str, str, bool, int | None]]:
    """(name, kind, nullable, length limit) of each column."""
    out = []
    for column in TABLES[table].split(", "):
        name, kind, *limit = column.split()
        out.append((name, kind.rstrip("?"), kind.endswith("?"), int(limit[0]) if limit else None))
    return out


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, KINDS[k], nullable) for n, k, nullable, _ in columns_of(table)])


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """All columns of the table: those missing are null, then defaults fill nulls."""
    have, fill = set(df.columns), DEFAULTS.get(table, {})
    out = []
    for f in schema(table):
        value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, F.lit(fill[f.name])) if f.name in fill else value).alias(f.name))
    return df.select(*out)


def response(df: DataFrame, table: str) -> DataFrame:
    """The columns that callers see."""
    return df.select(*[n for n, *_ in columns_of(table) if n not in HIDDEN.get(table, []) and n in df.columns])


def unique_faults(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """key, column names: rows whose unique columns others bear too; nulls never clash."""
    out = None
    for names in UNIQUE.get(table, []):
        full = F.lit(True)
        for n in names:
            full = full & F.col(n).isNotNull()
        rows = df.where(full)
        twice = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
        found = rows.join(twice, list(names)).select(key, F.lit(", ".join(names)).alias("columns"))
        out = found if out is None else out.union(found)
    return out


def faults(table: str) -> Column:
    """Names of the columns whose value is null though required, or too long."""
    tests = []
    for name, kind, nullable, limit in columns_of(table):
        if not nullable:
            tests.append(F.when(F.col(name).isNull(), F.lit(name)))
        if limit and kind == "str":
            tests.append(F.when(F.char_length(name) > limit, F.lit(name)))
    return F.array_distinct(F.array_compact(F.array(*tests)))
