"""Validation of what models return: JSON of a closed schema, bounds, and agreement of type and record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.schemas import DOCUMENT_TYPES, RECORD_FIELDS


def parses(raw: Column) -> Column:
    """Is it a JSON object?"""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))


def confidence_of(raw: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(raw), "$.confidence", "double")


def bounded(value: Column) -> Column:
    return F.coalesce(value.between(0, 1), F.lit(False))


def validate_classification(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """replies with document_type, confidence and error (null if valid)."""
    r = F.col(raw)
    kind = F.get_json_object(r, "$.document_type")
    error = (
        F.when(F.coalesce(F.trim(r), F.lit("")) == "", "empty reply").when(~parses(r), "invalid JSON")
        .when(~F.coalesce(kind.isin(*DOCUMENT_TYPES), F.lit(False)), "unknown document type").when(confidence_of(r).isNull(), "no confidence").when(~bounded(confidence_of(r)), "confidence out of bounds")
    )
    return replies.withColumns({"document_type": kind, "confidence": confidence_of(r), "error": error})


def validate_fields(replies: DataFrame, raw: str = "reply", kind: str = "document_type") -> DataFrame:
    """replies ({"fields": {...}, "confidence": x}) with fields (a map), confidence and error (null if valid).

    Fields that the document type doesn't know are errors, and so is a type without a record.
    """
    r = F.col(raw)
    fields = F.coalesce(F.get_json_object(r, "$.fields"), F.lit("{}"))
    known = F.create_map(*[x for k, v in RECORD_FIELDS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    allowed = F.try_element_at(known, F.col(kind))
    error = (
        F.when(allowed.isNull(), "unsupported document type").when(F.coalesce(F.trim(r), F.lit("")) == "", "empty reply").when(~parses(r), "invalid JSON")
        .when(confidence_of(r).isNull(), "no confidence").when(~bounded(confidence_of(r)), "confidence out of bounds")
        .when(F.size(F.array_except(F.coalesce(F.json_object_keys(fields), F.array().cast("array<string>")), allowed)) > 0, "unknown field")
    )
    out = replies.withColumn("error", error)
    return out.withColumns({"fields": F.when(F.col("error").isNull(), F.from_json(fields, "map<string,string>")), "confidence": confidence_of(r)})


def validate_record_type(rows: DataFrame, kind: str = "document_type", record: str = "record_type") -> DataFrame:
    """rows with error where the record isn't of the document's type; UNKNOWN has none."""
    fault = F.when(F.col(kind) == "UNKNOWN", F.when(F.col(record).isNotNull(), "an unknown document has no record")).when(~F.col(kind).eqNullSafe(F.col(record)), "record and document type differ")
    return rows.withColumn("error", fault)


REQUIREMENT_REPLY = "requirements array<struct<requirement_type:string,requirement_name:string,description:string,is_required:boolean,validation_config:string,source_document:string,source_chunk_ids:array<string>>>"


def validate_requirements(replies: DataFrame, raw: str = "reply", keep: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """A row for each requirement of each reply, with error: missing type, name, description, flag, source or chunk ids.

    A reply that is empty, no JSON object, or without requirements gives one row with that error, ordinal null.
    """
    r = F.col(raw)
    whole = F.when(F.coalesce(F.trim(r), F.lit("")) == "", "empty reply").when(~parses(r), "invalid JSON").when(F.from_json(raw, REQUIREMENT_REPLY)["requirements"].isNull(), "no requirements")
    parsed = replies.select(*keep, F.when(parses(r), F.from_json(raw, REQUIREMENT_REPLY)).alias("r"), whole.alias("__whole"))
    rows = parsed.select(*keep, "__whole", F.posexplode_outer("r.requirements").alias("ordinal", "q")).where("ordinal is not null or __whole is not null").select(*keep, "__whole", "ordinal", "q.*")
    error = F.when(F.col("__whole").isNotNull(), F.col("__whole")).when(F.col("is_required").isNull(), "is_required")
    for c in ("requirement_type", "requirement_name", "description", "source_document"):
        error = error.when(F.coalesce(c, F.lit("")) == "", c)
    return rows.withColumn("error", error.when(F.coalesce(F.size("source_chunk_ids"), F.lit(-1)) < 1, "source_chunk_ids")).drop("__whole")


def extraction_json() -> Column:
    """The stored form of a finished extraction, null fields kept."""
    inner = F.struct("document_type", "classification_confidence", "extraction_method", "total_pages", "total_characters", "fields")
    return F.to_json(inner, {"ignoreNullFields": "false"})


def verification_input(results: DataFrame, id_key: str) -> DataFrame:
    """Stored verification results as the rules read them: status and the identifier beside the verified data."""
    own = F.create_map(F.lit("status"), F.col("verification_status"), F.lit(id_key), F.col("identifier"))
    rest = F.map_filter(F.coalesce("verified_data", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~k.isin("status", id_key))
    return results.withColumn("verification_data", F.map_concat(own, rest))


def extraction_input(extractions: DataFrame) -> DataFrame:
    """Stored extractions as the rules read them: fields at the top, pan for pan_number."""
    fields = F.from_json(F.get_json_object("extracted_data", "$.fields"), "map<string,string>")
    return extractions.withColumn("extracted_data", F.transform_keys(fields, lambda k, _: F.when(k == "pan_number", "pan").otherwise(k)))


def provider_status(success: str = "success", status: str = "verification_status") -> Column:
    """Is a provider record in order? A success is VERIFIED, NOT_FOUND or INVALID, a failure PENDING or ERROR."""
    good = F.col(status).isin("VERIFIED", "NOT_FOUND", "INVALID")
    return F.coalesce(F.when(F.col(success), good).otherwise(F.col(status).isin("PENDING", "ERROR")), F.lit(False))


RECORD = "struct<success:boolean,provider:string,identifier:string,verification_status:string,data:map<string,string>,message:string,errors:array<string>>"


def provider_record(results: DataFrame, provider: str = "provider", success: str = "success", identifier: str = "identifier", status: str = "verification_status", data: str = "data", message: str = "message", errors: str = "errors") -> DataFrame:
    """results with `record`, what every verification provider returns, and `faults`, the names of its members that are out of order.

    A record names its provider and identifier, says whether the provider worked, and a status that goes with that; one that
    worked has no errors, one that didn't has a message or errors, and data only with VERIFIED. Missing data are an empty map,
    missing errors an empty list, errors that are blank are left out. Repeated rows fare alike; empty table: no rows.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    told = F.filter(F.coalesce(F.col(errors), F.array().cast("array<string>")), lambda e: F.coalesce(F.trim(e), F.lit("")) != "")
    held = F.coalesce(F.col(data), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    record = F.struct(F.col(success).alias("success"), F.col(provider).alias("provider"), F.col(identifier).alias("identifier"), F.col(status).alias("verification_status"), held.alias("data"), F.col(message).alias("message"), told.alias("errors")).cast(RECORD)
    failed = ~F.coalesce(F.col(success), F.lit(False))
    faults = {
        "success": F.col(success).isNull(), "provider": blank(provider), "identifier": blank(identifier), "verification_status": ~provider_status(success, status),
        "data": (F.size(held) > 0) & ~F.coalesce(F.col(status) == "VERIFIED", F.lit(False)), "message": failed & blank(message) & (F.size(told) == 0), "errors": ~failed & (F.size(told) > 0),
    }
    return results.withColumns({"record": record, "faults": F.array_compact(F.array(*[F.when(bad, name) for name, bad in faults.items()]))})


def processing_status(fields: str = "fields", error: str = "error") -> Column:
    """SUCCESS, PARTIAL if some field is null, FAILED with an error or without any field."""
    values = F.map_values(F.col(fields))
    some = F.coalesce(F.exists(values, lambda v: v.isNotNull()), F.lit(False))
    return F.when(F.col(error).isNotNull() | ~some, "FAILED").when(F.exists(values, lambda v: v.isNull()), "PARTIAL").otherwise("SUCCESS")
