"""Compliance rules: decision lists compiled to one `when` chain for each output column.

A rule set is data: rules of (condition, status, reason, evidence). The first rule that holds decides.
Conditions are SQL over four names: `document` and `verified` are the two identifiers (an empty one counts
as none), `identifier` is the verified one or else the document's, and ver['x'] is a verification value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    condition: str
    status: str
    reason: str
    #: evidence key -> `document`, `verified`, `identifier`, or a verification key
    evidence: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RuleSet:
    requirement_type: str
    id_key: str
    rules: tuple[Rule, ...]


NOTHING, DIFFER = "nothing", "document <> verified"


def shape(requirement_type: str, id_key: str, reasons: dict[str, str], signals: tuple[str, ...], bad: tuple[tuple[str, str, str], ...], good: tuple[str, str]) -> RuleSet:
    """The shape the sets share: no evidence, ids differ, invalid, bad signals, not verified, good signal, else."""
    seen = {id_key: "identifier", "verification_status": "status"}
    all_of = seen | {s: s for s in signals}
    rules = [
        Rule(NOTHING, "REVIEW", reasons["nothing"]),
        Rule(DIFFER, "REVIEW", reasons["differ"], {f"document_{id_key}": "document", f"verified_{id_key}": "verified"}),
        Rule("ver['status'] = 'INVALID'", "FAIL", reasons["invalid"], seen),
    ]
    told = {id_key: "identifier"}
    for signal, value, reason in bad:
        told = told | {signal: signal}
        rules.append(Rule(f"ver['{signal}'] = '{value}'", "FAIL", reason, dict(told)))
    signal, value = good
    rules += [
        Rule("NOT (ver['status'] <=> 'VERIFIED')", "REVIEW", reasons["unverified"], all_of),
        Rule(f"ver['{signal}'] IS NULL OR ver['{signal}'] = '{value}'", "PASS", reasons["pass"], all_of),
        Rule("true", "REVIEW", reasons["else"], all_of),
    ]
    return RuleSet(requirement_type, id_key, tuple(rules))


# The reasons as they are reported.
GST = shape("GST", "gstin", {
    "nothing": "No GST evidence is available.",
    "differ": "GSTIN mismatch between document evidence and verification data.",
    "invalid": "GST registration could not be verified.",
    "unverified": "GST registration verification evidence is incomplete.",
    "pass": "GST registration is verified and no non-compliant return filing status was identified.",
    "else": "GST return filing status requires review.",
}, ("return_filing_status",), (("return_filing_status", "NON_COMPLIANT", "GST return filing is non-compliant."),), ("return_filing_status", "COMPLIANT"))
UDYAM = shape("UDYAM", "udyam_number", {
    "nothing": "No Udyam/MSME evidence is available.",
    "differ": "Udyam number mismatch between document evidence and verification data.",
    "invalid": "Udyam/MSME registration could not be verified.",
    "unverified": "Udyam/MSME verification evidence is incomplete.",
    "pass": "Udyam/MSME registration is verified and the enterprise is active.",
    "else": "Udyam/MSME enterprise status requires review.",
}, ("enterprise_status",), (("enterprise_status", "INACTIVE", "Udyam/MSME enterprise is not active."),), ("enterprise_status", "ACTIVE"))
INCOME_TAX = shape("INCOME_TAX", "pan", {
    "nothing": "No PAN or Income Tax compliance evidence is available.",
    "differ": "PAN mismatch between document evidence and verification data.",
    "invalid": "PAN could not be verified.",
    "unverified": "PAN and Income Tax verification evidence is incomplete.",
    "pass": "PAN is verified and Income Tax compliance requirements are satisfied.",
    "else": "Income Tax compliance status requires review.",
}, ("pan_status", "income_tax_compliance"), (("pan_status", "INACTIVE", "PAN is not active."), ("income_tax_compliance", "NON_COMPLIANT", "Income Tax compliance requirements are not satisfied.")), ("income_tax_compliance", "COMPLIANT"))
NO_RULES = "No automated evaluator is available for requirement type: "


class Registry:
    """Rule sets by requirement type, upper or lower case alike."""

    def __init__(self, sets: Iterable[RuleSet] = ()):
        self.sets: dict[str, RuleSet] = {}
        for s in sets:
            self.register(s)

    def register(self, rules: RuleSet) -> None:
        key = rules.requirement_type.upper()
        if key in self.sets:
            raise ValueError(f"rules for {key} are registered already")
        self.sets[key] = rules

    def get(self, requirement_type: str) -> RuleSet | None:
        return self.sets.get(requirement_type.upper())


def default_registry() -> Registry:
    return Registry((GST, UDYAM, INCOME_TAX))


def evaluate(inputs: DataFrame, registry: Registry | None = None, columns: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """inputs (requirement_type, requirement_name, extracted_data, verification_data, ...) with status, reason, evidence.

    Data are maps; a null or empty map is none, a map of null values isn't. Types without rules are for
    review. Evidence keeps keys with null values. Evidence may come as columns instead of maps: `columns` names,
    for each type, those of `document`, `verified`, `nothing` (is there none at all?) and of each verification key.
    """
    registry = registry or default_registry()
    kind = F.upper("requirement_type")
    status = reason = evidence = None
    for name, rules in registry.sets.items():
        own = columns[name] if columns else None
        found = {"document": own["document"], "verified": own["verified"]} if own else {"document": f"try_element_at(extracted_data, '{rules.id_key}')", "verified": f"try_element_at(verification_data, '{rules.id_key}')"}
        nothing = own["nothing"] if own else "coalesce(size(extracted_data), -1) <= 0 AND coalesce(size(verification_data), -1) <= 0"
        told_by = (lambda k, own=own: own[k]) if own else (lambda k: f"try_element_at(verification_data, '{k}')")
        document, verified = (F.expr(f"nullif({x}, '')") for x in found.values())
        values = {"document": document, "verified": verified, "identifier": F.coalesce(verified, F.expr(found["document"]))}
        chain = {"status": None, "reason": None, "evidence": None}
        for r in rules.rules:
            holds = compile_condition(r.condition, found, nothing, told_by)
            told = F.create_map(*[x for k, v in r.evidence.items() for x in (F.lit(k), values[v] if v in values else F.expr(told_by(v)))]) if r.evidence else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
            for column, value in (("status", F.lit(r.status)), ("reason", F.lit(r.reason)), ("evidence", told)):
                chain[column] = F.when(holds, value) if chain[column] is None else chain[column].when(holds, value)
        here = kind == name
        status = F.when(here, chain["status"]) if status is None else status.when(here, chain["status"])
        reason = F.when(here, chain["reason"]) if reason is None else reason.when(here, chain["reason"])
        evidence = F.when(here, chain["evidence"]) if evidence is None else evidence.when(here, chain["evidence"])
    none = (F.lit("REVIEW"), F.concat(F.lit(NO_RULES), "requirement_type"), F.create_map(F.lit("requirement_type"), F.col("requirement_type"), F.lit("requirement_name"), F.col("requirement_name")))
    out = [none[k] if x is None else x.otherwise(none[k]) for k, x in enumerate((status, reason, evidence))]
    return inputs.withColumns({"status": out[0], "reason": out[1], "evidence": out[2]})


def compile_condition(condition: str, found: dict[str, str], nothing: str, told_by: Callable[[str], str]) -> Column:
    if condition == NOTHING:
        return F.expr(nothing)
    if condition == DIFFER:
        return F.expr(f"nullif({found['document']}, '') <> nullif({found['verified']}, '')")
    out = condition
    while "ver['" in out:
        a = out.index("ver['")
        b = out.index("']", a)
        out = f"{out[:a]}{told_by(out[a + 5 : b])}{out[b + 2 :]}"
    return F.expr(out)


def evidence_text(evidence: str = "evidence") -> Column:
    """Evidence as key=value pairs in order, for comparison across engines."""
    return F.array_join(F.transform(F.map_entries(evidence), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


def record_checks(requests: DataFrame, submissions: DataFrame, requirements: DataFrame, registry: Registry | None = None, columns: dict[str, dict[str, str]] | None = None, at: Column | None = None) -> DataFrame:
    """Evaluate requests (bid_submission_id, tender_requirement_id, extracted_data, verification_data) against stored rows.

    Type and name come from the stored requirement, whatever the request says. error tells what is missing
    or doesn't match, and then status, reason, evidence and checked_at (now, or `at`) are null.
    """
    s = submissions.select(F.col("id").alias("bid_submission_id"), F.col("tender_id").alias("own_tender"), F.lit(True).alias("has_submission"))
    r = requirements.select(F.col("id").alias("tender_requirement_id"), F.col("tender_id").alias("of_tender"), "requirement_type", "requirement_name", F.lit(True).alias("has_requirement"))
    joined = requests.drop("requirement_type", "requirement_name").join(s, "bid_submission_id", "left").join(r, "tender_requirement_id", "left")
    error = (
        F.when(F.col("has_submission").isNull(), F.concat(F.lit("Bid submission not found: "), F.col("bid_submission_id").cast("string")))
        .when(F.col("has_requirement").isNull(), F.concat(F.lit("Tender requirement not found: "), F.col("tender_requirement_id").cast("string")))
        .when(F.col("own_tender") != F.col("of_tender"), "Tender requirement does not belong to the tender of the submission")
    )
    out = evaluate(joined.withColumn("error", error), registry, columns)
    for c in ("status", "reason", "evidence"):
        out = out.withColumn(c, F.when(F.col("error").isNull(), F.col(c)))
    return out.drop("own_tender", "of_tender", "has_submission", "has_requirement").withColumns({"checked_by": F.lit("COMPLIANCE_ENGINE"), "checked_at": F.when(F.col("error").isNull(), F.current_timestamp() if at is None else at)})
