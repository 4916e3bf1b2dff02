"""Assessment and recommendation of submissions from their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts as they are reported.
NO_CHECKS = "No compliance checks are available for this bid submission."
DO_NOT_PROCEED = "Do not proceed with automatic qualification. One or more mandatory compliance requirements have failed and require resolution or manual review."
MANUAL_REVIEW = "Manual review is recommended before proceeding. Some compliance requirements could not be conclusively verified."
MAY_PROCEED = "The bid satisfies the evaluated compliance requirements. The Procurement Officer may proceed with the next stage of evaluation."
FURTHER_REVIEW = "Further compliance review is recommended before making a procurement decision."
LOW_RISK_FROM = 80


def tally(checks: DataFrame, key: str = "bid_submission_id") -> DataFrame:
    """key, total_checks, passed, failed, review, pending; other statuses count in the total only."""
    status = F.upper("status")
    return checks.groupBy(key).agg(F.count(F.lit(1)).alias("total_checks"), *[F.count_if(status == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("REVIEW", "review"), ("PENDING", "pending"))])


def score() -> Column:
    """Percent passed to two places, halves to even; null without checks."""
    return F.when(F.col("total_checks") > 0, F.bround(F.col("passed") / F.col("total_checks") * 100, 2))


def stamped(assessments: DataFrame, at: Column | None = None) -> DataFrame:
    """assessments with their metadata and assessed_at: now, or `at`; null without checks."""
    return assessments.withColumns({"assessment_metadata": metadata(), "assessed_at": F.when(F.col("total_checks") > 0, F.current_timestamp() if at is None else at)})


def assess(submissions: DataFrame, checks: DataFrame, key: str = "bid_submission_id") -> DataFrame:
    """One assessment for each submission (key): counts, score, risk_level, status, summary."""
    counts = ("total_checks", "passed", "failed", "review", "pending")
    rows = submissions.select(key).join(tally(checks, key), key, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("score", score())
    none, open_ = F.col("total_checks") == 0, (F.col("review") > 0) | (F.col("pending") > 0)
    summary = F.format_string("Compliance assessment completed for %d requirement(s): %d passed, %d failed, %d under review, %d pending.", *counts)
    return rows.withColumns({
        "risk_level": F.when(none, None).when(F.col("failed") > 0, "HIGH").when(open_, "MEDIUM").when(F.col("score") >= LOW_RISK_FROM, "LOW").otherwise("MEDIUM"),
        "status": F.when(none, "PENDING").when(F.col("failed") > 0, "NON_COMPLIANT").when(open_, "REVIEW").when(F.col("passed") == F.col("total_checks"), "COMPLIANT").otherwise("REVIEW"),
        "summary": F.when(none, NO_CHECKS).otherwise(summary),
    })


def metadata() -> Column:
    return F.struct("total_checks", "passed", "failed", "review", "pending")


def recommend(latest: DataFrame, checks: DataFrame, key: str = "bid_submission_id") -> DataFrame:
    """latest (key, status) with its recommendation, from the checks as they are now; a null status is an error."""
    now = tally(checks, key).select(key, F.col("failed").alias("now_failed"), (F.col("review") + F.col("pending")).alias("now_open"))
    text = F.when(F.col("now_failed") > 0, DO_NOT_PROCEED).when(F.col("now_open") > 0, MANUAL_REVIEW).when(F.col("status") == "COMPLIANT", MAY_PROCEED).otherwise(FURTHER_REVIEW)
    error = F.when(F.col("status").isNull(), F.concat(F.lit("Compliance assessment not found for bid submission: "), F.col(key).cast("string")))
    return latest.join(now, key, "left").withColumn("error", error).withColumn("recommendation", F.when(F.col("error").isNull(), text)).drop("now_failed", "now_open")
