"""Scores of filings from check results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import classify as C

# Weights of categories and of checks within them, penalties, checks that are scored by pass rate.
CATEGORY_WEIGHTS = {"horizontal": 0.40, "vertical": 0.40, "library": 0.20}
CHECK_WEIGHTS = {
    "calculation_consistency": 0.50, "total_reconciliation": 0.30, "sign_convention": 0.15, "duplicate_facts": 0.05,
    "xbrl_calculation_company": 0.40, "xbrl_calculation_taxonomy": 0.30, "balance_sheet_equation": 0.10, "income_statement_linkage": 0.08,
    "cash_flow_linkage": 0.05, "retained_earnings_rollforward": 0.02, "common_values_consistency": 0.05,
    "concept_validity": 0.40, "period_type_match": 0.25, "balance_type_match": 0.20, "data_type_match": 0.15,
}
PENALTIES = {"critical": 25.0, "warning": 5.0, "info": 0.5}
PASS_RATE_CHECKS = ("xbrl_calculation_company", "xbrl_calculation_taxonomy")


def _map(values: dict[str, float]):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def category_scores(checks: DataFrame) -> DataFrame:
    """checks: filing_id, check_type, check_name, passed (null: skipped), severity → a score for each filing and type.

    A check's score is its pass rate, or 100 less the penalties of what did not pass, 0 at least. A type's score is the
    mean of its checks that are present, weighted; names without a weight share evenly. Two small aggregations, the
    second over at most a few names for each filing.
    """
    failed = ~F.coalesce("passed", F.lit(False))
    penalty = F.sum(F.when(failed, F.coalesce(F.try_element_at(_map(PENALTIES), F.col("severity")), F.lit(PENALTIES["info"]))).otherwise(0.0))
    by_name = checks.groupBy("filing_id", "check_type", "check_name").agg(
        F.when(F.col("check_name").isin(*PASS_RATE_CHECKS), 100.0 * F.count_if(~failed) / F.count("*")).otherwise(F.greatest(F.lit(0.0), 100.0 - penalty)).alias("score"),
        F.count("*").alias("n_checks"),
        F.count_if(failed & (F.col("severity") == "critical")).alias("n_critical"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("n_warning"),
        F.count_if(failed & (F.col("severity") == "info")).alias("n_info"),
    )
    weight = F.try_element_at(_map(CHECK_WEIGHTS), F.col("check_name"))
    named = by_name.withColumn("weight", weight)
    grouped = named.groupBy("filing_id", "check_type").agg(
        F.collect_list(F.struct("score", "weight")).alias("parts"), F.count("*").alias("n_names"), *[F.sum(c).alias(c) for c in ("n_checks", "n_critical", "n_warning", "n_info")]
    )
    w = lambda p: F.coalesce(p["weight"], 1.0 / F.col("n_names"))
    top = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["score"] * w(p))
    base = F.aggregate("parts", F.lit(0.0), lambda a, p: a + w(p))
    return grouped.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), top / base))).drop("parts")


def filing_scores(categories: DataFrame) -> DataFrame:
    """One row a filing: the three scores (100 where a type has no check), the overall one, issues, level and confidence."""
    pick = lambda t, c, none: F.coalesce(F.max(F.when(F.col("check_type") == t, F.col(c))), F.lit(none))
    out = categories.groupBy("filing_id").agg(
        *[pick(t, "score", 100.0).alias(f"{t}_score") for t in CATEGORY_WEIGHTS], F.sum("n_checks").alias("n_checks"), F.sum("n_critical").alias("n_critical"), F.sum("n_warning").alias("n_warning"), F.sum("n_info").alias("n_info")
    )
    out = out.withColumn("overall_score", sum((F.col(f"{t}_score") * w for t, w in CATEGORY_WEIGHTS.items()), F.lit(0.0)))
    h, v = F.col("horizontal_score"), F.col("vertical_score")
    return out.withColumn("level", C.quality_level(F.col("overall_score"), F.col("n_critical"), h, v)).withColumn(
        "confidence", C.confidence(F.col("overall_score"), [h, v, F.col("library_score")], F.col("n_checks"))
    )


def level_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("level").agg(F.count("*").alias("n"), F.avg("overall_score").alias("mean_score"))


def failed_first(checks: DataFrame, most: int = 10) -> DataFrame:
    """The gravest failed checks of each filing, in order of severity and place: a top-k report."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    failed = checks.filter(~F.coalesce("passed", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("filing_id").orderBy(rank, "check_seq", "check_name", "severity"))
    return failed.withColumn("place", place).filter(F.col("place") <= most).select("filing_id", "place", "check_name", "severity", "check_seq")
