"""Checks of facts against a taxonomy's definitions of their concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prefixes whose concepts are no extension.
STANDARD_PREFIXES = ("us-gaap", "ifrs", "dei", "srt", "country")


def defined(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Facts beside the definition of their concept: by its full name, else by the part after the colon.

    definitions: name, period_type, balance, where of equal names the last (the highest def_seq) counts. Adds known,
    period_type and balance, null where nothing defines the concept.
    """
    # Full name and local part have the same local part, so that facts meet the definitions of theirs once.
    local = lambda c: F.when(c.contains(":"), F.get(F.split(c, ":"), F.lit(1))).otherwise(c)
    by_name = definitions.groupBy("name").agg(F.max_by(F.struct("period_type", "balance"), "def_seq").alias("d"))
    alike = by_name.groupBy(local(F.col("name")).alias("local")).agg(F.collect_list(F.struct("name", "d")).alias("_alike"))
    of = lambda c: F.get(F.filter("_alike", lambda x: x["name"] == F.col(c)), F.lit(0))["d"]
    out = facts.withColumn("local", local(F.col("concept"))).join(alike, "local", "left").withColumn("_def", F.coalesce(of("concept"), of("local")))
    return out.withColumn("known", F.col("_def").isNotNull()).withColumn("period_type", F.lower("_def.period_type")).withColumn("balance", F.lower("_def.balance")).drop("local", "_alike", "_def")


def library_counts(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row a filing: how many facts have valid, extension and unknown concepts, periods of the wrong kind and negative balances.

    facts: filing_id, concept, value, period_start, period_end, is_abstract (such facts do not count). A fact with both
    ends is of a duration, one with an end alone an instant. One pass and one shuffle by filing after the joins.
    """
    actual = F.when(F.col("period_end").isNotNull(), F.when(F.col("period_start").isNotNull(), "duration").otherwise("instant"))
    told = facts.filter(~F.coalesce("is_abstract", F.lit(False))).select("filing_id", "concept", actual.alias("actual"), (F.col("value") < 0).alias("negative"))
    f = defined(told, definitions)
    prefix = F.when(F.col("concept").contains(":"), F.lower(F.substring_index("concept", ":", 1))).otherwise("")
    extension = ~F.col("known") & (prefix != "") & ~prefix.isin(*STANDARD_PREFIXES)
    kind, balance = F.coalesce("period_type", F.lit("")), F.coalesce("balance", F.lit(""))
    weighed = (balance != "") & F.col("negative").isNotNull()
    return f.groupBy("filing_id").agg(
        F.count_if("known").alias("n_valid"),
        F.count_if(extension).alias("n_extension"),
        F.count_if(~F.col("known") & ~extension).alias("n_unknown"),
        F.count_if(kind != "").alias("n_periods"),
        F.count_if((kind != "") & (F.col("actual") != kind)).alias("n_wrong_periods"),
        F.count_if(weighed).alias("n_balances"),
        F.count_if(weighed & balance.isin("debit", "credit") & F.col("negative")).alias("n_negative"),
    )


def library_checks(counts: DataFrame) -> DataFrame:
    """Three checks for each filing, as rows of the kind that scoring takes: unknown concepts and odd signs are for information only."""
    row = lambda name, passed, severity, checked, found: F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), severity.alias("severity"), checked.alias("n_checked"), found.alias("n_found"))
    info, right = F.lit("info"), F.col("n_wrong_periods") == 0
    rows = F.array(
        row("concept_validity", F.col("n_unknown") == 0, info, F.col("n_valid") + F.col("n_extension") + F.col("n_unknown"), F.col("n_unknown")),
        row("period_type_match", right, F.when(right, "info").otherwise("warning"), F.col("n_periods"), F.col("n_wrong_periods")),
        row("balance_type_match", F.lit(True), info, F.col("n_balances"), F.col("n_negative")),
    )
    return counts.select("filing_id", F.lit("library").alias("check_type"), F.inline(rows))


def taxonomy_summary(definitions: DataFrame) -> DataFrame:
    """Definitions by source: how many, and how many of each kind."""
    return definitions.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("period_type") == "instant").alias("n_instant"), F.count_if(F.col("period_type") == "duration").alias("n_duration"), F.count_if(F.col("balance").isNotNull()).alias("n_balance")
    )
