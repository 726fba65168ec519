"""Verification of calculation trees over all contexts, by one source or by two side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import numbers as N


def tree_results(arcs: DataFrame, checks: DataFrame) -> DataFrame:
    """One row for each tree (role, parent) of arcs, over its checks in all contexts.

    checks: role, parent, context_id, passed, expected, value, one row for each context that could be verified. A tree
    passes only if a context was verified and none failed; one that no context could verify has failed. expected and
    value are those of the first context.
    """
    trees = arcs.select("role", "parent").distinct()
    first = F.min_by(F.struct("expected", "value"), "context_id").alias("f")
    seen = checks.groupBy("role", "parent").agg(F.count("*").alias("contexts_verified"), F.count_if("passed").alias("contexts_passed"), first)
    out = trees.join(seen, ["role", "parent"], "left").fillna(0, ["contexts_verified", "contexts_passed"])
    passed = (F.col("contexts_verified") > 0) & (F.col("contexts_verified") == F.col("contexts_passed"))
    return out.select("role", "parent", "contexts_verified", "contexts_passed", passed.alias("passed"), "f.expected", "f.value")


def dual(company: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """tree_results of two sources side by side. They agree unless both have the tree and only one passes it."""
    keys = ["role", "parent"]
    side = lambda df, name: df.select(*keys, F.col("passed").alias(f"{name}_passed"), F.col("contexts_verified").alias(f"{name}_contexts"))
    out = side(company, "company").join(side(taxonomy, "taxonomy"), keys, "full_outer")
    return out.withColumn("sources_agree", F.coalesce(F.col("company_passed") == F.col("taxonomy_passed"), F.lit(True)))


CHECK = ("filing_id", "context_id", "check_type", "check_name", "passed", "severity")


def horizontal_checks(bound: DataFrame, groups: DataFrame) -> DataFrame:
    """Check rows of the horizontal kind: each reported total against its components, and each fact that is given several times.

    bound: bind's result; totals that do not bind are skipped, with passed null. groups: classify_duplicates' result.
    """
    passed = F.when(F.col("status") == "bound", N.within_tolerance(F.col("expected"), F.col("value"), F.col("child_decimals"), F.col("decimals")))
    grave = N.severity(F.col("expected"), F.col("value"), F.col("n_found") < F.col("n_children"))
    sums = bound.filter("status <> 'skip_no_parent'").withColumn("passed", passed).withColumn("severity", F.when(F.coalesce("passed", F.lit(True)), "info").otherwise(grave)).withColumn("check_name", F.lit("calculation_consistency"))
    right = F.col("duplicate_type") != "inconsistent"
    several = groups.filter("n_entries > 1").withColumn("passed", right).withColumn("severity", F.when(right, "info").otherwise("warning")).withColumn("check_name", F.lit("duplicate_facts"))
    return sums.withColumn("check_type", F.lit("horizontal")).select(*CHECK).unionByName(several.withColumn("check_type", F.lit("horizontal")).select(*CHECK))


def filing_trees(rolled: DataFrame) -> DataFrame:
    """Each filing's calculation trees over all contexts that could be verified: filing_id, context_id (the first), passed, severity.

    rolled: rollup's result. A tree passes if all its contexts do; how grave it is otherwise is told by the first context.
    """
    first = F.min_by(F.struct("expected", "value"), "context_id").alias("f")
    trees = rolled.groupBy("filing_id", "role", "parent").agg(F.every("passed").alias("passed"), F.min("context_id").alias("context_id"), first, F.bool_or(F.col("n_found") < F.col("n_children")).alias("missing"))
    return trees.withColumn("severity", F.when(F.col("passed"), "info").otherwise(N.severity(F.col("f.expected"), F.col("f.value"), F.col("missing")))).select("filing_id", "context_id", "passed", "severity")


def vertical_checks(filings: dict[str, DataFrame], common: DataFrame) -> DataFrame:
    """Check rows of the vertical kind: roll-ups by name of check, and common values, of which only failed ones are given.

    filings: for each name of a check the rows (filing_id, context_id, passed, severity). common: filing_id, context_id.
    """
    rows = [df.select("filing_id", "context_id", F.lit(name).alias("check_name"), "passed", "severity") for name, df in filings.items()]
    rows.append(common.select("filing_id", "context_id", F.lit("common_values_consistency").alias("check_name"), F.lit(False).alias("passed"), F.lit("warning").alias("severity")))
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("check_type", F.lit("vertical"))


def unlike_values(groups: DataFrame) -> DataFrame:
    """filing_id, context_id of facts that a context gives several times with values beyond tolerance; groups as classify_duplicates leaves them."""
    return groups.filter((F.col("n_entries") > 1) & (F.col("low") != F.col("high")) & ~N.within_vertical(F.col("low"), F.col("high"))).select("filing_id", "context_id")


def all_checks(resolved: DataFrame, bound: DataFrame, rolled: DataFrame, library: DataFrame) -> DataFrame:
    """The check rows of all three kinds for scoring: filing_id, context_id, check_type, check_name, passed, severity.

    resolved, bound, rolled: the filings' facts by classify_duplicates, bind and rollup; library: library_checks' result, whose
    rows have no context. A filing without unlike common values passes that check with one row.
    """
    common = unlike_values(resolved)
    vertical = vertical_checks({"xbrl_calculation_company": filing_trees(rolled)}, common).select(*CHECK)
    fine = resolved.select("filing_id").distinct().join(common.select("filing_id").distinct(), "filing_id", "left_anti")
    none = F.lit(None).cast(dict(resolved.dtypes)["context_id"]).alias("context_id")
    consistent = fine.select("filing_id", none, F.lit("vertical").alias("check_type"), F.lit("common_values_consistency").alias("check_name"), F.lit(True).alias("passed"), F.lit("info").alias("severity"))
    known = library.select("filing_id", none, "check_type", "check_name", "passed", "severity")
    return horizontal_checks(bound, resolved).unionByName(vertical).unionByName(consistent).unionByName(known)


def multi_role_parents(arcs: DataFrame) -> DataFrame:
    """Parents that are calculated in several roles."""
    return arcs.groupBy("parent").agg(F.array_sort(F.collect_set("role")).alias("roles")).filter(F.size("roles") > 1)


def role_summary(arcs: DataFrame) -> DataFrame:
    """Roles, parents, arcs and parents of several roles, in one row."""
    by_parent = arcs.groupBy("parent").agg(F.count("*").alias("n_arcs"), F.count_distinct("role").alias("n_roles"))
    totals = by_parent.agg(F.count("*").alias("n_parents"), F.sum("n_arcs").alias("n_arcs"), F.count_if(F.col("n_roles") > 1).alias("n_multi_role"))
    return totals.join(F.broadcast(arcs.agg(F.count_distinct("role").alias("n_roles"))))  # one row each


def weights_of(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """pairs (role, parent, child) with the weight of their arc and whether there is one, the first of repeated arcs."""
    first = arcs.groupBy("role", "parent", "child").agg(F.min_by("weight", "arc_seq").alias("weight"))
    return pairs.join(first, ["role", "parent", "child"], "left").withColumn("is_child", F.col("weight").isNotNull())
