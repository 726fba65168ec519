"""Contexts with fewer members: sets of members that lie within others, joined on an inverted index of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import periods as P
from auditloom.operators.contexts import entries

#: Key of sets without members.
EMPTY = ""


def members(dims: Column) -> Column:
    """The members of a map of dimensions as texts axis=member, in order of the axes."""
    return F.transform(entries(dims), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))


def within_sets(small: DataFrame, large: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of rows whose keys ``by`` agree and where all of small.members are among large.members.

    Each small set meets the large ones on its rarest member, each large set is there once for each of its members and once
    for the sets without any: a row for each member in place of one for each subset. Both sides need a column members;
    columns other than by and members must differ by name. A set is within itself.
    """
    freq = small.select(*by, F.explode("members").alias("_member")).groupBy(*by, "_member").agg(F.count("*").alias("_n"))
    each = small.distinct().withColumn("_member", F.explode(F.when(F.size("members") > 0, F.col("members")).otherwise(F.array(F.lit(EMPTY)))))
    counted = each.join(freq, [*by, "_member"], "left")
    rare = counted.groupBy(*small.columns).agg(F.min_by("_member", F.struct(F.coalesce("_n", F.lit(0)), "_member")).alias("_member")).withColumnRenamed("members", "_small_members")
    offered = large.withColumn("_member", F.explode(F.concat("members", F.array(F.lit(EMPTY)))))
    met = rare.join(offered, [*by, "_member"])
    return met.filter(F.size(F.array_except("_small_members", "members")) == 0).drop("_member").withColumnsRenamed({"members": "large_members", "_small_members": "small_members"})


def generalised_children(missing: DataFrame, facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """For children that a context lacks, the fact of the context with the most of its members, of those with fewer.

    missing: filing_id, context_id, period_key, unit, child. facts: filing_id, context_id, concept, value, unit, fact_seq.
    contexts: filing_id, context_id, period_key, dims. A fact fits if its concept and period are the same, its unit is or
    is missing, and the members of its context are some of those of the context that lacks it, but not all. Of those that
    fit the one with the most members counts, of equal ones the first (by fact_seq, then context). So a slice takes what it
    does not report itself from the narrowest slice around it, and never from another one. Sets are compared by context, not by fact:
    what lacks and what is offered meet only where one context is known to lie around the other.
    """
    sized = contexts.select("filing_id", "context_id", "period_key", members(F.col("dims")).alias("members"))
    keys = ["filing_id", "period_key"]
    around = within_sets(sized.withColumnRenamed("context_id", "source_context"), sized, keys).filter(F.size("small_members") < F.size("large_members"))
    pairs = around.select("filing_id", "context_id", "source_context", F.size("small_members").alias("n_members"))
    wanted = missing.select("filing_id", "context_id", "unit", "child").join(pairs, ["filing_id", "context_id"])
    offered = facts.select("filing_id", F.col("concept").alias("child"), F.col("context_id").alias("source_context"), F.col("value").alias("child_value"), F.col("unit").alias("child_unit"), "fact_seq")
    fits = wanted.join(offered, ["filing_id", "source_context", "child"]).filter(P.units_equal(F.col("unit"), F.col("child_unit")))
    best = F.min(F.struct((-F.col("n_members")).alias("fewer"), "fact_seq", "source_context", "child_value")).alias("b")
    return fits.groupBy("filing_id", "context_id", "child").agg(best).select("filing_id", "context_id", "child", "b.source_context", "b.child_value", (-F.col("b.fewer")).alias("n_members"))
