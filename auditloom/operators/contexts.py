"""Contexts: equality by entity, period and dimensions, and the default context of a dimensional one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(dims: Column) -> Column:
    """The entries of a map in order of their keys; a missing map is an empty one. Equal maps have equal entries."""
    return F.array_sort(F.map_entries(F.coalesce(dims, F.create_map().cast("map<string,string>"))))


def segments_match(a: Column, b: Column, strict: bool = True) -> Column:
    """Dimensions are the same or, if not strict, those of a are among those of b."""
    if strict:
        return entries(a) == entries(b)
    return F.forall(entries(a), lambda e: F.coalesce(F.try_element_at(b, e["key"]) == e["value"], F.lit(False)))


def context_key(entity: Column, kind: Column, start: Column, end: Column, segment: Column, scenario: Column) -> Column:
    """A text on which contexts meet that are equal in entity, period, segment and scenario; order of dimensions counts for nothing."""
    return F.to_json(F.struct(entity.alias("e"), kind.alias("k"), start.alias("s"), end.alias("x"), entries(segment).alias("g"), entries(scenario).alias("c")), {"ignoreNullFields": "false"})


def equal_contexts(contexts: DataFrame, key: Column) -> DataFrame:
    """Each context with the first equal one of its filing (by seq) and their number: equal contexts meet on a key, no pairs are made."""
    keyed = contexts.withColumn("_key", key)
    groups = keyed.groupBy("filing_id", "_key").agg(F.min_by("context_id", "seq").alias("same_as"), F.count("*").alias("n_equal"))
    return keyed.join(groups, ["filing_id", "_key"]).drop("_key")


def default_contexts(contexts: DataFrame) -> DataFrame:
    """For each context with dimensions the first (by seq) without any of the same filing, entity and period; null without one.

    contexts: filing_id, context_id, seq, entity, period_key, dims.
    """
    plain = F.size(entries(F.col("dims"))) == 0
    first = contexts.filter(plain).groupBy("filing_id", "entity", "period_key").agg(F.min_by("context_id", "seq").alias("default_id"))
    return contexts.filter(~plain).join(first, ["filing_id", "entity", "period_key"], "left").select("filing_id", "context_id", "default_id")


def by_period(contexts: DataFrame) -> DataFrame:
    """Contexts of each filing and period: how many, how many with dimensions, and the first."""
    dimensional = F.size(entries(F.col("dims"))) > 0
    return contexts.groupBy("filing_id", "period_key").agg(F.count("*").alias("n"), F.count_if(dimensional).alias("n_dimensional"), F.min_by("context_id", "seq").alias("first_id"))


def in_period(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """All facts of each wanted (filing_id, concept, period_key)."""
    return facts.join(wanted.select("filing_id", "concept", "period_key").distinct(), ["filing_id", "concept", "period_key"], "left_semi")


def hypercubes(arcs: DataFrame) -> DataFrame:
    """Of definition arcs (role, arcrole as its last segment, parent, child) each role's dimensions with domain, default and number of members.

    Members are the children of domains that are reached over domain-member arcs directly.
    """
    of = lambda kind, parent, child: arcs.filter(F.col("arcrole") == kind).select("role", F.col("parent").alias(parent), F.col("child").alias(child)).distinct()
    dims = of("hypercube-dimension", "hypercube", "dimension")
    domains = of("dimension-domain", "dimension", "domain").groupBy("role", "dimension").agg(F.min("domain").alias("domain"))
    defaults = of("dimension-default", "dimension", "default_member").groupBy("role", "dimension").agg(F.min("default_member").alias("default_member"))
    members = of("domain-member", "domain", "member").groupBy("role", "domain").agg(F.count("*").alias("n_members"))
    out = dims.join(domains, ["role", "dimension"], "left").join(defaults, ["role", "dimension"], "left").join(members, ["role", "domain"], "left")
    return out.select("role", "hypercube", "dimension", "domain", "default_member", F.coalesce("n_members", F.lit(0)).alias("n_members"))
