"""Catalogs of filings and names: filters, first entries, lookups, closures and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.lineage import cut

#: Concepts that a diagnosis of groups names.
NAMED = 50


def of_market(filings: DataFrame, market: str) -> DataFrame:
    """Filings of a market, whatever the case."""
    return filings.filter(F.lower("market") == market.lower())


def of_company(filings: DataFrame, part: str) -> DataFrame:
    """Filings whose company's name holds a text, whatever the case."""
    return filings.filter(F.lower("company").contains(part.lower()))


def paths_of_kind(paths: DataFrame, kind: str) -> DataFrame:
    """The paths of one kind, in order, of those that filing_json.json_paths lists."""
    return paths.filter(F.col("kind") == kind).select("path", "n").orderBy("path")


def of_concept(facts: DataFrame, part: str) -> DataFrame:
    """Facts whose concept holds a text, whatever the case."""
    return facts.filter(F.lower("concept").contains(part.lower()))


def listing(facts: DataFrame, by: list[str], most: int, part: str = "") -> DataFrame:
    """A listing of at most ``most`` facts of each group, the first in input order, whose concept holds a text."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("fact_seq"))
    return of_concept(facts, part).withColumn("place", place).filter(F.col("place") <= most)


def required_libraries(namespaces: DataFrame) -> DataFrame:
    """The libraries that namespaces (name, version, url, seq, is_required) call for: one for each name and version, the first."""
    first = F.min_by(F.struct("url", "seq"), "seq").alias("f")
    return namespaces.filter("is_required").groupBy("name", "version").agg(first).select("name", "version", "f.url", "f.seq")


def numbers_of_tickers(tickers: DataFrame, companies: DataFrame) -> DataFrame:
    """tickers (ticker) with the cik of the company (ticker, cik) that has it, whatever the case; the smallest of several, null if none."""
    by = companies.groupBy(F.upper("ticker").alias("_key")).agg(F.min("cik").alias("cik"))
    return tickers.withColumn("_key", F.upper("ticker")).join(by, "_key", "left").drop("_key")


def role_definitions(roles: DataFrame, from_schemas: DataFrame, from_linkbases: DataFrame) -> DataFrame:
    """roles (role) with their definition: a schema's, else a linkbase's, both (role, definition, seq) of which the first counts."""
    first = lambda df, name: df.groupBy("role").agg(F.min_by("definition", "seq").alias(name))
    out = roles.join(first(from_schemas, "_s"), "role", "left").join(first(from_linkbases, "_l"), "role", "left")
    return out.withColumn("definition", F.coalesce("_s", "_l")).drop("_s", "_l")


def child_of(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """pairs (role, parent, child) and whether arcs place the child directly below the parent."""
    known = arcs.select("role", "parent", "child").distinct().withColumn("is_child", F.lit(True))
    return pairs.join(known, ["role", "parent", "child"], "left").fillna(False, ["is_child"])


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """name and depth of all that starts (name) lead to over edges (source, target), starts included at depth 0.

    Schemas that import, include or refer to others, for instance. Each name has the least depth; cycles end by themselves.
    One level is one join, written to the checkpoint folder, until a level brings nothing new.
    """
    edges = cut(edges.select("source", "target").distinct())
    level = cut(starts.select("name").distinct().withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while not level.isEmpty():
        depth += 1
        reached = level.join(edges, F.col("name") == F.col("source")).select(F.col("target").alias("name")).distinct()
        level = cut(reached.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(level)
    return seen


def group_diagnosis(facts: DataFrame) -> DataFrame:
    """One row: numbers of facts, contexts, concepts and groups of both, and the first NAMED concepts in order."""
    groups = facts.groupBy("filing_id", "context_id", "concept").agg(F.count("*").alias("n"))
    counts = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"), F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_distinct("filing_id", "context_id").alias("n_contexts"), F.count_distinct("concept").alias("n_concepts"),
    )
    named = groups.select("concept").distinct().orderBy("concept").limit(NAMED).agg(F.array_join(F.array_sort(F.collect_list("concept")), ",").alias("concepts"))
    both = counts.unionByName(named, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def error_statistics(results: DataFrame, path: Column) -> DataFrame:
    """Numbers of errors of results (error_type, null where there is none) by type and by folder: facet, name, n."""
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    facets = F.explode(F.array(F.struct(F.lit("type").alias("facet"), F.col("error_type").alias("name")), F.struct(F.lit("folder").alias("facet"), folder.alias("name")))).alias("f")
    return results.filter("error_type is not null").select(facets).groupBy("f.facet", "f.name").agg(F.count("*").alias("n"))
