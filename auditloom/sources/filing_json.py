"""Parsed filings as JSON: facts, contexts, units and mapped statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.periods import date_or_null
from auditloom.operators.lineage import cut

_FACT = "concept string, name string, qname string, value string, fact_value string, context_ref string, contextRef string, context_id string, unit_ref string, unit string, decimals string, precision string, id string, footnote string"
_CONTEXT = "id string, entity struct<identifier string>, period struct<type string, instant string, start_date string, end_date string>, segment map<string,string>, scenario map<string,string>"
_UNIT = "id string, measures array<string>, numerator array<string>, denominator array<string>"
#: Contexts and units may be maps by id or arrays; both are read as text and parsed by what they begin with.
FILING = f"metadata struct<document_type string, market string, filing_date string, period_end string>, instance struct<entity struct<identifier string, cik string, entity_name string>, namespaces map<string,string>, facts array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _FACT.split(', '))}>>, contexts string, units string>"
# Names under which statements give what is one column here.
STATEMENT_FACT = (
    "concept string, name string, qname string, value string, fact_value string, unit string, unit_ref string, decimals string, label string, `order` double, depth int, level int, context_id string, context_ref string, contextRef string, "
    "period_start string, startDate string, period_end string, endDate string, instant string, is_total boolean, isTotal boolean, is_abstract boolean, isAbstract boolean, parent_concept string"
)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, keyed by filing_id (its path), by an explicit schema: nothing is read to infer one."""
    return spark.read.schema(FILING).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("filing_id", F.col("_metadata.file_path"))


def facts(filings: DataFrame) -> DataFrame:
    f = filings.select("filing_id", F.posexplode("instance.facts").alias("fact_seq", "f"))
    return f.select(
        "filing_id", F.col("fact_seq").cast("long"), F.coalesce("f.concept", "f.name", "f.qname").alias("concept"), F.coalesce("f.value", "f.fact_value").alias("value"),
        F.coalesce("f.context_id", "f.context_ref", "f.contextRef").alias("context_id"), F.coalesce("f.unit_ref", "f.unit").alias("unit"), "f.decimals", "f.precision", F.col("f.id").alias("fact_id"), "f.footnote",
    )


def _entries(column: str, schema: str):
    as_map = F.map_values(F.from_json(column, f"map<string, struct<{_typed(schema)}>>"))
    as_list = F.from_json(column, f"array<struct<{_typed(schema)}>>")
    return F.when(F.trim(column).startswith("["), as_list).otherwise(as_map)


def _typed(schema: str) -> str:
    import re

    depth, out, part = 0, [], ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(re.sub(r"^\s*(\S+) ", r"\1: ", part.strip()))
            part = ""
        else:
            part += ch
    return ", ".join(re.sub(r"(struct<)([^<>]*)>", lambda m: m[1] + re.sub(r"(\w+) (string)", r"\1: \2", m[2]) + ">", x) for x in out)


def contexts(filings: DataFrame) -> DataFrame:
    """context_id, entity, kind, instant, start, end (dates, null where unreadable), dims (segment and scenario)."""
    c = filings.select("filing_id", F.posexplode(_entries("instance.contexts", _CONTEXT)).alias("context_seq", "c"))
    none = F.create_map().cast("map<string,string>")
    return c.select(
        "filing_id", "context_seq", F.col("c.id").alias("context_id"), F.col("c.entity.identifier").alias("entity"), F.col("c.period.type").alias("kind"),
        date_or_null(F.col("c.period.instant")).alias("instant"), date_or_null(F.col("c.period.start_date")).alias("start"), date_or_null(F.col("c.period.end_date")).alias("end"),
        F.map_concat(F.coalesce("c.segment", none), F.map_filter(F.coalesce("c.scenario", none), lambda k, v: ~F.map_contains_key(F.coalesce("c.segment", none), k))).alias("dims"),
    )


def units(filings: DataFrame) -> DataFrame:
    u = filings.select("filing_id", F.explode(_entries("instance.units", _UNIT)).alias("u"))
    divide = F.size(F.coalesce("u.denominator", F.array().cast("array<string>"))) > 0
    text = F.when(divide, F.concat(F.array_join("u.numerator", "*"), F.lit("/"), F.array_join("u.denominator", "*"))).otherwise(F.array_join("u.measures", "*"))
    return u.select("filing_id", F.col("u.id").alias("unit_id"), divide.alias("is_divide"), text.alias("measure"))


def with_context(facts_: DataFrame, contexts_: DataFrame, units_: DataFrame) -> DataFrame:
    """Facts beside their context's period and unit's measure; unknown references leave nulls."""
    c = contexts_.select("filing_id", "context_id", "entity", "kind", "instant", "start", "end", F.size("dims").alias("dimension_count"))
    u = units_.select("filing_id", F.col("unit_id").alias("unit"), "measure")
    return facts_.join(c, ["filing_id", "context_id"], "left").join(u, ["filing_id", "unit"], "left")


def broken_references(facts_: DataFrame, contexts_: DataFrame, units_: DataFrame) -> DataFrame:
    """Facts whose context or unit does not exist."""
    c = facts_.join(contexts_.select("filing_id", "context_id").distinct(), ["filing_id", "context_id"], "left_anti").withColumn("problem", F.lit("context"))
    u = facts_.filter(F.col("unit").isNotNull()).join(units_.select("filing_id", F.col("unit_id").alias("unit")).distinct(), ["filing_id", "unit"], "left_anti").withColumn("problem", F.lit("unit"))
    return c.unionByName(u).select("filing_id", "fact_seq", "concept", "context_id", "unit", "problem")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Facts of mapped statements, one row each, whatever the spelling of their fields; bytes is the size of the file, by which main statements are told."""
    schema = f"role_uri string, role string, roleUri string, role_definition string, statement_type string, facts array<struct<{_typed(STATEMENT_FACT)}>>, items array<struct<{_typed(STATEMENT_FACT)}>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    rows = raw.select(F.col("_metadata.file_path").alias("filing_id"), F.col("_metadata.file_size").alias("bytes"), F.coalesce("role_uri", "roleUri", "role").alias("role"), "role_definition", "statement_type", F.posexplode(F.coalesce("facts", "items")).alias("fact_seq", "f"))
    return rows.select(
        "filing_id", "bytes", "role", "role_definition", "statement_type", "fact_seq", F.coalesce("f.concept", "f.name", "f.qname").alias("concept"), F.coalesce("f.value", "f.fact_value").alias("value"),
        F.coalesce("f.unit", "f.unit_ref").alias("unit"), "f.decimals", "f.label", "f.order", F.coalesce("f.depth", "f.level").alias("depth"), F.coalesce("f.context_id", "f.context_ref", "f.contextRef").alias("context_id"),
        F.coalesce("f.period_start", "f.startDate").alias("period_start"), F.coalesce("f.period_end", "f.endDate", "f.instant").alias("period_end"),
        F.coalesce("f.is_total", "f.isTotal", F.lit(False)).alias("is_total"), F.coalesce("f.is_abstract", "f.isAbstract", F.lit(False)).alias("is_abstract"), "f.parent_concept",
    )


def json_paths(rows: DataFrame, column: str) -> DataFrame:
    """All paths that occur in a JSON text column, with their kinds and counts. Arrays by their first element."""
    level = cut(rows.select(F.lit("$").alias("path"), F.try_parse_json(column).alias("v")))
    out = None
    while out is None or not level.isEmpty():
        kind = F.schema_of_variant("v")
        here = level.filter("v is not null").select("path", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind)).alias("kind"))
        out = here if out is None else out.unionByName(here)
        inner = level.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        inner = inner.filter("pos = 0 or key is not null").select(F.concat("path", F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit("[0]"))).alias("path"), F.col("value").alias("v"))
        level = cut(inner)
    return out.groupBy("path", "kind").agg(F.count("*").alias("n"))
