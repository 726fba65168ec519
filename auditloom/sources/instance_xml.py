"""Instance documents in XML, given as text: contexts with explicit and typed members, units, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.periods import date_or_null

_MEMBERS = "struct<explicitMember: array<struct<_dimension: string, _VALUE: string>>, typedMember: array<struct<_dimension: string, xs_any: array<string>>>>"
_DOCUMENT = (
    f"context array<struct<_id: string, entity: struct<identifier: struct<_scheme: string, _VALUE: string>, segment: {_MEMBERS}>, "
    f"period: struct<instant: string, startDate: string, endDate: string, forever: string>, scenario: {_MEMBERS}>>, "
    "unit array<struct<_id: string, measure: array<string>, divide: struct<unitNumerator: struct<measure: array<string>>, unitDenominator: struct<measure: array<string>>>>>, "
    "_corrupt_record string"
)


def parsed(documents: DataFrame, column: str = "xml", key: str = "filing_id") -> DataFrame:
    """key and x, the parsed document, by one pass over the text. Namespace prefixes count for nothing; broken texts keep what
    is wrong in x._corrupt_record and have no contexts."""
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "rowTag": "xbrl"}
    return documents.select(F.col(key).alias(key), F.from_xml(F.col(column), _DOCUMENT, options).alias("x"))


def _members(part: Column) -> Column:
    """Map of dimensions to members of a segment or scenario; a typed member is the text within its element. The last of equal dimensions counts."""
    none = F.array().cast("array<struct<key: string, value: string>>")
    trimmed = lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), r"^\s+|\s+$", "")
    explicit = F.coalesce(F.transform(part["explicitMember"], lambda m: F.struct(F.trim(m["_dimension"]).alias("key"), trimmed(m["_VALUE"]).alias("value"))), none)
    inner = lambda m: F.regexp_replace(F.array_join(m["xs_any"], " "), "<[^>]*>", "")
    typed = F.coalesce(F.transform(part["typedMember"], lambda m: F.struct(F.trim(m["_dimension"]).alias("key"), trimmed(inner(m)).alias("value"))), none)
    every = F.filter(F.concat(explicit, typed), lambda e: F.coalesce(e["key"], F.lit("")) != "")
    names = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(every, lambda e: e["key"] == n), -1)["value"])))


def contexts(documents: DataFrame, key: str = "filing_id", *others: str) -> DataFrame:
    """key, context_seq, context_id, entity, kind, instant, start, end, dims, typed of the contexts of parsed documents, and other columns of these.

    kind is instant, duration or forever; dates that cannot be read are null. dims holds the members of segment and scenario,
    of which the segment's count where both have one; typed tells which of its dimensions have typed members. Contexts without an id are left out.
    """
    # The outer form keeps the parse of the text from being repeated in a filter below it; contexts that are none go with those without an id.
    c = documents.select(key, *others, F.posexplode_outer("x.context").alias("context_seq", "c"))
    period = F.col("c.period")
    segment, scenario = _members(F.col("c.entity.segment")), _members(F.col("c.scenario"))
    kind = F.when(period["instant"].isNotNull(), "instant").when(period["startDate"].isNotNull() & period["endDate"].isNotNull(), "duration").otherwise("forever")
    typed = F.array_distinct(F.concat(*[F.coalesce(F.transform(F.col(f"c.{p}.typedMember"), lambda m: F.trim(m["_dimension"])), F.array().cast("array<string>")) for p in ("entity.segment", "scenario")]))
    return c.filter(F.coalesce("c._id", F.lit("")) != "").select(
        key, "context_seq", F.col("c._id").alias("context_id"), F.trim("c.entity.identifier._VALUE").alias("entity"), kind.alias("kind"), date_or_null(F.trim(period["instant"])).alias("instant"),
        date_or_null(F.trim(period["startDate"])).alias("start"), date_or_null(F.trim(period["endDate"])).alias("end"),
        F.map_concat(segment, F.map_filter(scenario, lambda k, v: ~F.map_contains_key(segment, k))).alias("dims"), F.array_sort(typed).alias("typed"), *others,
    )


def measures(unit: Column) -> Column:
    """The units of a parsed document as structs of unit_id and measure (products with *, quotients with /)."""
    joined = lambda c: F.array_join(F.transform(c, lambda m: F.trim(m)), "*")
    measure = lambda u: F.coalesce(F.concat(joined(u["divide"]["unitNumerator"]["measure"]), F.lit("/"), joined(u["divide"]["unitDenominator"]["measure"])), joined(u["measure"]))
    return F.transform(unit, lambda u: F.struct(u["_id"].alias("unit_id"), measure(u).alias("measure")))


def units(documents: DataFrame, key: str = "filing_id") -> DataFrame:
    """key, unit_id, measure (products with *, quotients with /) of parsed documents."""
    each = documents.select(key, measures(F.col("x.unit")).alias("units"))
    return each.select(key, F.explode_outer("units").alias("u")).filter("u is not null").select(key, "u.*")


def broken(documents: DataFrame, key: str = "filing_id") -> DataFrame:
    """key of the parsed documents that are no well-formed XML."""
    return documents.filter(F.col("x").isNull() | F.col("x._corrupt_record").isNotNull()).select(key)


def is_default(dims: Column, defaults: Column) -> Column:
    """Whether all members are those that their dimension has by default; defaults is a map of dimensions to members.

    Without members a context is a default one; a dimension without a default makes it none.
    """
    from auditloom.operators.contexts import entries

    return F.forall(entries(dims), lambda e: F.coalesce(F.try_element_at(defaults, e["key"]) == e["value"], F.lit(False)))
