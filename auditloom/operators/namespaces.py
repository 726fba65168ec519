"""Namespaces of filings: which taxonomies they name, what is left, and what owns an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import namespaces as N
from auditloom.operators.lineage import Levels


def taxonomies(uris: DataFrame, column: str = "uri") -> DataFrame:
    """uris but those that name no taxonomy, with taxonomy, version, authority, url, market and is_recognised. Each address is looked at once."""
    each = uris.select(column).distinct().filter(~N.is_standard(F.col(column))).select(F.col(column).alias("_uri"), N.recognised(F.col(column)).alias("r"))
    return uris.join(each, F.col(column) == F.col("_uri")).select(*uris.columns, "r.*")


def unrecognised(uris: DataFrame, column: str = "uri") -> DataFrame:
    """The addresses of uris that no form fits, with how often they occur: extensions of companies and unknown taxonomies."""
    counts = uris.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.filter(~N.is_standard(F.col(column)) & ~N.recognised(F.col(column))["is_recognised"])


def segments(uri: Column) -> Column:
    """Host and path of an address as segments; scheme, query and fragment don't count, nor do empty segments."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", ""), "/"), lambda s: s != "")


def longest_prefix(uris: DataFrame, owners: DataFrame, column: str = "uri") -> DataFrame:
    """Each address with the owner of its longest prefix of whole segments, null without one.

    owners: prefix (host and some of the path, with or without a scheme), owner; of equal prefixes the least owner counts. The
    prefixes are a trie as a table: each address offers one for each of its segments, and meets the owners in an equi-join.
    """
    known = owners.select(F.array_join(segments(F.col("prefix")), "/").alias("_prefix"), "owner").filter("_prefix <> ''").groupBy("_prefix").agg(F.min("owner").alias("owner"))
    each = uris.select(F.col(column).alias("_uri")).distinct().withColumn("s", segments(F.col("_uri")))
    offered = each.select("_uri", F.posexplode("s").alias("at", "_"), "s").select("_uri", "at", F.array_join(F.slice("s", 1, F.col("at") + 1), "/").alias("_prefix"))
    best = offered.join(known, "_prefix").groupBy("_uri").agg(F.max_by(F.struct("owner", F.col("_prefix").alias("prefix")), "at").alias("b"))
    return uris.join(best, F.col(column) == F.col("_uri"), "left").select(*uris.columns, "b.owner", "b.prefix")


def declared(rows: DataFrame, column: str, key: str = "filing_id") -> DataFrame:
    """key, uri: the namespaces that JSON texts declare, wherever they do so, each once.

    An object of any depth declares namespaces if more than half of its values are web addresses; its other non-empty texts
    then count as well. What is no JSON declares none.
    """
    levels = Levels(rows.sparkSession, "declared")
    some = levels.add(rows.select(F.col(key).alias("key"), F.lit(0).alias("node"), F.try_parse_json(column).alias("v")).filter("v is not null"))
    found = Levels(rows.sparkSession, "namespaces")
    while some:
        inner = levels.last().filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).withColumn("node", F.monotonically_increasing_id())
        inside = inner.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("name"), F.col("value").alias("inner_value")))
        text = F.when(F.schema_of_variant("inner_value") == "STRING", F.try_variant_get("inner_value", "$", "string"))
        entries = inside.select("key", "node", "name", text.alias("text"), "inner_value")
        maps = entries.filter("name is not null").groupBy("key", "node").agg(F.count_if(F.coalesce(F.col("text").rlike("^https?://"), F.lit(False))).alias("n"), F.count("*").alias("all"), F.collect_set("text").alias("texts"))
        found.add(maps.filter("n * 2 > all").select("key", F.explode("texts").alias("uri")).filter("uri <> ''").distinct())
        some = levels.add(entries.select("key", F.lit(0).cast("long").alias("node"), F.col("inner_value").alias("v")).filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
    if not found.count:
        return rows.select(F.col(key), F.lit("").alias("uri")).limit(0)
    return found.every().distinct().withColumnRenamed("key", key)
