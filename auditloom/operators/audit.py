"""Audits of relational tables: duplicate keys, orphans, status consistency, clean-up sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, keys: list[str], ignore_null: bool = False) -> DataFrame:
    """Keys that occur more than once. ignore_null leaves out rows with a null in a key."""
    rows = table.dropna(subset=keys) if ignore_null else table
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is not null and not found in parent."""
    keys = parent.select(F.col(parent_key).alias("_key")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_key"), "left_anti")


def keep_set(child: DataFrame, *parents: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows of child that have a match in each parent, given as (table, child key, parent key)."""
    for i, (parent, child_key, parent_key) in enumerate(parents):
        keys = parent.select(F.col(parent_key).alias(f"_key{i}"))
        child = child.join(keys, F.col(child_key) == F.col(f"_key{i}"), "left_semi")
    return child


def keep_oldest(table: DataFrame, keys: list[str], created: str) -> DataFrame:
    """Rows that no row of the same keys is older than; rows of equal age all stay."""
    oldest = table.groupBy(*keys).agg(F.min(created).alias("_oldest"))
    on = reduce(lambda a, b: a & b, [table[k].eqNullSafe(oldest[k]) for k in keys]) & table[created].eqNullSafe(oldest["_oldest"])
    return table.join(oldest, on, "left_semi")


def status_distribution(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in sorted(tables.items())])


def uniqueness(table: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Whether a unique constraint on keys would hold, with the number of keys that violate it."""
    return duplicate_keys(table, keys, ignore_null=True).agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations", (F.col("violations") == 0).alias("holds"))


def summary(table: DataFrame, status: str, values: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Counts of each status in one pass, and the share of the first one in percent of those that ended."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values]
    out = table.groupBy(*(by or [])).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("success_rate", F.round(F.coalesce(F.try_divide(F.col(f"n_{values[0].lower()}") * 100.0, F.col("total")), F.lit(0.0)), 2))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep_current: tuple[str, ...] = ()) -> DataFrame:
    """current with incoming merged in: known keys take incoming's non-null values (but for keep_current), new keys are added."""
    c, i = current.alias("c"), incoming.alias("i")
    on = reduce(lambda a, b: a & b, [F.col(f"c.{k}") == F.col(f"i.{k}") for k in keys])
    pick = lambda n: F.coalesce(f"c.{n}", f"i.{n}") if n in (*keys, *keep_current) else F.coalesce(f"i.{n}", f"c.{n}")
    return c.join(i, on, "full_outer").select(*[pick(n).alias(n) for n in current.columns])


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"))


def availability(required: DataFrame, in_catalog: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """What catalog and disk say of each required library: available, to re-index, to download again, or missing."""
    c, d = in_catalog.select(key, F.lit(True).alias("in_catalog")).distinct(), on_disk.select(key, F.lit(True).alias("on_disk")).distinct()
    out = required.join(c, key, "left").join(d, key, "left").fillna(False, ["in_catalog", "on_disk"])
    return out.withColumn("outcome", F.when(F.col("in_catalog") & F.col("on_disk"), "available").when(F.col("on_disk"), "reindex").when(F.col("in_catalog"), "redownload").otherwise("missing"))


def first_match(rows: DataFrame, by: list[str], rank: list[Column], columns: list[str]) -> DataFrame:
    """Of each group the row that ranks first."""
    picked = F.min_by(F.struct(*columns), F.struct(*rank)).alias("p")
    return rows.groupBy(*by).agg(picked).select(*by, *[F.col(f"p.{c}").alias(c) for c in columns if c not in by])
