"""Filing-like views of the driver tables, in Spark and in SQL.

An order is a context of its customer's filing, a line is a fact of concept Line<n> in it, and the order's total is the
reported parent of a calculation over its lines. fact_seq is a total order of the lines of an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.operators.lineage import dealt, tasks_for

FACT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select(*_fact(), "fact_seq")


def _fact() -> list[Column]:
    """A fact but for its place, from a line whose order is its context_id."""
    decimals = F.when(F.col("l_returnflag") == "A", -3).when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 2)
    return [
        F.lit(0).alias("filing_id"), F.col("context_id"), F.concat(F.lit("us-gaap:Line"), F.col("l_linenumber")).alias("concept"), F.col("l_extendedprice").alias("value"),
        F.col("l_linestatus").alias("unit"), decimals.cast("int").alias("decimals"),
    ]


def unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts without their places, for what does not ask for these: no line is shuffled."""
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "context_id").select(*_fact())


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with context_id and fact_seq. Lines are dealt out by context_id, under that name, so that facts stay where they are numbered."""
    stored = table(spark, sf_dir, "lineitem")
    lines = dealt(stored.withColumnRenamed("l_orderkey", "context_id"), tasks_for(stored), "context_id")
    return lines.withColumn("fact_seq", F.row_number().over(Window.partitionBy("context_id").orderBy(*FACT_ORDER)).cast("long"))


FACTS_SQL = """facts AS (
  SELECT l_orderkey AS context_id, 'us-gaap:Line' || l_linenumber AS concept, l_extendedprice AS value, l_linestatus AS unit,
         CASE l_returnflag WHEN 'A' THEN -3 WHEN 'N' THEN 0 WHEN 'R' THEN 2 END AS decimals,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS fact_seq
  FROM lineitem)"""

ROUNDED = "CASE {d} WHEN -3 THEN round_even({v} / 1000, 0) * 1000 WHEN 0 THEN round_even({v}, 0) WHEN 2 THEN round_even({v}, 2) ELSE {v} END"


def equal_sql(a: str, b: str, d: str) -> str:
    gap = f"abs({ROUNDED.format(v=a, d=d)} - {ROUNDED.format(v=b, d=d)})"
    return f"(CASE WHEN {d} IS NULL THEN abs({a} - {b}) <= 0.5 ELSE {gap} < CASE WHEN {d} >= 0 THEN 0.5 * pow(10.0, -{d}) ELSE 0.5 END END)"


DUPLICATES_SQL = f"""{FACTS_SQL},
firsts AS (SELECT *, first_value(value) OVER w AS v0, first_value(decimals) OVER w AS d0 FROM facts WINDOW w AS (PARTITION BY context_id, concept ORDER BY fact_seq)),
grouped AS (
  SELECT context_id, concept, count(*) AS n_entries, bool_and({equal_sql("value", "v0", "least(decimals, d0)")}) AS all_alike,
         CASE WHEN max(abs(value)) = 0 THEN 0 ELSE (max(abs(value)) - min(abs(value))) / max(abs(value)) END AS spread, count(DISTINCT decimals) AS n_precisions,
         first(value ORDER BY decimals DESC NULLS LAST, fact_seq) AS best, first(unit ORDER BY fact_seq) AS unit, max(decimals) AS decimals
  FROM firsts GROUP BY ALL),
resolved AS (
  SELECT *, CASE WHEN duplicate_type IS NULL OR duplicate_type <> 'inconsistent' THEN best END AS selected_value FROM (
    SELECT *, CASE WHEN n_entries = 1 THEN NULL WHEN NOT (all_alike OR spread <= 0.02) THEN 'inconsistent' WHEN n_precisions <= 1 THEN 'complete' ELSE 'consistent' END AS duplicate_type FROM grouped))"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order priority is a role whose total has lines 1 to 7 as children; line 4 counts negative."""
    roles = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("role")).distinct()
    n = F.explode(F.sequence(F.lit(1), F.lit(7)))
    return roles.select("role", F.lit("us-gaap:Total").alias("parent"), n.alias("arc_seq")).select(
        "role", "parent", F.concat(F.lit("us-gaap:Line"), F.col("arc_seq")).alias("child"), F.when(F.col("arc_seq") == 4, -1.0).otherwise(1.0).alias("weight"), "arc_seq"
    )


def parents(spark: SparkSession, sf_dir: str, filing: Column | None = None) -> DataFrame:
    """Totals of orders; filing: their filing_id, else 0."""
    return table(spark, sf_dir, "orders").select(
        (F.lit(0) if filing is None else filing).alias("filing_id"), F.col("o_orderkey").alias("context_id"), F.col("o_orderpriority").alias("role"), F.lit("us-gaap:Total").alias("parent"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus")).cast("string").alias("unit"), F.lit(None).cast("int").alias("decimals"), F.lit(None).cast("string").alias("duplicate_type"),
    )


BOUND_SQL = f"""{DUPLICATES_SQL},
arcs AS (SELECT role, k AS arc_seq, 'us-gaap:Line' || k AS child, CASE WHEN k = 4 THEN -1.0 ELSE 1.0 END AS weight
         FROM (SELECT DISTINCT o_orderpriority AS role FROM orders), (SELECT unnest(range(1, 8)) AS k)),
kids AS (
  SELECT o_orderkey AS context_id, role, o_totalprice AS value, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS unit, arc_seq, weight,
         selected_value AS cv, r.unit AS cu, r.decimals AS d, duplicate_type AS ct, selected_value IS NOT NULL AND coalesce(duplicate_type, '') <> 'inconsistent' AS found
  FROM orders JOIN arcs ON role = o_orderpriority LEFT JOIN resolved r ON r.context_id = o_orderkey AND r.concept = child),
marked AS (SELECT *, CASE WHEN ct = 'inconsistent' THEN 'skip_inconsistent_child' WHEN found AND unit IS NOT NULL AND cu IS NOT NULL AND unit <> cu THEN 'skip_unit_mismatch' END AS block FROM kids),
bound AS (
  SELECT *, CASE WHEN value IS NULL THEN 'skip_no_parent' WHEN blocked IS NOT NULL THEN blocked WHEN n_found = 0 THEN 'skip_no_children' WHEN n_found * 2 < n_children THEN 'skip_incomplete' ELSE 'bound' END AS status
  FROM (SELECT context_id, role, any_value(value) AS value, arg_min(block, arc_seq) FILTER (block IS NOT NULL) AS blocked, count(*) AS n_children, count(*) FILTER (found) AS n_found,
               CAST(sum(CAST(cv * weight AS DECIMAL(28,4))) FILTER (found) AS DOUBLE) AS expected, min(d) FILTER (found) AS child_decimals
        FROM marked GROUP BY context_id, role))"""

TOLERANCE_SQL = f"CASE WHEN child_decimals IS NOT NULL THEN {equal_sql('expected', 'value', 'child_decimals')} WHEN expected = 0 AND value = 0 THEN true WHEN abs(expected) < 1000 OR abs(value) < 1000 THEN abs(expected - value) <= 1.0 ELSE abs(expected - value) / greatest(abs(expected), abs(value)) <= 0.01 END"
SEVERITY_SQL = "CASE WHEN passed THEN 'info' WHEN expected * value < 0 THEN 'critical' WHEN abs(expected) > abs(value) THEN CASE WHEN abs(value) > 0 AND (abs(expected) - abs(value)) / abs(value) <= 0.05 THEN 'warning' ELSE 'critical' END WHEN abs(expected) < abs(value) THEN CASE WHEN n_found < n_children THEN 'warning' ELSE 'critical' END ELSE 'critical' END"
CHECKS_SQL = f"{BOUND_SQL}, checks AS (SELECT *, abs(expected - value) AS difference, {SEVERITY_SQL} AS severity FROM (SELECT *, {TOLERANCE_SQL} AS passed FROM bound WHERE status = 'bound'))"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs region → nation → customer as one tree a region; the order of siblings is a text."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    role = F.col("n_regionkey").cast("string").alias("role")
    top = nation.select(role, F.concat(F.lit("region"), "n_regionkey").alias("parent"), F.concat(F.lit("nation"), "n_nationkey").alias("child"), F.col("n_nationkey").cast("string").alias("order"), F.col("n_nationkey").cast("long").alias("arc_seq"))
    low = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        role, F.concat(F.lit("nation"), "n_nationkey").alias("parent"), F.concat(F.lit("customer"), "c_custkey").alias("child"), (F.col("c_custkey") % 7).cast("string").alias("order"), (F.col("c_custkey") + 1000).alias("arc_seq")
    )
    return top.unionByName(low).select(F.lit(0).alias("filing_id"), "*", F.lit(1.0).alias("weight"))


HIERARCHY_SQL = """arcs AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS role, 'region' || n_regionkey AS parent, 'nation' || n_nationkey AS child, CAST(n_nationkey AS BIGINT) AS ord, CAST(n_nationkey AS BIGINT) AS arc_seq FROM nation
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), 'nation' || n_nationkey, 'customer' || c_custkey, c_custkey % 7, c_custkey + 1000 FROM customer JOIN nation ON c_nationkey = n_nationkey),
walk AS (
  SELECT role, parent AS concept, CAST(NULL AS VARCHAR) AS parent, 0 AS level, lpad('0', 8, '0') || lpad(CAST(min(arc_seq) AS VARCHAR), 8, '0') AS sort_key, parent AS path
  FROM arcs a WHERE NOT EXISTS (SELECT 1 FROM arcs b WHERE b.role = a.role AND b.child = a.parent) GROUP BY role, a.parent
  UNION ALL SELECT w.role, a.child, w.concept, w.level + 1, w.sort_key || lpad(CAST(a.ord AS VARCHAR), 8, '0') || lpad(CAST(a.arc_seq AS VARCHAR), 8, '0'), w.path || '/' || a.child
  FROM walk w JOIN arcs a ON a.role = w.role AND a.parent = w.concept)"""
