"""Catalogs of filings and names over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import lookups as K
from auditloom.plans import proxies as X
from auditloom.plans.proxies import table
from auditloom.plans.registry import Registry
from auditloom.sources.filing_json import json_paths

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add("SELECT c_custkey, n_name AS market, c_name AS company FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE lower(r_name) = 'europe' AND contains(lower(c_name), '1')")
def filings_of_market(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    catalog = rows.select("c_custkey", F.col("r_name").alias("market"), F.col("c_name").alias("company"), "n_name")
    return K.of_company(K.of_market(catalog, "Europe"), "1").select("c_custkey", F.col("n_name").alias("market"), "company")


@_r.add("SELECT '$.' || k AS path, count(*) AS n FROM (SELECT unnest(json_keys(CAST(props AS JSON))) AS k FROM events) GROUP BY ALL")
def json_numbers(spark: SparkSession, d: str) -> DataFrame:
    return K.paths_of_kind(json_paths(table(spark, d, "events"), "props"), "bigint")


@_r.add(f"WITH {X.FACTS_SQL} SELECT context_id, concept, fact_seq, value FROM facts WHERE contains(lower(concept), 'line3')")
def facts_of_concept(spark: SparkSession, d: str) -> DataFrame:
    return K.of_concept(X.facts(spark, d), "LINE3").select("context_id", "concept", "fact_seq", "value")


@_r.add(f"WITH {X.FACTS_SQL} SELECT * FROM (SELECT context_id, concept, fact_seq, row_number() OVER (PARTITION BY context_id ORDER BY fact_seq) AS place FROM facts WHERE contains(lower(concept), 'line')) WHERE place <= 3")
def fact_listing(spark: SparkSession, d: str) -> DataFrame:
    return K.listing(X.facts(spark, d), ["context_id"], 3, "line").select("context_id", "concept", "fact_seq", "place")


@_r.add("SELECT o_orderpriority AS name, o_orderstatus AS version, arg_min(o_clerk, o_orderkey) AS url, min(o_orderkey) AS seq FROM (SELECT *, 'clerk' || (o_custkey % 9) AS o_clerk FROM orders) WHERE o_orderstatus <> 'P' GROUP BY ALL")
def required_libraries(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    url = F.concat(F.lit("clerk"), F.col("o_custkey") % 9)
    return K.required_libraries(o.select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("version"), url.alias("url"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "P").alias("is_required")))


@_r.add("SELECT s_suppkey, 'x' || (s_suppkey % 30) AS ticker, (SELECT min(c_custkey) FROM customer WHERE c_custkey % 40 = s_suppkey % 30 AND c_custkey % 40 >= 10) AS cik FROM supplier")
def ticker_numbers(spark: SparkSession, d: str) -> DataFrame:
    companies = table(spark, d, "customer").filter("c_custkey % 40 >= 10").select(F.concat(F.lit("X"), F.col("c_custkey") % 40).alias("ticker"), F.col("c_custkey").alias("cik"))
    return K.numbers_of_tickers(table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("x"), F.col("s_suppkey") % 30).alias("ticker")), companies)


@_r.add("""SELECT n_name AS role, coalesce((SELECT arg_min(s_name, s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 2 = 0), (SELECT arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey = n_nationkey)) AS definition FROM nation""")
def role_definitions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("role"))
    of = lambda t, p: table(spark, d, t).join(n, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
    schemas = of("supplier", "s").filter("s_suppkey % 2 = 0").select("role", F.col("s_name").alias("definition"), F.col("s_suppkey").alias("seq"))
    linkbases = of("customer", "c").select("role", F.col("c_name").alias("definition"), F.col("c_custkey").alias("seq"))
    return K.role_definitions(n.select("role"), schemas, linkbases)


@_r.add("""SELECT c_custkey, CAST(n_regionkey AS VARCHAR) AS role, 'nation' || n_nationkey AS parent, 'customer' || c_custkey AS child, c_nationkey = n_nationkey AS is_child
FROM customer JOIN nation ON n_nationkey IN (c_nationkey, (c_custkey % 25))""")
def children_of(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    key = F.explode(F.array_distinct(F.array(F.col("c_nationkey").cast("long"), (F.col("c_custkey") % 25).cast("long")))).alias("n_nationkey")
    pairs = table(spark, d, "customer").select("c_custkey", key).join(n, "n_nationkey")
    pairs = pairs.select("c_custkey", F.col("n_regionkey").cast("string").alias("role"), F.concat(F.lit("nation"), "n_nationkey").alias("parent"), F.concat(F.lit("customer"), "c_custkey").alias("child"))
    return K.child_of(pairs, X.hierarchy(spark, d))


@_r.add("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 500 AS a, o_orderkey % 500 AS b FROM orders WHERE o_orderkey % 4 = 0),
reach AS (SELECT 7 AS name, 0 AS depth UNION SELECT b, depth + 1 FROM reach JOIN e ON a = name WHERE depth < 40) SELECT CAST(name AS BIGINT) AS name, min(depth) AS depth FROM reach GROUP BY name""")
def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    """Everything that one schema leads to, over edges with cycles."""
    edges = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select((F.col("o_custkey") % 500).cast("long").alias("source"), (F.col("o_orderkey") % 500).cast("long").alias("target"))
    return K.closure(spark.range(7, 8).select(F.col("id").alias("name")), edges)


@_r.add(f"""WITH {X.FACTS_SQL}, g AS (SELECT context_id, concept, count(*) AS n FROM facts GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_facts, count(*) AS n_groups, count(*) FILTER (n > 1) AS n_repeated, count(DISTINCT context_id) AS n_contexts, count(DISTINCT concept) AS n_concepts,
(SELECT string_agg(concept, ',' ORDER BY concept) FROM (SELECT DISTINCT concept FROM g ORDER BY concept LIMIT 50)) AS concepts FROM g""")
def group_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return K.group_diagnosis(X.facts(spark, d))


@_r.add("""WITH r AS (SELECT event_type AS t, 'd' || (user_id % 10) AS f FROM events WHERE event_id % 3 <> 0)
SELECT 'type' AS facet, t AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'folder', f, count(*) FROM r GROUP BY ALL""")
def error_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("error_type"), F.concat(F.lit("d"), F.col("user_id") % 10, F.lit("/f"), "event_id", F.lit(".xml")).alias("path"))
    return K.error_statistics(rows, F.col("path"))
