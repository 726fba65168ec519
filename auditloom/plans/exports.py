"""Exports of statements and the monitor of new filings: what is written, read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.lineage import shared_folder
from auditloom.plans.proxies import table
from auditloom.plans.registry import Registry
from auditloom.sources import sinks
from auditloom.streaming import monitor as M

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

# --- statements: an order is a statement of its customer's filing, its lines are the facts ------------------------------------------

FACTS_SQL = """f AS (SELECT o_custkey AS filing_id, o_orderkey AS stmt_seq, o_orderpriority || ' (' || o_orderstatus || ')' AS title, CASE o_orderstatus WHEN 'F' THEN 'CORE_STATEMENT' WHEN 'O' THEN 'DETAIL' ELSE 'NOTE' END AS category,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS fact_seq, 'Line' || l_linenumber AS concept, l_extendedprice AS value, CASE WHEN l_suppkey % 2 = 0 THEN l_returnflag END AS label,
  l_linenumber % 3 = 0 AS is_total, l_quantity < 5 AS is_abstract, CASE WHEN l_tax > 0.02 THEN strftime(l_shipdate, '%Y-%m-%d') END AS period_end FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _statement_facts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"))
    status = F.col("o_orderstatus")
    return lines.select(
        F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("stmt_seq"), F.concat("o_orderpriority", F.lit(" ("), status, F.lit(")")).alias("title"), F.when(status == "F", "CORE_STATEMENT").when(status == "O", "DETAIL").otherwise("NOTE").alias("category"),
        seq.cast("long").alias("fact_seq"), F.concat(F.lit("Line"), "l_linenumber").alias("concept"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag")).alias("label"),
        (F.col("l_linenumber") % 3 == 0).alias("is_total"), (F.col("l_quantity") < 5).alias("is_abstract"), F.when(F.col("l_tax") > 0.02, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("period_end"),
    )


NAMED_SQL = f"""{FACTS_SQL}, s AS (SELECT DISTINCT filing_id, stmt_seq, title, CASE category WHEN 'CORE_STATEMENT' THEN 'core' WHEN 'DETAIL' THEN 'details' ELSE 'other' END AS route, rtrim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_.\\-]+', '_', 'g'), '^_+', ''), '_') AS base FROM f),
named AS (SELECT *, base || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS file_name FROM s WINDOW w AS (PARTITION BY filing_id, route, base ORDER BY stmt_seq))"""


@_r.add(f"WITH {NAMED_SQL} SELECT route, filing_id, file_name, stmt_seq, count(*) AS n_facts, round(sum(value), 2) AS total FROM named JOIN f USING (filing_id, stmt_seq) WHERE filing_id % 3 < 2 GROUP BY route, filing_id, file_name, stmt_seq")
def exported_statements(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of filings are exported, the second one twice, the first time with other facts; a third is begun only. What is finished is read again."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    facts = _statement_facts(spark, d)
    sinks.export(facts.filter("filing_id % 3 = 0"), path, "first")
    sinks.export(facts.filter("filing_id % 3 = 1 and fact_seq < 3"), path, "second")
    sinks.export(facts.filter("filing_id % 3 = 1"), path, "second")
    begun = sinks.routed(facts.filter("filing_id % 3 = 2")).withColumn("batch", F.lit("third"))
    begun.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "route").parquet(f"{path}/statements")
    rows = sinks.exported(spark, path).groupBy("route", "filing_id", "file_name", "stmt_seq")
    return rows.agg(F.count("*").alias("n_facts"), F.round(F.sum("value"), 2).alias("total"))


@_r.add(f"WITH {FACTS_SQL} SELECT filing_id, stmt_seq, concept, arg_max(value, fact_seq) AS value, coalesce(arg_max(coalesce(label, concept), fact_seq), '') AS label, coalesce((SELECT arg_min(period_end, fact_seq) FROM f p WHERE p.stmt_seq = f.stmt_seq AND p.filing_id = f.filing_id AND NOT is_abstract AND period_end IS NOT NULL), '') AS period_end FROM f WHERE NOT is_abstract AND is_total GROUP BY filing_id, stmt_seq, concept")
def simplified_statements(spark: SparkSession, d: str) -> DataFrame:
    return sinks.simplified(_statement_facts(spark, d))


@_r.add(f"WITH {FACTS_SQL}, c AS (SELECT filing_id, stmt_seq, title, count(*) AS n FROM f WHERE category = 'CORE_STATEMENT' GROUP BY ALL) SELECT filing_id, count(*) AS core_statement_count, CAST(sum(n) AS BIGINT) AS n_facts, string_agg(title, ',' ORDER BY stmt_seq) AS titles FROM c GROUP BY filing_id")
def core_statement_info(spark: SparkSession, d: str) -> DataFrame:
    return sinks.core_info(_statement_facts(spark, d)).withColumn("titles", F.array_join("titles", ","))


@_r.add(f"""WITH {FACTS_SQL} SELECT filing_id, stmt_seq, any_value(title) AS title, any_value(c_name) AS company, count(*) AS total_facts, string_agg(concept, ',' ORDER BY fact_seq) AS concepts, first(value ORDER BY fact_seq) AS first_value FROM f JOIN customer ON c_custkey = filing_id WHERE category = 'CORE_STATEMENT' GROUP BY filing_id, stmt_seq""")
def core_statement_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON texts of core statements, read again."""
    info = table(spark, d, "customer").select(F.col("c_custkey").alias("filing_id"), F.col("c_name").alias("company"))
    texts = sinks.statement_json(_statement_facts(spark, d), info)
    j = F.from_json("json", "filing_info struct<company: string>, title string, total_facts long, facts array<struct<fact_seq: long, concept: string, value: double>>").alias("j")
    return texts.select("filing_id", "stmt_seq", j).select("filing_id", "stmt_seq", "j.title", "j.filing_info.company", "j.total_facts", F.array_join("j.facts.concept", ",").alias("concepts"), F.get("j.facts.value", F.lit(0)).alias("first_value"))


# --- the monitor: events arrive as filings in four files, some of them twice, errors fail ---------------------------------------------------


@_r.add("SELECT event_id, event_type, event_type <> 'error' OR user_id % 4 = 0 AS done, CASE WHEN event_type = 'error' AND user_id % 4 <> 0 THEN 0 ELSE 1 END AS n_done, CASE WHEN event_type = 'error' AND user_id % 4 <> 0 THEN 1 ELSE 0 END AS n_failed FROM events")
def monitor_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each event is processed until it succeeds, and then no more, whichever file it comes in, and however often.

    Errors fail; those of every fourth user fail in the first batch only.
    """
    path = f"{shared_folder(spark)}/monitor-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    for k in range(4):
        events.filter((F.col("event_id") % 4 == k) | (F.col("event_id") % 10 == 0)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arrivals = M.read_arrivals(spark, f"{path}/in", "event_id long, event_type string, user_id long", files_per_trigger=1)
    turn = iter(range(10**6))

    def process(new: DataFrame) -> DataFrame:
        later = next(turn) > 0
        return new.filter((F.col("event_type") != "error") | (F.lit(later) & (F.col("user_id") % 4 == 0)))

    M.monitor(arrivals, process, f"{path}/done", f"{path}/mark", key="event_id").awaitTermination()
    count = lambda df, name: df.groupBy("event_id").agg(F.count("*").alias(name))
    done = count(spark.read.parquet(f"{path}/done"), "n_done")
    last = spark.read.parquet(f"{path}/done_failed")
    failed = count(last.join(last.agg(F.max("batch").alias("batch")), "batch"), "n_failed")
    out = events.distinct().join(done, "event_id", "left").join(failed, "event_id", "left").fillna(0, ["n_done", "n_failed"])
    return out.select("event_id", "event_type", (F.col("n_done") > 0).alias("done"), "n_done", "n_failed")
