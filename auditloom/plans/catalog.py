"""Audits and statistics of the relational catalog. Region, customer, orders, lineitem stand for markets, entities, searches, downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.operators import audit as A
from auditloom.operators import joins as J
from auditloom.plans.proxies import table
from auditloom.plans.registry import Registry
from auditloom.sources import searches, sinks
from auditloom.streaming import monitor as M

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def audit_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_keys(table(spark, d, "part"), ["p_brand", "p_type"])


@_r.add("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return A.orphans(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@_r.add("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1")
def completed_without_download(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return A.orphans(o, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@_r.add("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def not_exists_cleanup(spark: SparkSession, d: str) -> DataFrame:
    o, p = table(spark, d, "orders").filter("o_orderstatus != 'P'"), table(spark, d, "part").filter("p_size > 10")
    return A.keep_set(table(spark, d, "lineitem"), (o, "l_orderkey", "o_orderkey"), (p, "l_partkey", "p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_r.add("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus AND b.o_orderdate < a.o_orderdate)")
def keep_oldest_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return A.keep_oldest(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate").select("o_orderkey", "o_custkey", "o_orderstatus")


@_r.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.status_distribution(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@_r.add("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 2) AS success_rate FROM orders GROUP BY 1")
def conditional_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(table(spark, d, "orders"), "o_orderstatus", ("F", "O", "P"), ["o_orderpriority"])


@_r.add("SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def table_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.row_counts({n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "nation")})


@_r.add("SELECT 'orders_key' AS constraint_name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) = 0 AS holds UNION ALL SELECT 'part_brand_type', count(*), count(*) = 0 FROM (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING count(*) > 1)")
def uniqueness_constraints(spark: SparkSession, d: str) -> DataFrame:
    return A.uniqueness(table(spark, d, "orders"), "orders_key", ["o_orderkey"]).unionByName(A.uniqueness(table(spark, d, "part"), "part_brand_type", ["p_brand", "p_type"]))


@_r.add("""SELECT *, CASE WHEN in_catalog AND on_disk THEN 'available' WHEN on_disk THEN 'reindex' WHEN in_catalog THEN 'redownload' ELSE 'missing' END AS outcome FROM (
SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS in_catalog, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AS on_disk FROM part)""")
def availability_truth_table(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return A.availability(table(spark, d, "part").select("p_partkey"), lines.filter("l_quantity > 45"), lines.filter("l_discount > 0.08"), "p_partkey")


@_r.add("""WITH i AS (SELECT o_custkey AS k, max(o_totalprice) AS price FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 10 = 0)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(price, c_acctbal) AS c_acctbal, c_name FROM customer FULL JOIN i ON k = c_custkey""")
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")
    new = table(spark, d, "orders").filter("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    more = c.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_acctbal")
    return A.upsert(c, new.unionByName(more).withColumn("c_name", F.lit(None).cast("string")), ["c_custkey"])


@_r.add("SELECT o_orderkey, c_name, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderstatus, o_orderkey LIMIT 100) LEFT JOIN customer ON c_custkey = o_custkey")
def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 pending items by status and key, with their owner: a work queue."""
    q = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).orderBy("o_orderstatus", "o_orderkey").limit(100)
    return q.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", "o_orderstatus")


@_r.add("""SELECT facet, name, n FROM (
SELECT 'category' AS facet, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'statement_type', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'confidence', CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END, count(*) FROM orders GROUP BY 2)""")
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    """Three counts in one pass over grouping sets."""
    o = table(spark, d, "orders").select(F.lit(0).alias("filing_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("statement_type"), F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("confidence"))
    return sinks.catalog(o).drop("filing_id")


@_r.add("SELECT l_returnflag || '/' || l_shipmode_n AS name, n FROM (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS l_shipmode_n, count(*) AS n, min(l_orderkey) AS s FROM lineitem GROUP BY ALL ORDER BY n DESC, s, 1, 2 LIMIT 5)")
def topk_concepts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("string").alias("k")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("s"))
    return g.orderBy(F.desc("n"), "s", "l_returnflag", "k").limit(5).select(F.concat_ws("/", "l_returnflag", "k").alias("name"), "n")


@_r.add("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'only_r', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'either', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    side = lambda f: table(spark, d, "lineitem").filter(F.col("l_returnflag") == f).select("l_partkey")
    r, a = side("R"), side("A")
    sets = {"both": r.intersect(a), "only_r": r.subtract(a), "either": r.union(a).distinct()}
    out = [s.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, s in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_r.add("SELECT source, count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS unmapped, round((count(*) - count(*) FILTER (l.doc_id IS NULL)) * 100.0 / count(*), 2) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", F.lit(True).alias("known"))
    g = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("unmapped"))
    return g.withColumn("coverage", F.round((F.col("total") - F.col("unmapped")) * 100.0 / F.col("total"), 2))


@_r.add("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unmapped_facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@_r.add("SELECT n_regionkey AS market, count(DISTINCT c_custkey) AS entities, count(o_orderkey) AS searches, min(o_orderdate)::DATE::VARCHAR AS first_date, max(o_orderdate)::DATE::VARCHAR AS last_date FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def filing_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return c.groupBy(F.col("n_regionkey").alias("market")).agg(F.count_distinct("c_custkey").alias("entities"), F.count("o_orderkey").alias("searches"), day(F.min("o_orderdate")).alias("first_date"), day(F.max("o_orderdate")).alias("last_date"))


@_r.add("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_filing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return A.first_match(o, ["o_custkey"], [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


@_r.add("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", M.rate(F.col("ts"), ["user_id"], 86400).alias("n"))


@_r.add("SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000 AS gap FROM events")
def min_interval(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", M.gap_seconds(F.col("ts"), ["user_id"], "event_id").alias("gap"))


@_r.add("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, max(ts) OVER () AS now FROM events) WHERE r = 1 AND epoch_us(now) - epoch_us(ts) <= 3 * 86400000000")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user if it is not older than three days before the last of all."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    latest = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value", "ts"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")
    now = e.agg(F.max("ts").alias("now"))
    return latest.join(F.broadcast(now)).filter(F.unix_micros("now") - F.unix_micros("ts") <= 3 * 86400 * 1_000_000).select("user_id", "event_id", "value")  # now: one row


@_r.add("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.windowed_counts(e, "ts", ["event_type"], "1 day").select("event_type", F.unix_seconds("window.start").alias("day"), "n")


@_r.add("""SELECT event_type, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1""")
def operation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@_r.add("""SELECT a.o_orderkey AS instant_key, b.o_orderkey AS duration_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND CAST(a.o_orderdate AS DATE) BETWEEN CAST(b.o_orderdate AS DATE) AND CAST(b.o_orderdate AS DATE) + 90""")
def instant_in_duration(spark: SparkSession, d: str) -> DataFrame:
    """Instants within durations of the same owner: a range join on buckets of days."""
    day = F.to_date("o_orderdate")
    a = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("instant_key"), day.alias("instant"))
    b = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("duration_key"), day.alias("start"), F.date_add(day, 90).alias("end"))
    return J.within(a, b, ["o_custkey"], "instant", "start", "end", 90).filter("instant_key != duration_key").select("instant_key", "duration_key")


@_r.add("""SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 5""")
def period_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of dates of one owner that are at most five days apart: a band join on buckets of days."""
    day = F.to_date("o_orderdate")
    a = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("a_key"), day.alias("a_day"))
    b = a.select("o_custkey", F.col("a_key").alias("b_key"), F.col("a_day").alias("b_day"))
    return J.near(a, b, ["o_custkey"], "a_day", "b_day", 5).filter("a_key < b_key").select("a_key", "b_key")


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'manual_intervention' WHEN o_orderstatus = 'F' AND o_custkey % 5 >= 3 THEN 'try_alternative_url' WHEN o_orderstatus = 'O' AND o_orderkey % 3 >= 2 THEN 'try_alternative_url' ELSE 'retry_same_url' END AS strategy FROM orders""")
def retry_strategy(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") == "P", "disk_full").when(F.col("o_orderstatus") == "F", "url_404").otherwise("corrupted_zip")
    return table(spark, d, "orders").select("o_orderkey", C.retry_strategy(reason, F.col("o_custkey") % 5, F.col("o_orderkey") % 3).alias("strategy"))


@_r.add("""SELECT p_partkey, first(s_suppkey ORDER BY s_suppkey) AS s_suppkey FROM part JOIN supplier ON contains(lower(s_name), right(CAST(p_partkey AS VARCHAR), 2)) AND p_size % 5 = s_nationkey % 5 GROUP BY p_partkey""")
def substring_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first supplier whose name holds a text, within the same class: a join on pieces of names."""
    p = table(spark, d, "part").select("p_partkey", F.right(F.col("p_partkey").cast("string"), F.lit(2)).alias("text"), (F.col("p_size") % 5).alias("c"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("name"), (F.col("s_nationkey") % 5).alias("c"))
    return p.join(J.first_holding(p, s, ["c"]), ["c", "text"]).select("p_partkey", F.col("id").alias("s_suppkey"))


@_r.add("""SELECT c_custkey, coalesce((SELECT min(c.c_custkey) FROM customer c WHERE c.c_nationkey = w.c_nationkey AND c.c_name = w.t), (SELECT min(c.c_custkey) FROM customer c WHERE c.c_nationkey = w.c_nationkey AND contains(c.c_name, w.t))) AS first_key
FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN right(c_name, 4) ELSE right(c_name, 5) END AS t FROM customer) w""")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's name, or an end of one, looked up in a nation: an equal name first, else the first that holds it."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.when(k % 3 == 0, name).when(k % 3 == 1, F.right(name, F.lit(4))).otherwise(F.right(name, F.lit(5)))
    wanted = table(spark, d, "customer").select("c_custkey", "c_nationkey", text.alias("text"))
    names = table(spark, d, "customer").select("c_nationkey", k.alias("id"), name.alias("name"))
    return wanted.join(J.first_holding(wanted, names, ["c_nationkey"]), ["c_nationkey", "text"]).select("c_custkey", F.col("id").alias("first_key"))


@_r.add("""WITH c AS (SELECT o_custkey AS filing_id, o_orderkey AS k, 40000 + o_orderkey % 30000 AS size, CASE o_orderpriority[1] WHEN '1' THEN 'balance' WHEN '2' THEN 'income' WHEN '3' THEN 'cashflow' WHEN '4' THEN 'equity' END AS slot FROM orders)
SELECT filing_id, slot, k FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, slot ORDER BY size DESC, k) AS r FROM c WHERE slot IS NOT NULL) WHERE r = 1""")
def slot_assign(spark: SparkSession, d: str) -> DataFrame:
    """The largest candidate of each statement slot of a filing."""
    slot = F.substring("o_orderpriority", 1, 1)
    slot = F.when(slot == "1", "balance").when(slot == "2", "income").when(slot == "3", "cashflow").when(slot == "4", "equity")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("k"), (40000 + F.col("o_orderkey") % 30000).alias("size"), slot.alias("slot")).filter("slot is not null")
    return A.first_match(c, ["filing_id", "slot"], [-F.col("size"), F.col("k")], ["k"])


@_r.add("""SELECT l_orderkey, l_linenumber, n, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS running FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""")
def running_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))


_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'Text/XML; charset=utf-8' WHEN 2 THEN 'text/html' WHEN 3 THEN 'application/octet-stream' WHEN 4 THEN '' END"
_URL = "CASE p_size % 7 WHEN 0 THEN 'http://h/a.ZIP' WHEN 1 THEN 'http://h/a.xsd' WHEN 2 THEN 'http://h/a/' WHEN 3 THEN 'http://h/a.xhtml' WHEN 4 THEN 'http://h/a.tar.xz' WHEN 5 THEN 'http://h/a' END"


@_r.add("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'archive' WHEN p_size % 7 = 3 THEN 'ixbrl' WHEN p_partkey % 6 = 1 THEN 'xsd' WHEN p_partkey % 6 = 2 THEN 'directory'
WHEN p_size % 7 IN (0, 4) THEN 'archive' WHEN p_size % 7 = 1 THEN 'xsd' WHEN p_size % 7 = 2 THEN 'directory' ELSE 'unknown' END AS kind FROM part""")
def distribution_types(spark: SparkSession, d: str) -> DataFrame:
    """What an address serves, by its content type and its end."""
    return table(spark, d, "part").select("p_partkey", searches.distribution_type(F.expr(_KIND), F.expr(_URL)).alias("kind"))


@_r.add("""SELECT c_custkey AS cik, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INT) AS place, CAST(o_orderkey AS VARCHAR) AS accession, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date, o_orderstatus AS form
FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) <= 5""")
def recent_filings(spark: SparkSession, d: str) -> DataFrame:
    """The first five filings of a form and of some years from each entity's list of submissions."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cik"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")
    rows = o.groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "day", "o_orderstatus"))).alias("r"))
    column = lambda n: F.transform("r", lambda x: x[n].cast("string"))
    recent = F.struct(column("o_orderkey").alias("accessionNumber"), column("day").alias("filingDate"), column("o_orderstatus").alias("form"))
    bodies = rows.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))
    return searches.recent_filings(bodies, "F", 5, "1996-01-01", "1999-12-31")
