"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import classify, names, numbers, periods, urls
from auditloom.plans.proxies import ROUNDED, equal_sql, table
from auditloom.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


def _case(column: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def _case_sql(column: str, values: list[str]) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[{column} % {len(values)} + 1]"


PRINTED_SQL = "CASE c_custkey % 6 WHEN 0 THEN '-' WHEN 1 THEN 'n/a' WHEN 2 THEN 'junk' ELSE CASE WHEN c_acctbal < 0 THEN '($' || format('{:.2f}', -c_acctbal) || ')' ELSE ' $' || format('{:,.2f}', c_acctbal) END END"


@_r.add(f"SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1) THEN 0.0 WHEN c_custkey % 6 = 2 THEN NULL ELSE CAST(replace(replace(replace(replace(trim(t), ',', ''), '$', ''), '(', '-'), ')', '') AS DOUBLE) END AS value FROM (SELECT c_custkey, {PRINTED_SQL} AS t FROM customer)")
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("c_acctbal"), F.col("c_custkey") % 6
    money = F.when(v < 0, F.concat(F.lit("($"), F.translate(F.format_number(-v, 2), ",", ""), F.lit(")"))).otherwise(F.concat(F.lit(" $"), F.format_number(v, 2)))
    text = F.when(k == 0, "-").when(k == 1, "n/a").when(k == 2, "junk").otherwise(money)
    return table(spark, d, "customer").select("c_custkey", numbers.parse_number(text).alias("value"))


CONCEPTS = ["us-gaap:CashAndCash_Equivalents", "us-gaap_Assets", "v_CustomItem", "verylongprefix_Asset", "a_b", "{http://fasb.org/us-gaap/2024}Liabilities", "Revenue-Total", ""]
KEYS = ["cashandcashequivalents", "assets", "customitem", "verylongprefixasset", "ab", "liabilities", "revenuetotal", ""]


@_r.add(f"SELECT p_partkey, {_case_sql('p_partkey', KEYS)} || CASE WHEN p_partkey % 8 = 7 THEN '' ELSE lower(replace(p_name, ' ', '')) END AS concept_key FROM part")
def normalize_concept(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 8 == 7, F.lit("")).otherwise(F.concat(_case(F.col("p_partkey"), CONCEPTS), F.translate("p_name", "#_-", "")))
    return table(spark, d, "part").select("p_partkey", names.concept_key(text).alias("concept_key"))


@_r.add("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '($' || format('{:,}', CAST(round_even(-c_acctbal, 0) AS BIGINT)) || ')' ELSE '$' || format('{:,}', CAST(round_even(c_acctbal, 0) AS BIGINT)) END AS shown FROM customer")
def format_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", names.display(F.col("c_acctbal")).alias("shown"))


@_r.add("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE c_custkey % 3 WHEN 0 THEN 'cik' WHEN 1 THEN 'ticker' ELSE 'name' END AS kind FROM customer")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.lit("BRK.B")).otherwise(F.concat(F.lit("Company "), k))
    return table(spark, d, "customer").select("c_custkey", names.cik(k).alias("cik"), names.identifier_type(text).alias("kind"))


FLAG = "CASE l_returnflag WHEN 'A' THEN -3 WHEN 'N' THEN 0 WHEN 'R' THEN 2 END"
LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _flag() -> Column:
    f = F.col("l_returnflag")
    return F.when(f == "A", -3).when(f == "N", 0).when(f == "R", 2)


@_r.add(f"SELECT {LINE_KEY}, {ROUNDED.format(v='l_extendedprice', d='(' + FLAG + ')')} + 0.0 AS rounded FROM lineitem")
def round_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE_KEY.split(", "), numbers.round_half_even(F.col("l_extendedprice"), _flag()).alias("rounded"))


@_r.add(f"SELECT {LINE_KEY}, {equal_sql('l_extendedprice', '(l_extendedprice + l_quantity * 10)', '(' + FLAG + ')')} AS equal FROM lineitem")
def compare_decimals(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(*LINE_KEY.split(", "), numbers.equal_at_precision(v, v + F.col("l_quantity") * 10, _flag(), F.lit(2)).alias("equal"))


@_r.add("SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN NULL ELSE 3 - CAST(floor(log10(abs(o_totalprice))) AS INT) - 1 END AS decimals FROM orders")
def precision_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", numbers.decimals_from_precision(F.col("o_totalprice"), F.lit(3)).alias("decimals"))


@_r.add("SELECT o_orderkey, round(least(pow(2.0, o_orderkey % 8), 60.0), 2) AS wait, CASE WHEN o_totalprice >= 300000 THEN 'ok' WHEN o_orderkey % 2 = 0 THEN 'temporary' ELSE 'permanent' END AS severity FROM orders")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_totalprice") >= 300000, 200).when(F.col("o_orderkey") % 2 == 0, 503).otherwise(404)
    return table(spark, d, "orders").select("o_orderkey", F.round(numbers.backoff(F.col("o_orderkey") % 8), 2).alias("wait"), classify.http_severity(status).alias("severity"))


@_r.add("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'duration' WHEN 1 THEN 'instant' WHEN 2 THEN 'unknown' ELSE 'unknown' END AS kind,
CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y') || '-01-01' END AS start, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "end",
CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y') END AS year,
CASE o_orderkey % 4 WHEN 0 THEN 'd_' || strftime(o_orderdate, '%Y') || '-01-01_' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'i_' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'y_' || strftime(o_orderdate, '%Y') END AS key FROM orders""")
def period_extract(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    mdy = F.concat_ws("_", F.month(day), F.dayofmonth(day), F.year(day))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Duration_1_1_"), F.year(day), F.lit("_To_"), mdy)).when(k == 1, F.concat(F.lit("AsOf_"), mdy, F.lit("_x"))).when(k == 2, F.concat(F.lit("fy"), F.year(day))).otherwise("c-4")
    return table(spark, d, "orders").select("o_orderkey", periods.period(text).alias("p")).select("o_orderkey", "p.*")


@_r.add("""SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND year(a.o_orderdate) = year(b.o_orderdate)""")
def period_match(spark: SparkSession, d: str) -> DataFrame:
    p = periods.period(F.concat(F.lit("AsOf_"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    a = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("a_key"), p.alias("pa"), p["year"].alias("year"))
    b = a.select("o_custkey", F.col("a_key").alias("b_key"), F.col("pa").alias("pb"), "year")
    return a.join(b, ["o_custkey", "year"]).filter((F.col("a_key") < F.col("b_key")) & periods.periods_match(F.col("pa"), F.col("pb"))).select("a_key", "b_key")


@_r.add(r"""SELECT page_id, regexp_extract(url, '^([A-Za-z][\w+.-]*)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z][\w+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""")
def url_components(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


NAMESPACES = ["http://fasb.org/us-gaap/2024", "http://xbrl.sec.gov/country/2023", "http://www.acme.com/20241231/", "http://fasb.org/us-gaap/1999", "http://xbrl.org/dei/2022", "https://charity.org/own/2024", "http://xbrl.sec.gov/custom/2024"]


@_r.add(f"""SELECT page_id, {_case_sql('page_id', ['us-gaap', 'country', 'company-extension', 'unknown', 'dei', 'company-extension', 'unknown'])} AS taxonomy, {_case_sql('page_id', ['2024', '2023', 'unknown', 'unknown', '2022', 'unknown', 'unknown'])} AS version,
{_case_sql('page_id', ['direct', 'included', 'skipped', 'unknown', 'direct', 'skipped', 'unknown'])} AS source,
{_case_sql('page_id', ['https://xbrl.fasb.org/us-gaap/2024/us-gaap-2024.zip', '', '', '', 'https://xbrl.org/dei/2022/dei-2022.zip', '', ''])} AS url FROM pages""")
def namespace_resolve(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.namespace_library(_case(F.col("page_id"), NAMESPACES)).alias("n")).select("page_id", "n.*")


@_r.add("""WITH p AS (SELECT unnest([1, 2]) AS pi, unnest(['https', 'http']) AS proto), h AS (SELECT unnest([1, 2]) AS hi, unnest(['xbrl.fasb.org', 'fasb.org']) AS host),
t AS (SELECT unnest([1, 2, 3, 4]) AS ti, unnest(['/T/V/T-V.zip', '/T/T-V.zip', '/taxonomies/T-V.zip', '/T-V.zip']) AS tail), n AS (SELECT n_nationkey, 'tax' || n_nationkey AS tax, CAST(2000 + n_nationkey AS VARCHAR) AS v FROM nation)
SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY pi, hi, ti) AS place, proto || '://' || host || replace(replace(tail, 'T', tax), 'V', v) AS url FROM n, p, h, t""")
def url_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    every = urls.url_candidates(F.lit("fasb.org"), F.concat(F.lit("tax"), "n_nationkey"), (2000 + F.col("n_nationkey")).cast("string"))
    return n.select("n_nationkey", F.posexplode(every).alias("place", "url")).select("n_nationkey", (F.col("place") + 1).cast("long").alias("place"), "url")


@_r.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NULL AS absent FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").isNull().alias("absent"))


@_r.add("""WITH RECURSIVE level AS (
  SELECT '$' AS path, CAST(props AS JSON) AS v FROM events
  UNION ALL SELECT path || step.name, step.value FROM (
    SELECT path, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'name': '.' || k, 'value': v -> k})
      WHEN 'ARRAY' THEN [{'name': '[0]', 'value': v -> 0}] END) AS step FROM level) WHERE step.value IS NOT NULL)
SELECT path, CASE json_type(v) WHEN 'UBIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'void' ELSE lower(json_type(v)) END AS kind, count(*) AS n FROM level GROUP BY ALL""")
def json_structure(spark: SparkSession, d: str) -> DataFrame:
    from auditloom.sources.filing_json import json_paths

    return json_paths(table(spark, d, "events"), "props")


@_r.add("SELECT o_orderkey, 'priority=' || o_orderpriority || ',status=' || o_orderstatus AS signature FROM orders")
def dimension_signature(spark: SparkSession, d: str) -> DataFrame:
    dims = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", names.dimension_signature(dims).alias("signature"))


ROLES = ["http://x/role/CoverPage", "http://x/role/BalanceSheetParenthetical", "http://x/role/DebtDetails", "http://x/role/LeasesTables", "http://x/role/AccountingPolicies", "http://x/role/ConsolidatedBalanceSheets", "http://x/role/StatementOfCashFlow", "http://x/role/Operations", "http://x/role/Stockholders", "http://x/role/Misc"]


@_r.add(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 5 THEN {_case_sql('o_orderkey', ['DOCUMENT', 'PARENTHETICAL', 'DETAIL', 'TABLE', 'POLICY', '', '', '', '', ''])}
WHEN (o_custkey % 30 >= 15)::INT + (o_custkey % 9 <= 6)::INT + (o_custkey % 3 >= 1)::INT >= 2 THEN 'CORE_STATEMENT' ELSE 'UNKNOWN' END AS category,
{_case_sql('o_orderkey', ['OTHER', 'BALANCE_SHEET', 'BALANCE_SHEET', 'OTHER', 'OTHER', 'BALANCE_SHEET', 'CASH_FLOW', 'INCOME_STATEMENT', 'EQUITY', 'OTHER'])} AS statement FROM orders""")
def network_classify(spark: SparkSession, d: str) -> DataFrame:
    role, c = _case(F.col("o_orderkey"), ROLES), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", classify.network_category(role, c % 30, c % 9, c % 3).alias("category"), classify.statement_type(role).alias("statement"))


@_r.add("SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '') AS title, CAST(len(regexp_extract_all(html, '(?is)<a\\b[^>]*>')) AS BIGINT) AS links FROM pages")
def markup_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tags and attributes of markup by pattern."""
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>"), 0)).cast("long").alias("links")
    )


@_r.add("SELECT o_orderkey, round(least(greatest(o_custkey * 100.0 / nullif(o_orderkey, 0), 0), 100), 2) AS done FROM orders")
def percent_done(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", numbers.percent_done(F.col("o_custkey"), F.col("o_orderkey")).alias("done"))


@_r.add("SELECT p_partkey, sha256(p_name) AS digest FROM part")
def file_integrity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"))
