"""Rules on names, documents and facts whose inputs are made from columns of the tables, and flagships that join several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import checks as K
from auditloom.functions import names, numbers
from auditloom.operators import facts as O
from auditloom.operators import reports as R
from auditloom.plans import filings as P
from auditloom.plans import proxies as X
from auditloom.plans import verification as V
from auditloom.plans.proxies import table
from auditloom.plans.registry import Registry
from auditloom.sources import instance_xml

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


def pick(index: Column, values: list[str]) -> Column:
    """The value at index modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def pick_sql(index: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + ({index}) % {len(values)}]"


# --- flagships ---------------------------------------------------------------------------------------------------------------------------

FULL_SQL = V.RESCUED_SQL.replace("l_extendedprice AS value", "CASE WHEN l_linenumber % 3 = 0 THEN -abs(l_extendedprice) ELSE l_extendedprice END AS value")


@_r.add(f"WITH {FULL_SQL} {V.RESULT_SQL}")
def rollup_full(spark: SparkSession, d: str) -> DataFrame:
    """Roll-ups of facts with the signs of their markup, where lines that an order lacks come from orders of its customer and year."""
    period = table(spark, d, "orders").select(F.col("o_orderkey").alias("context_id"), F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("period_key"))
    f = X.facts(spark, d).withColumn("concept_key", names.concept_key(F.col("concept")))
    signs = f.filter(F.substring("concept", -1, 1).cast("int") % 3 == 0).select("filing_id", "context_id", "concept", "concept_key", F.lit("-").alias("sign"), F.col("fact_seq").alias("sign_seq"))
    signed = O.sign_corrected(f, signs).drop("concept_key")
    others = signed.join(period, "context_id").withColumn("dimensional", F.lit(False))
    bound = O.bind(O.classify_duplicates(signed), X.arcs(spark, d), X.parents(spark, d).join(period, "context_id"), others)
    return O.rollup(bound).select("context_id", "role", F.round("expected", 2).alias("expected"), "value", "n_found", "n_children", "passed", "severity")


WRITTEN_SQL = (
    X.DUPLICATES_SQL.replace(X.FACTS_SQL, X.FACTS_SQL.replace("'us-gaap:Line' || l_linenumber AS concept", "'line' || l_linenumber AS concept").replace("WHEN 'R' THEN 2 END AS decimals", "WHEN 'R' THEN CASE WHEN l_quantity <= 25 THEN 2 END END AS decimals, CASE l_returnflag WHEN 'A' THEN '-3' WHEN 'N' THEN '0' WHEN 'R' THEN CASE WHEN l_quantity > 25 THEN 'INF' ELSE '2' END END AS raw"))
    .replace("count(DISTINCT decimals) AS n_precisions", "count(DISTINCT raw) AS n_precisions")
)


@_r.add(f"WITH {WRITTEN_SQL} SELECT context_id, concept, n_entries, duplicate_type, selected_value FROM resolved")
def dup_written(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates told apart by decimals as written (INF is exact) among concepts in several spellings."""
    n = F.col("l_linenumber").cast("string")
    spelled = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("us-gaap:Line"), n)).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("us-gaap_Line"), n)).otherwise(F.concat(F.lit("Line"), n))
    raw = F.when(F.col("l_returnflag") == "A", "-3").when(F.col("l_returnflag") == "N", "0").when(F.col("l_returnflag") == "R", F.when(F.col("l_quantity") > 25, "INF").otherwise("2"))
    f = X.numbered(spark, d).select(F.lit(0).alias("filing_id"), "context_id", spelled.alias("concept"), F.col("l_extendedprice").alias("value"), F.col("l_linestatus").alias("unit"), raw.alias("decimals_raw"), "fact_seq")
    resolved = O.classify_duplicates(O.by_concept_key(f.withColumn("decimals", numbers.parse_decimals(F.col("decimals_raw")))))
    return resolved.select("context_id", "concept", "n_entries", "duplicate_type", "selected_value")


@_r.add(f"WITH {P.CHECK_ROWS_SQL} SELECT check_type, check_name, passed, severity, count(*) AS n, count(DISTINCT filing_id) AS n_filings FROM results GROUP BY ALL")
def check_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the horizontal, vertical and library checks, counted."""
    return P._checks(spark, d).groupBy("check_type", "check_name", "passed", "severity").agg(F.count("*").alias("n"), F.count_distinct("filing_id").alias("n_filings"))


@_r.add(f"""WITH {X.BOUND_SQL}, s AS (SELECT context_id, value AS p, expected AS e, context_id % 3 = 0 AS minus FROM (SELECT context_id, CASE WHEN context_id % 5 = 0 THEN -expected WHEN context_id % 5 = 1 THEN 3 * expected WHEN context_id % 5 = 2 THEN expected ELSE value END AS value, expected FROM bound WHERE expected IS NOT NULL))
SELECT context_id, array_to_string(list_filter([CASE WHEN minus AND abs(-abs(p) - e) < abs(p - e) THEN 'correction' END, CASE WHEN p <> e AND abs(abs(p) - abs(e)) < 0.01 * abs(p) THEN 'magnitude' END, CASE WHEN p <> e AND abs(p - e - 2 * abs(e)) < 0.01 * abs(p) THEN 'opposite' END], lambda x: x IS NOT NULL), ',') AS diagnosis FROM s""")
def mismatch_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """What may explain totals that are the opposite, the triple or something else than their expected sums."""
    k, e = F.col("context_id") % 5, F.col("expected")
    b = P._bound(spark, d).filter("expected is not null").withColumn("p", F.when(k == 0, -e).when(k == 1, 3 * e).when(k == 2, e).otherwise(F.col("value")))
    return b.select("context_id", F.array_join(numbers.mismatch_diagnosis(F.col("p"), e, F.when(F.col("context_id") % 3 == 0, "-")), ",").alias("diagnosis"))


@_r.add(f"WITH {X.FACTS_SQL}, w AS (SELECT DISTINCT concept FROM facts WHERE decimals = 2 AND concept LIKE '%7') SELECT DISTINCT concept, context_id FROM facts WHERE concept IN (SELECT concept FROM w)")
def contexts_with_concept(spark: SparkSession, d: str) -> DataFrame:
    f = X.unplaced(spark, d)
    return O.contexts_with(f, f.filter("decimals = 2 and concept like '%7'")).select("concept", "context_id")


# --- names -------------------------------------------------------------------------------------------------------------------------------

FORMS = ["Annual", " 10-K ", "half year", "semi-Annual", "QFR", "10 q", "interim", "yearly", "prospectus", "Half-Year Report"]


@_r.add(f"""WITH t AS (SELECT c_custkey, {pick_sql("c_custkey", FORMS)} || CASE WHEN c_nationkey % 7 = 0 THEN ' ' || c_mktsegment ELSE '' END AS f FROM customer)
SELECT c_custkey, CASE replace(replace(lower(trim(f)), ' ', ''), '-', '') WHEN 'annual' THEN 'AFR' WHEN 'afr' THEN 'AFR' WHEN 'yearly' THEN 'AFR' WHEN '10k' THEN 'AFR' WHEN 'semiannual' THEN 'SFR' WHEN 'sfr' THEN 'SFR' WHEN 'halfyear' THEN 'SFR' WHEN 'interim' THEN 'IFR' WHEN 'ifr' THEN 'IFR' WHEN 'quarterly' THEN 'QFR' WHEN 'qfr' THEN 'QFR' WHEN '10q' THEN 'QFR' ELSE upper(trim(f)) END AS form FROM t""")
def european_form(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    f = F.concat(pick(F.col("c_custkey"), FORMS), F.when(F.col("c_nationkey") % 7 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(""))
    return c.select("c_custkey", names.european_form(f).alias("form"))


PREFIXES = ["us-gaap:", "us-gaap_", "{http://x.org/2024}", "acme_", "", "a:b:"]


@_r.add(f"""WITH t AS (SELECT p_partkey, {pick_sql("p_partkey", PREFIXES)} || CASE WHEN p_size % 2 = 0 THEN replace(p_brand, '#', '') ELSE p_type END || CASE WHEN p_size % 5 = 0 THEN '_' || p_type ELSE '' END AS c, {pick_sql("p_size", PREFIXES[:3])} || CASE WHEN p_size % 2 = 0 THEN replace(p_brand, '#', '') ELSE p_type END AS o FROM part),
cut AS (SELECT *, regexp_extract(c, '[^:]*$') AS after, CASE WHEN c LIKE '{{%' THEN regexp_extract(c, '^\\{{[^}}]*\\}}(.*)$', 1) WHEN contains(c, ':') THEN regexp_extract(c, '^[^:]*:(.*)$', 1) WHEN regexp_matches(c, '^[A-Za-z][A-Za-z0-9_-]*?_[A-Z]') THEN regexp_extract(c, '^[A-Za-z][A-Za-z0-9_-]*?_([A-Z].*)$', 1) ELSE c END AS l,
  CASE WHEN o LIKE '{{%' THEN regexp_extract(o, '^\\{{[^}}]*\\}}(.*)$', 1) WHEN contains(o, ':') THEN regexp_extract(o, '^[^:]*:(.*)$', 1) WHEN regexp_matches(o, '^[A-Za-z][A-Za-z0-9_-]*?_[A-Z]') THEN regexp_extract(o, '^[A-Za-z][A-Za-z0-9_-]*?_([A-Z].*)$', 1) ELSE o END AS lo FROM t)
SELECT p_partkey, lower(replace(replace(replace(regexp_extract(after, '[^_]*$'), '_', ''), '-', ''), ' ', '')) AS last_key, l = lo AS same, '{{http://new}}' || l AS moved FROM cut""")
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    """Keys by the last part, equality of local names and names in another namespace, for spellings of brands and types."""
    part = table(spark, d, "part")
    word = F.when(F.col("p_size") % 2 == 0, F.translate("p_brand", "#", "")).otherwise(F.col("p_type"))
    c = F.concat(pick(F.col("p_partkey"), PREFIXES), word, F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("_"), "p_type")).otherwise(""))
    other = F.concat(pick(F.col("p_size"), PREFIXES[:3]), word)
    return part.select("p_partkey", names.last_part_key(c).alias("last_key"), names.local_names_match(c, other).alias("same"), names.replace_namespace(c, F.lit("http://new")).alias("moved"))


ARCROLES = ["parent-child", "summation-item", "domain-member", "all", "notAll", "own", ""]


@_r.add(f"""WITH t AS (SELECT c_custkey, {pick_sql("c_custkey", ARCROLES)} AS n FROM customer)
SELECT c_custkey, CASE WHEN n IN ('parent-child', 'summation-item') THEN 'http://www.xbrl.org/2003/arcrole/' || n WHEN n IN ('domain-member', 'all', 'notAll') THEN 'http://xbrl.org/int/dim/arcrole/' || n END AS uri, CASE WHEN n IN ('own', '') THEN NULL ELSE n END AS name FROM t""")
def arcroles(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of relationships and back."""
    uri = names.arcrole_uri(pick(F.col("c_custkey"), ARCROLES))
    return table(spark, d, "customer").select("c_custkey", uri.alias("uri"), names.arcrole_name(uri).alias("name"))


STATEMENTS = ["Balance Sheet", "Statement_of-Financial-Position", "profit-or-loss", "ProfitAndLoss", "Cash_Flow_Statement", "notes", "Segment information", "equity-statement_details", "Comprehensive_Income"]


@_r.add(f"""WITH t AS (SELECT o_custkey AS filing_id, o_orderkey AS stmt_seq, {pick_sql("o_orderkey", STATEMENTS)} AS n FROM orders),
k AS (SELECT *, replace(replace(regexp_replace(regexp_replace(lower(n), '(parenthetical|details|policies|tables)$', ''), '_$', ''), '_', ''), '-', '') AS key FROM t),
s AS (SELECT *, CASE key WHEN 'balancesheet' THEN 'balance_sheet' WHEN 'statementoffinancialposition' THEN 'balance_sheet' WHEN 'profitorloss' THEN 'income_statement' WHEN 'profitandloss' THEN 'income_statement' WHEN 'cashflowstatement' THEN 'cash_flow' WHEN 'equitystatement' THEN 'equity_statement' WHEN 'comprehensiveincome' THEN 'comprehensive_income' WHEN 'notes' THEN 'notes' END AS slot FROM k)
SELECT filing_id, slot, arg_max(n, stmt_seq) AS name FROM s WHERE slot IS NOT NULL GROUP BY filing_id, slot""")
def european_main(spark: SparkSession, d: str) -> DataFrame:
    """The main statements of each filing by their names; of several for one slot the last."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("stmt_seq"), pick(F.col("o_orderkey"), STATEMENTS).alias("n"))
    return R.european_main(o, F.col("n"), K.european_slot(F.col("n")))


# --- documents and facts -------------------------------------------------------------------------------------------------------------------

ENDS = [".zip", ".TAR.GZ", ".html", ".tgz", ""]


@_r.add(f"""WITH t AS (SELECT page_id, length(html) AS n, url, split_part(split_part(url, '?', 1), '#', 1) || {pick_sql("page_id", ENDS)} AS name, page_id % 6 > 0 AS there FROM pages)
SELECT page_id, array_to_string(list_filter([CASE WHEN NOT there THEN 'missing' END, CASE WHEN n < 3000 THEN 'too small' END, CASE WHEN NOT regexp_matches(lower(name), '\\.(zip|tar|tar\\.gz|tgz)$') THEN 'no archive' END], lambda x: x IS NOT NULL), ',') AS errors,
CASE WHEN page_id % 4 = 0 THEN 'https://base/' || page_id || '.zip' WHEN page_id % 4 = 1 THEN url WHEN page_id % 4 = 2 THEN 'https://base/r' || page_id END AS url FROM t""")
def document_rules(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against downloaded pages, and where a filing is to be had."""
    p, i = table(spark, d, "pages"), F.col("page_id")
    name = F.concat(F.substring_index(F.substring_index("url", "?", 1), "#", 1), pick(i, ENDS))
    package = F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit(".zip"))).when(i % 4 == 1, F.col("url")).when(i % 4 == 2, "")
    report = F.when(i % 4 == 2, F.concat(F.lit("r"), i.cast("string")))
    errors = K.download_errors(i % 6 > 0, F.length("html"), name, 3000)
    return p.select("page_id", F.array_join(errors, ",").alias("errors"), K.download_url(package, report, "https://base/").alias("url"))


@_r.add("""WITH t AS (SELECT l_orderkey, list(l_extendedprice) AS v, CAST(sum(CAST(l_extendedprice * CASE WHEN l_linenumber = 2 THEN -1 ELSE 1 END AS DECIMAL(28,2))) AS DECIMAL(38,2)) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 3 < 2 THEN l_orderkey % 3 = 0 OR s = CAST(s + 0.01 AS DECIMAL(38,2)) END AS valid, len(v) AS n FROM t""")
def arc_validity(spark: SparkSession, d: str) -> DataFrame:
    """Totals that are the weighted sum of their lines to the cent, that are a cent off, and that are unknown."""
    price = F.col("l_extendedprice")
    w = F.when(F.col("l_linenumber") == 2, -1.0).otherwise(1.0)
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(price.alias("v"), w.alias("w"))).alias("a"), F.sum((price * w).cast("decimal(28,2)")).alias("s"))
    k = F.col("l_orderkey") % 3
    parent = F.when(k == 0, F.col("s").cast("double")).when(k == 1, F.col("s").cast("double") + 0.01)
    return g.select("l_orderkey", K.arc_valid(parent, F.col("a.v"), F.col("a.w")).alias("valid"), F.size("a").cast("long").alias("n"))


MEMBERS = ["p:AllMember", "p_All_Member", "q:OtherMember", "", "x:y:All-Member"]


@_r.add(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v, l_quantity AS q, {pick_sql("l_suppkey", MEMBERS)} AS m, l_shipdate AS s, l_shipdate + INTERVAL 1 DAY * CAST(l_suppkey % 3 - 1 AS INT) AS e, l_tax FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, v BETWEEN 10000 AND 30000 AS within_bounds, CASE WHEN l_tax > 0.04 THEN s < e ELSE true END AS dates_ok, m = '' OR lower(replace(regexp_extract(regexp_extract(m, '[^:]*$'), '[^_]*$'), '-', '')) IN ('allmember', 'member') AS is_default FROM t""")
def fact_rules(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of values, order of dates and default members of lines."""
    s = F.col("l_shipdate").cast("timestamp")
    end = F.when(F.col("l_tax") > 0.04, F.timestamp_add("DAY", (F.col("l_suppkey") % 3 - 1).cast("int"), s))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("v"), K.value_within(F.col("l_extendedprice"), 10000, 30000).alias("within_bounds"), K.dates_consistent(s, end).alias("dates_ok"),
        K.is_default_member(pick(F.col("l_suppkey"), MEMBERS), F.lit("p_AllMember"), F.lit("p:Top_Member")).alias("is_default"),
    )


@_r.add("""SELECT o_orderkey, (o_orderpriority = '3-MEDIUM' OR o_orderpriority = CASE o_custkey % 3 WHEN 0 THEN '1-URGENT' ELSE '2-HIGH' END) AND (o_orderstatus = 'O' OR (o_custkey % 2 = 0 AND o_orderstatus = 'F')) AS is_default FROM orders""")
def default_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Contexts whose members are all defaults of their role: priority and status of orders."""
    o = table(spark, d, "orders")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    dims = F.map_from_entries(F.array_compact(F.array(F.when(F.col("o_orderpriority") != "3-MEDIUM", entry("P", F.col("o_orderpriority"))), F.when(F.col("o_orderstatus") != "O", entry("S", F.col("o_orderstatus"))))))
    defaults = F.map_from_entries(F.array_compact(F.array(entry("P", F.when(F.col("o_custkey") % 3 == 0, "1-URGENT").otherwise("2-HIGH")), F.when(F.col("o_custkey") % 2 == 0, entry("S", F.lit("F"))))))
    return o.select("o_orderkey", instance_xml.is_default(dims, defaults).alias("is_default"))


# --- reports -----------------------------------------------------------------------------------------------------------------------------

SUMMARY_SQL = """s AS (SELECT o_custkey AS filing_id, count(*) AS n_facts, count(*) FILTER (l_linestatus = 'O') AS n_monetary, count(*) FILTER (l_tax = 0) AS n_nil FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey),
t AS (SELECT * FROM (SELECT filing_id, concept, n, row_number() OVER (PARTITION BY filing_id ORDER BY n DESC, concept) AS place FROM (SELECT o_custkey AS filing_id, 'Line' || l_linenumber AS concept, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)) WHERE place <= 5)"""


def _summary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("filing_id", F.col("o_custkey"))
    summary = lines.groupBy("filing_id").agg(F.count("*").alias("n_facts"), F.count_if(F.col("l_linestatus") == "O").alias("n_monetary"), F.count_if(F.col("l_tax") == 0).alias("n_nil"))
    counts = lines.groupBy("filing_id", F.concat(F.lit("Line"), "l_linenumber").alias("concept")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("filing_id").orderBy(F.desc("n"), "concept"))
    return summary, counts.withColumn("place", place).filter("place <= 5")


@_r.add(f"""WITH {SUMMARY_SQL} SELECT filing_id, 'Filing: ' || filing_id || chr(10) || 'Company: ' || CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE c_name END || chr(10) || 'Form: ' || c_mktsegment || chr(10) || 'Date: N/A' || chr(10) || 'Facts: ' || n_facts
|| CASE WHEN n_monetary > 0 THEN chr(10) || 'Monetary: ' || n_monetary || ' (' || CAST(round(100.0 * n_monetary / n_facts) AS INT) || '%)' ELSE '' END || CASE WHEN n_nil > 0 THEN chr(10) || 'Nil: ' || n_nil || ' (' || CAST(round(100.0 * n_nil / n_facts) AS INT) || '%)' ELSE '' END
|| (SELECT coalesce(string_agg(chr(10) || '  ' || concept || ': ' || n, '' ORDER BY place), '') FROM t WHERE t.filing_id = s.filing_id) AS text FROM s JOIN customer ON c_custkey = filing_id""")
def filing_text(spark: SparkSession, d: str) -> DataFrame:
    summary, top = _summary(spark, d)
    info = table(spark, d, "customer").select(F.col("c_custkey").alias("filing_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("company"), F.col("c_mktsegment").alias("form"), F.lit(None).cast("string").alias("date"))
    return R.filing_text(info, summary, top)


@_r.add("""WITH f AS (SELECT l_suppkey AS filing_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS fact_seq, l_extendedprice AS value FROM lineitem)
SELECT s_suppkey AS filing_id, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS n, s_name AS first FROM supplier UNION ALL SELECT filing_id, CAST((fact_seq - 1) // 1000 + 1 AS BIGINT), count(*), CAST(min(fact_seq) AS VARCHAR) FROM f GROUP BY 1, 2""")
def parsed_json(spark: SparkSession, d: str) -> DataFrame:
    """Filings of suppliers as JSON in parts, read again."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"))
    facts = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("filing_id"), seq.cast("long").alias("fact_seq"), F.col("l_extendedprice").alias("value"))
    info = table(spark, d, "supplier").select(F.col("s_suppkey").alias("filing_id"), F.col("s_name").alias("name"))
    j = F.from_json("json", "metadata struct<name: string>, facts array<struct<fact_seq: long, value: double>>").alias("j")
    read = R.parsed_json(info, facts).select("filing_id", "part", j)
    return read.select("filing_id", "part", F.coalesce(F.size("j.facts"), F.lit(0)).cast("long").alias("n"), F.coalesce("j.metadata.name", F.array_min("j.facts.fact_seq").cast("string")).alias("first"))


# --- texts put together from lists in steps of several columns, so that all branches and their order are met; SQL has the rules of its own -------


def _joined(parts: list[tuple[Column, list[str]]]) -> Column:
    return F.concat(*[pick(i, values) for i, values in parts])


def _joined_sql(parts: list[tuple[str, list[str]]]) -> str:
    return " || ".join(pick_sql(i, values) for i, values in parts)


def _any_sql(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


SIGN_PARTS = [["us-gaap:", "v_", "", "a:b_"], ["Payments", "Repayment", "Proceeds", "Revenue", "Decrease", "Increase", "Net", "Provided", "Gain", "Used", "paymentOf"], ["Expense", "Cost", "Loss", "Inflow", "Outflow", "Assets", "LossReserve", "cost"]]
SIGN_KEYS = ["p_partkey", "p_partkey // 4", "p_size"]


@_r.add(f"""WITH t AS (SELECT p_partkey, regexp_extract(regexp_extract({_joined_sql(list(zip(SIGN_KEYS, SIGN_PARTS, strict=True)))}, '[^:]*$'), '[^_]*$') AS l FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(l, '^(payment|repayment|decrease|use)|(expense|cost|loss)$|outflow', 'i') THEN -1 WHEN regexp_matches(l, '^(proceed|revenue|income|gain|increase|provide)|inflow', 'i') THEN 1 END AS sign FROM t""")
def name_signs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = _joined(list(zip([k, F.floor(k / 4), F.col("p_size")], SIGN_PARTS, strict=True)))
    return table(spark, d, "part").select("p_partkey", K.sign_of_name(text).alias("sign"))


DEFINITION_PARTS = [[" - Statement - ", " - Disclosure - ", " - Schedule - ", " - Document - "], ["Consolidated Balance Sheets", "Income", "Cash Flows", "Equity", "Accounting Policies", "Debt", "Financial Position", "Loss of Capital", "Shareholders"], ["", " (Details)", " (Tables)", ", policy", " of operations"]]
DEFINITION_KEYS = ["p_partkey", "p_partkey // 4", "p_partkey // 36"]


@_r.add(f"""WITH t AS (SELECT p_partkey, lower(p_size || {_joined_sql(list(zip(DEFINITION_KEYS, DEFINITION_PARTS, strict=True)))}) AS t FROM part)
SELECT p_partkey, CASE WHEN {_any_sql("t", ("statement", "sheet", "consolidated"))} THEN CASE WHEN {_any_sql("t", ("detail", "schedule", "table"))} THEN 'UNKNOWN' ELSE 'CORE_STATEMENT' END WHEN {_any_sql("t", ("detail", "schedule"))} THEN 'DETAIL' WHEN contains(t, 'table') THEN 'TABLE' WHEN contains(t, 'polic') THEN 'POLICY' ELSE 'UNKNOWN' END AS category,
CASE WHEN {_any_sql("t", ("balance sheet", "financial position"))} THEN 'BALANCE_SHEET' WHEN {_any_sql("t", ("income", "operations", "earnings", "profit", "loss"))} THEN 'INCOME_STATEMENT' WHEN contains(t, 'cash flow') THEN 'CASH_FLOW' WHEN {_any_sql("t", ("equity", "stockholders", "shareholders", "capital"))} THEN 'EQUITY' ELSE 'OTHER' END AS kind,
CASE WHEN {_any_sql("t", ("balance", "position"))} THEN 'balance_sheet' WHEN {_any_sql("t", ("income", "operations", "profit"))} THEN 'income_statement' WHEN contains(t, 'cash') THEN 'cash_flow' WHEN {_any_sql("t", ("equity", "stockholder"))} THEN 'equity' WHEN contains(t, 'comprehensive') THEN 'comprehensive_income' ELSE 'other' END AS simple FROM t""")
def definition_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.col("p_size").cast("string"), _joined(list(zip([k, F.floor(k / 4), F.floor(k / 36)], DEFINITION_PARTS, strict=True))))
    return table(spark, d, "part").select("p_partkey", K.definition_category(text).alias("category"), K.definition_type(text).alias("kind"), K.simple_type(text, F.lit(None).cast("string")).alias("simple"))


EUROPEAN_PARTS = [["Statement", "Balance", "Profit_Or", "Income", "Share", "Asset", "Equity-", "CashFlow"], ["OfFinancialPosition", "Sheet", "-Loss", "Statement", "Note", "Detail", "Other"], ["", "_Details", "Parenthetical", "_policies", " Tables"]]


@_r.add(f"""WITH t AS (SELECT p_partkey, {_joined_sql(list(zip(["p_partkey", "p_partkey // 8", "p_partkey // 56"], EUROPEAN_PARTS, strict=True)))} AS n FROM part),
k AS (SELECT *, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(n), 'parenthetical$', ''), 'details$', ''), 'policies$', ''), 'tables$', ''), '_', ''), '-', '') AS key FROM t)
SELECT p_partkey, CASE WHEN key IN ('statementoffinancialposition', 'profitorloss', 'statementofcashflows', 'statementofchangesinequity', 'statementofcomprehensiveincome', 'notesandmandatoryitems', 'balancesheet', 'consolidatedbalancesheet', 'incomestatement', 'profitandloss', 'cashflowstatement', 'equitystatement', 'comprehensiveincome', 'othercomprehensiveincome', 'notes') THEN 'main'
WHEN contains(lower(n), 'detail') THEN 'detail' WHEN contains(lower(n), 'note') THEN 'note' ELSE 'other' END AS category FROM k""")
def european_category(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = _joined(list(zip([k, F.floor(k / 8), F.floor(k / 56)], EUROPEAN_PARTS, strict=True)))
    return table(spark, d, "part").select("p_partkey", K.european_category(text).alias("category"))


URI_PARTS = [["http://", "https://www.", " http://xbrl."], ["fasb.org/", "esma.europa.eu/", "ifrs.org/", "acme.com/", "frc.org.uk/", "iasb.eu/"], ["US-GAAP/2024", "taxonomy", "srt/2023/", "dei", "own/2024//", "esef"]]
URI_KEYS = ["p_partkey", "p_partkey // 3", "p_partkey // 18"]


@_r.add(f"""WITH t AS (SELECT p_partkey, {_joined_sql(list(zip(URI_KEYS, URI_PARTS, strict=True)))} AS u FROM part)
SELECT p_partkey, CASE WHEN contains(lower(u), 'us-gaap') THEN 'us-gaap' WHEN {_any_sql("lower(u)", ("ifrs", "iasb"))} THEN 'ifrs' WHEN {_any_sql("lower(u)", ("uk-gaap", "frc.org.uk"))} THEN 'uk-gaap' WHEN {_any_sql("lower(u)", ("esef", "esma"))} THEN 'esef' WHEN contains(lower(u), 'dei') THEN 'dei' WHEN contains(lower(u), 'srt') THEN 'srt' ELSE regexp_extract(rtrim(u, '/'), '[^/]*$') END AS taxonomy, rtrim(trim(u), '/') AS uri FROM t""")
def taxonomy_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    uri = _joined(list(zip([k, F.floor(k / 3), F.floor(k / 18)], URI_PARTS, strict=True)))
    return table(spark, d, "part").select("p_partkey", names.taxonomy_of(uri).alias("taxonomy"), names.namespace_uri(uri).alias("uri"))


QNAME_PREFIXES = ["{http://x.org/2024}", "us-gaap:", "v_", "", "A-b_", "n:s:", "_"]


@_r.add(f"""WITH t AS (SELECT p_partkey, {pick_sql("p_partkey", QNAME_PREFIXES)} || CASE WHEN p_size % 2 = 0 THEN p_type ELSE replace(p_name, ' ', '_') END AS c FROM part),
b AS (SELECT *, regexp_matches(c, '^[A-Za-z][A-Za-z0-9_-]*?_[A-Z]') AS bar FROM t)
SELECT p_partkey, CASE WHEN starts_with(c, '{{') THEN regexp_extract(c, '^\\{{([^}}]*)\\}}', 1) END AS namespace, CASE WHEN starts_with(c, '{{') THEN NULL WHEN contains(c, ':') THEN split_part(c, ':', 1) WHEN bar THEN regexp_extract(c, '^([A-Za-z][A-Za-z0-9_-]*?)_[A-Z]', 1) END AS prefix,
CASE WHEN starts_with(c, '{{') THEN regexp_extract(c, '^\\{{[^}}]*\\}}(.*)$', 1) WHEN contains(c, ':') THEN regexp_extract(c, '^[^:]*:(.*)$', 1) WHEN bar THEN regexp_extract(c, '^[A-Za-z][A-Za-z0-9_-]*?_([A-Z].*)$', 1) ELSE c END AS local FROM b""")
def qname_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(pick(F.col("p_partkey"), QNAME_PREFIXES), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.translate("p_name", " ", "_")))
    return table(spark, d, "part").select("p_partkey", names.qname(text).alias("q")).select("p_partkey", "q.*")


FORM_PARTS = [["10k", "10-K", "10-q", "8K", "20-F", "def 14a", "6k", "40F", "s-1", "10Q"], ["", "/A", "/a", "T", "-405"], [" ", "", "\t"]]


@_r.add(f"""WITH t AS (SELECT o_orderkey, upper(trim({_joined_sql(list(zip(["o_orderkey", "o_orderkey // 10", "o_orderkey // 50"], FORM_PARTS, strict=True)))}, chr(9) || ' ')) AS t FROM orders), b AS (SELECT *, regexp_replace(t, '/A$', '') AS base FROM t),
f AS (SELECT *, CASE base WHEN '10K' THEN '10-K' WHEN '10Q' THEN '10-Q' WHEN '8K' THEN '8-K' WHEN '20F' THEN '20-F' WHEN '40F' THEN '40-F' WHEN '6K' THEN '6-K' ELSE base END AS known FROM b)
SELECT o_orderkey, known || CASE WHEN ends_with(t, '/A') THEN '/A' ELSE '' END AS form, CASE WHEN known IN ('10-K', '20-F', '40-F') THEN 'annual' WHEN known = '10-Q' THEN 'quarterly' WHEN known IN ('8-K', '6-K') THEN 'current' ELSE 'other' END AS category FROM f""")
def form_alias(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = _joined(list(zip([k, F.floor(k / 10), F.floor(k / 50)], FORM_PARTS, strict=True)))
    return table(spark, d, "orders").select("o_orderkey", names.form(text).alias("form"), names.form_category(text).alias("category"))
