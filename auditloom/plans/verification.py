"""Verification by two sources, checks against definitions, contexts and dimensions, reports and validations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import checks as K
from auditloom.functions import names
from auditloom.operators import contexts as C
from auditloom.operators import facts as O
from auditloom.operators import library as L
from auditloom.operators import reports as R
from auditloom.operators import verify as V
from auditloom.operators.lineage import cut
from auditloom.plans import proxies as X
from auditloom.plans.filings import LIBRARY_SQL, library_tables
from auditloom.plans.proxies import table
from auditloom.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

WEIGHT_SQL = "CASE WHEN k = 4 THEN -1.0 ELSE 1.0 END"


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return cut(O.classify_duplicates(X.facts(spark, d)))


def _checks(spark: SparkSession, d: str, arcs: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    return O.rollup(O.bind(O.classify_duplicates(X.facts(spark, d)) if resolved is None else resolved, arcs, X.parents(spark, d)))


def _tree_sql(checks: str) -> str:
    return f"SELECT role, count(*) AS nv, count(*) FILTER (passed) AS np FROM (WITH {checks} SELECT role, passed FROM checks) GROUP BY role"


@_r.add(f"""WITH roles AS (SELECT DISTINCT o_orderpriority AS role FROM orders), a AS ({_tree_sql(X.CHECKS_SQL)}), b AS ({_tree_sql(X.CHECKS_SQL.replace(WEIGHT_SQL, "1.0"))}),
s AS (SELECT role, coalesce(a.nv > 0 AND a.nv = a.np, false) AS company_passed, coalesce(a.nv, 0) AS company_contexts,
  CASE WHEN role <> '1-URGENT' THEN coalesce(b.nv > 0 AND b.nv = b.np, false) END AS taxonomy_passed, CASE WHEN role <> '1-URGENT' THEN coalesce(b.nv, 0) END AS taxonomy_contexts
  FROM roles LEFT JOIN a USING (role) LEFT JOIN b USING (role))
SELECT role, 'us-gaap:Total' AS parent, company_passed, company_contexts, taxonomy_passed, taxonomy_contexts, coalesce(company_passed = taxonomy_passed, true) AS sources_agree FROM s""")
def dual_verify(spark: SparkSession, d: str) -> DataFrame:
    """Totals by the company's calculation and by the taxonomy's, which has no negative weight and lacks one role."""
    company = X.arcs(spark, d)
    taxonomy = company.filter("role != '1-URGENT'").withColumn("weight", F.lit(1.0))
    resolved = _resolved(spark, d)
    return V.dual(V.tree_results(company, _checks(spark, d, company, resolved)), V.tree_results(taxonomy, _checks(spark, d, taxonomy, resolved)))


@_r.add(f"""WITH {X.CHECKS_SQL}, t AS (SELECT role, count(*) AS contexts_verified, count(*) FILTER (passed) AS contexts_passed, arg_min(round(expected, 2), context_id) AS expected, arg_min(value, context_id) AS value FROM checks GROUP BY role)
SELECT role, 'us-gaap:Total' AS parent, contexts_verified, contexts_passed, contexts_verified = contexts_passed AS passed, expected, value FROM t""")
def tree_results(spark: SparkSession, d: str) -> DataFrame:
    arcs = X.arcs(spark, d)
    return V.tree_results(arcs, _checks(spark, d, arcs)).withColumn("expected", F.round("expected", 2))


SIGNED_SQL = X.CHECKS_SQL.replace("l_extendedprice AS value", "CASE WHEN l_linenumber % 3 = 0 THEN -abs(l_extendedprice) ELSE l_extendedprice END AS value")
RESULT_SQL = "SELECT context_id, role, round(expected, 2) AS expected, value, n_found, n_children, passed, severity FROM checks"


def _result(rolled: DataFrame) -> DataFrame:
    return rolled.select("context_id", "role", F.round("expected", 2).alias("expected"), "value", "n_found", "n_children", "passed", "severity")


@_r.add(f"WITH {SIGNED_SQL} {RESULT_SQL}")
def rollup_signed(spark: SparkSession, d: str) -> DataFrame:
    """Roll-ups of facts whose signs stand in the markup: those of every third line are negative."""
    f = X.facts(spark, d).withColumn("concept_key", names.concept_key(F.col("concept")))
    signs = f.filter(F.substring("concept", -1, 1).cast("int") % 3 == 0).select("filing_id", "context_id", "concept", "concept_key", F.lit("-").alias("sign"), F.col("fact_seq").alias("sign_seq"))
    resolved = O.classify_duplicates(O.sign_corrected(f, signs))
    return _result(O.rollup(O.bind(resolved, X.arcs(spark, d), X.parents(spark, d))))


RESCUE_SQL = """fb AS (WITH p AS (SELECT o_orderkey AS context_id, o_custkey || '/' || year(o_orderdate) AS period_key, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS unit FROM orders),
  missing AS (SELECT p.*, 'us-gaap:Line' || k AS child FROM p, (SELECT unnest(range(1, 8)) AS k) WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.context_id = p.context_id AND f.concept = 'us-gaap:Line' || k)),
  named AS (SELECT f.*, p.period_key FROM facts f JOIN p USING (context_id))
  SELECT m.context_id, m.child, first(n.value ORDER BY n.fact_seq, n.context_id, n.value) AS child_value
  FROM missing m JOIN named n ON n.period_key = m.period_key AND n.concept = m.child AND n.context_id <> m.context_id AND (m.unit IS NULL OR n.unit IS NULL OR m.unit = n.unit) GROUP BY m.context_id, m.child),
arcs AS (SELECT role, k"""
RESCUED_SQL = (
    X.CHECKS_SQL.replace("arcs AS (SELECT role, k", RESCUE_SQL, 1)
    .replace("selected_value AS cv", "coalesce(selected_value, fb.child_value) AS cv")
    .replace("selected_value IS NOT NULL AND coalesce(duplicate_type", "coalesce(selected_value, fb.child_value) IS NOT NULL AND coalesce(duplicate_type")
    .replace("AND r.concept = child)", "AND r.concept = child LEFT JOIN fb ON fb.context_id = o_orderkey AND fb.child = arcs.child)")
    .replace("AND r.concept = child LEFT", "AND r.concept = arcs.child LEFT")
)


@_r.add(f"WITH {RESCUED_SQL} {RESULT_SQL}")
def rollup_rescued(spark: SparkSession, d: str) -> DataFrame:
    """Roll-ups where lines that an order lacks come from other orders of its customer and year."""
    period = table(spark, d, "orders").select(F.col("o_orderkey").alias("context_id"), F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("period_key"))
    f = X.facts(spark, d)
    others = f.join(period, "context_id").withColumn("dimensional", F.lit(False))
    return _result(O.rollup(O.bind(O.classify_duplicates(f), X.arcs(spark, d), X.parents(spark, d).join(period, "context_id"), others)))


PARTS_SQL = """arcs AS (SELECT p_brand AS role, p_type AS parent, p_size % 5 AS child, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE -1.0 END AS weight, p_partkey AS arc_seq FROM part)"""


def _part_arcs(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(-1.0)
    return table(spark, d, "part").select(F.col("p_brand").alias("role"), F.col("p_type").alias("parent"), (F.col("p_size") % 5).alias("child"), w.alias("weight"), F.col("p_partkey").alias("arc_seq"))


@_r.add(f"WITH {PARTS_SQL} SELECT parent, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM arcs GROUP BY parent HAVING count(DISTINCT role) > 1")
def multi_role_parents(spark: SparkSession, d: str) -> DataFrame:
    return V.multi_role_parents(_part_arcs(spark, d)).withColumn("roles", F.array_join("roles", ","))


@_r.add(f"""WITH {PARTS_SQL}, p AS (SELECT parent, count(DISTINCT role) AS n FROM arcs GROUP BY parent)
SELECT (SELECT count(*) FROM p) AS n_parents, (SELECT count(*) FROM arcs) AS n_arcs, (SELECT count(*) FROM p WHERE n > 1) AS n_multi_role, (SELECT count(DISTINCT role) FROM arcs) AS n_roles""")
def role_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.role_summary(_part_arcs(spark, d))


@_r.add(f"""WITH {PARTS_SQL}, w AS (SELECT role, parent, child, arg_min(weight, arc_seq) AS weight FROM arcs GROUP BY ALL), q AS (SELECT DISTINCT p_brand AS role, p_type AS parent, p_size % 7 AS child FROM part)
SELECT role, parent, child, weight, weight IS NOT NULL AS is_child FROM q LEFT JOIN w USING (role, parent, child)""")
def weight_lookup(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "part").select(F.col("p_brand").alias("role"), F.col("p_type").alias("parent"), (F.col("p_size") % 7).alias("child")).distinct()
    return V.weights_of(pairs, _part_arcs(spark, d))


@_r.add(f"WITH {LIBRARY_SQL} SELECT * FROM counts")
def library_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.library_counts(*library_tables(spark, d))


@_r.add(f"""WITH {LIBRARY_SQL} SELECT filing_id, 'library' AS check_type, 'concept_validity' AS check_name, n_unknown = 0 AS passed, 'info' AS severity, n_valid + n_extension + n_unknown AS n_checked, n_unknown AS n_found FROM counts
UNION ALL SELECT filing_id, 'library', 'period_type_match', n_wrong_periods = 0, CASE WHEN n_wrong_periods = 0 THEN 'info' ELSE 'warning' END, n_periods, n_wrong_periods FROM counts
UNION ALL SELECT filing_id, 'library', 'balance_type_match', true, 'info', n_balances, n_negative FROM counts""")
def library_checks(spark: SparkSession, d: str) -> DataFrame:
    return L.library_checks(L.library_counts(*library_tables(spark, d)))


@_r.add(f"WITH {LIBRARY_SQL} SELECT p_brand AS source, count(*) AS n, count(*) FILTER (kind = 'instant') AS n_instant, count(*) FILTER (kind = 'duration') AS n_duration, count(balance) AS n_balance FROM defs JOIN part USING (p_partkey) GROUP BY p_brand")
def taxonomy_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.taxonomy_summary(library_tables(spark, d)[1])


CONTEXTS_SQL = "contexts AS (SELECT o_custkey AS filing_id, o_orderkey AS context_id, o_orderpriority AS entity, CAST(year(o_orderdate) AS VARCHAR) AS period_key, o_orderstatus = 'F' AS dimensional FROM orders)"


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    dims = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("Status"), "o_orderstatus"))
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("context_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("entity"), F.year("o_orderdate").cast("string").alias("period_key"), dims.alias("dims")
    )


@_r.add(f"""WITH {CONTEXTS_SQL}, plain AS (SELECT filing_id, entity, period_key, min(context_id) AS default_id FROM contexts WHERE NOT dimensional GROUP BY ALL)
SELECT c.filing_id, c.context_id, default_id FROM contexts c LEFT JOIN plain USING (filing_id, entity, period_key) WHERE dimensional""")
def default_contexts(spark: SparkSession, d: str) -> DataFrame:
    return C.default_contexts(_contexts(spark, d))


@_r.add(f"WITH {CONTEXTS_SQL} SELECT filing_id, period_key, count(*) AS n, count(*) FILTER (dimensional) AS n_dimensional, min(context_id) AS first_id FROM contexts GROUP BY ALL")
def contexts_by_period(spark: SparkSession, d: str) -> DataFrame:
    return C.by_period(_contexts(spark, d))


@_r.add(f"""WITH {CONTEXTS_SQL} SELECT filing_id, context_id, min(context_id) OVER w AS same_as, count(*) OVER w AS n_equal FROM contexts WINDOW w AS (PARTITION BY filing_id, entity, period_key, dimensional)""")
def equal_contexts(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    key = C.context_key(F.col("entity"), F.lit("instant"), none, F.col("period_key"), F.col("dims"), F.create_map().cast("map<string,string>"))
    return C.equal_contexts(_contexts(spark, d), key).select("filing_id", "context_id", "same_as", "n_equal")


@_r.add("SELECT o_orderkey, o_orderkey % 3 = 0 AS strict, o_orderkey % 3 < 2 AS within FROM orders")
def segments_match(spark: SparkSession, d: str) -> DataFrame:
    """The same entries in another order, one of them, and one with another member."""
    k, s, p = F.col("o_orderkey") % 3, F.col("o_orderstatus"), F.col("o_orderpriority")
    both = F.create_map(F.lit("Status"), s, F.lit("Priority"), p)
    other = F.when(k == 0, F.create_map(F.lit("Priority"), p, F.lit("Status"), s)).when(k == 1, F.create_map(F.lit("Status"), s)).otherwise(F.create_map(F.lit("Status"), F.concat(s, F.lit("x"))))
    return table(spark, d, "orders").select("o_orderkey", C.segments_match(other, both).alias("strict"), C.segments_match(other, both, False).alias("within"))


@_r.add(f"""WITH {X.FACTS_SQL}, w AS (SELECT DISTINCT context_id, 'us-gaap:Line1' AS concept FROM facts WHERE concept = 'us-gaap:Line2') SELECT context_id, concept, fact_seq, value FROM facts WHERE concept = 'us-gaap:Line1' AND context_id IN (SELECT context_id FROM w)""")
def facts_in_period(spark: SparkSession, d: str) -> DataFrame:
    f = X.facts(spark, d).withColumn("period_key", F.col("context_id").cast("string"))
    wanted = f.filter("concept = 'us-gaap:Line2'").withColumn("concept", F.lit("us-gaap:Line1"))
    return C.in_period(f, wanted).select("context_id", "concept", "fact_seq", "value")


@_r.add("""SELECT o_custkey AS filing_id, count(*) AS n_facts, count(*) FILTER (l_linestatus = 'O') AS n_monetary, count(*) FILTER (l_quantity > 25) AS n_numeric, count(*) FILTER (l_discount = 0) AS n_nil, count(*) FILTER (l_tax = 0) AS n_footnotes,
min(least(o_orderdate, l_shipdate)) AS first_date, max(l_shipdate) AS last_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def fact_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.fact_summary(rows.select(
        F.col("o_custkey").alias("filing_id"), F.when(F.col("l_linestatus") == "O", "iso4217:USD").otherwise("shares").alias("unit"), (F.col("l_quantity") > 25).alias("is_numeric"), (F.col("l_discount") == 0).alias("is_nil"),
        (F.col("l_tax") == 0).alias("is_footnote"), F.least("o_orderdate", "l_shipdate").alias("period_start"), F.col("l_shipdate").alias("period_end"),
    ))


@_r.add("SELECT l_suppkey AS filing_id, l_linenumber AS concept, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS units FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def mixed_units(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("filing_id"), F.col("l_linenumber").alias("concept"), F.col("l_returnflag").alias("unit"))
    return R.mixed_units(f).withColumn("units", F.array_join("units", ","))


@_r.add("""WITH f AS (SELECT user_id AS filing_id, event_type AS prefix, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events), c AS (SELECT filing_id, prefix, count(*) AS n, min(s) AS seen FROM f WHERE s <= 100 GROUP BY ALL)
SELECT filing_id, arg_max(prefix, n * 1000 - seen) AS prefix, max(n) AS n FROM c GROUP BY filing_id""")
def primary_prefix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return R.primary_prefix(table(spark, d, "events").select(F.col("user_id").alias("filing_id"), F.concat("event_type", F.lit(":Item")).alias("concept"), s.alias("fact_seq")))


@_r.add("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderpriority ILIKE '%urgent%' GROUP BY o_custkey)
SELECT c_custkey AS filing_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name ELSE CAST(k AS VARCHAR) END AS value FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def characteristic(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    filings = table(spark, d, "customer").select(F.col("c_custkey").alias("filing_id"), F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "").alias("first"), F.when(k == 1, F.col("c_name")).otherwise("").alias("second"))
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.col("o_orderpriority").alias("concept"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("fact_seq"))
    return R.characteristic(filings, facts, ["first", "second"], ["Urgent"], 2**62)


@_r.add("""SELECT c_custkey AS filing_id, coalesce(n, 0) AS n_facts, coalesce(m, 0) AS n_contexts, CAST(1 AS BIGINT) AS n_units FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def metadata_row(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "filing_id")
    return R.metadata_row(o, o.filter("o_orderstatus = 'O'"), table(spark, d, "customer").withColumnRenamed("c_custkey", "filing_id"))


@_r.add("SELECT p_partkey FROM part WHERE p_partkey % 4 = 0")
def extension_facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    f = table(spark, d, "part").withColumn("concept", F.when(k % 4 == 0, "acme:Own").when(k % 4 == 1, "us-gaap:Assets").when(k % 4 == 2, "Plain").otherwise("dei:Name"))
    return R.extension_facts(f, F.substring_index("concept", ":", 1).isin(*L.STANDARD_PREFIXES)).select("p_partkey")


@_r.add("SELECT p_type, p_brand, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY p_type), 2) AS share FROM part GROUP BY p_type, p_brand")
def networks_by_type(spark: SparkSession, d: str) -> DataFrame:
    return R.organised(table(spark, d, "part"), "p_type", "p_brand")


@_r.add("SELECT p_size AS concept, p_brand AS role, count(*) AS n FROM part GROUP BY p_size, p_brand")
def concept_roles(spark: SparkSession, d: str) -> DataFrame:
    return R.concept_roles(table(spark, d, "part").select(F.col("p_size").alias("concept"), F.col("p_brand").alias("role")))


@_r.add("""SELECT o_custkey AS filing_id, o_orderkey AS role, CASE o_orderstatus WHEN 'F' THEN 'CASH_FLOW' WHEN 'O' THEN 'BALANCE_SHEET' ELSE 'NOTES' END AS statement_type,
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 5 END, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderpriority <> '5-LOW'""")
def core_statements(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("role"), F.when(s == "F", "CASH_FLOW").when(s == "O", "BALANCE_SHEET").otherwise("NOTES").alias("statement_type"),
        F.when(F.col("o_orderpriority") == "5-LOW", "DETAIL").otherwise("CORE_STATEMENT").alias("category"),
    )
    return R.core_statements(rows)


@_r.add("""WITH q AS (SELECT l_suppkey AS filing_id, avg((l_discount > 0.04)::INT::DOUBLE) AS value_share, avg((l_tax > 0)::INT::DOUBLE) AS period_share FROM lineitem GROUP BY 1)
SELECT filing_id, round(value_share, 9) AS value_share, round(period_share, 9) AS period_share, value_share >= 0.5 AND period_share >= 0.9 AS sound FROM q""")
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("filing_id"), F.when(F.col("l_discount") > 0.04, 1).alias("value"), F.when(F.col("l_tax") > 0, 1).alias("period_end"))
    return R.data_quality(f).withColumns({c: F.round(c, 9) for c in ("value_share", "period_share")})


@_r.add("""SELECT c.o_custkey AS filing_id, r.missing FROM (SELECT DISTINCT o_custkey FROM orders) c, (VALUES ('Urgent'), ('High'), ('Nothing')) r(missing)
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND lower(o_orderpriority) LIKE '%' || lower(r.missing) || '%')""")
def missing_concepts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.col("o_orderpriority").alias("concept"))
    return R.missing_concepts(f, ["Urgent", "High", "Nothing"])


@_r.add("SELECT count(*) AS n_files, count(*) FILTER (p_size < 40) AS n_valid, CAST(sum(CASE WHEN p_size < 40 THEN 0 ELSE p_size END) AS BIGINT) AS n_errors, CAST(sum(p_size % 3) AS BIGINT) AS n_warnings FROM part")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return R.batch_totals(table(spark, d, "part").select((size < 40).alias("is_valid"), F.when(size < 40, 0).otherwise(size).alias("n_errors"), (size % 3).alias("n_warnings")))


@_r.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, array_to_string(list_filter([CASE WHEN l_linenumber % 5 = 0 THEN 'missing name' END, CASE WHEN l_tax = 0 THEN 'missing value' END, CASE WHEN l_suppkey % 4 = 0 THEN 'missing context' END,
CASE WHEN l_quantity > 20 AND l_returnflag = 'N' THEN 'missing unit' END], lambda x: x IS NOT NULL), ',') AS errors FROM lineitem""")
def fact_errors(spark: SparkSession, d: str) -> DataFrame:
    e = K.fact_errors(
        F.when(F.col("l_linenumber") % 5 != 0, "x"), F.when(F.col("l_tax") != 0, F.col("l_tax")), F.when(F.col("l_suppkey") % 4 == 0, "").otherwise("c"), F.when(F.col("l_returnflag") != "N", "USD"), F.col("l_quantity") > 20
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array_join(e, ",").alias("errors"))


@_r.add("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey % 9 = 0 THEN 'missing entity' END, CASE WHEN o_orderstatus = 'P' THEN 'missing kind' END, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'missing instant' END,
CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'missing start' END, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 > 0 AND o_orderkey % 7 = 0 THEN 'start after end' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders""")
def context_errors(spark: SparkSession, d: str) -> DataFrame:
    k, s, at = F.col("o_orderkey"), F.col("o_orderstatus"), F.to_date("o_orderdate")
    kind = F.when(s == "F", "instant").when(s == "O", "duration")
    e = K.context_errors(k, F.when(F.col("o_custkey") % 9 != 0, "e"), kind, F.when(k % 2 != 0, at), F.when(k % 5 != 0, F.when(k % 7 == 0, F.date_add(at, 1)).otherwise(at)), at)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(e, ",").alias("errors"))


@_r.add("""SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AS for_extraction, o_orderstatus IN ('F', 'O') AND o_custkey % 4 > 0 AND o_orderkey % 2 = 0 AS available, o_orderstatus = 'P' AND o_custkey % 9 < 6 AS retry, o_orderstatus = 'P' AND o_custkey % 9 >= 6 AS lost FROM orders""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "ready").otherwise("failed")
    tries = F.col("o_custkey") % 9
    return table(spark, d, "orders").select(
        "o_orderkey", K.ready_for_extraction(s, F.when(F.col("o_orderpriority") == "2-HIGH", "pending").otherwise("done")).alias("for_extraction"),
        K.library_available(s, F.col("o_custkey") % 4, F.col("o_orderkey") % 2 == 0).alias("available"), K.needs_retry(s, tries).alias("retry"), K.failed_for_good(s, tries).alias("lost"),
    )


@_r.add("""SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'EXCELLENT' WHEN p_size * 2 >= 80 THEN 'GOOD' WHEN p_size * 2 >= 70 THEN 'ACCEPTABLE' WHEN p_size * 2 >= 60 THEN 'POOR' WHEN p_size * 2 >= 50 THEN 'MINIMUM' ELSE 'UNACCEPTABLE' END AS grade,
CASE WHEN 0.3 * (p_size % 2) + 0.5 * (p_partkey % 4) / 3 + CASE WHEN p_size > 20 THEN 0.2 ELSE 0 END >= 0.8 - 1e-9 THEN 'HIGH' WHEN 0.3 * (p_size % 2) + 0.5 * (p_partkey % 4) / 3 + CASE WHEN p_size > 20 THEN 0.2 ELSE 0 END >= 0.5 - 1e-9 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM part""")
def grades(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", K.grade(size * 2).alias("grade"), K.network_confidence(size % 2 == 1, F.col("p_partkey") % 4, F.when(size > 20, "DETAIL").otherwise("UNKNOWN")).alias("confidence"))


@_r.add("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS folder, year(o_orderdate) >= 1934 AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30' AS valid,
o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AS in_range FROM orders""")
def date_checks(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.date_format(at, "yyyy-MM-dd"))
    return table(spark, d, "orders").select(
        "o_orderkey", K.period_end_text(F.date_format(at, "yyyy/MM/dd'T'HH:mm:ss")).alias("folder"), K.date_valid(F.to_date(at), F.lit("1997-06-30").cast("date")).alias("valid"), K.in_date_range(text, "1995-01-01", "1996-12-31").alias("in_range")
    )


@_r.add("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '10-k,10_k,10k,form10k,form10-k,form 10-k,annual' WHEN 1 THEN 'afr,annual-financial-report,annual_financial_report' ELSE 's-1,s_1,s1' END AS spellings,
CASE WHEN c_custkey % 2 = 0 THEN '10-K' ELSE 'none' END AS folder, 'Consolidated Balance Sheets' AS statement FROM customer""")
def form_spellings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    form = F.when(k % 3 == 0, "10-K").when(k % 3 == 1, "AFR").otherwise("S-1")
    path = F.when(k % 2 == 0, "data/entities/sec/acme/filings/10-K/0001").otherwise("data/other")
    return table(spark, d, "customer").select(
        "c_custkey", F.array_join(names.form_variations(form), ",").alias("spellings"), names.form_of_path(path, F.lit("none")).alias("folder"), names.statement_name(F.lit("out/core/consolidated_balance-sheets.json")).alias("statement")
    )


@_r.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity > 30 AS display_ok, l_quantity > 40 AS too_precise, l_linenumber % 2 = 0 AS period_ok FROM lineitem""")
def value_checks(spark: SparkSession, d: str) -> DataFrame:
    v, q = F.col("l_extendedprice"), F.col("l_quantity")
    shown = v * 1000 + F.when(q > 30, 0.0).otherwise(1.0)
    kinds = F.when(F.col("l_linenumber") % 2 == 0, "instant").otherwise("duration")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", K.display_valid(v, F.lit(-3), shown).alias("display_ok"), K.too_precise(F.when(q > 40, 7).otherwise(6)).alias("too_precise"), K.period_type_valid(F.lit("instant"), kinds).alias("period_ok")
    )
