"""Networks of calculations and dimensions: totals of totals, slices, hypercubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import cubes, dag, lattice
from auditloom.operators import facts as O
from auditloom.plans import proxies as X
from auditloom.plans.proxies import table
from auditloom.plans.registry import Registry

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

# --- totals of totals: type of a brand -> brand -> group of brands -> all brands -> all but promotions ----------------------

ARCS_SQL = """pairs AS (SELECT DISTINCT p_brand AS brand, p_type AS kind FROM part),
arcs AS (
  SELECT 'brands' AS role, brand AS parent, brand || '/' || kind AS child, 1.0 AS weight, 1 AS lvl FROM pairs
  UNION ALL SELECT DISTINCT 'brands', 'Group' || (CAST(substr(brand, 7) AS INT) % 5), brand, 1.0, 2 FROM pairs
  UNION ALL SELECT DISTINCT 'brands', 'All', 'Group' || (CAST(substr(brand, 7) AS INT) % 5), 1.0, 3 FROM pairs
  UNION ALL SELECT 'brands', 'Promo', brand || '/' || kind, 1.0, 1 FROM pairs WHERE kind = 'PROMO'
  UNION ALL SELECT 'brands', 'Net', 'All', 1.0, 4 UNION ALL SELECT 'brands', 'Net', 'Promo', -1.0, 4
  UNION ALL SELECT 'loop', 'Promo', 'Net', 1.0, NULL UNION ALL SELECT 'loop', 'Net', 'Promo', 1.0, NULL)"""


def _brand_arcs(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).distinct()
    group = F.concat(F.lit("Group"), F.substring("brand", 7, 9).cast("int") % 5)
    leaf = F.concat_ws("/", "brand", "kind")
    row = lambda parent, child, weight=1.0, role="brands": F.struct(F.lit(role).alias("role"), parent.alias("parent"), child.alias("child"), F.lit(weight).alias("weight"))
    name = F.lit
    every = F.array(row(F.col("brand"), leaf), row(group, F.col("brand")), row(name("All"), group), row(F.when(F.col("kind") == "PROMO", "Promo"), leaf))
    fixed = [("brands", "Net", "All", 1.0), ("brands", "Net", "Promo", -1.0), ("loop", "Promo", "Net", 1.0), ("loop", "Net", "Promo", 1.0)]
    more = spark.createDataFrame(fixed, "role string, parent string, child string, weight double")
    arcs = pairs.select(F.inline(every)).filter("parent is not null").unionByName(more).distinct()
    return arcs.select(F.lit(0).alias("filing_id"), "*", F.lit(0).alias("arc_seq"))


BRAND_FACTS_SQL = """lines AS (SELECT l_linestatus || '/' || year(l_shipdate) AS context_id, p_brand AS brand, p_type AS kind, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, l_quantity AS q, CAST(substr(p_brand, 7) AS INT) AS no FROM lineitem JOIN part ON p_partkey = l_partkey),
facts AS (
  SELECT context_id, brand || '/' || kind AS concept, CAST(sum(v) AS DOUBLE) AS v, 2 AS d FROM lines WHERE NOT (no = 25 AND kind <> 'PROMO' AND kind <> 'LARGE') AND NOT (no % 4 = 0 AND kind = 'LARGE') GROUP BY ALL
  UNION ALL SELECT context_id, brand, CAST(sum(v) FILTER (no % 3 = 1 OR q <= 45) AS DOUBLE), NULL FROM lines WHERE no % 3 > 0 GROUP BY context_id, brand, no
  UNION ALL SELECT context_id, 'All', round_even(CAST(sum(v) AS DOUBLE) / 1000, 0) * 1000, -3 FROM lines GROUP BY context_id
  UNION ALL SELECT context_id, 'Promo', CAST(sum(v) FILTER (kind = 'PROMO') AS DOUBLE), 2 FROM lines GROUP BY context_id)"""


def _brand_facts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.substring("p_brand", 7, 9).cast("int").alias("no"))
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select(F.concat_ws("/", "l_linestatus", F.year("l_shipdate")).alias("context_id"), "brand", "kind", "no", F.col("l_quantity").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    total = lambda when=None: F.sum(F.col("v") if when is None else F.when(when, F.col("v"))).cast("double").alias("value")
    decimals = lambda n: F.lit(n).cast("int").alias("decimals")
    leaves = lines.filter("not (no = 25 and kind <> 'PROMO' and kind <> 'LARGE') and not (no % 4 = 0 and kind = 'LARGE')").groupBy("context_id", F.concat_ws("/", "brand", "kind").alias("concept")).agg(total())
    brands = lines.filter("no % 3 > 0").groupBy("context_id", F.col("brand").alias("concept")).agg(total((F.col("no") % 3 == 1) | (F.col("q") <= 45)))
    whole = lines.groupBy("context_id").agg(total(), total(F.col("kind") == "PROMO").alias("promo"))
    rounded = F.rint(F.col("value") / 1000) * 1000
    rows = [leaves.select("context_id", "concept", "value", decimals(2)), brands.select("context_id", "concept", "value", decimals(None))]
    rows += [whole.select("context_id", F.lit("All").alias("concept"), rounded.alias("value"), decimals(-3)), whole.select("context_id", F.lit("Promo").alias("concept"), F.col("promo").alias("value"), decimals(2))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select(F.lit(0).alias("filing_id"), "*")


def _level_sql(k: int) -> str:
    return f"""e{k} AS (SELECT concept, context_id, n_children, coalesce(n_found, 0) AS n_found, CASE WHEN coalesce(n_found, 0) * 2 >= n_children THEN s END AS computed, cd, v AS reported, d AS rd, {k} AS level
  FROM (SELECT context_id, parent AS concept, count(*) AS n_found, CAST(sum(CAST(ev * weight AS DECIMAL(38,6))) AS DOUBLE) AS s, min(ed) AS cd FROM all{k - 1} JOIN arcs ON child = all{k - 1}.concept AND lvl = {k} GROUP BY ALL)
  FULL JOIN (SELECT * FROM facts WHERE concept IN (SELECT parent FROM arcs WHERE lvl = {k})) USING (context_id, concept) JOIN sizes USING (concept)),
all{k} AS (SELECT * FROM all{k - 1} UNION ALL SELECT context_id, concept, coalesce(computed, reported), CASE WHEN computed IS NOT NULL THEN cd ELSE rd END FROM e{k} WHERE coalesce(computed, reported) IS NOT NULL)"""


DAG_SQL = f"""{ARCS_SQL}, {BRAND_FACTS_SQL},
sizes AS (SELECT parent AS concept, count(*) AS n_children FROM arcs WHERE role = 'brands' GROUP BY parent),
all0 AS (SELECT context_id, concept, v AS ev, d AS ed FROM facts WHERE contains(concept, '/') AND v IS NOT NULL),
{_level_sql(1)}, {_level_sql(2)}, {_level_sql(3)}, {_level_sql(4)},
rolled AS (SELECT *, CASE WHEN computed IS NULL THEN 'incomplete' WHEN reported IS NULL THEN 'computed' ELSE 'checked' END AS status, least(cd, rd) AS dd
  FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4) WHERE computed IS NOT NULL OR reported IS NOT NULL),
judged AS (SELECT *, CASE WHEN status = 'checked' THEN CASE WHEN dd IS NOT NULL THEN {X.equal_sql("computed", "reported", "dd")} WHEN computed = 0 AND reported = 0 THEN true
  WHEN abs(computed) < 1000 OR abs(reported) < 1000 THEN abs(computed - reported) <= 1 ELSE abs(computed - reported) / greatest(abs(computed), abs(reported)) <= 0.01 END END AS passed FROM rolled)"""


@_r.add(f"""WITH {DAG_SQL} SELECT 'brands' AS role, context_id, concept, level, n_children, n_found, round(computed, 2) AS computed, round(reported, 2) AS reported, status, passed FROM judged
UNION ALL SELECT 'loop', context_id, concept, NULL, 1, 0, NULL, round(v, 2), 'circular', NULL FROM facts WHERE concept IN ('Promo', 'Net')""")
def rollup_dag(spark: SparkSession, d: str) -> DataFrame:
    """Sales of brands' types rolled up to brands, groups, all brands and all but promotions, beside what is reported of them."""
    rows = dag.rollup_dag(_brand_arcs(spark, d), _brand_facts(spark, d))
    return rows.select("role", "context_id", "concept", "level", "n_children", "n_found", F.round("computed", 2).alias("computed"), F.round("reported", 2).alias("reported"), "status", "passed")


@_r.add(f"""WITH RECURSIVE {ARCS_SQL}, reach AS (SELECT role, parent AS concept, child AS below FROM arcs UNION SELECT r.role, r.concept, a.child FROM reach r JOIN arcs a ON a.role = r.role AND a.parent = r.below),
levels AS (SELECT DISTINCT role, parent AS concept, lvl AS level FROM arcs)
SELECT l.role, concept, level, (SELECT count(*) FROM arcs a WHERE a.role = l.role AND a.parent = l.concept) AS n_children, (SELECT count(*) FROM reach r WHERE r.role = l.role AND r.concept = l.concept) AS n_below,
NOT EXISTS (SELECT 1 FROM arcs a WHERE a.role = l.role AND a.child = l.concept) AS is_top FROM levels l""")
def calculation_trees(spark: SparkSession, d: str) -> DataFrame:
    return dag.calculation_trees(_brand_arcs(spark, d)).drop("filing_id")


@_r.add("""WITH a AS (SELECT p_brand AS role, p_type AS parent, p_size % 7 AS child, arg_max((p_size % 3)::DOUBLE, p_partkey) AS w, max(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
b AS (SELECT p_brand AS role, p_type AS parent, p_size % 7 AS child, arg_max((p_size % 3)::DOUBLE, p_partkey) AS w, max(p_partkey) AS k FROM part WHERE p_partkey % 3 = 0 AND p_type <> 'SMALL' GROUP BY ALL),
a1 AS (SELECT parent, child, arg_max(w, k) AS wa FROM a GROUP BY ALL), b1 AS (SELECT parent, child, arg_max(w, k) AS wb FROM b GROUP BY ALL),
p AS (SELECT parent, bool_and(wa IS NOT DISTINCT FROM wb) AS same FROM a1 FULL JOIN b1 USING (parent, child) GROUP BY parent)
SELECT (SELECT count(*) FROM (SELECT DISTINCT role, parent FROM a)) AS company_trees, (SELECT count(DISTINCT parent) FROM a) AS company_concepts, (SELECT count(*) FROM (SELECT DISTINCT role, parent FROM b)) AS taxonomy_trees,
(SELECT count(DISTINCT parent) FROM b) AS taxonomy_concepts, (SELECT count(*) FROM p) AS total_unique_concepts, (SELECT count(*) FROM p WHERE same) AS matches, (SELECT count(*) FROM p WHERE NOT same) AS mismatches""")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_brand").alias("role"), F.col("p_type").alias("parent"), (F.col("p_size") % 7).alias("child"), (F.col("p_size") % 3).cast("double").alias("weight"), F.col("p_partkey").alias("arc_seq"))
    return dag.registry_summary(part.filter("arc_seq % 2 = 0"), part.filter("arc_seq % 3 = 0 and parent <> 'SMALL'"))


# --- slices: an order is reported for its priority and status; missing lines come from wider slices of its customer and year -------

SLICES_SQL = """ctx AS (SELECT o_orderkey AS context_id, o_custkey AS filing_id, year(o_orderdate) AS period_key, o_orderpriority AS role, CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice END AS value,
  CASE WHEN o_orderkey % 17 = 0 THEN 'inconsistent' END AS pt, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS unit,
  list_filter([CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'Priority=' || o_orderpriority END, CASE WHEN o_orderstatus <> 'O' THEN 'Status=' || o_orderstatus END], lambda x: x IS NOT NULL) AS m FROM orders),"""
SLICED_SQL = f"""{X.DUPLICATES_SQL}, {SLICES_SQL}
arcs AS (SELECT k AS arc_seq, 'us-gaap:Line' || k AS child, CASE WHEN k = 4 THEN -1.0 ELSE 1.0 END AS weight FROM (SELECT unnest(range(1, 8)) AS k)),
named AS (SELECT f.*, c.filing_id, c.period_key, c.m FROM facts f JOIN ctx c USING (context_id)),
lacking AS (SELECT c.*, child FROM ctx c, arcs WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.context_id = c.context_id AND r.concept = child)),
fb AS (SELECT l.context_id, l.child, first(n.value ORDER BY len(n.m) DESC, n.fact_seq, n.context_id, n.value) AS rescued FROM lacking l JOIN named n
  ON n.filing_id = l.filing_id AND n.period_key = l.period_key AND n.concept = l.child AND len(n.m) < len(l.m) AND list_has_all(l.m, n.m) AND (l.unit IS NULL OR n.unit IS NULL OR l.unit = n.unit) GROUP BY ALL),
kids AS (SELECT c.context_id, c.filing_id, role, c.value, c.unit, pt, arc_seq, weight, coalesce(selected_value, rescued) AS cv, r.unit AS cu, r.decimals AS d, duplicate_type AS ct, coalesce(selected_value, rescued) IS NOT NULL AND coalesce(duplicate_type, '') <> 'inconsistent' AS found
  FROM ctx c CROSS JOIN arcs LEFT JOIN resolved r ON r.context_id = c.context_id AND r.concept = arcs.child LEFT JOIN fb ON fb.context_id = c.context_id AND fb.child = arcs.child),
marked AS (SELECT *, CASE WHEN ct = 'inconsistent' THEN 'skip_inconsistent_child' WHEN found AND unit IS NOT NULL AND cu IS NOT NULL AND unit <> cu THEN 'skip_unit_mismatch' END AS block FROM kids),
bound AS (SELECT *, CASE WHEN value IS NULL AND pt IS NULL THEN 'skip_no_parent' WHEN pt = 'inconsistent' THEN 'skip_inconsistent_parent' WHEN blocked IS NOT NULL THEN blocked WHEN n_found = 0 THEN 'skip_no_children' WHEN n_found * 2 < n_children THEN 'skip_incomplete' ELSE 'bound' END AS status
  FROM (SELECT context_id, filing_id, role, any_value(value) AS value, any_value(pt) AS pt, arg_min(block, arc_seq) FILTER (block IS NOT NULL) AS blocked, count(*) AS n_children, count(*) FILTER (found) AS n_found,
               CAST(sum(CAST(cv * weight AS DECIMAL(28,4))) FILTER (found) AS DOUBLE) AS expected, min(d) FILTER (found) AS child_decimals FROM marked GROUP BY context_id, filing_id, role))"""


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents, contexts with their dimensions, and facts of the orders, a filing for each customer."""
    o = table(spark, d, "orders")
    key = o.select(F.col("o_orderkey").alias("context_id"), F.col("o_custkey").alias("filing_id"))
    when = lambda c, v: F.when(c, v)
    axes = F.map_from_entries(F.array_compact(F.array(when(F.col("o_orderpriority") != "3-MEDIUM", F.struct(F.lit("Priority").alias("key"), F.col("o_orderpriority").alias("value"))), when(F.col("o_orderstatus") != "O", F.struct(F.lit("Status").alias("key"), F.col("o_orderstatus").alias("value"))))))
    contexts = o.select(F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("context_id"), F.year("o_orderdate").alias("period_key"), axes.alias("dims"))
    parents = o.select(
        F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("context_id"), F.year("o_orderdate").alias("period_key"), F.col("o_orderpriority").alias("role"), F.lit("us-gaap:Total").alias("parent"),
        when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice")).alias("value"), when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("unit"), F.lit(None).cast("int").alias("decimals"), when(F.col("o_orderkey") % 17 == 0, "inconsistent").alias("duplicate_type"),
    )
    return parents, contexts, X.facts(spark, d).drop("filing_id").join(key, "context_id")


def _sliced(spark: SparkSession, d: str) -> DataFrame:
    parents, contexts, facts = _slices(spark, d)
    return O.bind(O.classify_duplicates(facts), X.arcs(spark, d), parents, lambda lacking: lattice.generalised_children(lacking, facts, contexts))


@_r.add(f"WITH {SLICED_SQL} SELECT filing_id, context_id, role, status, n_found, n_children, round(expected, 2) AS expected FROM bound")
def rollup_dimensional(spark: SparkSession, d: str) -> DataFrame:
    """Totals of orders by priority and status, where lines that a slice lacks come from the wider slices around it."""
    return _sliced(spark, d).select("filing_id", "context_id", "role", "status", "n_found", "n_children", F.round("expected", 2).alias("expected"))


# --- hypercubes: kinds of parts by nation and segment, a role for each region ---------------------------------------------------

CUBES_SQL = """sold AS (SELECT o_custkey % 10 AS filing_id, p_type AS concept, n_name AS nation, CASE WHEN l_returnflag <> 'N' THEN c_mktsegment END AS segment, CASE WHEN l_linenumber = 7 THEN l_shipmode END AS mode, n_regionkey
  FROM (SELECT *, 'mode' || (l_suppkey % 2) AS l_shipmode FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
judged AS (SELECT *, n_regionkey < 4 AND (segment IS NULL OR segment IN ('BUILDING', 'FURNITURE', 'MACHINERY')) AND (mode IS NULL OR n_regionkey % 2 = 1) AS fits,
  n_regionkey < 4 AND concept IN ('PROMO', 'LARGE') AND n_regionkey = 1 AND segment IS NULL AND mode IS NULL AS barred FROM sold WHERE concept <> 'SMALL'),
texts AS (SELECT *, 'Nation=' || nation || CASE WHEN segment IS NULL THEN '' ELSE ';Segment=' || segment END || CASE WHEN mode IS NULL THEN '' ELSE ';Transport=' || mode END AS dims FROM (SELECT *, true AS covered FROM judged UNION ALL SELECT *, false, false, false FROM sold WHERE concept = 'SMALL'))"""


def _cube_arcs(spark: SparkSession, d: str) -> DataFrame:
    """For each of the first four regions a role: lines (a tree of kinds of parts but SMALL) by nation and segment.

    Roles of even regions are closed. HOUSEHOLD, the segment's default, and AUTOMOBILE are not allowed as members. In region 1, PROMO and
    what is below it (LARGE) may not be reported by nation alone.
    """
    nation = table(spark, d, "nation").filter("n_regionkey < 4")
    role = F.concat(F.lit("role"), F.col("n_regionkey")).alias("role")
    row = lambda kind, parent, child, closed=None: F.struct(F.lit(kind).alias("arcrole"), F.lit(parent).alias("parent"), child.alias("child"), (F.lit(None).cast("boolean") if closed is None else closed).alias("closed"))
    t = F.lit
    plain = [("hypercube-dimension", "Cube", "Nation"), ("hypercube-dimension", "Cube", "Segment"), ("dimension-domain", "Nation", "AllNations"), ("dimension-domain", "Segment", "Kinds"), ("dimension-default", "Segment", "HOUSEHOLD")]
    plain += [("domain-member", "Kinds", "Heavy"), ("domain-member", "Heavy", "MACHINERY"), ("domain-member", "Kinds", "BUILDING"), ("domain-member", "Kinds", "FURNITURE"), ("domain-member", "Kinds", "HOUSEHOLD")]
    plain += [("domain-member", "Lines", "STANDARD"), ("domain-member", "Lines", "PROMO"), ("domain-member", "PROMO", "LARGE"), ("domain-member", "Lines", "MEDIUM"), ("domain-member", "MEDIUM", "ECONOMY")]
    fixed = F.array(row("all", "Lines", t("Cube"), F.col("n_regionkey") % 2 == 0), *[row(k, p, t(c)) for k, p, c in plain])
    barred = F.array(row("notAll", "PROMO", t("Barred"), F.lit(True)), row("hypercube-dimension", "Barred", t("Nation")))
    roles = nation.select(role, "n_regionkey").distinct()
    out = roles.select("role", F.inline(fixed)).unionByName(nation.select(role, F.lit("domain-member").alias("arcrole"), F.lit("AllNations").alias("parent"), F.col("n_name").alias("child"), F.lit(None).cast("boolean").alias("closed")))
    return out.unionByName(roles.filter("n_regionkey = 1").select("role", F.inline(barred)))


@_r.add(f"""WITH {CUBES_SQL} SELECT filing_id, concept, dims, count(*) AS n_facts, CASE WHEN NOT any_value(covered) THEN 'uncovered' WHEN bool_or(fits AND NOT barred) THEN 'valid' WHEN bool_or(fits AND barred) THEN 'excluded' ELSE 'invalid' END AS status FROM texts GROUP BY filing_id, concept, dims""")
def hypercube_validity(spark: SparkSession, d: str) -> DataFrame:
    """Lines of customers' orders as facts of their kind of part, against the cubes of the regions."""
    part, orders, customer, nation = (table(spark, d, t) for t in ("part", "orders", "customer", "nation"))
    lines = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    e = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    mode = F.concat(F.lit("mode"), F.col("l_suppkey") % 2)
    dims = F.map_from_entries(F.array_compact(F.array(e("Nation", F.col("n_name")), F.when(F.col("l_returnflag") != "N", e("Segment", F.col("c_mktsegment"))), F.when(F.col("l_linenumber") == 7, e("Transport", mode)))))
    return cubes.dimensional_validity(lines.select((F.col("o_custkey") % 10).alias("filing_id"), F.col("p_type").alias("concept"), dims.alias("dims")), _cube_arcs(spark, d))
