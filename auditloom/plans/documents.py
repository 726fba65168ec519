"""Namespaces, documents in XML and JSON, catalogs of files, validation and schemas over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from auditloom.functions import namespaces as NS
from auditloom.operators import evolution as E
from auditloom.operators import namespaces as N
from auditloom.operators import validation as V
from auditloom.plans.proxies import table
from auditloom.plans.registry import Registry
from auditloom.sources import files, instance_xml, linkbase_xml, searches

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

# --- namespaces: the hosts of pages with a taxonomy and a year ---------------------------------------------------------------

URIS_SQL = """parts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]*)', 1) AS lang, page_id % 7 AS k FROM pages),
uris AS (SELECT page_id, CASE k WHEN 0 THEN 'http://xbrl.' || host || '/' || lang || '/' || (2000 + page_id % 25) WHEN 1 THEN 'https://www.' || host || '/Tax-' || lang || '/' || (2000 + page_id % 25) WHEN 2 THEN 'HTTP://' || host || '/taxonomy/' || lang || '/2019-03'
  WHEN 3 THEN 'http://' || host || '/a/b/' || lang || '/' || (1990 + page_id % 9) WHEN 4 THEN 'http://www.w3.org/2001/XMLSchema' WHEN 5 THEN 'http://' || (CASE page_id % 3 WHEN 0 THEN 'fasb.org' WHEN 1 THEN 'www.sec.gov' ELSE 'ESMA.europa.eu' END) || '/' || lang || '/2024#x' ELSE 'urn:' || host || ':' || lang END AS uri FROM parts)"""


def _uris(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    host, lang, i = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([a-z]*)", 1), F.col("page_id")
    owner = F.when(i % 3 == 0, "fasb.org").when(i % 3 == 1, "www.sec.gov").otherwise("ESMA.europa.eu")
    t, k = F.lit, i % 7
    uri = (
        F.when(k == 0, F.concat(t("http://xbrl."), host, t("/"), lang, t("/"), 2000 + i % 25)).when(k == 1, F.concat(t("https://www."), host, t("/Tax-"), lang, t("/"), 2000 + i % 25))
        .when(k == 2, F.concat(t("HTTP://"), host, t("/taxonomy/"), lang, t("/2019-03"))).when(k == 3, F.concat(t("http://"), host, t("/a/b/"), lang, t("/"), 1990 + i % 9)).when(k == 4, t("http://www.w3.org/2001/XMLSchema"))
        .when(k == 5, F.concat(t("http://"), owner, t("/"), lang, t("/2024#x"))).otherwise(F.concat(t("urn:"), host, t(":"), lang))
    )
    return p.select("page_id", uri.alias("uri"))


def _recognised_sql() -> str:
    """The forms in order of trial, in SQL of their own."""
    cases = []
    for k, (pattern, template) in enumerate(NS.PATTERNS):
        filled = "'" + template.replace("{authority}", f"' || g{k}[1] || '").replace("{taxonomy}", f"' || lower(g{k}[2]) || '").replace("{version}", f"' || g{k}[3] || '") + "'"
        cases.append((f"[regexp_extract(uri, '{pattern}', 1, 'i'), regexp_extract(uri, '{pattern}', 2, 'i'), regexp_extract(uri, '{pattern}', 3, 'i')] AS g{k}", f"WHEN g{k}[3] <> '' THEN ", f"g{k}", filled))
    pick = lambda f, none: "CASE " + " ".join(c[1] + f(c) for c in cases) + f" ELSE {none} END"
    market = "CASE " + " ".join(f"WHEN contains(lower(authority), '{part}') THEN '{name}'" for part, name in NS.MARKETS) + " WHEN authority = '' THEN 'unknown' ELSE split_part(authority, '.', 1) END"
    return f"""tried AS (SELECT *, {', '.join(c[0] for c in cases)} FROM uris WHERE uri NOT IN ({', '.join(f"'{s}'" for s in NS.STANDARD)})),
named AS (SELECT page_id, uri, {pick(lambda c: f'lower({c[2]}[2])', "'unknown'")} AS taxonomy, {pick(lambda c: f'{c[2]}[3]', "'unknown'")} AS version, {pick(lambda c: f'{c[2]}[1]', "''")} AS authority, {pick(lambda c: c[3], "''")} AS url FROM tried),
found AS (SELECT *, {market} AS market, authority <> '' AS is_recognised FROM named)"""


@_r.add(f"WITH {URIS_SQL}, {_recognised_sql()} SELECT * FROM found")
def namespace_taxonomies(spark: SparkSession, d: str) -> DataFrame:
    return N.taxonomies(_uris(spark, d))


@_r.add(f"WITH {URIS_SQL}, {_recognised_sql()} SELECT uri, count(*) AS n FROM found WHERE NOT is_recognised GROUP BY uri")
def namespace_unrecognised(spark: SparkSession, d: str) -> DataFrame:
    return N.unrecognised(_uris(spark, d))


def _alternatives_sql() -> str:
    filled = ", ".join("'" + t.replace("{authority}", "' || a || '").replace("{taxonomy}", "' || taxonomy || '").replace("{version}", "' || version || '") + "'" for t in NS.ALTERNATIVES)
    spell = "CASE " + " ".join(f"WHEN contains(lower(host), '{k}') OR contains('{k}', lower(host)) THEN [{', '.join(repr(x) for x in v)}]" for k, v in NS.AUTHORITY_SPELLINGS.items()) + " ELSE [host] END"
    return f"""hosts AS (SELECT *, regexp_extract(uri, 'https?://(?:www\\.|xbrl\\.)?([^/]+)', 1, 'i') AS host FROM found WHERE is_recognised),
spelled AS (SELECT page_id, uri, taxonomy, version, unnest({spell}) AS a FROM hosts),
every AS (SELECT page_id, uri, unnest([{filled}]) AS url FROM spelled)
SELECT page_id, count(DISTINCT url) FILTER (url <> uri) AS n, md5(string_agg(DISTINCT url, ',' ORDER BY url) FILTER (url <> uri)) AS urls FROM every GROUP BY page_id"""


@_r.add(f"WITH {URIS_SQL}, {_recognised_sql()}, {_alternatives_sql()}")
def namespace_alternatives(spark: SparkSession, d: str) -> DataFrame:
    t = N.taxonomies(_uris(spark, d)).filter("is_recognised").withColumn("urls", NS.alternative_urls(F.col("uri"), F.col("taxonomy"), F.col("version")))
    return t.select("page_id", F.size("urls").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("urls"), ",").cast("binary")).alias("urls"))


@_r.add("""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS u FROM pages), h AS (SELECT *, split_part(u, '/', 1) AS host, split_part(u, '/', 1) || '/' || split_part(u, '/', 2) AS deep FROM p),
owners AS (SELECT host AS prefix, 'host ' || min(page_id) AS owner FROM h WHERE page_id % 3 < 2 GROUP BY host UNION ALL SELECT deep, 'path ' || min(page_id) FROM h WHERE page_id % 5 = 0 AND split_part(u, '/', 2) <> '' GROUP BY deep)
SELECT page_id, (SELECT arg_max(owner, length(prefix)) FROM owners o WHERE rtrim(h.u, '/') = o.prefix OR starts_with(h.u, o.prefix || '/')) AS owner FROM h""")
def namespace_owners(spark: SparkSession, d: str) -> DataFrame:
    """Who owns a page: the owner of the longest known beginning of its address."""
    p = table(spark, d, "pages").withColumn("s", N.segments(F.col("url")))
    first = lambda name: F.concat(F.lit(f"{name} "), F.min("page_id")).alias("owner")
    hosts = p.filter("page_id % 3 < 2").groupBy(F.get("s", F.lit(0)).alias("prefix")).agg(first("host"))
    paths = p.filter("page_id % 5 = 0 and size(s) > 1").groupBy(F.array_join(F.slice("s", 1, 2), "/").alias("prefix")).agg(first("path"))
    return N.longest_prefix(p.select("page_id", "url"), hosts.unionByName(paths), "url").select("page_id", "owner")


@_r.add("""WITH e AS (SELECT event_id, 'http://a/' || event_type AS one, 'https://b/' || (user_id % 20) AS two, event_id % 5 AS k FROM events)
SELECT DISTINCT event_id, uri FROM (SELECT event_id, unnest(CASE k WHEN 0 THEN [one, two, 'plain'] WHEN 1 THEN [two] WHEN 2 THEN [one] WHEN 3 THEN [one, two] ELSE [] END) AS uri FROM e)""")
def namespace_declared(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces declared anywhere in JSON texts: at the top, in an array, deep inside, in two places, or by less than half of the values."""
    e, one, two = table(spark, d, "events"), F.concat(F.lit("http://a/"), "event_type"), F.concat(F.lit("https://b/"), (F.col("user_id") % 20).cast("string"))
    obj = lambda **v: F.to_json(F.struct(*[c.alias(n) for n, c in v.items()]))
    raw = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, obj(x=one, y=two, z=F.lit("plain"))).when(k == 1, raw('[1, {"deep": {"n": ', obj(q=two), "}}]")).when(k == 2, raw('{"a": {"b": [[', obj(ns=one), "]]}}"))
        .when(k == 3, raw('{"m": ', obj(u=one), ', "n": [', obj(v=two), "]}")).otherwise(obj(u=one, v=F.lit("no"), w=F.lit("neither")))
    )
    return N.declared(e.select("event_id", text.alias("json")), "json", "event_id")


# --- XML: an instance document for each order, a linkbase for each nation -----------------------------------------------------------


def _tag(name: str, *inside: str | object, **attributes: object) -> F.Column:
    text = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    opened = [F.lit(f"<{name}")] + [x for k, v in attributes.items() for x in (F.lit(f' {k.rstrip("_").replace("__", ":")}="'), text(v), F.lit('"'))] + [F.lit(">")]
    return F.concat(*opened, *map(text, inside), F.lit(f"</{name}>"))


def _instances(spark: SparkSession, d: str) -> DataFrame:
    """An order's duration context with an explicit member, an instant one with a typed member, and a broken text for each 50th."""
    o = table(spark, d, "orders").repartition(4 * spark.sparkContext.defaultParallelism)  # a parse is a thousand times a row's scan; the table may be one file
    who = _tag("xbrli:identifier", F.col("o_custkey"), scheme="http://example.org/customers")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    start = F.concat(F.year("o_orderdate").cast("string"), F.lit("-01-01"))
    explicit = _tag("xbrli:segment", _tag("xbrldi:explicitMember", F.lit(" p:"), F.translate("o_orderpriority", " ", "_"), F.lit("\n"), dimension="p:Priority"))
    typed = _tag("xbrli:scenario", _tag("xbrldi:typedMember", _tag("p:status", F.col("o_orderstatus")), dimension="p:Status"))
    first = _tag("xbrli:context", _tag("xbrli:entity", who, explicit), _tag("xbrli:period", _tag("xbrli:startDate", start), _tag("xbrli:endDate", day)), id=F.concat(F.lit("d"), F.col("o_orderkey").cast("string")))
    second = _tag("xbrli:context", _tag("xbrli:entity", who), _tag("xbrli:period", _tag("xbrli:instant", day)), typed, id=F.concat(F.lit("i"), F.col("o_orderkey").cast("string")))
    unit = _tag("xbrli:unit", _tag("xbrli:divide", _tag("xbrli:unitNumerator", _tag("xbrli:measure", "iso4217:USD")), _tag("xbrli:unitDenominator", _tag("xbrli:measure", F.concat(F.lit("p:"), "o_orderstatus")))), id="u")
    whole = F.concat(F.lit('<?xml version="1.0"?>\n'), _tag("xbrli:xbrl", first, second, unit, xmlns__xbrli="i", xmlns__xbrldi="d", xmlns__p="p"))
    k = F.col("o_orderkey") % 50
    text = F.when(k == 0, F.substring(whole, 1, 200)).when(k == 1, F.replace(whole, F.lit("</xbrli:xbrl>"), F.lit("</xbrli:other>"))).when(k == 2, "").when(k == 3, F.lit(None)).when(k == 4, F.concat(whole, F.lit("<more/>"))).when(k == 5, F.col("o_orderpriority")).otherwise(whole)
    return o.select(F.col("o_orderkey").alias("filing_id"), text.alias("xml"))


@_r.add("""WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS day, make_date(year(o_orderdate), 1, 1) AS first, replace(o_orderpriority, ' ', '_') AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 50 = 4 OR o_orderkey % 50 > 5)
SELECT o_orderkey AS filing_id, 0 AS context_seq, 'd' || o_orderkey AS context_id, entity, 'duration' AS kind, NULL AS instant, first AS start, day AS "end", 'p:Priority=p:' || p AS dims, '' AS typed, 'iso4217:USD/p:' || s AS measure FROM o
UNION ALL SELECT o_orderkey, 1, 'i' || o_orderkey, entity, 'instant', day, NULL, NULL, 'p:Status=' || s, 'p:Status', 'iso4217:USD/p:' || s FROM o""")
def xml_instance_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts and units of instance documents; what is broken has none, what comes after the root does not count."""
    p = instance_xml.parsed(_instances(spark, d)).withColumn("units", instance_xml.measures(F.col("x.unit")))
    c = instance_xml.contexts(p, "filing_id", "units")  # of each document both, by one parse
    dims = F.array_join(F.transform(F.array_sort(F.map_entries("dims")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return c.withColumn("dims", dims).withColumn("typed", F.array_join("typed", ",")).withColumn("measure", F.explode("units.measure")).drop("units")


@_r.add("SELECT o_orderkey AS filing_id, o_orderkey % 50 > 5 AS well_formed FROM orders")
def xml_wellformed(spark: SparkSession, d: str) -> DataFrame:
    """Texts that end too early, close another element, are empty or null, have two roots or no element at all."""
    return linkbase_xml.well_formed(_instances(spark, d)).select("filing_id", "well_formed")


def _linkbases(spark: SparkSession, d: str) -> DataFrame:
    """For each nation a linkbase with three networks over its suppliers; a locator that is given twice, one that lacks."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    loc = _tag("link:loc", "", xlink__label=F.concat(F.lit("l"), key), xlink__href=F.concat(F.lit("x.xsd#sup_S"), key))
    ends = {"xlink__from": "top", "xlink__to": F.concat(F.lit("l"), key)}
    each = s.select(
        "n_nationkey", "n_regionkey", "s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, loc).otherwise("").alias("loc"),
        _tag("link:presentationArc", "", order=F.col("s_suppkey") % 7, preferredLabel="terse", **ends).alias("pre"), _tag("link:calculationArc", "", weight=F.when(F.col("s_suppkey") % 2 == 0, "-1.0").otherwise("1"), **ends).alias("cal"),
        F.when(F.col("s_suppkey") % 3 == 0, _tag("link:definitionArc", "", xlink__arcrole="http://x/all", **ends)).otherwise("").alias("def"),
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", c))), lambda x: x[c]), "")
    g = each.groupBy("n_nationkey", "n_regionkey").agg(*[joined(c).alias(c) for c in ("loc", "pre", "cal", "def")])
    top = F.lit('<link:loc xlink:label="top" xlink:href="x.xsd#old_T"/><link:loc xlink:label="top" xlink:href="x.xsd#nat_Top"/>')
    link = lambda kind, c: _tag(f"link:{kind}Link", top, F.col("loc"), F.col(c), xlink__role=F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return g.join(n.select("n_nationkey"), "n_nationkey").select(F.col("n_nationkey").alias("filing_id"), _tag("link:linkbase", link("presentation", "pre"), link("calculation", "cal"), link("definition", "def"), xmlns__link="l", xmlns__xlink="x").alias("xml"))


@_r.add("""WITH s AS (SELECT n_nationkey AS filing_id, 'r' || n_regionkey AS role, s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN 'sup:S' || s_suppkey ELSE 'l' || s_suppkey END AS child FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT filing_id, 'presentation' AS kind, role, 'nat:Top' AS parent, child, CAST(s_suppkey % 7 AS DOUBLE) AS "order", 1.0 AS weight, 'terse' AS preferred_label, NULL AS arcrole FROM s
UNION ALL SELECT filing_id, 'calculation', role, 'nat:Top', child, 0.0, CASE WHEN s_suppkey % 2 = 0 THEN -1.0 ELSE 1.0 END, NULL, NULL FROM s
UNION ALL SELECT filing_id, 'definition', role, 'nat:Top', child, 0.0, 1.0, NULL, 'http://x/all' FROM s WHERE s_suppkey % 3 = 0""")
def xml_linkbase_scan(spark: SparkSession, d: str) -> DataFrame:
    return linkbase_xml.arcs_of(_linkbases(spark, d)).select("filing_id", "kind", "role", "parent", "child", "order", "weight", "preferred_label", "arcrole")


# --- catalogs: paths made of the addresses of pages --------------------------------------------------------------------------------

TREE_SQL = """t AS (SELECT page_id, length(html) AS length, split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 2) AS company, CASE page_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN 'annual_report' ELSE '20f' END AS form, (2010 + page_id % 12) || '-03-31' AS date, page_id % 8 AS k FROM pages),
files AS (SELECT page_id, length, CASE k WHEN 0 THEN 'sec/' || company || '/filings/' || form || '/' || date || '/json/MAIN_FINANCIAL_STATEMENTS.json' WHEN 1 THEN 'sec/' || company || '/filings/' || form || '/' || date || '/json/core/s' || page_id || '.json'
  WHEN 2 THEN company || '/' || form || '/' || date || '/csv/t' || page_id || '.csv' WHEN 3 THEN company || '/' || form || '/statements.json' WHEN 4 THEN 'esef/' || company || '/' || form || '/parsed.json' WHEN 5 THEN 'sec/' || company || '/' || form || '/' || date || '/book.xlsx'
  WHEN 6 THEN 'uk/data/' || company || '/' || form || '/reports/2020/excel/b.xlsx' ELSE company || '/notes' || page_id || '.txt' END AS below FROM t)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    p, i = table(spark, d, "pages"), F.col("page_id")
    company = F.get(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), "[.]"), F.lit(1))
    form = F.when(i % 3 == 0, "10-K").when(i % 3 == 1, "annual_report").otherwise("20f")
    date = F.concat((2010 + i % 12).cast("string"), F.lit("-03-31"))
    at = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    k, s = i % 8, i.cast("string")
    below = (
        F.when(k == 0, at("sec/", company, "/filings/", form, "/", date, "/json/MAIN_FINANCIAL_STATEMENTS.json")).when(k == 1, at("sec/", company, "/filings/", form, "/", date, "/json/core/s", s, ".json"))
        .when(k == 2, at(company, "/", form, "/", date, "/csv/t", s, ".csv")).when(k == 3, at(company, "/", form, "/statements.json")).when(k == 4, at("esef/", company, "/", form, "/parsed.json"))
        .when(k == 5, at("sec/", company, "/", form, "/", date, "/book.xlsx")).when(k == 6, at("uk/data/", company, "/", form, "/reports/2020/excel/b.xlsx")).otherwise(at(company, "/notes", s, ".txt"))
    )
    rows = p.select(below.alias("below"), F.length("html").cast("long").alias("length"))
    return rows.withColumn("name", F.substring_index("below", "/", -1))


CATALOG_SQL = f"""{TREE_SQL},
placed AS (SELECT t.*, f.below, CASE WHEN k < 2 THEN 'sec/' || company || '/filings/' || form || '/' || date WHEN k = 2 THEN company || '/' || form || '/' || date WHEN k = 3 THEN company || '/' || form WHEN k = 5 THEN 'sec/' || company || '/' || form || '/' || date
  WHEN k = 6 THEN 'uk/data/' || company || '/' || form || '/reports/2020' END AS folder FROM t JOIN files f USING (page_id) WHERE k NOT IN (4, 5, 7)),
catalog AS (SELECT folder, CASE WHEN min(k) < 2 THEN 'sec' WHEN min(k) = 6 THEN 'uk' ELSE 'unknown' END AS market, any_value(company) AS company, any_value(form) AS form, CASE WHEN min(k) = 6 THEN '2020' WHEN min(k) = 3 THEN 'unknown' ELSE any_value(date) END AS date,
  CASE WHEN min(k) IN (0, 3) THEN min(below) FILTER (k IN (0, 3)) WHEN min(k) = 1 THEN min(below) END AS main_file, count(*) FILTER (k IN (0, 1, 3)) AS n_json, count(*) FILTER (k = 2) AS n_csv, count(*) FILTER (k = 6) AS n_excel, CAST(sum(length) AS BIGINT) AS bytes FROM placed GROUP BY folder)"""


@_r.add(f"WITH {CATALOG_SQL} SELECT * FROM catalog")
def mapped_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Mapped filings among files: by markers and by folders of formats, each folder once."""
    return files.mapped_filings(_tree(spark, d))


@_r.add(f"WITH {TREE_SQL} SELECT 'esef/' || company || '/' || form AS folder, 'esef' AS market, company, form, 'unknown' AS date, below AS file, length FROM t JOIN files f USING (page_id, length) WHERE k = 4 AND NOT regexp_matches(form, '[0-9]') UNION ALL SELECT 'esef/' || company || '/' || form, 'esef', 'esef', company, form, below, length FROM t JOIN files f USING (page_id, length) WHERE k = 4 AND regexp_matches(form, '[0-9]')")
def parsed_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parsed filings among files; a form with a digit at the end of a path of three parts counts as a date."""
    return files.parsed_filings(_tree(spark, d))


@_r.add(f"WITH {TREE_SQL} SELECT split_part(below, '/', 1) AS directory, 'libraries' AS source, count(*) AS n_files, CAST(0 AS BIGINT) AS n_schemas, CAST(sum(length) AS BIGINT) AS bytes FROM files GROUP BY 1")
def taxonomy_locations(spark: SparkSession, d: str) -> DataFrame:
    return files.taxonomy_locations(_tree(spark, d), "libraries")


@_r.add(f"""WITH {CATALOG_SQL}, w AS (SELECT c_custkey AS want_id, CASE c_custkey % 3 WHEN 0 THEN 'SEC' ELSE 'uk' END AS market, (SELECT list(DISTINCT company ORDER BY company) FROM catalog)[1 + c_custkey % (SELECT count(DISTINCT company) FROM catalog)] AS company,
  CASE c_custkey % 4 WHEN 0 THEN 'form10-K' WHEN 1 THEN 'annual-report' WHEN 2 THEN '20-F' ELSE '10_q' END AS form, CASE WHEN c_custkey % 5 = 0 THEN CAST(2010 + c_custkey % 12 AS VARCHAR) END AS date FROM customer),
kinds AS (SELECT *, CASE form WHEN '10-K' THEN ['form10-K'] WHEN 'annual_report' THEN ['annual-report'] ELSE ['20-F'] END AS known FROM catalog),
ok AS (SELECT want_id, k.*, lower(w.company) = lower(k.company) AS same FROM w JOIN kinds k ON (lower(k.market) = lower(w.market) OR k.market = 'unknown') AND (contains(w.company, k.company) OR contains(k.company, w.company)) AND (list_contains(known, w.form) OR (w.form = 'form10-K' AND k.form = 'annual_report') OR (w.form = 'annual-report' AND k.form = '10-K'))
  AND (w.date IS NULL OR contains(k.date, w.date) OR contains(w.date, k.date)))
SELECT want_id, folder, market, company, form, date FROM (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY same DESC, date DESC, folder) AS r FROM ok) WHERE r = 1""")
def filing_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The filing of each customer's company, form and year among the mapped ones."""
    catalog = files.mapped_filings(_tree(spark, d)).select("folder", "market", "company", "form", "date")
    names = catalog.agg(F.array_sort(F.collect_set("company")).alias("names"))
    c = F.col("c_custkey")
    form = F.when(c % 4 == 0, "form10-K").when(c % 4 == 1, "annual-report").when(c % 4 == 2, "20-F").otherwise("10_q")
    wanted = table(spark, d, "customer").join(F.broadcast(names)).select(c.alias("want_id"), F.when(c % 3 == 0, "SEC").otherwise("uk").alias("market"), F.get("names", (c % F.size("names")).cast("int")).alias("company"), form.alias("form"), F.when(c % 5 == 0, (2010 + c % 12).cast("string")).alias("date"))  # one row of names
    return files.find_filing(catalog, wanted)


# --- validation in stages --------------------------------------------------------------------------------------------------------------

STAGES_SQL = """e AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice < 20000 THEN ['price'] ELSE [] END AS a, list_filter([CASE WHEN year(o_orderdate) < 1994 THEN 'date' END, CASE WHEN o_orderkey % 7 = 0 OR o_orderstatus NOT IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL) AS b, CASE WHEN o_custkey % 10 = 0 THEN ['owner'] ELSE [] END AS c FROM orders)"""


def _rules() -> list[V.Rule]:
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus").isin("F", "O"))  # cannot be applied to each seventh
    return [V.Rule("format", "price", F.col("o_totalprice") >= 20000, "too small"), V.Rule("schema", "date", F.year("o_orderdate") >= 1994, F.concat(F.lit("too early: "), F.col("o_orderdate").cast("string"))), V.Rule("schema", "status", status, "unknown"), V.Rule("custom", "owner", F.col("o_custkey") % 10 != 0, "barred")]


@_r.add(f"""WITH {STAGES_SQL}, f AS (SELECT *, len(a) = 0 AS pa, len(a) = 0 AND len(b) = 0 AS pb FROM e)
SELECT stage, rule, count(*) AS n, mode FROM (SELECT 'format' AS stage, unnest(a) AS rule, 'fail_fast' AS mode FROM f UNION ALL SELECT 'schema', unnest(b), 'fail_fast' FROM f WHERE pa UNION ALL SELECT 'custom', unnest(c), 'fail_fast' FROM f WHERE pb
UNION ALL SELECT 'format', unnest(a), 'all' FROM f UNION ALL SELECT 'schema', unnest(b), 'all' FROM f UNION ALL SELECT 'custom', unnest(c), 'all' FROM f) GROUP BY ALL""")
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors by stage and rule, where stages stop at the first with errors, and where they don't."""
    o = table(spark, d, "orders")
    counts = [V.error_counts(V.validate(o, _rules(), fast)).withColumn("mode", F.lit(mode)) for fast, mode in ((True, "fail_fast"), (False, "all"))]
    return counts[0].unionByName(counts[1])


@_r.add(f"""WITH {STAGES_SQL}, f AS (SELECT *, CASE WHEN len(a) > 0 THEN len(a) ELSE CASE WHEN len(b) > 0 THEN len(b) ELSE len(c) END END AS n FROM e)
SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (n = 0) AS n_valid, CAST(sum(n) AS BIGINT) AS n_errors, round(100.0 * count(*) FILTER (n = 0) / count(*), 2) AS percent_valid FROM f GROUP BY o_orderpriority""")
def validation_batches(spark: SparkSession, d: str) -> DataFrame:
    return V.in_batches(V.validate(table(spark, d, "orders"), _rules()), ["o_orderpriority"])


# --- schemas ---------------------------------------------------------------------------------------------------------------------------


@_r.add("""WITH k AS (SELECT lower(table_name) AS t, lower(column_name) AS c, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS kind FROM information_schema.columns),
a AS (SELECT substr(c, 3) AS c, kind FROM k WHERE t = 'customer'), b AS (SELECT substr(c, 3) AS c, kind FROM k WHERE t = 'supplier' UNION ALL SELECT substr(c, 3), kind FROM k WHERE t = 'part' UNION ALL SELECT 'acctbal2', 'double' UNION ALL SELECT 'custkey', 'int')
SELECT coalesce(a.c, b.c) AS "column", a.kind AS have_type, b.kind AS want_type, CASE WHEN a.kind IS NULL THEN 'add' WHEN b.kind IS NULL THEN 'drop' WHEN a.kind = 'int' AND b.kind IN ('bigint', 'double') THEN 'widen' WHEN b.kind = 'int' AND a.kind IN ('bigint', 'double') THEN 'narrow' ELSE 'replace' END AS change
FROM a FULL JOIN b ON a.c = b.c WHERE a.kind IS DISTINCT FROM b.kind""")
def schema_changes(spark: SparkSession, d: str) -> DataFrame:
    """What would have to change for customers to be like suppliers and parts at once."""
    bare = lambda t: table(spark, d, t).withColumnsRenamed({c: c[2:] for c in table(spark, d, t).columns})
    fields = [f for f in bare("supplier").schema.fields if f.name != "name"] + bare("part").schema.fields
    want = spark.createDataFrame([], StructType([*fields, StructField("acctbal2", DoubleType()), StructField("custkey", IntegerType())]))
    return E.schema_diff(bare("customer"), want)


# --- search responses -------------------------------------------------------------------------------------------------------------------


def _british(spark: SparkSession, d: str) -> DataFrame:
    """A profile for each customer and its orders as filing history; a text that is no JSON for each eleventh."""
    o = table(spark, d, "orders")
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("transaction_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("2001-01-01")).alias("action_date"),
        (F.col("o_orderkey") % 9).alias("pages"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(True)).alias("paper_filed"), F.when(F.col("o_orderkey") % 5 == 0, "application/xhtml+xml").otherwise("application/pdf").alias("preferred_format"),
        F.struct(F.when(F.col("o_orderkey") % 6 > 0, F.concat(F.lit("https://x/document/D"), F.col("o_orderkey").cast("string"), F.lit("/metadata"))).alias("document_metadata")).alias("links"),
    )
    history = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), item.alias("i")))), lambda x: x["i"]).alias("items"))).alias("history"))
    c = table(spark, d, "customer")
    profile = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("company_number"), F.col("c_name").alias("company_name"), F.when(F.col("c_nationkey") % 2 == 0, "scotland").alias("jurisdiction")))
    return c.join(history, F.col("c_custkey") == F.col("o_custkey")).select(profile.alias("profile"), F.when(F.col("c_custkey") % 11 > 0, F.col("history")).otherwise("no json").alias("history"))


@_r.add("""SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS company_name, o_orderpriority AS form_type, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, CAST(o_orderkey AS VARCHAR) AS accession_number, 'uk' AS market_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place,
CAST(NULL AS VARCHAR) AS filing_description, o_orderstatus AS filing_category, CASE WHEN o_orderkey % 4 = 2 THEN '2001-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period_end, CASE WHEN o_orderkey % 6 > 0 THEN 'D' || o_orderkey END AS document_id, o_orderkey % 5 = 0 AS is_inline,
CASE WHEN c_nationkey % 2 = 0 THEN 'scotland' ELSE 'england-wales' END AS jurisdiction, o_orderkey % 9 AS pages, o_orderkey % 3 = 0 AS paper_filed FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 11 > 0""")
def british_filings(spark: SparkSession, d: str) -> DataFrame:
    return searches.british_filings(_british(spark, d))


@_r.add("""SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS company_name, o_orderpriority AS form_type, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, CAST(o_orderkey AS VARCHAR) AS accession_number, CASE WHEN o_orderkey % 6 > 0 THEN 'D' || o_orderkey END AS filing_url, 'uk' AS market_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 11 > 0""")
def standard_results(spark: SparkSession, d: str) -> DataFrame:
    rows = searches.british_filings(_british(spark, d))
    return searches.standard_rows(rows, "uk", entity_id="entity_id", company_name="company_name", form_type="form_type", filing_date="filing_date", accession_number="accession_number", filing_url="document_id")


@_r.add("""SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 7 = 1) THEN min(o_orderkey) FILTER (o_orderkey % 7 = 1) || '_htm.zip' WHEN bool_or(o_orderkey % 7 = 2) THEN min(o_orderkey) FILTER (o_orderkey % 7 = 2) || '-xbrl.zip' WHEN bool_or(o_orderkey % 7 = 3) THEN min(o_orderkey) FILTER (o_orderkey % 7 = 3) || '.zip' END AS package FROM orders GROUP BY o_custkey""")
def filing_packages(spark: SparkSession, d: str) -> DataFrame:
    """The package among the files that a filing's index lists."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    name = F.concat(k.cast("string"), F.when(k % 7 == 1, "_htm.zip").when(k % 7 == 2, "-xbrl.zip").when(k % 7 == 3, ".zip").otherwise(".txt"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", name.alias("name")))), lambda x: F.struct(x["name"].alias("name")))
    index = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(names.alias("item")).alias("directory"))).alias("index"))
    return index.select("o_custkey", searches.package_in(F.col("index")).alias("package"))
