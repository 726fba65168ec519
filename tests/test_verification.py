"""Facts, checks, contexts, reports and names on small hand-made filings."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import checks as K
from auditloom.functions import classify, names, numbers, periods
from auditloom.operators import audit, contexts, facts, hierarchy, library, reports, scoring, verify


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_values_are_equal_at_the_lesser_decimals(spark):
    rows = [(532e6, 532.3e6, -6, -5), (100.0, 100.5, None, None), (100.0, 100.6, None, None), (1.234, 1.236, 2, 3), (1.234, 1.224, 2, 2), (5.0, 6.0, 0, None)]
    equal = numbers.equal_at_precision(F.col("a"), F.col("b"), F.col("da"), F.col("db"))
    assert values(spark, equal, rows, "a double, b double, da int, db int") == [True, True, False, False, False, False]


def test_inf_is_a_precision_of_its_own(spark):
    rows = [(1, "c", "Cash", 1, 5.0, "USD", None, "INF"), (1, "c", "Cash", 2, 5.0, "USD", 0, "0"), (1, "c", "Debt", 3, 5.0, "USD", 0, "0"), (1, "c", "Debt", 4, 5.0, "USD", 0, "0")]
    df = spark.createDataFrame(rows, "filing_id int, context_id string, concept string, fact_seq int, value double, unit string, decimals int, decimals_raw string")
    assert {r.concept: r.duplicate_type for r in facts.classify_duplicates(df).collect()} == {"Cash": "consistent", "Debt": "complete"}


def test_spellings_of_a_concept_meet(spark):
    df = spark.createDataFrame([(1, "c", "us-gaap:Cash_Equivalents", 1, 5.0, "USD", 0), (1, "c", "us-gaap_CashEquivalents", 2, 9.0, "USD", 0)], "filing_id int, context_id string, concept string, fact_seq int, value double, unit string, decimals int")
    out = facts.classify_duplicates(facts.by_concept_key(df)).collect()
    assert [(r.n_entries, r.duplicate_type) for r in out] == [(2, "inconsistent")]


def test_a_lacking_child_comes_from_a_context_of_the_same_period(spark):
    resolved = spark.createDataFrame([(1, "c1", "A", 60.0, "USD", 0, None), (1, "c2", "B", 40.0, "USD", 0, None)], "filing_id int, context_id string, concept string, selected_value double, unit string, decimals int, duplicate_type string")
    arcs = spark.createDataFrame([("r", "T", "A", 1.0, 1), ("r", "T", "B", 1.0, 2), ("r", "T", "C", -1.0, 3)], "role string, parent string, child string, weight double, arc_seq int")
    parents = spark.createDataFrame([(1, "c1", "r", "T", 100.0, "USD", 0, None, "2024")], "filing_id int, context_id string, role string, parent string, value double, unit string, decimals int, duplicate_type string, period_key string")
    others = spark.createDataFrame([(1, "c2", "2024", "B", 40.0, "USD", 1, False), (1, "c3", "2024", "C", 7.0, "EUR", 2, False), (1, "c4", "2024", "C", 8.0, "USD", 3, True)], "filing_id int, context_id string, period_key string, concept string, value double, unit string, fact_seq int, dimensional boolean")
    plain, rescued = (facts.rollup(facts.bind(resolved, arcs, parents, o)).collect() for o in (None, others))
    assert plain == []  # one of three children is under half
    assert [(r.n_found, r.n_children, r.expected, r.passed) for r in rescued] == [(2, 3, 100.0, True)]


def test_reportable_facts_and_joined_checks(spark):
    df = spark.createDataFrame([("c", False, "5"), ("", False, "5"), ("c", True, "5"), ("c", None, "-"), (None, None, "5")], "context_id string, is_abstract boolean, value string")
    assert (facts.reportable(df).count(), facts.reportable(df, include_nil=True).count()) == (1, 2)
    assert facts.union_checks(df, df.select("value")).count() == 10


def test_depth_counts_roots_and_paths_follow_the_first_parent(spark):
    arcs = spark.createDataFrame([(1, "r", "A", "B", 1.0, 1, 1.0), (1, "r", "X", "C", 0.0, 2, 1.0), (1, "r", "B", "C", 1.0, 3, 1.0), (1, "r", "C", "D", 1.0, 4, 1.0)], "filing_id int, role string, parent string, child string, order double, arc_seq int, weight double")
    (tree,) = hierarchy.depth(hierarchy.walk(arcs, 6)).collect()
    assert (tree.max_depth, tree.n_concepts, tree.n_roots) == (4, 5, 2)
    assert {r.concept: r.path for r in hierarchy.path_to_root(arcs, 6).collect()}["D"] == ["D", "C", "X"]


def test_gravest_checks_come_first(spark):
    df = spark.createDataFrame([(1, i, "n", False, "critical" if i % 5 == 0 else "info") for i in range(30)] + [(1, 99, "n", True, "critical"), (2, 1, "n", None, "warning")], "filing_id int, check_seq int, check_name string, passed boolean, severity string")
    out = sorted((r.filing_id, r.place, r.check_seq) for r in scoring.failed_first(df, 8).collect())
    assert out == [(1, 1, 0), (1, 2, 5), (1, 3, 10), (1, 4, 15), (1, 5, 20), (1, 6, 25), (1, 7, 1), (1, 8, 2), (2, 1, 1)]


def test_library_checks_of_a_filing(spark):
    rows = [(1, "us-gaap:Cash", -5.0, None, "2024"), (1, "us-gaap:Sales", 5.0, None, "2024"), (1, "acme:Own", 1.0, None, None), (1, "Nowhere", 1.0, None, None)]
    f = spark.createDataFrame(rows, "filing_id int, concept string, value double, period_start string, period_end string").withColumn("is_abstract", F.lit(False))
    d = spark.createDataFrame([("us-gaap:Cash", "duration", "debit", 1), ("us-gaap:Cash", "instant", "debit", 2), ("Sales", "duration", "credit", 3)], "name string, period_type string, balance string, def_seq int")
    out = {r.check_name: (r.passed, r.severity, r.n_checked, r.n_found) for r in library.library_checks(library.library_counts(f, d)).collect()}
    assert out == {"concept_validity": (False, "info", 4, 1), "period_type_match": (False, "warning", 2, 1), "balance_type_match": (True, "info", 2, 1)}


def test_two_sources_agree_unless_one_fails_a_tree_that_both_have(spark):
    arcs = lambda *p: spark.createDataFrame([("r", x) for x in p], "role string, parent string")
    checks = lambda *rows: spark.createDataFrame([("r", p, c, ok, 1.0, 1.0) for p, c, ok in rows], "role string, parent string, context_id int, passed boolean, expected double, value double")
    company = verify.tree_results(arcs("A", "B", "C"), checks(("A", 1, True), ("A", 2, True), ("B", 1, False)))
    taxonomy = verify.tree_results(arcs("A", "B", "D"), checks(("A", 1, False), ("D", 1, True)))
    out = {r.parent: (r.company_passed, r.taxonomy_passed, r.sources_agree) for r in verify.dual(company, taxonomy).collect()}
    assert out == {"A": (True, False, False), "B": (False, False, True), "C": (False, None, True), "D": (None, True, True)}
    rows = verify.vertical_checks({"n": spark.createDataFrame([(1, "c", True, "info")], "filing_id int, context_id string, passed boolean, severity string")}, spark.createDataFrame([(1, "d")], "filing_id int, context_id string"))
    assert sorted((r.check_name, r.passed) for r in rows.collect()) == [("common_values_consistency", False), ("n", True)]


def test_contexts_and_dimensions(spark):
    rows = [(1, "a", 1, "e", "2024", None), (1, "b", 2, "e", "2024", {"x": "m", "y": "n"}), (1, "c", 3, "e", "2024", {"y": "n", "x": "m"}), (1, "d", 4, "e", "2023", {"x": "m"})]
    df = spark.createDataFrame(rows, "filing_id int, context_id string, seq int, entity string, period_key string, dims map<string,string>")
    assert {r.context_id: r.default_id for r in contexts.default_contexts(df).collect()} == {"b": "a", "c": "a", "d": None}
    none = F.lit(None).cast("string")
    key = contexts.context_key(F.col("entity"), none, none, F.col("period_key"), F.col("dims"), F.lit(None).cast("map<string,string>"))
    assert {r.context_id: (r.same_as, r.n_equal) for r in contexts.equal_contexts(df, key).collect()} == {"a": ("a", 1), "b": ("b", 2), "c": ("b", 2), "d": ("d", 1)}
    arcs = [("r", "hypercube-dimension", "H", "X"), ("r", "dimension-domain", "X", "D"), ("r", "dimension-default", "X", "D"), ("r", "domain-member", "D", "m1"), ("r", "domain-member", "D", "m2"), ("r", "hypercube-dimension", "H", "Y")]
    cubes = contexts.hypercubes(spark.createDataFrame(arcs, "role string, arcrole string, parent string, child string")).collect()
    assert sorted((r.dimension, r.domain, r.default_member, r.n_members) for r in cubes) == [("X", "D", "D", 2), ("Y", None, None, 0)]


@pytest.mark.parametrize(
    "column,text,want",
    [
        (lambda: names.last_part_key(F.col("t")), "us-gaap_Cash_Flow-Net", "flow net".replace(" ", "")),
        (lambda: names.replace_namespace(F.col("t"), F.lit("u")), "us-gaap:Cash", "{u}Cash"),
        (lambda: names.local_names_match(F.col("t"), F.lit("{http://x}Cash")), "us-gaap:Cash", True),
        (lambda: names.arcrole_name(F.col("t")), "http://xbrl.org/int/dim/arcrole/domain-member", "domain-member"),
        (lambda: names.arcrole_name(F.col("t")), "http://acme.com/own", "http://acme.com/own"),
        (lambda: names.arcrole_uri(F.col("t")), "summation-item", "http://www.xbrl.org/2003/arcrole/summation-item"),
        (lambda: names.same_role(F.col("t"), F.lit("http://y/role/BALANCE")), "http://x/role/Balance", True),
        (lambda: names.namespace_of(F.col("t")), "us-gaap:Cash", "us-gaap"),
        (lambda: names.uk_number(F.col("t")), "123 456", "00123456"),
        (lambda: names.is_lei(F.col("t")), "5493001KJTIIGC8Y1R12", True),
        (lambda: names.is_accession(F.col("t")), "0000320193-24-000123", True),
        (lambda: K.is_default_member(F.col("t"), F.lit("acme_AllMember"), F.lit(None).cast("string")), "acme:AllMember", True),
        (lambda: K.is_default_member(F.col("t"), F.lit("acme_AllMember"), F.lit("acme_Domain")), "acme:EuropeMember", False),
        (lambda: K.simple_type(F.col("t"), F.lit("http://x/role/CashFlows")), "Statement 3", "cash_flow"),
        (lambda: K.is_namespace_map(F.split("t", " ")), "http://a https://b c", True),
        (lambda: K.download_url(F.lit(""), F.col("t"), "https://x.org"), "/r.zip", "https://x.org/r.zip"),
        (lambda: periods.contexts_compatible(F.col("t"), F.lit("period_2024-01-01_to_2024-12-31")), "duration_2024-01-01_to_2024-12-31", True),
        (lambda: classify.coverage_level(F.col("t").cast("double")), "98.5", "excellent"),
        (lambda: classify.market_of(F.col("t")), "https://www.sec.gov/x", "sec"),
        (lambda: classify.slot_of(F.col("t")), "ConsolidatedBalanceSheets.json", "balance_sheet"),
        (lambda: F.array_join(K.download_errors(F.lit(True), F.lit(0), F.col("t")), ","), "a.txt", "too small,no archive"),
        (lambda: F.array_join(K.search_errors(F.col("t"), F.lit(""), F.lit("2024-02-01"), F.lit("2024-01-01"), F.lit(0)), ","), "12", "form,range,limit"),
        (lambda: K.arc_valid(F.lit(10.0), F.array(F.lit(4.0), F.lit(6.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(1.0), F.lit(-1.0))), "", True),
        (lambda: K.ready_for_parsing(F.lit(True), F.col("t"), F.lit(True)), "", False),
        (lambda: K.dates_consistent(F.lit("2024-01-02"), F.col("t")), "2024-01-01", False),
        (lambda: K.value_within(F.col("t").cast("double"), 1.0, 5.0), "7", False),
        (lambda: F.array_join(numbers.mismatch_reasons(F.lit(10.0), F.col("t").cast("double")), ","), "-10", "sign"),
        (lambda: numbers.parse_decimals(F.col("t")), "INF", None),
        (lambda: numbers.at_precision(F.col("t").cast("double"), F.lit(2)), "1234", 1200.0),
    ],
)
def test_column_functions(spark, column, text, want):
    assert values(spark, column(), [(text,)], "t string") == [want]


def test_reports_on_small_filings(spark):
    df = spark.createDataFrame([(1, 1, "acme:A", "5"), (1, 2, "us-gaap:B", None), (1, 3, "us-gaap:C", "6")], "filing_id int, fact_seq int, concept string, value string")
    assert [(r.prefix, r.n) for r in reports.primary_prefix(df).collect()] == [("us-gaap", 2)]
    assert [(r.prefix, r.n) for r in reports.primary_prefix(df, 2).collect()] == [("acme", 1)]
    assert [r.concept for r in reports.extension_facts(df, F.col("concept").startswith("us-gaap")).collect()] == ["acme:A"]
    new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, audit.insert_absent(spark.createDataFrame([(1, "old")], "k int, v string"), new, ["k"]).collect())) == [(1, "old"), (2, "y")]
