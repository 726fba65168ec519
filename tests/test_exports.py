"""Exports are the same however often they are written; what they hold."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom.operators import facts as O
from auditloom.operators import scoring, verify
from auditloom.sources import sinks

KIND = "filing_id int, stmt_seq int, title string, category string, fact_seq int, concept string, value double, label string, is_total boolean, is_abstract boolean, period_end string"
ROWS = [
    (1, 1, "Balance Sheet", "CORE_STATEMENT", 1, "Cash", 1.0, None, False, False, None),
    (1, 1, "Balance Sheet", "CORE_STATEMENT", 2, "Assets", 5.0, "All assets", True, False, "2024-12-31"),
    (1, 1, "Balance Sheet", "CORE_STATEMENT", 3, "Assets", 6.0, None, True, False, "2023-12-31"),
    (1, 2, "balance sheet!", "CORE_STATEMENT", 1, "Debt", 2.0, None, True, True, "2024-12-31"),
    (1, 3, "Balance Sheet", "DETAIL", 1, "Note", 3.0, None, True, None, ""),
    (2, 1, "Other", None, 1, "X", 4.0, None, None, False, None),
]


def snapshot(spark, path):
    return sorted(map(str, sinks.exported(spark, path).select("batch", "route", *[c.split()[0] for c in KIND.split(", ")], "file_name").collect()))


def test_an_export_written_twice_is_as_one_written_once(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, KIND), f"file://{tmp_path}/x"
    sinks.export(df.filter("filing_id = 1"), path, "a")
    sinks.export(df.filter("filing_id = 2"), path, "b")
    once = snapshot(spark, path)
    sinks.export(df.filter("filing_id = 1").repartition(3), path, "a")
    assert snapshot(spark, path) == once and len(once) == len(ROWS)
    assert sinks.damaged(spark, path).count() == 0
    names = {(r.filing_id, r.stmt_seq): (r.route, r.file_name) for r in sinks.exported(spark, path).collect()}
    assert names == {(1, 1): ("core", "balance_sheet"), (1, 2): ("core", "balance_sheet_2"), (1, 3): ("details", "balance_sheet"), (2, 1): ("other", "other")}
    sinks.export(df.filter("filing_id = 1 and stmt_seq < 3"), path, "a")
    assert {r.route for r in sinks.exported(spark, path).filter("batch = 'a'").collect()} >= {"core"}


def test_unfinished_and_damaged_exports_show(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, KIND), f"file://{tmp_path}/x"
    sinks.export(df.filter("filing_id = 2"), path, "b")
    begun = sinks.routed(df.filter("filing_id = 1")).withColumn("batch", F.lit("a"))
    begun.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "route").parquet(f"{path}/statements")
    assert {r.filing_id for r in sinks.exported(spark, path).collect()} == {2}
    assert {(r.batch, r.filing_id) for r in sinks.damaged(spark, path).collect()} == {("a", 1)}


def test_texts_of_core_statements_and_totals(spark):
    df = spark.createDataFrame(ROWS, KIND)
    info = spark.createDataFrame([(1, "Acme")], "filing_id int, company string")
    texts = {r.stmt_seq: json.loads(r.json) for r in sinks.statement_json(df, info).collect()}
    assert set(texts) == {1, 2} and texts[1]["filing_info"] == {"company": "Acme"} and [f["concept"] for f in texts[1]["facts"]] == ["Cash", "Assets", "Assets"] and texts[1]["total_facts"] == 3
    (head,) = sinks.core_info(df).collect()
    assert (head.core_statement_count, head.n_facts, head.titles) == (2, 4, ["Balance Sheet", "balance sheet!"])
    assert {(r.stmt_seq, r.concept, r.value, r.label, r.period_end) for r in sinks.simplified(df).collect()} == {(1, "Assets", 6.0, "Assets", "2024-12-31"), (3, "Note", 3.0, "Note", "")}


def test_csv_has_all_columns_and_no_nulls(spark, tmp_path):
    columns = ", ".join(f"`{c}` string" for c in sinks.STATEMENT_COLUMNS)
    df = spark.createDataFrame([("core", *["v"] * 3, *[None] * 8)], f"category string, {columns}")
    sinks.write_statements(df, f"file://{tmp_path}/c", "csv")
    (row,) = spark.read.option("header", "true").csv(f"file://{tmp_path}/c").collect()
    assert row.concept == "v" and row.label in (None, "") and row.category == "core"
    sinks.write_statements(df, f"file://{tmp_path}/j", "json")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 1
    with pytest.raises(ValueError):
        sinks.write_statements(df, f"file://{tmp_path}/n", "html")


# --- all kinds of checks -----------------------------------------------------------------------------------


def test_checks_of_all_kinds_feed_the_scores(spark):
    f = [(1, "c", "A", 60.0, "USD", 0, 1), (1, "c", "B", 40.0, "USD", 0, 2), (1, "d", "A", 1.0, "USD", 0, 3), (1, "d", "A", 9.0, "USD", 0, 4), (2, "e", "A", 7.0, "USD", 0, 1), (2, "e", "B", 3.0, "USD", 0, 2)]
    resolved = O.classify_duplicates(spark.createDataFrame(f, "filing_id int, context_id string, concept string, value double, unit string, decimals int, fact_seq int"))
    arcs = spark.createDataFrame([("r", "T", "A", 1.0, 1), ("r", "T", "B", 1.0, 2)], "role string, parent string, child string, weight double, arc_seq int")
    parents = spark.createDataFrame([(1, "c", "r", "T", 100.0, "USD", 0, None), (1, "d", "r", "T", 10.0, "USD", 0, None), (2, "e", "r", "T", 15.0, "USD", 0, None)], "filing_id int, context_id string, role string, parent string, value double, unit string, decimals int, duplicate_type string")
    bound = O.bind(resolved, arcs, parents)
    library = spark.createDataFrame([(1, "library", "concept_validity", True, "info"), (2, "library", "period_type_match", False, "warning")], "filing_id int, check_type string, check_name string, passed boolean, severity string")
    checks = verify.all_checks(resolved, bound, O.rollup(bound), library)
    rows = {(r.filing_id, r.context_id, r.check_name): (r.check_type, r.passed, r.severity) for r in checks.collect()}
    assert rows == {
        (1, "c", "calculation_consistency"): ("horizontal", True, "info"),
        (1, "d", "calculation_consistency"): ("horizontal", None, "info"),
        (1, "d", "duplicate_facts"): ("horizontal", False, "warning"),
        (2, "e", "calculation_consistency"): ("horizontal", False, "critical"),
        (1, "c", "xbrl_calculation_company"): ("vertical", True, "info"),
        (2, "e", "xbrl_calculation_company"): ("vertical", False, "critical"),
        (1, "d", "common_values_consistency"): ("vertical", False, "warning"),
        (2, None, "common_values_consistency"): ("vertical", True, "info"),
        (1, None, "concept_validity"): ("library", True, "info"),
        (2, None, "period_type_match"): ("library", False, "warning"),
    }
    scores = {(r.filing_id, r.check_type): round(r.score, 3) for r in scoring.category_scores(checks).collect()}
    assert scores == {(1, "horizontal"): round((99.5 * 0.5 + 95 * 0.05) / 0.55, 3), (1, "vertical"): round((100 * 0.4 + 95 * 0.05) / 0.45, 3), (1, "library"): 100.0, (2, "horizontal"): 75.0, (2, "vertical"): round(100 * 0.05 / 0.45, 3), (2, "library"): 95.0}


def test_common_values_are_compared_with_the_lowest(spark):
    """995 and 1003: the lowest is small, so a difference of 8 is beyond 1, although it is under one percent."""
    df = spark.createDataFrame([("A", "p", "c", 995.0), ("A", "p", "c", 1003.0), ("B", "p", "c", 2000.0), ("B", "p", "c", 2010.0)], "concept string, period_key string, context_id string, value double")
    assert [r.concept for r in O.common_values(df).collect()] == ["A"]
