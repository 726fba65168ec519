"""Functions, sources, sinks and streams on small inputs made here."""

import io
import zipfile
from decimal import ROUND_HALF_EVEN, Context, Decimal

import pytest
from pyspark.sql import functions as F

from auditloom.functions import classify, names, numbers, periods, urls
from auditloom.operators import audit, hierarchy
from auditloom.sources import archives, filing_json, files, linkbase_xml, sinks
from auditloom.streaming import monitor


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_numbers_are_parsed(spark):
    assert column(spark, ["(1,234)", "$5", "—", "nil", "", None, "junk", "1e3", " -2.50 "], numbers.parse_number) == [-1234.0, 5.0, 0.0, 0.0, 0.0, None, None, 1000.0, -2.5]


def test_values_are_equal_at_the_lower_precision(spark):
    rows = [(532_000_000.0, 532_300_000.0, -6, -5), (0.0, 0.0, None, None), (999.0, 1000.0, 0, 0)]
    df = spark.createDataFrame(rows, "a double, b double, da int, db int")
    out = [r.x for r in df.select(numbers.equal_at_precision(*map(F.col, ("a", "b", "da", "db"))).alias("x")).collect()]
    assert out == [True, True, False]


def test_rounding_goes_by_the_printed_number(spark):
    values = [(1.015, 2), (2.675, 2), (0.285, 2), (2.5, 0), (3.5, 0), (-2.5, 0), (25.0, -1), (35.0, -1), (1_234_567.0, -3), (86_036_299_462.35, 1), (1e300, 2), (5.25, None), (5.25, 13), (None, 1), (-0.4, 0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, v double, d int").orderBy("i")
    exact = lambda v, d: float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_EVEN, context=Context(prec=400))) + 0.0
    wanted = [v if v is None or d is None or d > 12 else exact(v, d) for v, d in values]
    assert [r.x for r in df.select(numbers.round_half_even(F.col("v"), F.col("d")).alias("x")).collect()] == wanted


def test_statement_keys_lose_their_ends_in_order(spark):
    values = ["Balance_Sheet-Details", "IncomeParentheticalDetails", "EquityDetailsParenthetical", "Details", "Cash-Flow", None]
    assert column(spark, values, names.statement_key, "string") == ["balancesheet", "incomeparenthetical", "equity", "", "cashflow", None]


def test_failed_downloads(spark):
    rows = [("url_404", 2, 0), ("url_404", 3, 0), ("timeout", 3, 0), ("corrupted_zip", 3, 1), ("invalid_archive", 0, 2), ("extraction_error", 0, 0), ("other", 9, 9), (None, 3, 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, reason string, n int, m int").orderBy("i")
    got = [r.x for r in df.select(classify.retry_strategy(*map(F.col, ("reason", "n", "m"))).alias("x")).collect()]
    same, other = "retry_same_url", "try_alternative_url"
    assert got == [same, other, other, same, other, "manual_intervention", same, same]


def test_concepts_have_one_key(spark):
    keys = column(spark, ["us-gaap:Assets", "us-gaap_Assets"], names.concept_key)
    assert keys[0] == keys[1]


@pytest.mark.parametrize("text,kind", [("Duration_1_1_2024_To_12_31_2024", "duration"), ("AsOf_12_31_2024", "instant"), ("c-4", "unknown")])
def test_kinds_of_contexts(spark, text, kind):
    assert column(spark, [text], lambda c: periods.period(c)["kind"]) == [kind]


def test_parts_of_urls(spark):
    assert column(spark, ["https://a.example.com/x/y.zip?q=1", "nothing", None], urls.host) [0] == "a.example.com"


def test_hierarchy_of_a_diamond_places_each_concept_once(spark):
    arcs = spark.createDataFrame([("r", "a", "b", 1.0, 0), ("r", "a", "c", 2.0, 1), ("r", "b", "d", 1.0, 2), ("r", "c", "d", 1.0, 3)], "role string, parent string, child string, order double, arc_seq int")
    arcs = arcs.withColumns({"filing_id": F.lit("f"), "weight": F.lit(1.0), "priority": F.lit(0), "use": F.lit("optional"), "preferred_label": F.lit(None).cast("string")})
    placed = hierarchy.first_placements(hierarchy.walk(arcs)).collect()
    assert sorted(r.concept for r in placed) == ["a", "b", "c", "d"]


def test_duplicate_keys_may_leave_nulls_out(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert audit.duplicate_keys(df, ["k"], ignore_null=True).count() == 1


CALCULATION = """<link:linkbase xmlns:link="l" xmlns:xlink="x"><link:calculationLink xlink:role="http://r/1">
<link:loc xlink:label="l1" xlink:href="s.xsd#us-gaap_Assets"/><link:loc xlink:label="l2" xlink:href="s.xsd#us-gaap_Cash"/>
<link:calculationArc xlink:from="l1" xlink:to="l2" order="1" weight="-1"/></link:calculationLink></link:linkbase>"""


def test_calculation_arcs_are_read(spark, tmp_path):
    (tmp_path / "f1").mkdir()
    (tmp_path / "f1" / "a_cal.xml").write_text(CALCULATION)
    rows = linkbase_xml.arcs(spark, f"file://{tmp_path}", "calculation").collect()
    assert [(r.role, r.order, r.weight) for r in rows] == [("http://r/1", 1.0, -1.0)]
    assert "Assets" in rows[0].parent and "Cash" in rows[0].child and rows[0].filing_id.endswith("/f1")


def test_walks_follow_chains_of_any_length(spark):
    arcs = spark.createDataFrame([("f", "r", f"c{i}", f"c{i + 1}", 1.0, -1.0, i) for i in range(30)] + [("f", "r", "c30", "c5", 1.0, 1.0, 99)], "filing_id string, role string, parent string, child string, `order` double, weight double, arc_seq long")
    rows = {r.concept: r for r in hierarchy.walk(arcs).collect()}
    assert len(rows) == 31 and rows["c30"].level == 30 and rows["c30"].weight == 1.0 and rows["c29"].weight == -1.0
    assert {r.level for r in hierarchy.walk(arcs, 3).collect()} == {0, 1, 2}
    assert hierarchy.walk(arcs.limit(0)).count() == 0


def test_json_paths_of_any_depth(spark):
    deep = "[" * 9 + '{"a": 1}' + "]" * 9
    rows = filing_json.json_paths(spark.createDataFrame([(deep,), ("no json",), (None,)], "j string"), "j").collect()
    assert {(r.path, r.kind, r.n) for r in rows} == {("$" + "[0]" * k, "array", 1) for k in range(9)} | {("$" + "[0]" * 9, "object", 1), ("$" + "[0]" * 9 + ".a", "bigint", 1)}


def test_inline_signs(spark):
    html = '<p><ix:nonFraction name="us-gaap:Loss" contextRef="c-1" sign="-">5</ix:nonFraction><ix:nonFraction name="us-gaap:Cash" contextRef="c-1">7</ix:nonFraction></p>'
    rows = linkbase_xml.inline_signs(spark.createDataFrame([("f", html)], "filing_id string, html string")).collect()
    assert [(r.concept, r.context_id, r.sign) for r in rows] == [("us-gaap:Loss", "c-1", "-")]


def test_members_of_archives_stay_inside(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/b.xml", "<x/>")
        z.writestr("../evil.txt", "no")
    df = spark.createDataFrame([("z.zip", raw.getvalue()), ("bad.zip", b"not an archive")], "path string, content binary")
    rows = archives.members(df).collect()
    assert [r.member for r in rows if r.archive == "z.zip"] == ["a/b.xml"]
    assert [bool(r.error) for r in rows if r.archive == "bad.zip"] == [True]


def test_members_are_not_capped_and_refused_ones_are_listed(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(50_001):
            z.writestr(f"{i}", "")
        z.writestr("../evil.txt", "no")
    assert sum(why is None for *_, why in archives._members(raw.getvalue())) == 50_001
    rows = archives.refused(spark.createDataFrame([("z.zip", raw.getvalue()), ("bad.zip", b"not an archive")], "path string, content binary")).collect()
    assert [(r.archive, r.member, r.length, r.error) for r in rows] == [("z.zip", "../evil.txt", 2, "unsafe or deep path")]


def test_files_are_found_below_a_folder(spark, tmp_path):
    (tmp_path / "sec" / "ACME").mkdir(parents=True)
    (tmp_path / "sec" / "ACME" / "x.xsd").write_text("<a/>")
    assert [r.name for r in files.discover(spark, f"file://{tmp_path}").collect()] == ["x.xsd"]


def test_catalog_counts_each_facet(spark):
    df = spark.createDataFrame([("f", "core", "income", "high"), ("f", "core", "balance", "low")], "filing_id string, category string, statement_type string, confidence string")
    rows = {(r.facet, r.name): r.n for r in sinks.catalog(df).collect()}
    assert rows == {("category", "core"): 2, ("statement_type", "income"): 1, ("statement_type", "balance"): 1, ("confidence", "high"): 1, ("confidence", "low"): 1}


def test_monitor_processes_each_filing_once_and_retries_failures(spark, tmp_path):
    where = {k: f"file://{tmp_path}/{k}" for k in ("in", "done", "mark")}
    schema = "filing_id string, ok boolean"
    for rows in ([("a", True), ("b", False)], [("a", True), ("b", True), ("c", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where["in"])
        arrivals = monitor.read_arrivals(spark, where["in"], schema)
        monitor.monitor(arrivals, lambda d: d.filter("ok"), where["done"], where["mark"]).awaitTermination()
    assert sorted(r.filing_id for r in spark.read.parquet(where["done"]).collect()) == ["a", "b", "c"]


def test_stream_counts_equal_those_of_the_table(spark, smallest):
    events = spark.read.parquet(f"{smallest}/events.parquet")
    want = {(r.window.start, r.event_type): r.n for r in monitor.windowed_counts(events, "ts", ["event_type"]).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{smallest}/events.parquet*")
    q = monitor.windowed_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.window.start, r.event_type): r.n for r in spark.table("counts").collect()} == want


def test_failed_filings_come_back_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    done, failed = f"file://{tmp_path}/done", f"file://{tmp_path}/failed"
    ready = set()
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "filing_id string")
    run = lambda rows, n: monitor.process_batch(rows, n, lambda new: new.filter(F.col("filing_id").isin(*ready)), done, failed)
    show = lambda path: sorted((r.filing_id, r.batch) for r in spark.read.parquet(path).collect())
    ready.add("a")
    for _ in range(2):
        run(batch("a", "b", "a"), 0)
        assert (show(done), show(failed)) == ([("a", 0)], [("b", 0)])
    ready.update("bc")
    for _ in range(2):
        run(batch("a", "c"), 1)
        assert (show(done), show(failed)) == ([("a", 0), ("b", 1), ("c", 1)], [("b", 0)])
    run(batch("b"), 2)
    assert show(done) == [("a", 0), ("b", 1), ("c", 1)]
