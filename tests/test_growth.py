"""Queries whose cost must not grow faster than their tables: what their plans hold, and the same results."""

from pyspark.sql import functions as F

from auditloom.operators import facts, joins
from auditloom.sources import files, instance_xml, linkbase_xml


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_meet_one_row_and_not_the_names_that_hold_them(spark):
    names = spark.range(300).select(F.lit(1).alias("c"), F.col("id"), F.concat(F.lit("name"), F.lpad((F.col("id") % 30).cast("string"), 3, "0")).alias("name"))
    out = joins.first_holding(names.select("c", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.right("name", F.lit(5))).alias("text")), names, ["c"])
    assert "Contains" not in plan_of(out)
    assert {(r.text, r.id) for r in out.collect()} == {(f"name{i:03}" if i % 2 == 0 else f"me{i:03}", i) for i in range(30)}


def test_filings_wanted_alike_are_looked_for_once(spark):
    catalog = spark.createDataFrame([(f"f{i}", "sec", "Acme Inc", "10-K", None if i == 0 else "2024") for i in range(4)] + [("g", "sec", "Acme", "10-K", "2025")], "folder string, market string, company string, form string, date string")
    wanted = spark.createDataFrame([(i, "SEC", "acme-inc", "10-k" if i % 2 else "10-K", "2024" if i < 4 else None) for i in range(8)] + [(9, "sec", None, "10-K", None)], "want_id int, market string, company string, form string, date string")
    out = files.find_filing(catalog, wanted)
    assert not [line for line in plan_of(out).splitlines() if "Generate explode" in line and "want_id" in line]
    assert {r.want_id: r.folder for r in out.collect()} == {i: "f1" for i in range(8)}
    assert {(r.text, r.name) for r in joins.holding(spark.createDataFrame([("a",), ("bc",), ("",), (None,)], "text string"), spark.createDataFrame([("abc",), ("x",), (None,)], "name string")).collect()} == {("a", "abc"), ("bc", "abc"), ("", "abc"), ("", "x")}


def test_instances_are_parsed_once(spark):
    unit = "<unit id='u'><measure>a</measure><measure> b</measure></unit><unit id='v'><divide><unitNumerator><measure>c</measure></unitNumerator><unitDenominator><measure>d</measure></unitDenominator></divide></unit>"
    doc = f"<xbrl><context id='x'><period><instant>2024-01-01</instant></period></context>{unit}</xbrl>"
    p = instance_xml.parsed(spark.createDataFrame([(1, doc), (2, "<xbrl"), (3, None), (4, "<xbrl/>")], "filing_id int, xml string"))
    contexts, units = instance_xml.contexts(p), instance_xml.units(p)
    assert plan_of(contexts).count("from_xml(") == plan_of(units).count("from_xml(") == 1
    assert [(r.filing_id, r.context_id) for r in contexts.collect()] == [(1, "x")]
    assert [tuple(r) for r in units.collect()] == [(1, "u", "a*b"), (1, "v", "c/d")]


def test_locators_of_long_links_are_met_and_not_searched(spark):
    n = 40
    locs = "".join(f"<loc label='l{i}' href='x.xsd#n_C{i}'/>" for i in range(n)) + "<loc label='l1' href='x.xsd#n_Last'/><loc href='x.xsd#n_None'/>"
    arcs = "".join(f"<calculationArc from='l0' to='l{i}' weight='{i}' order='x'/>" for i in range(n + 1)) + "<calculationArc to='l2'/>"
    link = f"<calculationLink role='r'>{locs}{arcs}</calculationLink>"
    text = f"<linkbase>{link}<presentationLink role='p'><presentationArc from='a' to='b'/></presentationLink>{link}</linkbase>"
    out = linkbase_xml.arcs_of(spark.createDataFrame([(1, text), (2, None), (3, "<linkbase/>")], "filing_id int, xml string"))
    assert plan_of(out).count("from_xml(") == 1 and "map_from_entries" not in plan_of(out)
    child = lambda i: "n:Last" if i == 1 else f"n:C{i}" if i < n else f"l{i}"
    one = lambda k: {("calculation", k, i, "n:C0", child(i), float(i)) for i in range(n + 1)} | {("calculation", k, n + 1, None, "n:C2", 1.0)}
    assert {(r.kind, r.link_seq, r.arc_seq, r.parent, r.child, r.weight) for r in out.collect()} == one(0) | one(1) | {("presentation", 0, 0, "a", "b", 1.0)}
    assert out.count() == 2 * (n + 2) + 1


def test_totals_and_facts_are_shuffled_by_context_alone(spark):
    resolved = spark.createDataFrame([(1, "c", "a", 1.0, None, 2, None), (1, "c", "b", None, "EUR", 1, None)], "filing_id int, context_id string, concept string, selected_value double, unit string, decimals int, duplicate_type string")
    arcs = spark.createDataFrame([("r", "t", k, w, i) for i, (k, w) in enumerate([("a", 1.0), ("b", -1.0), ("x", 2.0), ("y", 1.0)])], "role string, parent string, child string, weight double, arc_seq int")
    parents = spark.createDataFrame([(1, "c", "r", "t", 9.0, "USD", None, None, "p"), (1, "d", "r", "t", 9.0, None, None, None, "p")], "filing_id int, context_id string, role string, parent string, value double, unit string, decimals int, duplicate_type string, period_key string")
    for size in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            out = facts.bind(resolved, arcs, parents)
            exchanges = [line for line in plan_of(out).splitlines() if "Exchange hashpartitioning" in line]
            assert exchanges and not [line for line in exchanges if "child" in line or "concept" in line]
            assert {(r.context_id, r.status, r.n_children, r.n_found, r.expected, r.child_decimals) for r in out.collect()} == {("c", "skip_incomplete", 4, 1, 1.0, 2), ("d", "skip_no_children", 4, 0, None, None)}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lacking = {}

    def others(rows):
        lacking["rows"] = {(r.context_id, r.child) for r in rows.collect()}
        return spark.createDataFrame([(1, "c", "b", 2.0), (1, "c", "x", 3.0), (1, "d", "x", 4.0)], "filing_id int, context_id string, child string, child_value double")

    out = facts.bind(resolved, arcs, parents, others)
    got = {(r.context_id, r.status, r.n_found, r.expected, r.child_decimals) for r in out.collect()}
    assert lacking["rows"] == {("c", "b"), ("c", "x"), ("c", "y"), ("d", "a"), ("d", "b"), ("d", "x"), ("d", "y")}
    assert got == {("c", "skip_unit_mismatch", 3, 5.0, 1), ("d", "skip_incomplete", 1, 8.0, None)}


def test_signs_are_looked_up_within_a_context(spark):
    rows = [(1, "c", "a:X", "x", 1.0), (1, "c", "b:X", "x", 2.0), (1, "c", "a:Y", "y", 3.0), (2, "c", "a:X", "x", 4.0)]
    f = spark.createDataFrame(rows, "filing_id int, context_id string, concept string, concept_key string, value double")
    signs = spark.createDataFrame([(1, "c", "a:X", "x", "-", 2), (1, "c", "a:X", "x", "", 3), (1, "c", "z:X", "x", "", 1), (1, "d", "a:Y", "y", "-", 1)], "filing_id int, context_id string, concept string, concept_key string, sign string, sign_seq int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = facts.sign_corrected(f, signs)
        assert not [line for line in plan_of(out).splitlines() if "Exchange hashpartitioning" in line and "concept" in line]
        assert sorted((r.filing_id, r.concept, r.value) for r in out.collect()) == [(1, "a:X", -1.0), (1, "a:Y", 3.0), (1, "b:X", 2.0), (2, "a:X", 4.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df) -> list[str]:
    return [line for line in plan_of(df).splitlines() if "Exchange" in line and "ReusedExchange" not in line]


def dealt_once(spark, smallest, monkeypatch, name):
    """The query's rows are the same in more tasks, dealt out once: a task for each 1,000 of some 6,000 lines."""
    import __spark_entry__ as entry
    from auditloom.operators import lineage

    query = entry.queries()[name]
    rows = lambda df: sorted(map(str, df.collect()))
    plain = rows(query(spark, smallest))
    monkeypatch.setattr(lineage, "TASK_ROWS", 1000)
    out = query(spark, smallest)
    n = -(-spark.read.parquet(f"{smallest}/lineitem.parquet").count() // 1000)
    assert n > 4 and len(exchanges(out)) == 1 and "hashpartitioning(context_id" in exchanges(out)[0] and f", {n})" in exchanges(out)[0]
    assert rows(out) == plain


def test_duplicates_are_judged_where_lines_are_numbered(spark, smallest, monkeypatch):
    dealt_once(spark, smallest, monkeypatch, "dup_classify")


def test_inconsistent_duplicates_are_counted_where_lines_are_numbered(spark, smallest, monkeypatch):
    dealt_once(spark, smallest, monkeypatch, "dup_inconsistent_report")


def test_written_duplicates_are_judged_where_lines_are_numbered(spark, smallest, monkeypatch):
    dealt_once(spark, smallest, monkeypatch, "dup_written")


def without_broadcasts(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = make()
        return out, plan_of(out), [line for line in exchanges(out) if "hashpartitioning" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_meet_definitions_once(spark):
    from auditloom.operators import library

    f = spark.createDataFrame([("a:X",), ("b:X",), ("X",), ("a:Y",), ("a:Z:q",), (None,)], "concept string")
    d = spark.createDataFrame([("a:X", "Instant", None, 1), ("a:X", "duration", None, 2), ("X", "instant", "Debit", 3), ("a:Y", None, None, 4), ("Z", "instant", None, 5), (None, "instant", None, 6)], "name string, period_type string, balance string, def_seq int")
    out, plan, _ = without_broadcasts(spark, lambda: library.defined(f, d))
    assert plan.count("SortMergeJoin") == 1
    assert {(r.concept, r.known, r.period_type, r.balance) for r in out.collect()} == {("a:X", True, "duration", None), ("b:X", True, "instant", "debit"), ("X", True, "instant", "debit"), ("a:Y", True, None, None), ("a:Z:q", True, "instant", None), (None, False, None, None)}


def test_children_are_summed_in_the_row_of_their_total(spark):
    resolved = spark.createDataFrame([(1, "c", k, v, u, d, t) for k, v, u, d, t in [("a", 1.25, "USD", 2, None), ("b", 2.0, "EUR", None, None), ("x", None, "USD", 0, "inconsistent")]], "filing_id int, context_id string, concept string, selected_value double, unit string, decimals int, duplicate_type string")
    arcs = spark.createDataFrame([("r", "t", "a", 1.0, 0), ("r", "u", "a", -1.0, 0), ("r", "u", "b", None, 1), ("r", "v", "b", 1.0, 2), ("r", "v", "x", 1.0, 1)], "role string, parent string, child string, weight double, arc_seq int")
    parents = spark.createDataFrame([(1, "c", "r", p, 1.0, "USD", None, None) for p in "tuv"], "filing_id int, context_id string, role string, parent string, value double, unit string, decimals int, duplicate_type string")
    out = facts.bind(resolved, arcs, parents)
    assert "inline" not in plan_of(out)
    assert {(r.parent, r.status, r.n_children, r.n_found, r.expected, r.child_decimals) for r in out.collect()} == {("t", "bound", 1, 1, 1.25, 2), ("u", "skip_unit_mismatch", 2, 2, -1.25, 2), ("v", "skip_inconsistent_child", 2, 1, 2.0, None)}


def test_failed_checks_are_ranked_where_they_are_told_apart(spark, smallest):
    from auditloom import plans

    _, plan, _ = without_broadcasts(spark, lambda: plans.QUERIES["failed_top10"](spark, smallest))
    top = plan[: plan.index("Union")]
    assert top.count("Exchange hashpartitioning") == 1


def test_lacking_lines_and_lines_are_dealt_out_once(spark, smallest):
    from auditloom import plans

    _, _, dealt = without_broadcasts(spark, lambda: plans.QUERIES["binding_fallback"](spark, smallest))
    assert len(dealt) == 2


def test_contexts_of_a_common_concept_lie_in_several_tasks(spark):
    f = spark.range(1000).select(F.lit(1).alias("filing_id"), F.lit("A").alias("concept"), (F.col("id") % 500).alias("context_id"))
    out, _, _ = without_broadcasts(spark, lambda: facts.contexts_with(f, f.filter("context_id < 3")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = facts.contexts_with(f, f.filter("context_id < 3")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 500 == out.distinct().count()


def test_totals_meet_facts_where_these_are_numbered(spark, smallest):
    from auditloom import plans

    _, plan, dealt = without_broadcasts(spark, lambda: plans.QUERIES["mismatch_diagnosis"](spark, smallest))
    assert len([line for line in dealt if "context_id" in line]) == 2 and "inline" not in plan


def most_rows(spark, monkeypatch, make) -> int:
    """The most rows of a task of what make returns, in a session with more shuffle partitions than there are tasks of 1,000 lines."""
    from auditloom.operators import lineage

    monkeypatch.setattr(lineage, "TASK_ROWS", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return max(r["count"] for r in make().groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbered_lines_are_not_put_together_in_fewer_tasks(spark, smallest, monkeypatch):
    from auditloom.plans import proxies

    assert most_rows(spark, monkeypatch, lambda: proxies.numbered(spark, smallest)) < 1000


def test_totals_and_their_facts_are_not_put_together_in_fewer_tasks(spark, smallest, monkeypatch):
    from auditloom.plans import filings

    assert most_rows(spark, monkeypatch, lambda: filings._bound(spark, smallest)) < 1000
