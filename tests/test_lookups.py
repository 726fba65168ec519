"""Lookups and closures on small tables."""

from auditloom.operators import lookups


def test_a_closure_ends_in_cycles_and_keeps_the_least_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), ("c", "d"), ("c", "d")], "source string, target string")
    starts = spark.createDataFrame([("a",), ("a",)], "name string")
    assert sorted(map(tuple, lookups.closure(starts, edges).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert lookups.closure(starts.limit(0), edges).count() == 0
    assert [tuple(r) for r in lookups.closure(starts, edges.limit(0)).collect()] == [("a", 0)]


def test_definitions_of_schemas_come_first(spark):
    roles = spark.createDataFrame([("r",), ("s",), ("t",)], "role string")
    schema = spark.createDataFrame([("r", "second", 2), ("r", "first", 1)], "role string, definition string, seq int")
    linkbase = spark.createDataFrame([("r", "other", 0), ("s", "own", 5)], "role string, definition string, seq int")
    assert sorted(map(tuple, lookups.role_definitions(roles, schema, linkbase).collect())) == [("r", "first"), ("s", "own"), ("t", None)]


def test_a_diagnosis_of_nothing_is_one_row_of_zeros(spark):
    facts = spark.createDataFrame([], "filing_id int, context_id string, concept string")
    assert [tuple(r)[:5] for r in lookups.group_diagnosis(facts).collect()] == [(0, 0, 0, 0, 0)]


def test_errors_by_type_and_folder(spark):
    rows = spark.createDataFrame([("syntax", "a/b/x.xml"), ("syntax", "a/y.xml"), (None, "a/z.xml"), ("schema", "top.xml")], "error_type string, path string")
    got = {(r.facet, r.name): r.n for r in lookups.error_statistics(rows, rows.path).collect()}
    assert got == {("type", "syntax"): 2, ("type", "schema"): 1, ("folder", "a/b"): 1, ("folder", "a"): 1, ("folder", ""): 1}
