"""Networks of calculations and dimensions on small graphs, against brute force."""

import itertools
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from auditloom.functions import periods
from auditloom.operators import cubes, dag, facts, hierarchy, lattice

ARCS = "filing_id int, role string, parent string, child string, `order` double, weight double, arc_seq int"


def random_arcs(rng, n, acyclic):
    names = [f"c{i}" for i in range(n)]
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)}
    return [(1, "r", names[a], names[b], float(rng.randint(0, 3)), rng.choice([1.0, -1.0]), k) for k, (a, b) in enumerate(sorted(pairs)) if (a < b if acyclic else a != b)]


def longest(arcs, up):
    """Most arcs below (or above) each concept, None where a cycle lies on the way."""
    below = {}
    for _, _, p, c, *_ in arcs:
        below.setdefault(p if up else c, set()).add(c if up else p)
    concepts = {x for a in arcs for x in a[2:4]}

    def level(x, seen=()):
        if x in seen:
            return None
        deeper = [level(y, (*seen, x)) for y in below.get(x, ())]
        return None if None in deeper else 1 + max(deeper, default=-1)

    return {x: level(x) for x in concepts}


@pytest.mark.parametrize("seed", range(4))
def test_levels_equal_longest_paths(spark, seed):
    arcs = random_arcs(random.Random(seed), 9, seed % 2 == 0)
    df = spark.createDataFrame(arcs, ARCS)
    for up in (True, False):
        assert {r.concept: r.level for r in hierarchy.levels(df, up).collect()} == longest(arcs, up)


@pytest.mark.parametrize("seed", range(3))
def test_first_places_equal_those_of_all_paths(spark, seed):
    arcs = spark.createDataFrame(random_arcs(random.Random(seed), 7, seed % 2 == 0), ARCS)
    want = {(r.concept, tuple(r.path), r.level, r.weight) for r in hierarchy.first_placements(hierarchy.walk(arcs)).collect()}
    assert {(r.concept, tuple(r.path), r.level, r.weight) for r in hierarchy.first_places(arcs).collect()} == want


def diamonds(n):
    out = []
    for i in range(n):
        out += [(1, "r", f"n{i}", f"a{i}", 1.0, 1.0, 4 * i), (1, "r", f"n{i}", f"b{i}", 2.0, 1.0, 4 * i + 1), (1, "r", f"a{i}", f"n{i + 1}", 1.0, 1.0, 4 * i + 2), (1, "r", f"b{i}", f"n{i + 1}", 1.0, 0.5, 4 * i + 3)]
    return out


def test_stacked_diamonds_cost_as_much_as_their_arcs(spark):
    """A million paths lead through twenty diamonds; concepts are there once, level by level."""
    arcs = spark.createDataFrame(diamonds(20), ARCS)
    assert hierarchy.first_places(arcs).count() == 61
    few = spark.createDataFrame(diamonds(5), ARCS)
    assert hierarchy.depths(few).collect()[0][2:] == (11, 16, 1)
    reported = spark.createDataFrame([(1, "c", "n5", 64.0, None), (1, "c", "n0", 64.0 * 1.5**5, None)], "filing_id int, context_id string, concept string, value double, decimals int")
    out = {r.concept: r for r in dag.rollup_dag(few, reported).collect()}
    assert len(out) == 15 and out["n0"].passed and out["n0"].level == 10 and out["a0"].status == "computed"


def brute_rollup(arcs, values, least=0.5):
    children = {}
    for _, _, p, c, _, w, _ in arcs:
        children.setdefault(p, {})[c] = w
    level = longest(arcs, True)

    @cache
    def value(x):
        own = values.get(x)
        if x not in children or level[x] is None:
            return own if x not in children else None
        found = {c: value(c) for c in children[x]}
        found = {c: v for c, v in found.items() if v is not None}
        s = sum(children[x][c] * v for c, v in found.items()) if found and len(found) >= least * len(children[x]) else None
        results[x] = (level[x], len(found), s, own)
        return own if s is None else s

    results = {}
    for x in sorted(children):
        if level[x] is None:
            results[x] = (None, 0, None, values.get(x))
        else:
            value(x)
    return {x: r for x, r in results.items() if r[2] is not None or r[3] is not None}


@pytest.mark.parametrize("seed", range(3))
def test_roll_up_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    arcs = random_arcs(rng, 10, seed < 2)
    values = {f"c{i}": float(rng.randint(-50, 50)) for i in range(10) if rng.random() < 0.7}
    df = spark.createDataFrame([(1, "x", c, v, None) for c, v in values.items()] + [(2, "x", "c0", 1.0, None)], "filing_id int, context_id string, concept string, value double, decimals int")
    got = {r.concept: (r.level, r.n_found, r.computed, r.reported) for r in dag.rollup_dag(spark.createDataFrame(arcs, ARCS), df).collect() if r.context_id == "x"}
    assert got == brute_rollup(arcs, values)


def test_roll_up_statuses(spark):
    arcs = [("T", "a", 1.0), ("T", "b", -1.0), ("U", "T", 1.0), ("U", "q", 1.0), ("V", "q", 1.0), ("V", "s", 1.0), ("V", "t", 1.0), ("X", "Y", 1.0), ("Y", "X", 1.0), ("Z", "X", 1.0)]
    df = spark.createDataFrame([(1, "r", p, c, 0.0, w, k) for k, (p, c, w) in enumerate(arcs)], ARCS)
    rows = [("a", 10.0, 0), ("b", 4.0, 0), ("T", 6.4, 0), ("q", 5.0, None), ("V", 1.0, None), ("X", 1.0, None), ("Z", 2.0, None)]
    reported = spark.createDataFrame([(1, "c", n, v, d) for n, v, d in rows], "filing_id int, context_id string, concept string, value double, decimals int")
    out = {r.concept: (r.status, r.computed, r.passed) for r in dag.rollup_dag(df, reported).collect()}
    assert out == {"T": ("checked", 6.0, True), "U": ("computed", 11.0, None), "V": ("incomplete", None, None), "X": ("circular", None, None), "Z": ("circular", None, None)}
    assert dag.rollup_dag(df.limit(0), reported).count() == 0 and dag.rollup_dag(df, reported.limit(0)).count() == 0


def test_calculation_trees_and_registry(spark):
    arcs = [("A", "B", 1.0), ("A", "C", 1.0), ("B", "D", 1.0), ("C", "D", 1.0)]
    df = spark.createDataFrame([(1, "r", p, c, 0.0, w, k) for k, (p, c, w) in enumerate(arcs)], ARCS)
    assert {(r.concept, r.level, r.n_children, r.n_below, r.is_top) for r in dag.calculation_trees(df).collect()} == {("A", 2, 2, 3, True), ("B", 1, 1, 1, False), ("C", 1, 1, 1, False)}
    (row,) = dag.registry_summary(df, df.filter("parent <> 'C'").withColumn("weight", F.when(F.col("parent") == "B", -1.0).otherwise(1.0))).collect()
    assert tuple(row) == (3, 3, 2, 2, 3, 1, 2)


# --- sets of members -------------------------------------------------------------------------------------


def test_sets_within_sets_equal_brute_force(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample("abcdef", rng.randint(0, 4))) for _ in range(30)]
    small = spark.createDataFrame([(k % 2, k, s) for k, s in enumerate(sets)], "g int, i int, members array<string>")
    large = small.withColumnRenamed("i", "j")
    got = {(r.i, r.j) for r in lattice.within_sets(small, large, ["g"]).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.product(enumerate(sets), repeat=2) if i % 2 == j % 2 and set(a) <= set(b)}


def test_a_slice_takes_from_the_narrowest_slice_around_it(spark):
    contexts = spark.createDataFrame([(1, "plain", "y", {}), (1, "seg", "y", {"S": "a"}), (1, "both", "y", {"S": "a", "G": "b"}), (1, "other", "y", {"S": "z"}), (1, "old", "x", {})], "filing_id int, context_id string, period_key string, dims map<string,string>")
    f = spark.createDataFrame([(1, "plain", "A", 1.0, "USD", 1), (1, "seg", "A", 2.0, "USD", 2), (1, "other", "A", 3.0, "USD", 0), (1, "plain", "B", 4.0, "EUR", 1), (1, "old", "C", 5.0, None, 1), (1, "plain", "D", 6.0, None, 1)], "filing_id int, context_id string, concept string, value double, unit string, fact_seq int")
    lacking = [(1, c, "y", "USD", x) for c in ("plain", "seg", "both") for x in "ABCD"]
    out = lattice.generalised_children(spark.createDataFrame(lacking, "filing_id int, context_id string, period_key string, unit string, child string"), f, contexts).collect()
    assert {(r.context_id, r.child, r.source_context, r.child_value, r.n_members) for r in out} == {("both", "A", "seg", 2.0, 1), ("seg", "A", "plain", 1.0, 0), ("both", "D", "plain", 6.0, 0), ("seg", "D", "plain", 6.0, 0)}


def test_periods_match_exactly_where_keys_do(spark):
    ids = ["Duration_1_1_2024_To_12_31_2024", "duration_2024-01-01_to_2024-12-31", "AsOf_12_31_2024", "instant_2023-06-30", "from_x", "duration_y", "at_nothing", "ctx2024q1", "c1", "", "period_12_1_2023_to_1_31_2024"]
    df = spark.createDataFrame([(i,) for i in ids], "a string")
    pairs = df.crossJoin(df.withColumnRenamed("a", "b"))
    a, b = periods.period(F.col("a")), periods.period(F.col("b"))
    rows = pairs.select("a", "b", F.coalesce(periods.periods_match(a, b), F.lit(False)).alias("want"), F.coalesce(periods.match_key(a) == periods.match_key(b), F.lit(False)).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == [] and sum(r.want for r in rows) > len(ids)


def test_the_fallback_follows_years(spark):
    ids = {"Duration_1_1_2024_To_12_31_2024": 1, "AsOf_12_31_2024": 2, "AsOf_12_31_2023": 3}
    f = spark.createDataFrame([(1, c, "Cash", float(k), "USD", k, False) for c, k in ids.items()], "filing_id int, context_id string, concept string, value double, unit string, fact_seq int, dimensional boolean").withColumn("period_key", periods.match_key(periods.period(F.col("context_id"))))
    missing = spark.createDataFrame([(1, "Duration_4_1_2024_To_6_30_2024", "USD", "Cash"), (1, "AsOf_1_1_2023", None, "Cash"), (1, "AsOf_1_1_1999", None, "Cash")], "filing_id int, context_id string, unit string, child string").withColumn("period_key", periods.match_key(periods.period(F.col("context_id"))))
    out = facts.fallback_children(missing, f).collect()
    assert {(r.context_id, r.child_value) for r in out} == {("Duration_4_1_2024_To_6_30_2024", 1.0), ("AsOf_1_1_2023", 3.0)}


# --- hypercubes ------------------------------------------------------------------------------------------


def brute_validity(concept, dims, arcs):
    roles = {a[0] for a in arcs}
    covered, valid, excluded = False, False, False
    for role in roles:
        own = [a for a in arcs if a[0] == role]

        def below(x, own=own):
            out, todo = set(), [x]
            while todo:
                y = todo.pop()
                if y not in out:
                    out.add(y)
                    todo += [c for _, k, p, c, _ in own if k == "domain-member" and p == y]
            return out

        right, out, any_ = True, False, False
        for _, kind, p, cube, closed in own:
            if kind not in ("all", "notAll") or concept not in below(p):
                continue
            any_ = True
            cube_dims = {c for _, k, q, c, _ in own if k == "hypercube-dimension" and q == cube}
            fits = not closed or set(dims) <= cube_dims
            for d in cube_dims:
                default = {c for _, k, q, c, _ in own if k == "dimension-default" and q == d}
                members = set().union(*[below(c) for _, k, q, c, _ in own if k == "dimension-domain" and q == d]) - default
                fits &= dims[d] in members if d in dims else bool(default)
            if kind == "all":
                right &= fits
            else:
                out |= fits
        covered |= any_
        valid |= any_ and right and not out
        excluded |= any_ and right and out
    return "valid" if valid else "excluded" if excluded else "invalid" if covered else "uncovered"


def test_validity_equals_brute_force(spark):
    arcs = [("r", "all", "Items", "C1", False), ("r", "domain-member", "Items", "A", None), ("r", "domain-member", "A", "B", None), ("r", "hypercube-dimension", "C1", "D", None), ("r", "hypercube-dimension", "C1", "E", None)]
    arcs += [("r", "dimension-domain", "D", "Top", None), ("r", "domain-member", "Top", "d1", None), ("r", "domain-member", "d1", "d2", None), ("r", "domain-member", "d2", "Top", None), ("r", "dimension-domain", "E", "e0", None), ("r", "dimension-default", "E", "e0", None), ("r", "domain-member", "e0", "e1", None)]
    arcs += [("r", "notAll", "A", "C2", False), ("r", "hypercube-dimension", "C2", "D2", None), ("r", "dimension-domain", "D2", "n1", None), ("s", "all", "B", "C3", False), ("s", "hypercube-dimension", "C3", "D", None), ("s", "dimension-domain", "D", "d9", None), ("s", "all", "Z", "C4", True)]
    options = {"D": [None, "Top", "d2", "d9", "zz"], "E": [None, "e0", "e1"], "D2": [None, "n1"], "F": [None, "f"]}
    rows = [(1, concept, {k: v for k, v in zip(options, vs, strict=True) if v}) for concept in ("Items", "A", "B", "Z", "Q") for vs in itertools.product(*options.values())]
    df = spark.createDataFrame(rows + rows[:5], "filing_id int, concept string, dims map<string,string>")
    adf = spark.createDataFrame(arcs, "role string, arcrole string, parent string, child string, closed boolean")
    got = {(r.concept, r.dims): r.status for r in cubes.dimensional_validity(df, adf).collect()}
    want = {(c, ";".join(f"{k}={dims[k]}" for k in sorted(dims))): brute_validity(c, dims, arcs) for _, c, dims in rows}
    assert set(want.values()) == {"valid", "excluded", "invalid", "uncovered"}
    assert got == want
    assert cubes.dimensional_validity(df.limit(0), adf).count() == 0
    assert {r.status for r in cubes.dimensional_validity(df, adf.limit(0)).collect()} == {"uncovered"}
