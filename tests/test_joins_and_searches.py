"""Joins on ranges and parts of texts against all pairs, and search responses, on small inputs."""

import datetime as dt
import json
import random

import pytest

from auditloom.operators import joins
from auditloom.sources import searches

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("width", [1, 7, 400])
def test_range_join_equals_all_pairs(spark, width):
    rng = random.Random(3)
    points = [(i, rng.randrange(3), rng.choice([None, *range(-200, 200)])) for i in range(120)]
    spans = [(i, rng.randrange(3), s, rng.choice([None, s, s - 1, s + rng.randrange(90)])) for i in range(80) for s in [rng.randrange(-200, 200)]]
    a = spark.createDataFrame([(i, o, day(x)) for i, o, x in points], "a long, owner long, at date")
    b = spark.createDataFrame([(i, o, day(s), day(e)) for i, o, s, e in spans], "b long, owner long, start date, end date")
    found = sorted((r.a, r.b) for r in joins.within(a, b, ["owner"], "at", "start", "end", width).collect())
    assert found == sorted((i, j) for i, o, x in points for j, p, s, e in spans if o == p and x is not None and e is not None and s <= x <= e)
    assert found


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(2), rng.choice([None, *range(-60, 60)])) for i in range(90)]
    a = spark.createDataFrame([(i, o, day(x)) for i, o, x in rows], "a long, owner long, at date")
    b = a.toDF("b", "owner", "other")
    found = sorted((r.a, r.b) for r in joins.near(a, b, ["owner"], "at", "other", 4).collect())
    assert found == sorted((i, j) for i, o, x in rows for j, p, y in rows if o == p and None not in (x, y) and abs(x - y) <= 4)


@pytest.mark.parametrize("piece", [1, 3])
def test_first_name_that_holds_a_text(spark, piece):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    names = [(rng.randrange(2), i, word(rng.randrange(9))) for i in range(60)] + [(0, 99, None), (0, 100, "é.b"), (0, 101, "é.b")]
    texts = [(rng.randrange(2), word(rng.randrange(8))) for _ in range(80)] + [(0, None), (0, ""), (0, "é.b"), (0, "é."), (0, "zz zz"), (1, names[0][2])]
    df = joins.first_holding(spark.createDataFrame(texts, "c long, text string"), spark.createDataFrame(names, "c long, id long, name string"), ["c"], piece)
    want = {}
    for c, t in texts:
        held = [(n != t, i) for d, i, n in names if t and n is not None and c == d and t in n]
        if held:
            want[c, t] = min(held)[1]
    assert {(r.c, r.text): r.id for r in df.collect()} == want
    assert df.count() == len(want) > 20


def test_nothing_to_look_up_in(spark):
    texts, names = spark.createDataFrame([(1, "ab")], "c long, text string"), spark.createDataFrame([], "c long, id long, name string")
    assert joins.first_holding(texts, names, ["c"]).count() == joins.first_holding(texts.limit(0), names, ["c"]).count() == 0


def test_filings_of_a_response_with_its_entities(spark):
    item = lambda i, e: {"id": i, "type": "filing", "attributes": {"fxo_id": f"x{i}", "error_count": 2}, "relationships": {"entity": {"data": {"id": e, "type": "entity"}}}}
    body = {
        "data": [item("1", "e1"), item("2", "e9"), {"id": "3", "type": "filing"}, {}],
        "included": [{"id": "e1", "type": "entity", "attributes": {"name": "Old"}}, {"id": "e1", "type": "entity", "attributes": {"name": "Acme", "lei": "L"}}, {"id": "e9", "type": "other", "attributes": {"name": "No"}}],
        "meta": {"total_count": 4},
    }
    df = spark.createDataFrame([(json.dumps(body),), ("{}",), ("no response",), (None,)], "body string")
    rows = [(r.filing_id, r.fxo_id, r.error_count, r.entity_id, r.entity_name, r.entity_lei) for r in searches.european_filings(df).collect()]
    assert rows == [("1", "x1", "2", "e1", "Acme", "L"), ("2", "x2", "2", "e9", None, None), ("3", None, None, None, None, None)]
    assert tuple(searches.pages(df).first()) == (4, 0, 1, 25)
    assert [tuple(r) for r in searches.pages(df).collect()[1:]] == [(0, 0, 1, 25)] * 3


def test_recent_filings_stop_at_the_most_and_the_shortest_list(spark):
    recent = {"accessionNumber": list("abcdef"), "filingDate": ["2020-01-01", "2020-02-01", "2019-01-01", "2020-03-01", "2020-04-01"], "form": ["10-K", "8-K", "10-K", "10-K", "10-K", "10-K"]}
    df = spark.createDataFrame([("1", json.dumps({"filings": {"recent": recent}})), ("2", "{}"), ("3", None)], "cik string, body string")
    found = lambda **k: [(r.cik, r.place, r.accession) for r in searches.recent_filings(df, "10-K", **k).collect()]
    assert found(most=9) == [("1", 0, "a"), ("1", 1, "c"), ("1", 2, "d"), ("1", 3, "e")]
    assert found(most=2, start="2020-01-01") == [("1", 0, "a"), ("1", 1, "d")]
    assert found(most=9, end="2019-12-31") == [("1", 0, "c")]
