"""Each query against its SQL in DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from auditloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smallest}/{t}.parquet')")
    return con


def shown(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, duck, smallest, name):
    df = plans.QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    assert rows
    if name in plans.ORACLE:
        found = duck.execute(plans.ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall()) == rows


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
