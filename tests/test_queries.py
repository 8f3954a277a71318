"""Each registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sedimark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(int(x))
    return f"{float(x):.9g}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, DIR)
    rows = found.collect()
    columns = sorted(found.columns)
    assert len(set(columns)) == len(columns)
    if name not in registry.oracle_sql():
        return
    answer = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert sorted(tuple(value(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
