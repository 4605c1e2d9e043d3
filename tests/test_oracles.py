"""Every scorer query against its SQL on the same tables, as the driver does it."""

import duckdb
import pytest

from evalgrid.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    # By key first: values that two engines may write otherwise, like zeros of either sign, come after all others.
    return sorted([tuple(v[i] for i in order) for v in values], key=lambda r: (str([x for x in r if not isinstance(x, float)]), [x for x in r if isinstance(x, float)]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    want = rows(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-12, abs=1e-9) if isinstance(x, float) else x == y


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
