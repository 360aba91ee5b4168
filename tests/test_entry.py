"""Every core query against its SQL on the smallest tables, where they are there."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(rows):
    def cell(v):
        return "~" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[c]) for c in sorted(r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _plain([r.asDict() for r in got.collect()]) == _plain([dict(zip(names, r)) for r in want.fetchall()])


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
