"""Every query outside the corpus operators runs on the smallest tables and agrees with its SQL where it has one."""

import os

import pytest

from oscillar.plans import queries as monitoring

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def canonical(frame):
    text = lambda v: "~" if v is None or str(v) in ("nan", "<NA>", "None", "NaT") else "%.6g" % v if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(monitoring.QUERIES))
def test_query(spark, sql, name):
    got = monitoring.QUERIES[name](spark, SF).toPandas()
    if name in monitoring.ORACLE_SQL:
        want = sql.execute(monitoring.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_entry_imports():
    import __spark_entry__

    assert set(monitoring.QUERIES) <= set(__spark_entry__.queries()) and set(monitoring.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
