"""Every registered query against its DuckDB oracle at sf0.001 (the driver does sf0.01)."""

import pytest

from fleetlens.catalog import load_all
from tools.oracle_check import digest

REG = load_all()
WITH_ORACLE = sorted(n for n, e in REG.items() if e.oracle)
ROWS_ONLY = sorted(n for n, e in REG.items() if not e.oracle)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_matches_oracle(spark, duck, name):
    e = REG[name]
    df = e.build(spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(e.oracle)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = REG[name].build(spark, SF)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
