"""The Spark views equal their SQL definition; the driver contract works."""

import duckdb
import pytest

import __spark_entry__ as entry
from benchscope.plans.oracles import full_sql

SF = "/root/testdata/sf0.001"


def _duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    return con


@pytest.mark.parametrize("view", ["metric_runs", "method_runs", "raw_scores", "raw_sidecars"])
def test_views_equal_sql(views, view):
    sdf = getattr(views, view)
    cols = sdf.columns
    def key(t):
        return tuple((v is None, v if v is not None else 0) for v in t)
    got = sorted((tuple(r) for r in sdf.select(*cols).collect()), key=key)
    exp = sorted((tuple(r) for r in _duck().execute(full_sql(f"SELECT {', '.join(cols)} FROM {view}")).fetchall()),
                 key=key)
    assert len(got) == len(exp)
    assert got == exp


def test_entry_and_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["backend", "total_combinations", "consistent_combinations", "percent_consistent",
                          "avg_score_range", "max_score_range"]
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 120
