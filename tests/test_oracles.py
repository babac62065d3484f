"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
FAST = ["backend_consistency", "score_variability", "compare_backends", "combined_runs", "method_summary",
        "peak_rss_summary", "pareto_by_metric", "method_rankings", "top_methods_by_metric", "radar",
        "hist_rss", "box_seed", "glm_input", "build_metric_rows", "build_method_rows", "labels_true_k",
        "parse_scores", "metric_wide", "lm_models", "anova", "coef_effects", "residual_diagnostics"]
KEYS = sorted(ORACLES) if os.environ.get("BENCHSCOPE_ALL_ORACLES") else FAST


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["lineitem"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows):
    def key(t):
        return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0) for v in t)
    return sorted(rows, key=key)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF)
    cols = sorted(sdf.columns)
    got = _norm([tuple(r[c] for c in cols) for r in sdf.collect()])
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    exp = _norm([tuple(dict(zip(dcols, r))[c] for c in cols) for r in cur.fetchall()])
    assert len(got) == len(exp)
    assert got == exp
