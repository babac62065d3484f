"""Golden numbers and semantics of the reference's R tests (FIXTURES.md section 2)."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchscope.operators import comparisons as cmp
from benchscope.operators import consistency as cons
from benchscope.operators.guards import InsufficientDataError


@pytest.fixture(scope="module")
def metric_table(spark):
    rng = np.random.default_rng(123)
    rows = []
    for b, m, n, g, met, ts in itertools.product(["apptainer", "conda", "envmodules"], ["kmeans", "dbscan", "hdbscan"],
                                                  ["atom", "iris", "tetra"], ["fcps", "uci"], ["ari", "ami"],
                                                  ["202301010000", "202301020000"]):
        score = 0.75 if (g, n, m, met) == ("fcps", "iris", "kmeans", "ari") else float(rng.uniform(0.5, 1.0))
        rows.append((b, m, n, g, met, ts, score, float(rng.uniform(0.1, 5.0))))
    return spark.createDataFrame(rows, "backend string, method string, dataset_name string, dataset_generator string, "
                                       "metric string, run_timestamp string, score double, execution_time_seconds double")


def test_full_cross_product(metric_table):
    assert metric_table.count() == 216


def test_constant_group_is_consistent(metric_table):
    c = cons.score_consistency(metric_table).where(
        (F.col("dataset_generator") == "fcps") & (F.col("dataset_name") == "iris")
        & (F.col("method") == "kmeans") & (F.col("metric") == "ari")).first()
    assert c["is_consistent"] is True
    assert c["score_range"] == 0
    assert c["score_sd"] == 0
    assert c["n_repetitions"] == 2


def test_summary_one_row_per_backend(metric_table):
    s = cons.backend_consistency(metric_table).collect()
    assert sorted(r["backend"] for r in s) == ["apptainer", "conda", "envmodules"]
    assert all(r["total_combinations"] == 36 for r in s)


def test_golden_pair_means(spark):
    rows = []
    for t, s in zip([1, 2, 3, 4], [0.8, 0.9, 0.8, 0.9]):
        rows.append(("apptainer", "fcps", "iris", "kmeans", "ari", float(t), s))
    for t, s in zip([5, 6, 7, 8], [0.7, 0.8, 0.7, 0.8]):
        rows.append(("conda", "fcps", "iris", "kmeans", "ari", float(t), s))
    df = spark.createDataFrame(rows, "backend string, dataset_generator string, dataset_name string, method string, "
                                     "metric string, execution_time_seconds double, score double")
    t = cmp.backend_time_pairs(df).first()
    assert (t["backend1"], t["backend2"]) == ("apptainer", "conda")
    assert t["avg_execution_time_b1"] == pytest.approx(2.5)
    assert t["avg_execution_time_b2"] == pytest.approx(6.5)
    s = cmp.backend_score_pairs(df).first()
    assert s["avg_score_b1"] == pytest.approx(0.85)
    assert s["avg_score_b2"] == pytest.approx(0.75)


def test_backend_subset_and_single_backend_error(metric_table):
    pairs = cmp.backend_score_pairs(metric_table, backends=["apptainer", "conda"])
    assert {(r["backend1"], r["backend2"]) for r in pairs.select("backend1", "backend2").distinct().collect()} == {
        ("apptainer", "conda")}
    all_pairs = cmp.backend_pairs(metric_table).collect()
    assert len(all_pairs) == 3
    with pytest.raises(InsufficientDataError):
        cmp.backend_score_pairs(metric_table.where(F.col("backend") == "conda"))
    with pytest.raises(InsufficientDataError):
        cmp.backend_time_pairs(metric_table, backends=["conda"])
