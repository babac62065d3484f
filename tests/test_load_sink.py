"""Sinks, output naming and the loader."""

import os
import time

import pytest
from pyspark.sql import functions as F

from benchscope.operators import ingest as ing
from benchscope.sources import load, sink
from benchscope.sources.runtree import read_run_tree
from treebuilder import integration_tree


def test_output_base_name():
    assert sink.output_base_name(["out-conda_1"], ["conda"], ["1"]) == "out-conda_1_conda_1"
    assert sink.output_base_name(["runs"], [], [], clock=lambda: "202401010000") == "runs_202401010000"
    assert sink.output_base_name(["a", "b"], ["x", "y"], [], clock=lambda: "T") == "multi_2_dirs_x_y_T"
    assert sink.output_base_name(["a", "b"], ["w", "x", "y", "z"], [], clock=lambda: "T") == "multi_2_dirs_4_backends_T"


def test_write_and_load_roundtrip(spark, tmp_path):
    integration_tree(str(tmp_path / "tree"))
    t = read_run_tree(spark, [str(tmp_path / "tree")])
    res = ing.ingest(t.scores, t.sidecars, t.label_lines)
    backends, stamps = sink.run_levels(res.metric)
    assert (backends, stamps) == (["conda"], ["202411051730"])
    base = sink.output_base_name(["tree"], backends, stamps)
    out = str(tmp_path / "out")
    written = sink.write_tables(res.method, res.metric.drop("path"), out, base, fmt="both")
    assert set(written) == {"method-performance.csv", "metric-performance.csv",
                            "method-performance.parquet", "metric-performance.parquet"}
    wide = spark.read.option("header", "true").csv(written["metric-performance.csv"])
    assert [c for c in wide.columns if c.startswith("k=")] == ["k=2", "k=3", "k=4", "k=5"]
    assert wide.count() == 36
    method, metric = load.load_both(spark, out)
    assert method.count() == 12 and metric.count() == 36
    assert dict(metric.dtypes)["empty_file"] == "boolean"
    assert load.load_any(spark, written["method-performance.parquet"]).count() == 12
    assert load.load_any(spark, out).count() == 36


def test_newest_pair_wins(spark, tmp_path):
    d = tmp_path / "outputs"
    for i, name in enumerate(["old", "new"]):
        for kind in ("method", "metric"):
            spark.createDataFrame([(name, 1.0)], "backend string, score double").write.parquet(
                str(d / f"{kind}-performance_{name}.parquet"))
        if i == 0:
            time.sleep(1.1)
    paths = load.find_latest_pair(spark, str(d))
    assert paths["method"].endswith("method-performance_new.parquet")
    assert load.load_metric(spark, paths["metric"]).first()["backend"] == "new"


def test_loader_errors(spark, tmp_path):
    with pytest.raises(load.DataNotFoundError):
        load.find_latest_pair(spark, str(tmp_path / "missing"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(load.DataNotFoundError):
        load.find_latest_pair(spark, str(tmp_path / "empty"))
    with pytest.raises(load.DataNotFoundError):
        load.load_any(spark, str(tmp_path / "missing"))


def test_loader_table_casts(spark, tmp_path):
    rows = [("apptainer", "fcps", "atom", "kmeans", "ari", "202301010000", 0.8, 1.5),
            ("conda", "uci", "iris", "dbscan", "ami", "202301020000", float("nan"), 2.5),
            ("envmodules", "fcps", "tetra", "hdbscan", "nmi", "202301030000", 0.7, 3.5)]
    p = str(tmp_path / "metric-performance_x.parquet")
    spark.createDataFrame(rows, "backend string, dataset_generator string, dataset_name string, method string, "
                                "metric string, run_timestamp string, score double, execution_time_seconds double"
                          ).write.parquet(p)
    df = load.load_metric(spark, p)
    assert df.count() == 3
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in ["backend", "dataset_generator", "dataset_name",
                                                              "method", "metric", "run_timestamp"]]).first()
    assert tuple(counts) == (3, 2, 3, 3, 3, 3)
    assert df.where(F.col("score").isNull()).count() == 1     # NaN -> NULL at load
