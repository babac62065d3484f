"""Benchmark-shaped views derived from the driver's ``lineitem`` table.

The driver ships TPC-H-like tables, not benchmark run trees.  These views give
``lineitem`` the shape of the two benchmark tables (``metric_runs``,
``method_runs``) and of the raw files the ingest reads (``raw_scores``,
``raw_sidecars``), so every operator runs over the whole of ``lineitem`` and
its work grows with it.  The same definitions exist as SQL text in
``benchscope.plans.oracles`` for the DuckDB oracle; ``tests/test_views_entry.py``
checks that both produce the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchscope.operators.dedup import first_per_key
from benchscope.schema import METHOD_KEY

# Columns of lineitem the views use (everything else is pruned at the scan).
_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]

_ORDER_COLS = ["src_order", "src_line", "src_part", "src_qty"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _metric_runs(lineitem: DataFrame) -> DataFrame:
    li = lineitem.select(*_LINEITEM_COLS)
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    year = _s(F.year("l_shipdate"))
    flag = F.lower("l_returnflag")
    null_d = F.lit(None).cast("double")
    return li.select(
        F.concat(F.lit("out_"), flag, F.lit("-"), year).alias("source_dir"),
        flag.alias("backend"),
        year.alias("run_timestamp"),
        F.lower("l_linestatus").alias("dataset_generator"),
        F.concat(F.lit("d"), _s(s % 5)).alias("dataset_name"),
        (F.lit(2) + (s % 5) % 3).alias("true_k"),
        ((s % 5) == 4).alias("has_noise"),
        F.concat(F.lit("m"), _s(p % 8)).alias("method"),
        F.when(p % 8 < 2, F.lit(None).cast("bigint"))
         .otherwise(F.col("l_linenumber").cast("bigint")).alias("seed"),
        F.when(o % 4 == 0, "ami").when(o % 4 == 1, "ari").when(o % 4 == 2, "fm")
         .otherwise("nca").alias("metric"),
        F.when(o % 50 == 7, null_d)
         .when(p % 8 == 0, (F.lit(1) + s % 5).cast("double") / 8)
         .otherwise(F.col("l_quantity") / 64).alias("score"),
        F.when(o % 61 == 3, null_d)
         .otherwise((F.lit(1) + p % 199).cast("double") / 8).alias("execution_time_seconds"),
        F.when(o % 61 == 3, null_d)
         .otherwise(F.floor("l_extendedprice").cast("double") / 1024).alias("runtime"),
        (F.lit(1024) * (F.lit(1) + s % 50) + p % 1024).alias("peak_rss"),
        (o % 97 == 0).alias("duplicate_k_anomaly"),
        (o % 50 == 7).alias("empty_file"),
        (o % 89 == 1).alias("missing_true_k_score"),
        o.alias("src_order"), F.col("l_linenumber").alias("src_line"),
        p.alias("src_part"), F.col("l_quantity").alias("src_qty"),
    )


_METHOD_VIEW_COLS = ["source_dir", "backend", "run_timestamp", "dataset_generator",
                     "dataset_name", "true_k", "has_noise", "method", "seed",
                     "execution_time_seconds", "runtime", "peak_rss"]


def _method_runs(metric_runs: DataFrame) -> DataFrame:
    # First row per method key in source order: a skew-safe min-struct aggregate.
    return first_per_key(metric_runs, METHOD_KEY, _ORDER_COLS, _METHOD_VIEW_COLS)


def _raw_paths(metric_runs: DataFrame) -> DataFrame:
    run_path = F.concat(
        F.lit("/bench/"), _s(F.col("src_order")), F.lit("_"), _s(F.col("src_line")), F.lit("_"),
        _s(F.col("src_part")), F.lit("_"), _s(F.floor("src_qty").cast("bigint")),
        F.lit("/"), F.col("source_dir"))
    dataset_path = F.concat(run_path, F.lit("/data/dataset_generator-"), F.col("dataset_generator"),
                            F.lit("_dataset_name-"), F.col("dataset_name"))
    method_path = F.concat(
        dataset_path, F.lit("/clustering/method-"), F.col("method"),
        F.when(F.col("seed").isNull(), F.lit("")).otherwise(F.concat(F.lit("_seed-"), _s(F.col("seed")))))
    return metric_runs.select("*", run_path.alias("run_path"), dataset_path.alias("dataset_path"),
                              method_path.alias("method_path"))


def _num(c: Column) -> Column:
    """Decimal text of a double the way both engines print dyadic values."""
    return _s(c)


def _raw_scores(raw_paths: DataFrame) -> DataFrame:
    nl = F.lit("\n")
    score = _num(F.col("score"))
    content = (F.when(F.col("score").isNull(), F.lit(""))
               .when(F.col("duplicate_k_anomaly"),
                     F.concat(F.lit("k=2,k=3,k=3"), nl, F.lit("0.25,"), score, F.lit(",0.125"), nl))
               .otherwise(F.concat(F.lit('"k=2","k=3"'), nl, score,
                                   F.when(F.col("src_order") % 53 == 5, ",n/a").otherwise(",0.5"), nl)))
    path = F.concat(F.col("method_path"), F.lit("/metrics/partition_metrics/metric-"), F.col("metric"),
                    F.lit("/clustbench.scores.gz"))
    # some second cells are no numbers, for the error list
    return raw_paths.select(path.alias("path"), content.alias("content"))


def _raw_sidecars(raw_paths: DataFrame) -> DataFrame:
    """All sidecar texts of each synthetic run, generated from one pass over
    ``raw_paths`` (one explode instead of a union of five scans)."""
    nl, tab = F.lit("\n"), F.lit("\t")
    mp = F.col("method_path")
    perf = F.struct(
        F.concat(mp, F.lit("/perf.json")).alias("path"),
        F.concat(F.lit('{"max_threads": 4, "peak_mem_rss_kb": '), _s(F.col("peak_rss")),
                 F.when(F.col("runtime").isNull(), F.lit(""))
                  .otherwise(F.concat(F.lit(', "total_time_secs": '), _num(F.col("runtime")))),
                 F.lit("}")).alias("content"))
    timing = F.struct(
        F.concat(mp, F.lit("/clustbench_performance.txt")).alias("path"),
        F.concat(F.lit("usr"), tab, F.lit("s"), nl, F.lit("0"), tab,
                 F.when(F.col("execution_time_seconds").isNull(), F.lit("-"))
                  .otherwise(_num(F.col("execution_time_seconds"))), nl).alias("content"))
    metric_perf = F.struct(
        F.concat(mp, F.lit("/metrics/partition_metrics/metric-"), F.col("metric"),
                 F.lit("/perf.json")).alias("path"),
        F.concat(F.lit('{"total_time_secs": '), _s(F.col("src_line")), F.lit(".5}")).alias("content"))
    params = F.when(F.col("src_order") % 10 == 0, F.struct(
        F.concat(mp, F.lit("/parameters.json")).alias("path"),
        F.concat(F.lit('{"method": "alt-'), F.col("method"), F.lit('", "seed": '),
                 _s(F.col("src_line")), F.lit("}")).alias("content")))
    labels = F.struct(
        F.concat(F.col("dataset_path"), F.lit("/clustbench.labels0.gz")).alias("path"),
        F.concat(F.when(F.col("has_noise"), F.concat(F.lit("0"), nl)).otherwise(F.lit("")),
                 F.lit("1"), nl, F.lit("2.0"), nl,
                 # a few files hold a line that is no label: they count as invalid
                 F.when(F.col("src_order") % 71 == 9, F.concat(F.lit("unlabelled"), nl)).otherwise(F.lit("")),
                 F.when(F.col("true_k") >= 3, F.concat(F.lit("3"), nl)).otherwise(F.lit("")),
                 F.when(F.col("true_k") >= 4, F.concat(F.lit("4"), nl)).otherwise(F.lit(""))
                 ).alias("content"))
    files = raw_paths.select(F.explode(F.array(perf, timing, metric_perf, params, labels)).alias("f"))
    return files.where(F.col("f").isNotNull()).select("f.path", "f.content")


@dataclass(frozen=True)
class BenchViews:
    """The benchmark-shaped views of one scale-factor directory."""

    metric_runs: DataFrame
    method_runs: DataFrame
    raw_paths: DataFrame
    raw_scores: DataFrame
    raw_sidecars: DataFrame

    @property
    def metric(self) -> DataFrame:
        """The metric table: ``metric_runs`` without the helper ``src_*``
        columns and without the method-level execution time and memory, which
        the real metric table does not carry (they come from a join, E7)."""
        return self.metric_runs.drop(*_ORDER_COLS, "execution_time_seconds", "peak_rss")

    @property
    def method(self) -> DataFrame:
        return self.method_runs


def bench_views(spark: SparkSession, sf_dir: str) -> BenchViews:
    lineitem = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").select(*_LINEITEM_COLS)
    metric_runs = _metric_runs(lineitem)
    raw_paths = _raw_paths(metric_runs)
    return BenchViews(metric_runs=metric_runs, method_runs=_method_runs(metric_runs),
                      raw_paths=raw_paths, raw_scores=_raw_scores(raw_paths),
                      raw_sidecars=_raw_sidecars(raw_paths))


@dataclass(frozen=True)
class IngestInputs:
    scores: DataFrame       # path, root, content
    sidecars: DataFrame     # path, content
    label_lines: DataFrame  # path, line


def ingest_inputs(v: BenchViews) -> IngestInputs:
    """The raw views in the shape ``benchscope.operators.ingest`` reads.

    Every synthetic run tree lives under its own ``/bench/<id>`` root.
    """
    from benchscope.operators.ingest import LABELS_FILE_RE, label_lines_from_text
    raw_paths = v.raw_paths
    scores = _raw_scores(raw_paths)
    scores = scores.select("path", F.regexp_extract("path", r"^(/bench/[^/]+)", 1).alias("root"), "content")
    sidecars = _raw_sidecars(raw_paths)
    name = F.substring_index(F.col("path"), "/", -1)
    is_labels = name.rlike(LABELS_FILE_RE)
    return IngestInputs(scores=scores, sidecars=sidecars.where(~is_labels),
                        label_lines=label_lines_from_text(sidecars.where(is_labels)))
