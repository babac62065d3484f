"""Summary tables of the report and the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.functions.columns import count_true, dataset_key, n_distinct
from benchscope.operators.ordered import _join_on, distribution, medians
from benchscope.schema import DM, QUALITY_FLAGS


def method_summary(method: DataFrame, backend: str = "backend") -> DataFrame:
    """per backend, runs, datasets, methods and mean/median of the
    execution time and of the profiler runtime."""
    agg = method.groupBy(backend).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_runs"),
        n_distinct("dataset_generator", "dataset_name").alias("datasets"),
        n_distinct("method").alias("methods"),
        F.avg("execution_time_seconds").alias("avg_execution_time"),
        F.avg("runtime").alias("avg_runtime"))
    return medians(agg, method, [backend], {"med_execution_time": "execution_time_seconds",
                                            "med_runtime": "runtime"}).orderBy(backend)


def metric_summary(metric: DataFrame) -> DataFrame:
    """per backend x metric, evaluations and mean/median/min/max score."""
    keys = ["backend", "metric"]
    return distribution(metric, keys, "score").select(
        *keys, F.col("rows").alias("total_evaluations"), F.col("mean").alias("avg_score"),
        F.col("min").alias("min_score"), F.col("max").alias("max_score"),
        F.col("q")[0].alias("med_score")).orderBy(*keys)


def runtime_summary(df: DataFrame, backend: str = "backend", value: str = "runtime") -> DataFrame:
    """runtime statistics per backend over rows with a runtime."""
    present = df.where(F.col(value).isNotNull())
    return distribution(present, [backend], value).select(
        backend, F.col("rows").alias("count"), F.col("mean").alias("mean_runtime"), F.col("sd").alias("sd_runtime"),
        F.col("min").alias("min_runtime"), F.col("max").alias("max_runtime"),
        F.col("q")[0].alias("median_runtime")).orderBy(backend)


def peak_rss_range(method: DataFrame) -> DataFrame:
    """how many runs report peak RSS, and its range (KB)."""
    return method.agg(F.count("peak_rss").cast("bigint").alias("n_with_peak_rss"),
                      F.min("peak_rss").alias("min_peak_rss"),
                      F.max("peak_rss").alias("max_peak_rss"))


def top_by_count(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``count(keys, sort = TRUE) %>% slice_head(n)`` (ties by key)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n))


def peak_rss_data(method: DataFrame, top_datasets: int = 8, top_methods: int = 8) -> DataFrame:
    """Runs with peak RSS of the most frequent datasets and methods, with
    ``dataset`` and ``peak_rss_mb`` added (input of F15, F16, N3)."""
    ds = top_by_count(method, ["dataset_generator", "dataset_name"], top_datasets)
    ms = top_by_count(method, ["method"], top_methods)
    rows = (method.where(F.col("peak_rss").isNotNull())
            .join(F.broadcast(ds.select("dataset_generator", "dataset_name")),
                  ["dataset_generator", "dataset_name"], "left_semi")
            .join(F.broadcast(ms.select("method")), ["method"], "left_semi"))
    return rows.withColumn("dataset", dataset_key("_")).withColumn(
        "peak_rss_mb", F.col("peak_rss") / 1024.0)


def peak_rss_summary(method: DataFrame, n: int | None = 10) -> DataFrame:
    """per dataset x method of the top datasets/methods, count and
    mean/median/max peak RSS in MB; highest mean first."""
    data = peak_rss_data(method)
    out = distribution(data, ["dataset", "method"], "peak_rss_mb").select(
        "dataset", "method", F.col("rows").alias("count"), F.col("mean").alias("mean_rss_mb"),
        F.col("max").alias("max_rss_mb"), F.col("q")[0].alias("median_rss_mb"))
    out = out.orderBy(F.col("mean_rss_mb").desc_nulls_last(), "dataset", "method")
    return out.limit(n) if n else out


def peak_rss_heatmap(method: DataFrame) -> DataFrame:
    """F16: mean peak RSS (MB) per dataset x method of the top sets."""
    return peak_rss_data(method).groupBy("dataset", "method").agg(
        F.avg("peak_rss_mb").alias("mean_rss_mb"))


def runtime_memory_points(method: DataFrame) -> DataFrame:
    """mean runtime and mean peak RSS (MB) per method x dataset."""
    return (method.where(F.col("runtime").isNotNull() & F.col("peak_rss").isNotNull())
            .groupBy("method", "dataset_generator", "dataset_name")
            .agg(F.avg("runtime").alias("avg_runtime"),
                 F.avg(F.col("peak_rss") / 1024.0).alias("avg_peak_rss_mb")))


def largest_dataset(method: DataFrame) -> DataFrame:
    """the dataset with the highest mean peak RSS (KB) among runs with
    runtime and memory, with its run count and mean runtime."""
    return (method.where(F.col("runtime").isNotNull() & F.col("peak_rss").isNotNull())
            .groupBy("dataset_generator", "dataset_name")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_runs"),
                 F.avg("runtime").alias("avg_runtime"),
                 F.avg("peak_rss").alias("avg_memory"))
            .orderBy(F.col("avg_memory").desc_nulls_last(), "dataset_generator", "dataset_name")
            .limit(1))


def largest_dataset_runs(method: DataFrame) -> DataFrame:
    """Runs of the largest dataset (input of its own runtime-memory frontier)."""
    top = largest_dataset(method).select("dataset_generator", "dataset_name")
    return method.join(F.broadcast(top), ["dataset_generator", "dataset_name"], "left_semi")


def quality_summary(metric: DataFrame) -> DataFrame:
    """totals of the three quality flags and their shares (percent)."""
    total = F.count(F.lit(1))
    names = {"empty_file": "empty_files", "duplicate_k_anomaly": "duplicate_k_anomalies",
             "missing_true_k_score": "missing_true_k_scores"}
    cols = [total.cast("bigint").alias("total_records")]
    for flag, name in names.items():
        cols.append(count_true(flag).alias(name))
        cols.append(F.round(F.lit(100.0) * count_true(flag) / total, 2).alias(f"pct_{name}"))
    return metric.agg(*cols)


def quality_by_method(metric: DataFrame) -> DataFrame:
    """flag counts per backend x method, only groups with an issue,
    most issues first."""
    out = metric.groupBy("backend", "method").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        count_true("empty_file").alias("empty_files"),
        count_true("duplicate_k_anomaly").alias("duplicate_k"),
        count_true("missing_true_k_score").alias("missing_true_k"))
    issues = F.col("empty_files") + F.col("duplicate_k") + F.col("missing_true_k")
    return (out.where((F.col("empty_files") > 0) | (F.col("duplicate_k") > 0) | (F.col("missing_true_k") > 0))
            .orderBy(issues.desc(), "backend", "method"))


def data_overview(method: DataFrame, metric: DataFrame) -> DataFrame:
    """sizes and level counts of both tables in one row.  Level counts
    skip NULL (R ``nlevels``); ``unique_datasets`` counts NULL combinations."""
    m = method.agg(
        F.count(F.lit(1)).cast("bigint").alias("method_runs"),
        F.count_distinct("backend").cast("bigint").alias("backends"),
        F.count_distinct("dataset_generator").cast("bigint").alias("dataset_generators"),
        F.count_distinct("dataset_name").cast("bigint").alias("dataset_names"),
        F.count_distinct("method").cast("bigint").alias("methods"),
        F.count_distinct("seed").cast("bigint").alias("unique_seeds"),
        F.count_distinct("run_timestamp").cast("bigint").alias("run_timestamps"),
        n_distinct("dataset_generator", "dataset_name").alias("unique_datasets"))
    x = metric.agg(F.count(F.lit(1)).cast("bigint").alias("metric_evaluations"),
                   F.count_distinct("metric").cast("bigint").alias("metrics"))
    return _join_on(m, x, [], "inner")


def time_overall(method: DataFrame) -> DataFrame:
    """median, mean, min and max execution time over all runs."""
    t = "execution_time_seconds"
    return distribution(method, [], t).select(
        F.col("mean").alias("mean_time"), F.col("min").alias("min_time"), F.col("max").alias("max_time"),
        F.col("q")[0].alias("median_time"))


def score_by_metric(metric: DataFrame) -> DataFrame:
    """median and mean score per metric."""
    return distribution(metric, ["metric"], "score").select(
        "metric", F.col("mean").alias("mean_score"), F.col("q")[0].alias("median_score")).orderBy("metric")


def completeness(metric: DataFrame) -> DataFrame:
    """share of score files that were not empty, in percent (1 place)."""
    total = F.count(F.lit(1))
    return metric.agg(F.round(F.lit(100.0) * (F.lit(1.0) - count_true("empty_file") / total), 1)
                      .alias("completeness_pct"))


def kpi_boxes(runs: DataFrame) -> DataFrame:
    """F32: dashboard KPIs: backend/method/metric levels, datasets, mean score."""
    return runs.agg(
        F.count_distinct("backend").cast("bigint").alias("backends"),
        n_distinct("dataset_generator", "dataset_name").alias("datasets"),
        F.count_distinct("method").cast("bigint").alias("methods"),
        F.count_distinct("metric").cast("bigint").alias("metrics"),
        F.avg("score").alias("average_score"))


def method_backend_scores(runs: DataFrame) -> DataFrame:
    """mean score per backend x method."""
    return runs.groupBy("backend", "method").agg(F.avg("score").alias("avg_score"))


def dataset_performance(combined: DataFrame) -> DataFrame:
    """mean score and mean execution time per dataset x method."""
    return combined.groupBy(*DM).agg(F.avg("score").alias("avg_score"),
                                     F.avg("execution_time_seconds").alias("avg_time"))


def first_metric_heatmap(runs: DataFrame) -> DataFrame:
    """for the first metric level only, mean score per dataset name x
    method (the generator is not part of the key, as in the dashboard)."""
    first = runs.agg(F.min("metric").alias("metric"))
    one = runs.join(F.broadcast(first), "metric", "left_semi")
    return one.groupBy("dataset_name", "method").agg(F.avg("score").alias("avg_score"))


def method_comparison(combined: DataFrame) -> DataFrame:
    """per method x backend, score mean/sd/min/max and mean time."""
    return combined.groupBy("method", "backend").agg(
        F.avg("score").alias("avg_score"),
        F.stddev_samp("score").alias("std_dev"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("execution_time_seconds").alias("avg_time"))


def method_counts(df: DataFrame, column: str = "method") -> DataFrame:
    """``count(column, sort = TRUE)``."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy(F.col("n").desc(), F.col(column).asc_nulls_last()))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """distinct combinations of ``cols``."""
    return df.select(*cols).distinct()


def quality_flag_columns() -> list[str]:
    return list(QUALITY_FLAGS)
