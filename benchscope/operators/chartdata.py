"""The data sets behind the report's and dashboard's charts.

Charts are not rendered; each function returns the DataFrame a plotting
library would draw.  Histogram bins and box statistics follow an explicit
spec (the graphics libraries' own defaults are not part of the reference):
``bins`` equal-width bins over [min, max] of each panel, the last bin
closed; quartiles by linear interpolation (R type 7); whiskers at the most
extreme values within 1.5 IQR of the box.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchscope.operators.ordered import _join_on, quantiles_of_counts

WHISKER = 1.5


def value_counts(df: DataFrame, value: Column, group_cols: Sequence[str]) -> DataFrame:
    """(group_cols, _v, _c): how often each finite value occurs; every chart below
    is a function of these counts, so no raw row is joined to its bounds."""
    return (df.select(*group_cols, value.cast("double").alias("_v"))
            .where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
            .groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c")))


def histogram(df: DataFrame, value: str | Column, group_cols: Sequence[str], bins: int,
              panel_cols: Sequence[str] = ()) -> DataFrame:
    """Counts per (group, bin).  Bounds come from ``panel_cols`` (a subset of
    ``group_cols``; empty = one shared axis).  NULL/non-finite values are
    dropped, as the graphics layer does."""
    v = F.col(value) if isinstance(value, str) else value
    counts = value_counts(df, v, group_cols)
    bounds = counts.groupBy(*panel_cols).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    j = _join_on(counts, bounds, list(panel_cols), "inner").withColumnRenamed("_v", "_x")
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    binned = j.select(*group_cols, "_c", b.cast("int").alias("bin"), "_lo", "_hi", width.alias("_w"))
    out = binned.groupBy(*group_cols, "bin").agg(
        F.sum("_c").cast("bigint").alias("count"),
        F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    return out.select(*group_cols, "bin",
                      (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"), "count")


def box_stats(df: DataFrame, value: str | Column, group_cols: Sequence[str]) -> DataFrame:
    """Five-number summary per group: quartiles (type 7), whiskers within
    1.5 IQR, count of values and of outliers."""
    v = F.col(value) if isinstance(value, str) else value
    counts = value_counts(df, v, group_cols)
    q = quantiles_of_counts(counts, group_cols, [0.25, 0.5, 0.75])
    qw = q.groupBy(*group_cols).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                      for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    j = _join_on(counts, qw, list(group_cols), "inner").withColumnRenamed("_v", "_x")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - WHISKER * iqr, F.col("q3") + WHISKER * iqr
    return j.groupBy(*group_cols).agg(
        F.sum("_c").cast("bigint").alias("n"),
        (F.min(F.when(F.col("_x") >= lo_f, F.col("_x")))).alias("whisker_low"),
        F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        (F.max(F.when(F.col("_x") <= hi_f, F.col("_x")))).alias("whisker_high"),
        F.sum(F.when((F.col("_x") < lo_f) | (F.col("_x") > hi_f), F.col("_c")).otherwise(0)).cast("bigint").alias("n_outliers"))


def hist_log_runtime(method: DataFrame, bins: int = 50) -> DataFrame:
    """log10(runtime) per backend, shared x axis."""
    return histogram(method, F.log10("runtime"), ["backend"], bins)


def hist_runtime(method: DataFrame, metric: DataFrame, bins: int = 30) -> DataFrame:
    """Runtime per backend for the method and the metric table (each
    chart has its own shared x axis)."""
    m = method.where(F.col("runtime").isNotNull()).select(F.lit("method").alias("level"), "backend", "runtime")
    x = metric.where(F.col("runtime").isNotNull()).select(F.lit("metric").alias("level"), "backend", "runtime")
    return histogram(m.unionByName(x), "runtime", ["level", "backend"], bins, ["level"])


def hist_rss(rss_data: DataFrame, bins: int = 20) -> DataFrame:
    """log10(peak RSS MB) per dataset x method panel (free scales),
    counted per backend."""
    return histogram(rss_data, F.log10("peak_rss_mb"), ["dataset", "method", "backend"], bins, ["dataset", "method"])


def hist_score(metric: DataFrame, bins: int = 30) -> DataFrame:
    """Score per metric, one panel (and bounds) per metric."""
    return histogram(metric, "score", ["metric"], bins, ["metric"])


def box_time_top_methods(method: DataFrame, top: DataFrame) -> DataFrame:
    """log10 execution time per method for the given top methods."""
    rows = method.join(top.select("method"), "method", "left_semi")
    return box_stats(rows, F.log10("execution_time_seconds"), ["method"])


def box_by_backend(runs: DataFrame, value: str, log: bool = False) -> DataFrame:
    """Box statistics of ``value`` per backend."""
    v = F.log10(value) if log else F.col(value)
    return box_stats(runs, v, ["backend"])


def box_seed(seed_rows: DataFrame) -> DataFrame:
    """Score box per combination and top method (F8's rows)."""
    keys = ["dataset_generator", "dataset_name", "metric", "method", "method_rank"]
    return box_stats(seed_rows, "score", keys)


def scatter_time_score(combined: DataFrame, metrics: DataFrame) -> DataFrame:
    """(time, score, method) points of the most common metrics."""
    rows = combined.join(metrics.select("metric"), "metric", "left_semi")
    return rows.where(F.col("execution_time_seconds").isNotNull() & F.col("score").isNotNull()).select(
        "metric", "method", "backend", "dataset_generator", "dataset_name", "execution_time_seconds", "score")


def bar_error(comparison: DataFrame) -> DataFrame:
    """Mean score +- sd per method and backend (error bars)."""
    return comparison.select("method", "backend", "avg_score", "std_dev",
                             (F.col("avg_score") - F.col("std_dev")).alias("ymin"),
                             (F.col("avg_score") + F.col("std_dev")).alias("ymax"))
