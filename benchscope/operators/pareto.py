"""Pareto frontiers.

The reference tests every point against every other point (O(n^2)).  Here a
point (x, y) -- x minimised, y maximised -- is optimal iff
  * y equals m(x), the best y among points with the same x, and
  * y beats b(x), the best y among points with strictly smaller x.
m is a grouped max; b is an exclusive running max over x, computed by the
range-split prefix of ``benchscope.operators.ordered``, so the whole frontier
is a few shuffles with no group held in one task.  Equal points do not
dominate each other, as in the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.functions.columns import ratio
from benchscope.operators.ordered import _join_on, exclusive_prefix, stable


def pareto_frontier(df: DataFrame, x: str, y: str, minimize_x: bool = True, maximize_y: bool = True,
                    partition_cols: Sequence[str] = (), out: str = "is_pareto") -> DataFrame:
    """G1 ``compute_pareto_frontier``: rows with both values present, flagged
    ``is_pareto`` when no other row of the same partition dominates them."""
    parts = list(partition_cols)
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ox = F.col(x) if minimize_x else -F.col(x)
    oy = F.col(y) if maximize_y else -F.col(y)
    # the points are joined back on their own computed coordinates: materialise them once
    pts = stable(clean.withColumn("_x", ox).withColumn("_y", oy))
    best = pts.groupBy(*parts, "_x").agg(F.max("_y").alias("_m"))
    best = exclusive_prefix(best, parts, ["_x"], "_m", how="max", out="_b")
    flagged = _join_on(pts, best, parts + ["_x"], "inner")
    is_opt = (F.col("_y") == F.col("_m")) & (F.col("_b").isNull() | (F.col("_y") > F.col("_b")))
    return flagged.select(*df.columns, is_opt.alias(out))


def frontier_points(flagged: DataFrame, x: str, partition_cols: Sequence[str] = (),
                    out: str = "is_pareto") -> DataFrame:
    """The optimal points in x order (the frontier step line)."""
    return flagged.where(F.col(out)).orderBy(*partition_cols, x)


# ------------------------------------------------------- runtime versus memory

def runtime_memory_frontier(points: DataFrame) -> DataFrame:
    """Frontier of F17's points: minimise runtime and memory."""
    return pareto_frontier(points, "avg_runtime", "avg_peak_rss_mb", minimize_x=True, maximize_y=False)


def pareto_memory_methods(points: DataFrame) -> DataFrame:
    """per method, its frontier points and their runtime/memory stats."""
    front = runtime_memory_frontier(points).where(F.col("is_pareto"))
    return (front.groupBy("method").agg(
        F.count(F.lit(1)).cast("bigint").alias("datasets_on_frontier"),
        F.avg("avg_runtime").alias("avg_runtime_sec"),
        F.avg("avg_peak_rss_mb").alias("avg_memory_mb"),
        F.min("avg_runtime").alias("min_runtime_sec"),
        F.max("avg_runtime").alias("max_runtime_sec"),
        F.min("avg_peak_rss_mb").alias("min_memory_mb"),
        F.max("avg_peak_rss_mb").alias("max_memory_mb"))
        .orderBy(F.col("datasets_on_frontier").desc(), "method"))


def fastest_frontier(summary: DataFrame, n: int = 3) -> DataFrame:
    """``slice_min(avg_runtime_sec, n)`` -- ties included."""
    return _smallest(summary, "avg_runtime_sec", n)


def leanest_frontier(summary: DataFrame, n: int = 3) -> DataFrame:
    """``slice_min(avg_memory_mb, n)`` -- ties included."""
    return _smallest(summary, "avg_memory_mb", n)


def _smallest(summary: DataFrame, col: str, n: int) -> DataFrame:
    # The summary has one row per method (bounded by the method catalogue).
    from pyspark.sql import Window
    w = Window.orderBy(F.col(col).asc_nulls_last())
    return summary.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= n).drop("_r")


def balanced_frontier(summary: DataFrame, n: int | None = 3) -> DataFrame:
    """Efficiency ratio and balanced score = z(runtime) + z(memory) (sample
    sd), lowest first.  The z-scores use one global aggregate of the (one row
    per method) summary, joined back on a constant key."""
    stats = summary.agg(F.avg("avg_runtime_sec").alias("_mr"), F.stddev_samp("avg_runtime_sec").alias("_sr"),
                        F.avg("avg_memory_mb").alias("_mm"), F.stddev_samp("avg_memory_mb").alias("_sm"))
    j = _join_on(summary, stats, [], "inner")
    z = (ratio(F.col("avg_runtime_sec") - F.col("_mr"), F.col("_sr"))
         + ratio(F.col("avg_memory_mb") - F.col("_mm"), F.col("_sm")))
    out = j.select(*summary.columns,
                   ratio("avg_runtime_sec", "avg_memory_mb").alias("efficiency_ratio"),
                   z.alias("balanced_score")).orderBy(F.col("balanced_score").asc_nulls_last(), "method")
    return out.limit(n) if n else out


# ---------------------------------------------------------- time versus score

def time_quality_points(combined: DataFrame) -> DataFrame:
    """per metric x method x dataset, mean time and mean score of runs
    that have both (all metrics in one pass)."""
    return (combined.where(F.col("execution_time_seconds").isNotNull() & F.col("score").isNotNull())
            .groupBy("metric", "method", "dataset_generator", "dataset_name")
            .agg(F.avg("execution_time_seconds").alias("avg_time"), F.avg("score").alias("avg_score")))


def pareto_by_metric(combined: DataFrame, metrics: DataFrame) -> DataFrame:
    """for each metric in ``metrics``, the time-quality frontier
    (minimise time, maximise score) summarised per method."""
    pts = time_quality_points(combined.join(metrics.select("metric"), "metric", "left_semi"))
    front = pareto_frontier(pts, "avg_time", "avg_score", partition_cols=["metric"]).where(F.col("is_pareto"))
    return (front.groupBy("metric", "method").agg(
        F.count(F.lit(1)).cast("bigint").alias("datasets_on_frontier"),
        F.avg("avg_time").alias("avg_execution_time"),
        F.avg("avg_score").alias("avg_quality_score"))
        .orderBy("metric", F.col("datasets_on_frontier").desc(), "method"))


def pareto_overall(by_metric: DataFrame) -> DataFrame:
    """per method, on how many metric frontiers it sits, its total
    frontier points and the means of its per-metric means."""
    return (by_metric.groupBy("method").agg(
        F.count(F.lit(1)).cast("bigint").alias("metrics_on_frontier"),
        F.sum("datasets_on_frontier").cast("bigint").alias("total_datasets_on_frontier"),
        F.avg("avg_execution_time").alias("avg_execution_time"),
        F.avg("avg_quality_score").alias("avg_quality_score"))
        .orderBy(F.col("metrics_on_frontier").desc(), F.col("total_datasets_on_frontier").desc(), "method"))

