"""Score consistency across repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.functions.columns import n_distinct, null_safe_join
from benchscope.schema import DMM


def score_consistency(metric: DataFrame, group_cols: Sequence[str] = DMM,
                      score: str = "score", repetition: str = "run_timestamp") -> DataFrame:
    """Per combination: repetitions, mean/min/max/range/sd of the score and
    whether every repetition scored the same; most inconsistent first.

    An all-NULL group has NULL extremes (R: -Inf) and counts as inconsistent.
    """
    s = F.col(score)
    out = metric.groupBy(*group_cols).agg(
        n_distinct(repetition).alias("n_repetitions"),
        F.avg(s).alias("mean_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.stddev_samp(s).alias("score_sd"),
    )
    rng = F.col("max_score") - F.col("min_score")
    out = out.select(*group_cols, "n_repetitions", "mean_score", "min_score", "max_score",
                     rng.alias("score_range"), "score_sd",
                     F.coalesce(rng == 0, F.lit(False)).alias("is_consistent"))
    return out.orderBy(F.col("score_range").desc_nulls_last(), *group_cols)


def consistency_rejoin(metric: DataFrame, consistency: DataFrame | None = None,
                       group_cols: Sequence[str] = DMM, backend: str = "backend") -> DataFrame:
    """E5: each (backend, combination) present in the data with the
    combination's consistency (which is computed across all backends)."""
    consistency = consistency if consistency is not None else score_consistency(metric, group_cols)
    pairs = metric.select(backend, *group_cols).distinct()
    return null_safe_join(pairs, consistency, list(group_cols), "inner")


def backend_consistency(metric: DataFrame, group_cols: Sequence[str] = DMM,
                        backend: str = "backend") -> DataFrame:
    """per backend, how many of its combinations are perfectly consistent."""
    rejoined = consistency_rejoin(metric, None, group_cols, backend)
    total, consistent = F.count(F.lit(1)), F.count_if(F.col("is_consistent"))
    out = rejoined.groupBy(backend).agg(
        total.cast("bigint").alias("total_combinations"),
        consistent.cast("bigint").alias("consistent_combinations"),
        F.round(F.lit(100.0) * consistent / total, 2).alias("percent_consistent"),
        F.avg("score_range").alias("avg_score_range"),
        F.max("score_range").alias("max_score_range"),
    )
    return out.orderBy(F.col("percent_consistent").desc_nulls_last(), F.col(backend))


def consistency_overall(consistency: DataFrame) -> DataFrame:
    """total combinations, consistent ones and their share in percent."""
    total, consistent = F.count(F.lit(1)), F.count_if(F.col("is_consistent"))
    return consistency.agg(
        total.cast("bigint").alias("total_combinations"),
        consistent.cast("bigint").alias("consistent_combinations"),
        F.round(F.lit(100.0) * consistent / total, 2).alias("percent_consistent"))


def top_inconsistent(consistency: DataFrame, n: int = 10, group_cols: Sequence[str] = DMM) -> DataFrame:
    """the ``n`` inconsistent combinations with the widest score range."""
    return (consistency.where(~F.col("is_consistent"))
            .orderBy(F.col("score_range").desc_nulls_last(), *group_cols).limit(n))
