"""Rankings, top-k with ties and rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchscope.functions.columns import ratio
from benchscope.operators.ordered import _join_on, average_rank, stable


def top_k_with_ties(df: DataFrame, part_cols: Sequence[str], order_col: str, k: int,
                    descending: bool = True) -> DataFrame:
    """G3 ``slice_max``/``slice_min`` with ties: ``rank() <= k`` per partition.

    Spark plans a partial group limit before the shuffle for a rank filter, so
    only k rows (plus ties) per partition and task travel.  Without ``part_cols`` no
    window is planned, which would read all rows in one task: the k-th value comes from
    an ordered limit and is a scalar filter (on a frozen frame, as both read it).
    """
    if not part_cols:
        df = stable(df)
        order = F.desc_nulls_last if descending else F.asc_nulls_last
        top = df.select(F.col(order_col).alias("_v")).orderBy(order("_v")).limit(k)
        last = (F.min if descending else F.max)("_v")
        # with fewer than k values, all of them and the ties of NULL are within k
        bound = top.agg(F.when(F.count("_v") >= k, last).alias("_b")).scalar()
        within = F.col(order_col) >= F.col("_b") if descending else F.col(order_col) <= F.col("_b")
        kept = df.withColumn("_b", bound).where(F.col("_b").isNull() | within)
        return kept.select(*df.columns)
    o = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_last()
    w = Window.partitionBy(*part_cols).orderBy(o)
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= k).drop("_rank")


def top_methods_by_metric(metric: DataFrame, min_runs: int = 5, k: int = 10) -> DataFrame:
    """per metric, the methods (with at least ``min_runs`` runs) with the
    ``k`` highest mean scores, ties included."""
    agg = (metric.groupBy("metric", "method")
           .agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).cast("bigint").alias("n_runs"))
           .where(F.col("n_runs") >= min_runs))
    return top_k_with_ties(agg, ["metric"], "avg_score", k).orderBy("metric", F.col("avg_score").desc(), "method")


def method_rankings(combined: DataFrame, dataset_col: str = "dataset_name") -> DataFrame:
    """Per dataset, rank methods by mean score (high first) and by mean
    time (low first) with average ties; overall = mean of both; then mean
    ranks per method, best first."""
    means = combined.groupBy("method", dataset_col).agg(
        F.avg("score").alias("avg_score"), F.avg("execution_time_seconds").alias("avg_time"))
    ranked = average_rank(means, [dataset_col], "avg_score", "score_rank", descending=True)
    ranked = average_rank(ranked, [dataset_col], "avg_time", "time_rank")
    ranked = ranked.withColumn("overall_rank", (F.col("score_rank") + F.col("time_rank")) / 2)
    return (ranked.groupBy("method").agg(
        F.avg("score_rank").alias("avg_score_rank"),
        F.avg("time_rank").alias("avg_time_rank"),
        F.avg("overall_rank").alias("avg_overall_rank"))
        .orderBy(F.col("avg_overall_rank").asc_nulls_last(), "method"))


def rescale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """G6 ``scales::rescale`` to [0, 1]; a zero range maps to 0.5, NULL stays
    NULL.  Bounds come from one global aggregate joined on a constant key."""
    bounds = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    j = _join_on(df, bounds, [], "inner")
    outs = []
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        outs.append(F.when(F.col(c).isNull(), F.lit(None).cast("double"))
                    .when(hi == lo, F.lit(0.5))
                    .otherwise((F.col(c) - lo) / (hi - lo)).alias(f"{c}{suffix}"))
    return j.select(*df.columns, *outs)


def radar(comparison: DataFrame) -> DataFrame:
    """per method, mean of the per-backend mean scores, speed = 1 / mean
    of the per-backend mean times, both rescaled to [0, 1]."""
    per = comparison.groupBy("method").agg(
        F.avg("avg_score").alias("score"),
        ratio(F.lit(1.0), F.avg("avg_time")).alias("speed"))
    out = rescale(per, ["score", "speed"])
    return out.select("method", F.col("score").alias("score"), F.col("speed").alias("speed"),
                      F.col("score_scaled").alias("score_scaled"), F.col("speed_scaled").alias("speed_scaled"))
