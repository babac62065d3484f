"""Projections and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchscope.functions.columns import dataset_key, null_safe_join

ALL = "All"


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep only ``cols`` (pruned down to the parquet scan)."""
    return df.select(*cols)


def with_dataset_key(df: DataFrame, out: str = "dataset", sep: str = "_") -> DataFrame:
    """``paste(dataset_generator, dataset_name, sep = sep)``."""
    return df.withColumn(out, dataset_key(sep))


def with_rss_mb(df: DataFrame, out: str = "peak_rss_mb") -> DataFrame:
    """D3: peak RSS in MB (KB / 1024)."""
    return df.withColumn(out, F.col("peak_rss") / 1024.0)


def not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every column in ``cols`` is present (NaN already NULL)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def equals(df: DataFrame, **values) -> DataFrame:
    """Conjunction of ``column == value`` (NULL never matches)."""
    cond = F.lit(True)
    for c, v in values.items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def in_frame(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D6 ``x %in% top``: semi join with a key frame, never a collected list."""
    return null_safe_join(df, keys_df.select(*keys).distinct(), list(keys), "left_semi")


def score_in_range(df: DataFrame, column: str = "score", lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """``lo <= x <= hi`` (infinite values fall outside)."""
    return df.where(F.col(column).between(lo, hi))


def min_group_size(df: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """Rows of groups with at least ``n`` rows.

    Counted with a partially aggregated ``groupBy`` and applied with a semi
    join, instead of ``count(*) OVER (PARTITION BY ...)``, which would hold a
    large group in one task.
    """
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).drop("_n")
    return null_safe_join(df, big, list(keys), "left_semi")


def having(agg: DataFrame, condition: Column) -> DataFrame:
    """Filter on aggregated columns."""
    return agg.where(condition)


def filter_runs(df: DataFrame, backend: str = ALL, method: str = ALL,
                dataset_generator: str = ALL, metric: str = ALL,
                time_range: tuple[float, float] | None = None,
                time_col: str = "execution_time_seconds") -> DataFrame:
    """The dashboard's filter panel.  ``"All"`` disables a filter; the
    time range is closed and drops runs without a time."""
    cond = F.lit(True)
    for c, v in (("backend", backend), ("method", method),
                 ("dataset_generator", dataset_generator), ("metric", metric)):
        if v != ALL:
            cond = cond & (F.col(c) == F.lit(v))
    if time_range is not None:
        cond = cond & F.col(time_col).between(float(time_range[0]), float(time_range[1]))
    return df.where(cond)


def filter_choices(df: DataFrame, cols: Sequence[str] = ("backend", "method", "dataset_generator", "metric")) -> DataFrame:
    """The levels offered by each filter (long form: column, level)."""
    out = None
    for c in cols:
        part = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.orderBy("column", "level")


def time_slider_bounds(df: DataFrame, time_col: str = "execution_time_seconds") -> DataFrame:
    """The slider range [0, max time]."""
    return df.agg(F.lit(0.0).alias("min_time"), F.max(time_col).alias("max_time"))


def score_table(df: DataFrame, page: int = 0, page_size: int = 10) -> DataFrame:
    """H3: the dashboard's data table -- projected, best score first, one page."""
    cols = ["backend", "dataset_generator", "dataset_name", "method", "metric", "score",
            "execution_time_seconds"]
    ordered = df.select(*cols).orderBy(F.col("score").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in cols[:5]],
                                       F.col("execution_time_seconds").asc_nulls_last())
    if page:
        return ordered.offset(page * page_size).limit(page_size)
    return ordered.limit(page_size)
