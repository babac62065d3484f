"""Preconditions of an analysis.

Each guard is one small aggregate (min/max of a column), evaluated eagerly so
the error surfaces before the analysis is planned.  Callers that run several
analyses check once and pass ``check=False``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InsufficientDataError(ValueError):
    """Raised when an analysis lacks the data it needs."""


def has_seed_data(df: DataFrame, seed: str = "seed") -> bool:
    """The table has a seed column with more than one distinct value.

    More than one distinct non-NULL value <=> min < max, which needs no
    distinct aggregation.
    """
    if seed not in df.columns:
        return False
    row = df.agg(F.min(seed).alias("lo"), F.max(seed).alias("hi")).first()
    return row is not None and row["lo"] is not None and row["lo"] != row["hi"]


def require_seed_data(df: DataFrame, seed: str = "seed") -> None:
    if not has_seed_data(df, seed):
        raise InsufficientDataError("the runs carry at most one random seed, so there is no spread over seeds to measure")


def has_multiple_levels(df: DataFrame, column: str = "backend") -> bool:
    """More than one non-NULL level of ``column``."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return row is not None and row["lo"] is not None and row["lo"] != row["hi"]


def require_backends(df: DataFrame, backends: list[str] | None, column: str = "backend") -> None:
    if backends is not None:
        if len(set(backends)) < 2:
            raise InsufficientDataError(f"a comparison takes two different values of {column}, got {backends}")
        return
    if not has_multiple_levels(df, column):
        raise InsufficientDataError(f"the runs have fewer than two values of {column} to compare")


def seed_data_flag(df: DataFrame, seed: str = "seed") -> DataFrame:
    """D12 as a one-row DataFrame (lazy): ``has_seed_data``, ``n_seeds``."""
    s = F.col(seed)
    return df.agg(F.count_distinct(s).cast("bigint").alias("n_seeds"),
                  (F.coalesce(F.min(s) < F.max(s), F.lit(False))).alias("has_seed_data"))


def backend_guard(df: DataFrame, column: str = "backend") -> DataFrame:
    """D17 as a one-row DataFrame (lazy): number of backend levels and whether
    a backend comparison applies."""
    c = F.col(column)
    return df.agg(F.count_distinct(c).cast("bigint").alias("n_backends"),
                  (F.coalesce(F.min(c) < F.max(c), F.lit(False))).alias("multi_backend"))
