"""Joins between the two tables (E6, E7) and the key invariant check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.functions.columns import null_safe_join
from benchscope.schema import METHOD_KEY


def combined_runs(metric: DataFrame, method: DataFrame,
                  method_cols: Sequence[str] = ("execution_time_seconds",)) -> DataFrame:
    """Metric rows with the execution time of their method run.

    Left join on all seven method-key columns, NULL matching NULL (unseeded
    runs have ``seed`` NULL).  ``method`` has one row per key, so every metric
    row is kept exactly once.  A key that carries a large share of the metric
    rows is split by AQE's skew-join handling; the method side of that key
    is a single row.
    """
    right = method.select(*METHOD_KEY, *method_cols)
    return null_safe_join(metric, right, METHOD_KEY, "left")


def semi_join(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose ``keys`` occur in ``keys_df`` (``%in%`` / semi_join)."""
    return null_safe_join(df, keys_df.select(*keys).distinct(), list(keys), "left_semi")


def key_set_check(method: DataFrame, metric: DataFrame) -> DataFrame:
    """Method keys missing from the metric table and the reverse.

    Two anti joins; an empty result means both tables hold the same keys.
    """
    mk = method.select(*METHOD_KEY).distinct()
    xk = metric.select(*METHOD_KEY).distinct()
    only_method = null_safe_join(mk, xk, METHOD_KEY, "left_anti").withColumn("side", F.lit("method_only"))
    only_metric = null_safe_join(xk, mk, METHOD_KEY, "left_anti").withColumn("side", F.lit("metric_only"))
    return only_method.unionByName(only_metric)
