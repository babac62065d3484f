"""Backend-versus-backend comparisons.

The reference loops over backend pairs and joins two filtered tables per pair.
Here one self-join of the per-backend means does all pairs: equi-keys on the
grouping columns (NULL-safe) plus ``a.backend < b.backend``.  The join runs
after the aggregation, so each key has at most one row per backend and a pair
set is bounded by the number of backends, whatever the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.operators.guards import require_backends
from benchscope.schema import DM, DMM


def avg_by_backend(df: DataFrame, group_cols: Sequence[str], value: str, out: str,
                   backend: str = "backend") -> DataFrame:
    """mean of ``value`` per backend x group (NULL values skipped)."""
    return df.groupBy(backend, *group_cols).agg(F.avg(value).alias(out))


def avg_time_by_backend(method: DataFrame) -> DataFrame:
    return avg_by_backend(method, DM, "execution_time_seconds", "avg_execution_time")


def avg_score_by_backend(metric: DataFrame) -> DataFrame:
    return avg_by_backend(metric, DMM, "score", "avg_score")


def _pairs(agg: DataFrame, group_cols: Sequence[str], value: str,
           backends: Sequence[str] | None, backend: str = "backend") -> DataFrame:
    if backends is not None:
        agg = agg.where(F.col(backend).isin(list(backends)))
    a = agg.alias("a")
    b = agg.alias("b")
    cond = F.col(f"a.{backend}") < F.col(f"b.{backend}")
    for c in group_cols:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, cond, "inner").select(
        F.col(f"a.{backend}").alias("backend1"), F.col(f"b.{backend}").alias("backend2"),
        *[F.col(f"a.{c}").alias(c) for c in group_cols],
        F.col(f"a.{value}").alias(f"{value}_b1"), F.col(f"b.{value}").alias(f"{value}_b2"))


def backend_time_pairs(method: DataFrame, backends: Sequence[str] | None = None,
                       check: bool = True) -> DataFrame:
    """E1 ``compare_backend_execution_times``: for each backend pair b1 < b2,
    the mean execution time of every dataset x method both ran."""
    if check:
        require_backends(method, list(backends) if backends is not None else None)
    return _pairs(avg_time_by_backend(method), DM, "avg_execution_time", backends)


def backend_score_pairs(metric: DataFrame, backends: Sequence[str] | None = None,
                        check: bool = True) -> DataFrame:
    """E2 ``compare_backend_scores``: as E1 for mean scores per dataset x
    method x metric."""
    if check:
        require_backends(metric, list(backends) if backends is not None else None)
    return _pairs(avg_score_by_backend(metric), DMM, "avg_score", backends)


def backend_pairs(df: DataFrame, backend: str = "backend") -> DataFrame:
    """Every pair of backend levels (b1 < b2).

    The level set is a catalogue dimension (a handful of backends): it is
    gathered into one sorted array and the pairs are generated with array
    functions, so no join (and no cross join) is involved.
    """
    levels = df.where(F.col(backend).isNotNull()).agg(
        F.sort_array(F.collect_set(backend)).alias("lv"))
    pairs = F.expr("""flatten(transform(lv, (x, i) ->
                 transform(slice(lv, i + 2, greatest(size(lv) - i - 1, 0)),
                           y -> named_struct('backend1', x, 'backend2', y))))""")
    return levels.select(F.explode(pairs).alias("p")).select("p.backend1", "p.backend2")


def compare_backends(method: DataFrame, metric: DataFrame, backends: Sequence[str] | None = None,
                     check: bool = True) -> DataFrame:
    """E4 ``compare_backend_plots``: both comparisons in one long table
    (``kind`` = execution_time | score; ``metric`` is NULL for times)."""
    t = backend_time_pairs(method, backends, check).select(
        F.lit("execution_time").alias("kind"), "backend1", "backend2", *DM,
        F.lit(None).cast("string").alias("metric"),
        F.col("avg_execution_time_b1").alias("value_b1"), F.col("avg_execution_time_b2").alias("value_b2"))
    s = backend_score_pairs(metric, backends, check).select(
        F.lit("score").alias("kind"), "backend1", "backend2", *DM, "metric",
        F.col("avg_score_b1").alias("value_b1"), F.col("avg_score_b2").alias("value_b2"))
    return t.unionByName(s)
