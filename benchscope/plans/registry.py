"""Registry of named queries: key -> plan over the benchmark views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchscope.plans.views import BenchViews, bench_views

Plan = Callable[[BenchViews], DataFrame]
PLANS: dict[str, Plan] = {}
# Operators keep full precision.  A registered result is compared value by value
# with another engine, whose sums run in another order, so its non-dyadic columns
# are rounded here, after the last operator: key -> {column: places}.
PLACES: dict[str, dict[str, int]] = {}


def register(key: str) -> Callable[[Plan], Plan]:
    def deco(fn: Plan) -> Plan:
        if key in PLANS:
            raise ValueError(f"duplicate query key {key}")
        PLANS[key] = fn
        return fn
    return deco


def bind(key: str, fn: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(bench_views(spark, sf_dir))
        places = PLACES.get(key, {})
        return out.withColumns({c: F.round(c, n) for c, n in places.items()}) if places else out
    run.__name__ = getattr(fn, "__name__", "plan")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from benchscope.plans import catalog  # noqa: F401  (registers the plans)
    return {k: bind(k, fn) for k, fn in PLANS.items()}
