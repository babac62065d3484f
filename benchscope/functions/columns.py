"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with R's rules for a zero divisor: x/0 = +-Inf, 0/0 = NA.

    Spark's ANSI mode raises on division by zero, so the zero case is spelled
    out.  NULL in either side gives NULL.
    """
    n, d = col_(num), col_(den)
    return (F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(d == 0, F.when(n > 0, F.lit(float("inf")))
                  .when(n < 0, F.lit(float("-inf")))
                  .otherwise(F.lit(None).cast("double")))
            .otherwise(n.cast("double") / d))


def cv(sd: str | Column, mean: str | Column, use_abs: bool = False) -> Column:
    """Coefficient of variation ``sd / mean`` (or ``sd / |mean|``)."""
    m = F.abs(col_(mean)) if use_abs else col_(mean)
    return ratio(sd, m)


def dataset_key(sep: str = "_", generator: str = "dataset_generator",
                name: str = "dataset_name") -> Column:
    """``paste(generator, name, sep=sep)``; NULL parts print as "NA" like R."""
    return F.concat_ws(sep, F.coalesce(F.col(generator), F.lit("NA")),
                       F.coalesce(F.col(name), F.lit("NA")))


def n_distinct(*cols: str) -> Column:
    """dplyr ``n_distinct``: counts NULL as a value of its own."""
    if len(cols) == 1:
        c = F.col(cols[0])
        return (F.count_distinct(c) + F.max(c.isNull().cast("int"))).cast("bigint")
    s = F.struct(*[F.col(c) for c in cols])
    return F.count_distinct(s).cast("bigint")


def count_true(c: str | Column) -> Column:
    """``sum(flag, na.rm=TRUE)`` for a boolean column."""
    return F.count_if(F.coalesce(col_(c), F.lit(False))).cast("bigint")


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` with NULL = NULL, keeping one copy of the keys.

    ``<=>`` keys stay equi-join keys for the planner (sort-merge or hash join),
    so there is no nested loop.
    """
    cols = list(cols)
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in cols],
                     *[F.col(c) for c in right.columns if c not in cols])
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(r[f"__r_{c}"])
    joined = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return joined
    if how in ("right", "right_outer", "rightouter"):
        keys = [F.col(f"__r_{c}").alias(c) for c in cols]
    elif how in ("full", "outer", "full_outer", "fullouter"):
        keys = [F.coalesce(left[c], F.col(f"__r_{c}")).alias(c) for c in cols]
    else:
        keys = [left[c] for c in cols]
    others_l = [left[c] for c in left.columns if c not in cols]
    others_r = [F.col(c) for c in right.columns if c not in cols]
    return joined.select(*keys, *others_l, *others_r)
