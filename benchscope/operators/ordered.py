"""Order-dependent building blocks that stay parallel under skew.

A window ``PARTITION BY g ORDER BY x`` runs each group in one task.  The three
primitives here (exclusive running aggregate, average-tie rank and exact
quantiles) instead work on value counts that were reduced by a partial
aggregate, and split every group across range partitions:

1. ``repartitionByRange`` on (group, order) so each task holds one contiguous
   slice of the sort order (``spark_partition_id`` names the slice);
2. a running aggregate inside each slice (window on (group, slice));
3. the total of each slice, turned into an exclusive running total over slices
   -- a table with at most ``#slices + #groups`` rows;
4. slice-local value combined with the carry of earlier slices.

No step holds more than one slice of one group in one task, so a group that
carries a third of all rows is still processed by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGS = {"max": F.max, "sum": F.sum, "min": F.min}


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once so that every consumer sees identical values.

    Operators that join rows back on a computed double (a mean, a fitted
    value) need both sides of that join to hold bit-identical values.  A
    recomputed floating-point sum is not guaranteed to be: the order in
    which a reduce task fetches shuffle blocks varies between runs.  The
    frame is therefore checkpointed to the session's reliable checkpoint
    directory (``spark.checkpoint.dir``), which also cuts its lineage: a lost
    executor can change neither a value nor a slice id.  On a cluster without
    that setting this raises (see ``session.ensure_checkpoint_dir``).
    Callers apply this to aggregated point sets, never to raw tables.
    """
    from pyspark import StorageLevel

    from benchscope.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    # persisted first so the checkpoint write reads the computed blocks
    # instead of running the lineage a second time
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out


def _slices(df: DataFrame) -> int:
    conf = df.sparkSession.conf
    return max(1, int(conf.get("spark.sql.shuffle.partitions", "200")))


def _join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join keeping the left copy of the key columns.

    Without key columns ``right`` is one row (a global aggregate): it is read
    as a scalar subquery, so no join is planned at all.
    """
    if not cols:
        one = right.select(F.struct(*right.columns).alias("__row")).scalar()
        row = left.withColumn("__row", one)
        return row.select(*left.columns, *[F.col("__row")[c].alias(c) for c in right.columns])
    r = right.select(*[F.col(c).alias(f"__k_{c}") for c in cols],
                     *[c for c in right.columns if c not in cols])
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(r[f"__k_{c}"])
    return left.join(r, cond, how).drop(*[f"__k_{c}" for c in cols])


def exclusive_prefix(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str],
                     value: str, how: str = "max", out: str = "prefix") -> DataFrame:
    """Add ``out`` = aggregate of ``value`` over rows of the same partition that
    sort strictly before the row in ``order_cols`` order.

    ``(part_cols, order_cols)`` must be unique (aggregate first).  ``how`` is
    ``max``, ``min`` or ``sum``; the empty prefix is NULL for max/min and 0 for sum.
    """
    part_cols, order_cols = list(part_cols), list(order_cols)
    agg = _AGGS[how]
    # The slice id is the range partition a row landed in.  It is frozen once
    # (checkpoint) because two consumers read it: a recomputed range exchange
    # (or a differently coalesced AQE read of it) need not number slices alike.
    ranged = stable(df.repartitionByRange(_slices(df), *[F.col(c).asc_nulls_first() for c in part_cols + order_cols])
                    .withColumn("_slice", F.spark_partition_id()))
    w = Window.partitionBy(*part_cols, "_slice").orderBy(*order_cols)
    local = ranged.select(
        "*",
        agg(value).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_local"),
        agg(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_block"),
    )
    blocks = local.groupBy(*part_cols, "_slice").agg(F.any_value("_block").alias("_block"))
    wc = (Window.partitionBy(*part_cols) if part_cols else Window).orderBy("_slice") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*part_cols, "_slice", agg("_block").over(wc).alias("_carry"))
    joined = _join_on(local, carry, part_cols + ["_slice"])
    if how == "sum":
        combined = F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    elif how == "max":
        combined = F.greatest(F.col("_local"), F.col("_carry"))
    else:
        combined = F.least(F.col("_local"), F.col("_carry"))
    return joined.select(*df.columns, combined.alias(out))


def average_rank(df: DataFrame, part_cols: Sequence[str], value: str, out: str,
                 descending: bool = False) -> DataFrame:
    """R ``rank(x)`` per partition: ties get the average rank, NULL stays NULL.

    rank = (#values strictly before) + (#ties + 1) / 2, from value counts.
    """
    part_cols = list(part_cols)
    df = stable(df)
    v = F.col(value)
    counts = (df.where(v.isNotNull())
              .groupBy(*part_cols, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_ov", -F.col("_v") if descending else F.col("_v")))
    pre = exclusive_prefix(counts, part_cols, ["_ov"], "_c", how="sum", out="_before")
    ranks = pre.select(*part_cols, F.col("_v").alias(value),
                       (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out))
    # rows without a value need no rank; in the join they would share one key
    ranked = _join_on(df.where(v.isNotNull()), ranks, part_cols + [value])
    return ranked.unionByName(df.where(v.isNull()).withColumn(out, F.lit(None).cast("double")))


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], values: Mapping[str, str | Column],
                    probs: Sequence[float]) -> DataFrame:
    """Exact quantiles (R type 7, linear interpolation) per group, in long form.

    ``values`` maps a measure name to a column; the result has ``group_cols``,
    ``measure``, ``p`` and ``q``.  Works from the count of each distinct value,
    so no group is ever buffered in one task (unlike ``percentile``).  NULL
    values are ignored; a group without values yields no row.
    """
    group_cols = list(group_cols)
    stacked = None
    for name, c in values.items():
        c = F.col(c) if isinstance(c, str) else c
        part = df.select(*group_cols, F.lit(name).alias("measure"), c.cast("double").alias("_v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    keys = group_cols + ["measure"]
    counts = (stacked.where(F.col("_v").isNotNull())
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    return quantiles_of_counts(counts, keys, probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``exact_quantiles`` of value counts (keys, ``_v``, ``_c``): keys, ``p``, ``q``."""
    keys = list(keys)
    pre = exclusive_prefix(counts, keys, ["_v"], "_c", how="sum", out="_lo")
    totals = pre.groupBy(*keys).agg(F.sum("_c").alias("_n"))  # the counts again, already reduced
    located = _join_on(pre, totals, keys, "inner")
    h = (F.col("_n") - 1) * F.col("p")
    j, k = F.floor(h), F.ceil(h)
    covers = lambda pos: (F.col("_lo") <= pos) & (pos < F.col("_lo") + F.col("_c"))
    picked = (located.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
              .where(covers(j) | covers(k))
              .groupBy(*keys, "p")
              .agg(F.max(F.when(covers(j), F.col("_v"))).alias("_vj"),
                   F.max(F.when(covers(k), F.col("_v"))).alias("_vk"),
                   F.max("_n").alias("_n")))
    gamma = (F.col("_n") - 1) * F.col("p") - F.floor((F.col("_n") - 1) * F.col("p"))
    q = F.when(gamma == 0, F.col("_vj")).otherwise(F.col("_vj") + gamma * (F.col("_vk") - F.col("_vj")))
    return picked.select(*keys, "p", q.alias("q"))


def distribution(df: DataFrame, group_cols: Sequence[str], value: str | Column,
                 probs: Sequence[float] = (0.5,)) -> DataFrame:
    """Moments and exact quantiles of one value per group, from its value counts alone.

    The result has ``group_cols``, ``rows`` (NULL values count), ``n`` (they do not),
    ``mean``, ``sd`` (sample, NULL below two values), ``min``, ``max`` and ``q``, the
    type-7 quantiles in the order of ``probs``.  ``df`` is read once: the frozen value
    counts feed everything, and the deviations are taken from the exact mean in a
    second step over them.  A group of NULL values keeps its row; without group
    columns there is one row, also of an empty table.
    """
    keys = list(group_cols)
    v = F.col(value) if isinstance(value, str) else value
    counts = (df.select(*keys, v.cast("double").alias("_v")).groupBy(*keys, "_v")
              .agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_c", F.when(F.col("_v").isNotNull(), F.col("_rows")).otherwise(F.lit(0).cast("bigint"))))
    pre = exclusive_prefix(counts, keys, ["_v"], "_c", how="sum", out="_lo")
    totals = pre.groupBy(*keys).agg(
        F.sum("_rows").alias("_r"), F.sum("_c").alias("_n"),
        F.try_divide(F.sum(F.col("_v") * F.col("_c")), F.sum("_c")).alias("_mean"))
    located = _join_on(pre, totals, keys, "inner")
    n = F.col("_n")
    covers = lambda pos: (F.col("_lo") <= pos) & (pos < F.col("_lo") + F.col("_c"))
    spots = [F.lit(float(p)) * (n - 1) for p in probs]
    ends = [F.max(F.when(covers(at(h)), F.col("_v"))).alias(f"{name}{i}")
            for i, h in enumerate(spots) for name, at in (("_j", F.floor), ("_k", F.ceil))]
    off = F.col("_v") - F.col("_mean")
    out = located.groupBy(*keys).agg(
        F.max("_r").alias("_r"), F.max("_n").alias("_n"), F.max("_mean").alias("mean"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.sum(off * off * F.col("_c")).alias("_ss"), *ends)

    def between(i: int, h: Column) -> Column:
        low, high, gamma = F.col(f"_j{i}"), F.col(f"_k{i}"), h - F.floor(h)
        return F.when(gamma == 0, low).otherwise(low + gamma * (high - low))

    zero = F.lit(0).cast("bigint")
    return out.select(
        *keys, F.coalesce(F.col("_r"), zero).alias("rows"), F.coalesce(n, zero).alias("n"), "mean",
        F.when(n > 1, F.sqrt(F.col("_ss") / (n - 1))).alias("sd"), "min", "max",
        F.array(*[between(i, h) for i, h in enumerate(spots)]).alias("q"))


def with_quantiles(summary: DataFrame, source: DataFrame, group_cols: Sequence[str],
                   outputs: Mapping[str, tuple[str | Column, float]]) -> DataFrame:
    """Join exact quantiles of ``source`` onto the per-group ``summary``.

    ``outputs`` maps an output column to ``(value column, p)``, for example
    ``{"med_score": ("score", 0.5)}``.  Groups without values get NULL.
    """
    group_cols = list(group_cols)
    measures = {}
    for out, (c, _p) in outputs.items():
        measures[out] = c
    probs = sorted({p for _c, p in outputs.values()})
    q = exact_quantiles(source, group_cols, measures, probs)
    wide = q.groupBy(*group_cols).agg(*[
        F.max(F.when((F.col("measure") == out) & (F.col("p") == float(p)), F.col("q"))).alias(out)
        for out, (_c, p) in outputs.items()])
    return _join_on(summary, wide, group_cols)


def medians(summary: DataFrame, source: DataFrame, group_cols: Sequence[str],
            outputs: Mapping[str, str | Column]) -> DataFrame:
    """``with_quantiles`` for p = 0.5 (R ``median``)."""
    return with_quantiles(summary, source, group_cols, {o: (c, 0.5) for o, c in outputs.items()})
