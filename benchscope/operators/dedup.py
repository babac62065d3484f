"""First row per key (G7), the method-table dedup of the ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                  payload_cols: Sequence[str] | None = None) -> DataFrame:
    """Keep, per key, the row that comes first in ``order_cols`` order.

    Written as ``min_by(payload, order)`` so Spark aggregates partially on the
    map side: a key that holds a large share of all rows is reduced to one row
    per task before the shuffle, unlike ``row_number()`` over a window, which
    sends the whole group to one task.  ``order_cols`` must be unique per key
    for a deterministic answer.  NULL keys form their own group, like
    ``PARTITION BY``.
    """
    payload_cols = list(payload_cols if payload_cols is not None else df.columns)
    rest = [c for c in payload_cols if c not in key_cols]
    order = F.struct(*[F.col(c) for c in order_cols])
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("_first")
    out = df.groupBy(*key_cols).agg(first)
    return out.select(*[F.col(c) if c in key_cols else F.col(f"_first.{c}").alias(c)
                        for c in payload_cols])
