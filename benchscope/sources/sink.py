"""Writing the two tables (A9-A11, A18) and naming the outputs."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.operators.ingest import metric_wide

METHOD_PREFIX = "method-performance"
METRIC_PREFIX = "metric-performance"


def _now() -> str:
    return _dt.datetime.now().strftime("%Y%m%d%H%M")


def output_base_name(source_dirs: Sequence[str], backends: Sequence[str], timestamps: Sequence[str],
                     clock: Callable[[], str] = _now) -> str:
    """``<dir>[_<backend>]_<timestamp or now>`` for one root -- the backend
    and the timestamp only where the root has exactly one; for several roots
    ``multi_<n>_dirs_<backends or "<n>_backends">_<now>``."""
    if len(source_dirs) == 1:
        parts = [source_dirs[0]]
        if len(backends) == 1:
            parts.append(backends[0])
        parts.append(timestamps[0] if len(timestamps) == 1 else clock())
        return "_".join(parts)
    b = "_".join(backends) if len(backends) <= 3 else f"{len(backends)}_backends"
    return f"multi_{len(source_dirs)}_dirs_{b}_{clock()}"


def run_levels(metric: DataFrame) -> tuple[list[str], list[str]]:
    """The backends found, and the timestamps as far as a name needs them
    (two stand for "several"); distinct values are reduced on the cluster."""
    distinct = lambda c: metric.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c)
    return [r[0] for r in distinct("backend").collect()], [r[0] for r in distinct("run_timestamp").limit(2).collect()]


def root_levels(files: DataFrame) -> DataFrame:
    """Per root, its backend and timestamp; NULL where it has several or none."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return files.groupBy("root").agg(one("backend"), one("run_timestamp"))


def write_tables(method: DataFrame, metric: DataFrame, out_dir: str, base_name: str,
                 fmt: str = "csv", partition_by: Sequence[str] = ()) -> dict[str, str]:
    """Write both tables as CSV and/or parquet.

    Parquet keeps ``k_scores`` as a map (the canonical form); CSV, which has no
    map type, gets one column per k label in numeric order (the wide form of
    the reference).  Outputs are Spark directories named like the reference's
    files.  ``partition_by`` (e.g. backend, run_timestamp) enables partition
    pruning on large collections.  The tables are computed once: with both
    formats the CSV files are written from the parquet files.
    """
    written = {}
    targets = [k for k in ("parquet", "csv") if fmt in (k, "both")]
    for kind in targets:
        for prefix, df in ((METHOD_PREFIX, method), (METRIC_PREFIX, metric)):
            path = f"{out_dir.rstrip('/')}/{prefix}_{base_name}.{kind}"
            done = written.get(f"{prefix}.parquet")
            df = df.sparkSession.read.schema(df.schema).parquet(done) if done else df
            out = df
            if kind == "csv" and "k_scores" in df.columns:
                out = metric_wide(df)
            w = out.write.mode("overwrite")
            if partition_by:
                w = w.partitionBy(*partition_by)
            if kind == "csv":
                w.option("header", "true").csv(path)
            else:
                w.parquet(path)
            written[f"{prefix}.{kind}"] = path
    return written
