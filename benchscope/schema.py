"""Declared schemas and key lists of the two benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity of one method run (metric rows add ``metric``).
METHOD_KEY = ["source_dir", "backend", "run_timestamp", "dataset_generator",
              "dataset_name", "method", "seed"]
# Dataset x method, and dataset x method x metric groupings used throughout.
DM = ["dataset_generator", "dataset_name", "method"]
DMM = ["dataset_generator", "dataset_name", "method", "metric"]

QUALITY_FLAGS = ["duplicate_k_anomaly", "empty_file", "missing_true_k_score"]

_META = [
    ("source_dir", T.StringType()),
    ("backend", T.StringType()),
    ("run_timestamp", T.StringType()),
    ("dataset_generator", T.StringType()),
    ("dataset_name", T.StringType()),
    ("true_k", T.LongType()),
    ("has_noise", T.BooleanType()),
    ("method", T.StringType()),
    ("seed", T.LongType()),
]

METHOD_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in _META]
    + [T.StructField(n, t, True) for n, t in [
        ("execution_time_seconds", T.DoubleType()),
        ("runtime", T.DoubleType()),
        ("threads", T.LongType()),
        ("disk_read", T.LongType()),
        ("disk_write", T.LongType()),
        ("avg_load", T.DoubleType()),
        ("peak_rss", T.LongType()),
    ]])

METRIC_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in _META]
    + [T.StructField(n, t, True) for n, t in [
        ("metric", T.StringType()),
        ("score", T.DoubleType()),
        ("runtime", T.DoubleType()),
        ("duplicate_k_anomaly", T.BooleanType()),
        ("empty_file", T.BooleanType()),
        ("missing_true_k_score", T.BooleanType()),
        ("k_scores", T.MapType(T.StringType(), T.DoubleType())),
    ]])

METHOD_COLUMNS = [f.name for f in METHOD_SCHEMA.fields]
METRIC_META_COLUMNS = [f.name for f in METRIC_SCHEMA.fields if f.name != "k_scores"]


def nan_to_null(c: Column) -> Column:
    """R's ``na.rm`` drops NaN as well as NA; Spark aggregates propagate NaN."""
    return F.nanvl(c, F.lit(None).cast("double"))


def clean_nan(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL in every DOUBLE column (done once at load)."""
    cols = [nan_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)
