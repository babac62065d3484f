"""Loading the newest pair of tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchscope.schema import clean_nan

METHOD_PATTERN = re.compile(r"method-performance.*\.parquet$")
METRIC_PATTERN = re.compile(r"metric-performance.*\.parquet$")
METHOD_CATEGORIES = ["source_dir", "backend", "run_timestamp", "dataset_generator", "dataset_name", "method"]
METRIC_CATEGORIES = METHOD_CATEGORIES + ["metric"]
METRIC_FLAGS = ["has_noise", "duplicate_k_anomaly", "empty_file", "missing_true_k_score"]


class DataNotFoundError(FileNotFoundError):
    pass


def _list(spark: SparkSession, directory: str) -> list[tuple[str, str, int]]:
    """(name, full path, modification time) of the entries of ``directory``
    (files and Spark output directories alike), via Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(directory)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        raise DataNotFoundError(f"not a folder of results: {directory}")
    return [(s.getPath().getName(), s.getPath().toString(), s.getModificationTime()) for s in fs.listStatus(p)]


def find_latest_pair(spark: SparkSession, directory: str) -> dict[str, str]:
    """Newest method and metric outputs by modification time."""
    entries = _list(spark, directory)
    out = {}
    for kind, pat in (("method", METHOD_PATTERN), ("metric", METRIC_PATTERN)):
        cands = [e for e in entries if pat.search(e[0])]
        if not cands:
            raise DataNotFoundError(f"{directory} holds no {kind} table")
        out[kind] = max(cands, key=lambda e: (e[2], e[0]))[1]
    return out


def _tolerant_cast(df: DataFrame, strings: list[str], flags: list[str]) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in strings:
            c = c.cast("string")
        elif f.name in flags and not isinstance(f.dataType, T.BooleanType):
            c = c.cast("boolean")
        cols.append(c.alias(f.name))
    return clean_nan(df.select(*cols))


def cast_method(df: DataFrame) -> DataFrame:
    """A13's tolerant casts: category columns as strings, ``has_noise`` as
    boolean (only where present), NaN as NULL."""
    return _tolerant_cast(df, METHOD_CATEGORIES, ["has_noise"])


def cast_metric(df: DataFrame) -> DataFrame:
    """A14's tolerant casts: as A13 plus the boolean flag columns."""
    return _tolerant_cast(df, METRIC_CATEGORIES, METRIC_FLAGS)


def load_method(spark: SparkSession, path: str) -> DataFrame:
    """Read a method table (column pruning reaches the parquet scan)."""
    return cast_method(spark.read.parquet(path))


def load_metric(spark: SparkSession, path: str) -> DataFrame:
    """Read a metric table."""
    return cast_metric(spark.read.parquet(path))


def load_both(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """The newest pair of tables of ``directory``."""
    paths = find_latest_pair(spark, directory)
    return load_method(spark, paths["method"]), load_metric(spark, paths["metric"])


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """A table output -> method or metric by name; a directory holding
    outputs -> its newest metric table; anything else -> error."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        raise DataNotFoundError(f"no such result table: {path}")
    name = p.getName()
    if METHOD_PATTERN.search(name) or METRIC_PATTERN.search(name) or not fs.getFileStatus(p).isDirectory():
        return load_method(spark, path) if "method-performance" in name else load_metric(spark, path)
    return load_metric(spark, find_latest_pair(spark, path)["metric"])
