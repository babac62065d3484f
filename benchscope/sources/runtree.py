"""Reading run trees with Spark's file sources.

Three recursive scans over all roots at once -- score files and sidecars as
whole texts (gzip decoded by the text source), label files line by line --
each with a file-name glob, so Spark lists the trees in parallel and never
opens an unrelated file.  Tiny files are packed several to a task by
``spark.sql.files.openCostInBytes``.

A damaged file must not end the job, so the scans skip what cannot be read; nothing is
lost silently, though.  A listing (path and length, no contents) is compared with what
was read: a plain sidecar with its length, a gzip file with the length that gzip stores
in its last four bytes, which are fetched by position (see ``stored_lengths``).  So every
file is read once.  What does not agree is listed in ``unreadable``: a score file or
sidecar is then left out, and a labels file gets a line that no label reads as, which
makes it invalid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchscope.operators.ingest import PARAMS_FILE, PERF_FILE, SCORES_FILE, TIMING_FILE

SIDECAR_GLOB = "{" + ",".join([PARAMS_FILE, PERF_FILE, TIMING_FILE]) + "}"
LABELS_GLOB = "clustbench.labels*.gz"


def local_path(uri: Column) -> Column:
    """URI of a listed file -> plain path (scheme and authority removed,
    percent-escapes decoded, '+' kept)."""
    no_scheme = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.url_decode(F.regexp_replace(no_scheme, r"\+", "%2B"))


def _norm_root(root: str) -> str:
    r = root.rstrip("/") or "/"
    if "://" in r:
        r = "/" + r.split("://", 1)[1].split("/", 1)[1] if "/" in r.split("://", 1)[1] else "/"
    elif r.startswith("file:"):
        r = r[len("file:"):]
    return r


def existing_roots(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """Roots that exist (driver-side metadata calls, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for r in roots:
        p = jvm.org.apache.hadoop.fs.Path(r)
        fs = p.getFileSystem(conf)
        if fs.exists(p) and fs.getFileStatus(p).isDirectory():
            out.append(r)
    return out


def _root_of(path: Column, roots: Sequence[str]) -> Column:
    """The given root a file was listed under (longest matching prefix)."""
    expr = F.lit(None).cast("string")
    for r in sorted((_norm_root(x) for x in roots), key=len):
        prefix = r if r.endswith("/") else r + "/"
        expr = F.when(path.startswith(prefix), F.lit(r)).otherwise(expr)
    return expr


def _scan(spark: SparkSession, roots: Sequence[str], glob: str, whole: bool) -> DataFrame:
    reader = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
              .option("ignoreCorruptFiles", "true"))
    if not whole:
        reader = reader.option("lineSep", "\n")  # so that line lengths add up to the file's; labels are trimmed later
    df = reader.text(list(roots), wholetext=whole)
    return df.select(local_path(F.col("_metadata.file_path")).alias("path"), F.col("value"))


@dataclass(frozen=True)
class RunTree:
    scores: DataFrame       # path, root, content
    sidecars: DataFrame     # path, content
    label_lines: DataFrame  # path, line
    unreadable: DataFrame   # path, kind, detail


UNREADABLE = "unreadable_file"


#: Stores from which a worker can read a few bytes by position; others are read whole.
SEEKABLE = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
#: The shortest gzip file; a shorter one stores no length.
GZIP_LEAST = 18


def listing(spark: SparkSession, roots: Sequence[str], glob: str) -> DataFrame:
    """(uri, path, length) of every file; no contents are read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(list(roots)))
    return files.select(F.col("path").alias("uri"), local_path(F.col("path")).alias("path"), "length")


def stored_lengths(listed: DataFrame) -> DataFrame:
    """(path, stored): the text length (modulo 2^32) that the trailer of each listed gzip file states.

    A task opens its files one after another and reads four bytes at the end of each,
    whatever their size.  A file that cannot be opened, or is too short, has none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[tuple[str, str], fs.FileSystem] = {}
        for b in batches:
            uris, lengths = b.column(0).to_pylist(), b.column(2).to_pylist()
            found = [_stored(stores, uri, n) for uri, n in zip(uris, lengths)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.int64())], ["path", "stored"])

    return listed.select("uri", "path", "length").mapInArrow(run, "path string, stored long")


def _stored(stores: dict, uri: str, length: int) -> int | None:
    if length < GZIP_LEAST:
        return None
    scheme, _, rest = uri.partition(":")
    authority, slash, path = rest[2:].partition("/") if rest.startswith("//") else ("", "/", rest[1:])
    try:
        if (scheme, authority) not in stores:
            kind = SEEKABLE[scheme]
            stores[scheme, authority] = fs.LocalFileSystem() if kind == "file" else fs.FileSystem.from_uri(f"{kind}://{authority}/")[0]
        place = f"{authority}/{path}" if scheme.startswith("s3") or scheme == "gs" else slash + path
        with stores[scheme, authority].open_input_file(place) as f:
            f.seek(length - 4)
            return int.from_bytes(f.read(4), "little")
    except OSError:
        return None


def _listed(spark: SparkSession, roots: Sequence[str], glob: str) -> DataFrame:
    """(path, stored): every gzip file and the text length it states."""
    schemes = {r.partition(":")[0] if ":/" in r else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").partition(":")[0] for r in roots}
    if schemes <= set(SEEKABLE):
        return stored_lengths(listing(spark, roots, glob))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(list(roots)))
    # the last four bytes, least significant first
    byte = [F.substring(F.hex(F.substring("content", -4, 4)), 2 * i + 1, 2) for i in (3, 2, 1, 0)]
    return files.select(local_path(F.col("path")).alias("path"), F.conv(F.concat(*byte), 16, 10).cast("bigint").alias("stored"))


def _lost(listed: DataFrame, read: DataFrame) -> DataFrame:
    """Files whose text (path, n: bytes) does not have the stored length."""
    both = listed.join(read, "path", "left")
    whole = F.coalesce(F.array_contains("n", F.col("stored")), F.lit(False))
    return both.where(~whole).select("path", F.lit(UNREADABLE).alias("kind"),
                                     F.concat(F.lit("stored length "), F.coalesce(F.col("stored").cast("string"), F.lit("none"))).alias("detail"))


def read_run_tree(spark: SparkSession, roots: Sequence[str]) -> RunTree:
    """Scan every root (A18: many roots in one read).  Missing or empty roots
    contribute nothing; no root at all gives empty frames."""
    roots = existing_roots(spark, roots)
    if not roots:
        empty_scores = spark.createDataFrame([], "path string, root string, content string")
        return RunTree(empty_scores, spark.createDataFrame([], "path string, content string"),
                       spark.createDataFrame([], "path string, line string"),
                       spark.createDataFrame([], "path string, kind string, detail string"))
    scores = _scan(spark, roots, SCORES_FILE, True)
    scores = scores.select("path", _root_of(F.col("path"), roots).alias("root"), F.col("value").alias("content"))
    sidecars = _scan(spark, roots, SIDECAR_GLOB, True).select("path", F.col("value").alias("content"))
    # plain files: as long as their text
    plain = listing(spark, roots, SIDECAR_GLOB).select("path", F.col("length").alias("stored"))
    size = F.octet_length("content").cast("bigint")
    lost_sidecars = _lost(plain, sidecars.select("path", F.array(size).alias("n"))).where("detail != 'stored length 0'")
    sidecars = sidecars.join(lost_sidecars.select("path"), "path", "left_anti").select("path", "content")
    labels = _scan(spark, roots, LABELS_GLOB, False).select("path", F.col("value").alias("line"))
    size = F.octet_length("content").cast("bigint") % (1 << 32)
    lost_scores = _lost(_listed(spark, roots, SCORES_FILE), scores.select("path", F.array(size).alias("n")))
    scores = scores.join(lost_scores.select("path"), "path", "left_anti").select("path", "root", "content")
    # a labels file ends with or without a newline
    size = F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0))
    read = labels.groupBy("path").agg(F.array(size % (1 << 32), (size - 1) % (1 << 32)).alias("n"))
    lost_labels = _lost(_listed(spark, roots, LABELS_GLOB), read).where("detail != 'stored length 0'")
    labels = labels.unionByName(lost_labels.select("path", F.lit(UNREADABLE).alias("line")))
    return RunTree(scores, sidecars, labels, lost_scores.unionByName(lost_labels).unionByName(lost_sidecars))
