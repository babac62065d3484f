"""Ingest: the cost of a row, and searches by string arithmetic."""

import pytest
from pyspark.sql import functions as F

from benchscope.functions import paths as P
from benchscope.operators import ingest as ing

COMPILED = 8000  # bytes of a method that HotSpot compiles, at most; a longer one is interpreted, row after row
PATH = "/r/out_conda-202401011200/data/dataset_generator-g_dataset_name-d/clustering/method-a_seed-{}/metrics/partition_metrics/metric-m/clustbench.scores.gz"


def _inputs(spark, n=3):
    paths = [PATH.format(i) for i in range(n)]
    scores = spark.createDataFrame([(p, "/r", "k=2\n0.5\n") for p in paths], "path string, root string, content string")
    sidecars = spark.createDataFrame([(f"{p.rsplit('/', 1)[0]}/perf.json", '{"total_time_secs": 1.5}') for p in paths]
                                     + [(f"{p.rsplit('/', 4)[0]}/parameters.json", '{"method": "p", "seed": 4}') for p in paths[:1]], "path string, content string")
    labels = spark.createDataFrame([(f"{PATH[:PATH.index('/clustering')]}/clustbench.labels0.gz", x) for x in "12"], "path string, line string")
    return scores, sidecars, labels


def _stages(df):
    """Bytes of the largest method of each generated stage."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan at once
    try:
        found = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$") \
            .codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return {found.apply(i)._1().strip()[:90]: found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


TABLES = {
    "F1 build_method_rows": lambda i: ing.ingest(*i).method,
    "F2 build_metric_rows": lambda i: ing.ingest(*i).metric.drop("k_scores"),
    "F3 metric_wide": lambda i: ing.metric_wide(ing.ingest(*i).metric.drop("path"), ["k=2"]),
    "F4 coerce_seed": lambda i: ing.resolve(*i, (ing.METHOD,)).select("path", "seed"),
    "F5 extract_method_info": lambda i: ing.resolve(*i, (ing.METHOD,)).select("path", "method", "seed"),
    "F6 ingest_report": lambda i: ing.ingest_report(ing.ingest(*i).flags),
    "F7 metric_perf_json": lambda i: ing.resolve(*i, (ing.METRIC_PERF,)).select("path", "metric_runtime"),
}


@pytest.mark.parametrize("key", TABLES)
def test_code_of_every_stage_is_short_enough_to_be_compiled(spark, key):
    sizes = _stages(TABLES[key](_inputs(spark)))
    assert sizes and max(sizes.values()) <= COMPILED, [(k, v) for k, v in sizes.items() if v > COMPILED]


def test_texts_are_read_and_shuffled_once_for_all_lookups(spark):
    scores, sidecars, labels = _inputs(spark)
    df = ing.ingest(scores, sidecars.repartition(3, F.col("path")), labels).metric
    assert df.count() == 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [x for x in plan.split("\n") if "REPARTITION_BY_COL" in x and "Exchange hashpartitioning(key" in x]
    assert len([x for x in dealt if "ReusedExchange" not in x]) == 1 and len(dealt) > 1


def test_perf_json_that_no_score_file_meets_is_not_parsed(spark):
    scores, sidecars, _ = _inputs(spark)
    got = ing.resolve(scores, sidecars, spark.createDataFrame([], "path string, line string"), (ing.METRIC_PERF,))
    assert [r.metric_runtime for r in got.collect()] == [1.5] * 3
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = next(i for i, x in enumerate(plan) if "Join" in x)
    assert not any("from_json" in x.lower() or "jsontostructs" in x.lower() for x in plan[joined:])
    assert any("from_json" in x.lower() or "jsontostructs" in x.lower() for x in plan[:joined])


def test_directories_by_string_arithmetic_equal_the_regexes(spark):
    a, b = "dataset_generator-g_dataset_name-d", "dataset_name-d_dataset_generator-g"
    dirs = [f"/r/{a}/method-a/x/m", f"/r/{b}/xmethod-a_seed-1/m", f"/r/{a}/dataset_generator-only/method-", "/method-a", "", "/", "method-a/x",
            "/r/method-a/agglomerative/linkage-w", "/r/sklearn/linkage-w_seed-4/m", "/r//method-a//m", "/r/method-a\nb/m", "/r /method-a/m",
            "/method-a" + "/x" * 4, "/method-a" + "/x" * 5, "/method-a" + "/x" * 9, "/method-a" + "/x" * 10, f"/{a}" + "/x" * 10, "/r/xmethod-a/m", "/r/m/"]
    paths = [f"{d}/clustbench.scores.gz" for d in dirs] + ["/r/method-b/method-f", "/r/m/method-f", f"/r/{a}/{a}"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    path, libs = F.col("path"), "|".join(P.LINKAGE_LIBRARIES)
    name = rf"(?:method-[^/]*|[^/]*method-(?:(?!/).)+?_seed-\d[^/]*|(?<=/(?:{libs})/)linkage-[^/]*)"
    (x, y), exact = P.DATASET_TOKENS, lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    got = df.select(path, P.method_dir(path, 10).alias("m"), exact(r"^(.*/[^/]*method-[^/]*)(?:/[^/]+){1,10}$").alias("m_"),
                    P.dataset_dir(path, 10).alias("d"), exact(rf"^(.*/[^/]*(?:{x}[^/]*{y}|{y}[^/]*{x})[^/]*)(?:/[^/]+){{1,10}}$").alias("d_"),
                    P.method_anchor(path, 5).alias("a"), exact(rf"(?U)^(.*/{name})(?:/[^/]+){{1,5}}$").alias("a_")).collect()
    for r in got:
        assert (r.m, r.d, r.a) == (r.m_, r.d_, r.a_), r.path
    assert {r.m is None for r in got} == {r.d is None for r in got} == {r.a is None for r in got} == {True, False}
