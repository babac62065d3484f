"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Each oracle restates a query from its definition in plain SQL over the
driver's tables; the views the queries run on are spelled out as CTEs.  The
driver runs these next to the Spark plans and compares the results.
"""

from __future__ import annotations

from benchscope.plans.model_oracles import model_oracles

VIEW_CTES = r"""
metric_runs AS (
  SELECT 'out_' || lower(l_returnflag) || '-' || CAST(year(l_shipdate) AS VARCHAR) AS source_dir,
    lower(l_returnflag) AS backend, CAST(year(l_shipdate) AS VARCHAR) AS run_timestamp,
    lower(l_linestatus) AS dataset_generator, 'd' || CAST(l_suppkey % 5 AS VARCHAR) AS dataset_name,
    2 + (l_suppkey % 5) % 3 AS true_k, (l_suppkey % 5) = 4 AS has_noise,
    'm' || CAST(l_partkey % 8 AS VARCHAR) AS method,
    CASE WHEN l_partkey % 8 < 2 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS seed,
    CASE l_orderkey % 4 WHEN 0 THEN 'ami' WHEN 1 THEN 'ari' WHEN 2 THEN 'fm' ELSE 'nca' END AS metric,
    CASE WHEN l_orderkey % 50 = 7 THEN NULL
         WHEN l_partkey % 8 = 0 THEN CAST(1 + l_suppkey % 5 AS DOUBLE) / 8
         ELSE l_quantity / 64 END AS score,
    CASE WHEN l_orderkey % 61 = 3 THEN NULL
         ELSE CAST(1 + l_partkey % 199 AS DOUBLE) / 8 END AS execution_time_seconds,
    CASE WHEN l_orderkey % 61 = 3 THEN NULL
         ELSE CAST(floor(l_extendedprice) AS DOUBLE) / 1024 END AS runtime,
    1024 * (1 + l_suppkey % 50) + l_partkey % 1024 AS peak_rss,
    l_orderkey % 97 = 0 AS duplicate_k_anomaly, l_orderkey % 50 = 7 AS empty_file,
    l_orderkey % 89 = 1 AS missing_true_k_score,
    l_orderkey AS src_order, l_linenumber AS src_line, l_partkey AS src_part, l_quantity AS src_qty
  FROM lineitem),
method_runs AS (
  SELECT source_dir, backend, run_timestamp, dataset_generator, dataset_name, true_k, has_noise, method,
         seed, execution_time_seconds, runtime, peak_rss
  FROM (SELECT *, row_number() OVER (PARTITION BY source_dir, backend, run_timestamp, dataset_generator,
          dataset_name, method, seed ORDER BY src_order, src_line, src_part, src_qty) AS rn
        FROM metric_runs) t WHERE rn = 1),
raw_paths AS (
  SELECT *, run_path || '/data/dataset_generator-' || dataset_generator || '_dataset_name-' || dataset_name AS dataset_path,
    run_path || '/data/dataset_generator-' || dataset_generator || '_dataset_name-' || dataset_name
      || '/clustering/method-' || method
      || CASE WHEN seed IS NULL THEN '' ELSE '_seed-' || CAST(seed AS VARCHAR) END AS method_path
  FROM (SELECT *, '/bench/' || CAST(src_order AS VARCHAR) || '_' || CAST(src_line AS VARCHAR) || '_'
          || CAST(src_part AS VARCHAR) || '_' || CAST(CAST(floor(src_qty) AS BIGINT) AS VARCHAR)
          || '/' || source_dir AS run_path FROM metric_runs) t),
raw_scores AS (
  SELECT method_path || '/metrics/partition_metrics/metric-' || metric || '/clustbench.scores.gz' AS path,
    CASE WHEN score IS NULL THEN ''
      WHEN duplicate_k_anomaly THEN 'k=2,k=3,k=3' || chr(10) || '0.25,' || CAST(score AS VARCHAR) || ',0.125' || chr(10)
      ELSE '"k=2","k=3"' || chr(10) || CAST(score AS VARCHAR) || CASE WHEN src_order % 53 = 5 THEN ',n/a' ELSE ',0.5' END || chr(10)
    END AS content
  FROM raw_paths),
raw_sidecars AS (
  SELECT method_path || '/perf.json' AS path, '{"max_threads": 4, "peak_mem_rss_kb": ' || CAST(peak_rss AS VARCHAR)
    || CASE WHEN runtime IS NULL THEN '' ELSE ', "total_time_secs": ' || CAST(runtime AS VARCHAR) END || '}' AS content FROM raw_paths
  UNION ALL
  SELECT method_path || '/clustbench_performance.txt', 'usr' || chr(9) || 's' || chr(10) || '0' || chr(9)
    || CASE WHEN execution_time_seconds IS NULL THEN '-' ELSE CAST(execution_time_seconds AS VARCHAR) END || chr(10) FROM raw_paths
  UNION ALL
  SELECT method_path || '/metrics/partition_metrics/metric-' || metric || '/perf.json',
    '{"total_time_secs": ' || CAST(src_line AS VARCHAR) || '.5}' FROM raw_paths
  UNION ALL
  SELECT method_path || '/parameters.json', '{"method": "alt-' || method || '", "seed": ' || CAST(src_line AS VARCHAR) || '}'
    FROM raw_paths WHERE src_order % 10 = 0
  UNION ALL
  SELECT dataset_path || '/clustbench.labels0.gz', CASE WHEN has_noise THEN '0' || chr(10) ELSE '' END || '1' || chr(10) || '2.0' || chr(10)
    || CASE WHEN src_order % 71 = 9 THEN 'unlabelled' || chr(10) ELSE '' END
    || CASE WHEN true_k >= 3 THEN '3' || chr(10) ELSE '' END || CASE WHEN true_k >= 4 THEN '4' || chr(10) ELSE '' END FROM raw_paths),
metric AS (SELECT * EXCLUDE (src_order, src_line, src_part, src_qty, execution_time_seconds, peak_rss) FROM metric_runs),
method AS (SELECT * FROM method_runs),
combined AS (
  SELECT m.*, d.execution_time_seconds FROM metric m LEFT JOIN method d
    ON m.source_dir IS NOT DISTINCT FROM d.source_dir AND m.backend IS NOT DISTINCT FROM d.backend
   AND m.run_timestamp IS NOT DISTINCT FROM d.run_timestamp
   AND m.dataset_generator IS NOT DISTINCT FROM d.dataset_generator
   AND m.dataset_name IS NOT DISTINCT FROM d.dataset_name AND m.method IS NOT DISTINCT FROM d.method
   AND m.seed IS NOT DISTINCT FROM d.seed)"""

DMM = "dataset_generator, dataset_name, method, metric"
DM = "dataset_generator, dataset_name, method"

ORACLES: dict[str, str] = {}


def oracle(key: str, sql: str) -> None:
    ORACLES[key] = sql.strip()


def full_sql(body: str) -> str:
    """Prefix the view CTEs; a body starting with WITH adds its own CTEs."""
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + VIEW_CTES.strip() + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + VIEW_CTES.strip() + ",\n" + body[4:].lstrip()
    return "WITH " + VIEW_CTES.strip() + "\n" + body


# ---------------------------------------------------------------- consistency
_CONSISTENCY = f"""
  SELECT {DMM},
    CAST(count(DISTINCT run_timestamp) + max(CAST(run_timestamp IS NULL AS INTEGER)) AS BIGINT) AS n_repetitions,
    avg(score) AS mean_score, min(score) AS min_score, max(score) AS max_score,
    max(score) - min(score) AS score_range, round(stddev_samp(score), 6) AS score_sd,
    coalesce(max(score) - min(score) = 0, false) AS is_consistent
  FROM metric GROUP BY {DMM}"""

oracle("score_consistency", _CONSISTENCY)
oracle("consistency_rejoin", f"""
WITH cons AS ({_CONSISTENCY}),
pairs AS (SELECT DISTINCT backend, {DMM} FROM metric)
SELECT p.backend, p.dataset_generator, p.dataset_name, p.method, p.metric, c.n_repetitions, c.mean_score,
       c.min_score, c.max_score, c.score_range, c.score_sd, c.is_consistent
FROM pairs p JOIN cons c ON p.dataset_generator IS NOT DISTINCT FROM c.dataset_generator
  AND p.dataset_name IS NOT DISTINCT FROM c.dataset_name AND p.method IS NOT DISTINCT FROM c.method
  AND p.metric IS NOT DISTINCT FROM c.metric""")
oracle("backend_consistency", f"""
WITH cons AS ({_CONSISTENCY}),
pairs AS (SELECT DISTINCT backend, {DMM} FROM metric),
j AS (SELECT p.backend, c.* FROM pairs p JOIN cons c ON p.dataset_generator IS NOT DISTINCT FROM c.dataset_generator
  AND p.dataset_name IS NOT DISTINCT FROM c.dataset_name AND p.method IS NOT DISTINCT FROM c.method
  AND p.metric IS NOT DISTINCT FROM c.metric)
SELECT backend, CAST(count(*) AS BIGINT) AS total_combinations,
  CAST(sum(CASE WHEN is_consistent THEN 1 ELSE 0 END) AS BIGINT) AS consistent_combinations,
  round(100.0 * sum(CASE WHEN is_consistent THEN 1 ELSE 0 END) / count(*), 2) AS percent_consistent,
  round(avg(score_range), 6) AS avg_score_range, max(score_range) AS max_score_range
FROM j GROUP BY backend""")
oracle("consistency_overall", f"""
WITH cons AS ({_CONSISTENCY})
SELECT CAST(count(*) AS BIGINT) AS total_combinations,
  CAST(sum(CASE WHEN is_consistent THEN 1 ELSE 0 END) AS BIGINT) AS consistent_combinations,
  round(100.0 * sum(CASE WHEN is_consistent THEN 1 ELSE 0 END) / count(*), 2) AS percent_consistent
FROM cons""")
oracle("top_inconsistent", f"""
WITH cons AS ({_CONSISTENCY})
SELECT * FROM cons WHERE NOT is_consistent
ORDER BY score_range DESC NULLS LAST, dataset_generator, dataset_name, method, metric LIMIT 10""")


def _cv_raw(sd: str, mean: str) -> str:
    """R's sd / mean with zero-mean handling."""
    return (f"(CASE WHEN ({sd}) IS NULL OR ({mean}) IS NULL THEN NULL "
            f"WHEN ({mean}) = 0 THEN CASE WHEN ({sd}) > 0 THEN CAST('inf' AS DOUBLE) ELSE NULL END "
            f"ELSE ({sd}) / ({mean}) END)")


def _cv(sd: str, mean: str) -> str:
    return f"round({_cv_raw(sd, mean)}, 6)"


def _ns(a: str, b: str, cols: str) -> str:
    """NULL-safe equality of two aliases over a comma list of columns."""
    return " AND ".join(f"{a}.{c.strip()} IS NOT DISTINCT FROM {b}.{c.strip()}" for c in cols.split(","))


_DS = "coalesce(dataset_generator, 'NA') || '_' || coalesce(dataset_name, 'NA')"
_HUNDRED = "CAST(100 AS DOUBLE)"

# ---------------------------------------------------------------- variability
_T = "execution_time_seconds"
oracle("time_variability", f"""
SELECT {DM}, CAST(count(*) AS BIGINT) AS n_seeds, avg({_T}) AS mean_execution_time,
  median({_T}) AS median_execution_time, round(stddev_samp({_T}), 6) AS sd_execution_time,
  {_cv(f'stddev_samp({_T})', f'avg({_T})')} AS cv_execution_time,
  min({_T}) AS min_execution_time, max({_T}) AS max_execution_time, max({_T}) - min({_T}) AS range_execution_time
FROM method WHERE seed IS NOT NULL GROUP BY {DM}""")
oracle("score_variability", f"""
SELECT {DMM}, CAST(count(*) AS BIGINT) AS n_seeds, avg(score) AS mean_score, median(score) AS median_score,
  round(stddev_samp(score), 6) AS sd_score, {_cv('stddev_samp(score)', 'abs(avg(score))')} AS cv_score,
  min(score) AS min_score, max(score) AS max_score, max(score) - min(score) AS range_score
FROM metric WHERE seed IS NOT NULL GROUP BY {DMM}""")
_SEED_CV = lambda grp, src: f"""
SELECT {grp}, CAST(count(*) AS BIGINT) AS n_seeds, avg(score) AS mean_score, stddev_samp(score) AS sd_score,
  {_cv_raw('stddev_samp(score)', 'abs(avg(score))')} AS cv_score
FROM {src} WHERE seed IS NOT NULL GROUP BY {grp} HAVING count(*) > 1"""  # noqa: E731
_CV_PLACES = "REPLACE (round(sd_score, 6) AS sd_score, round(cv_score, 6) AS cv_score)"
oracle("seed_cv", f"SELECT * {_CV_PLACES} FROM ({_SEED_CV(DMM, 'metric')}) s")
oracle("seed_top_methods", f"""
WITH combos AS (SELECT DISTINCT dataset_generator, dataset_name, metric FROM metric
                ORDER BY dataset_generator NULLS LAST, dataset_name NULLS LAST, metric NULLS LAST LIMIT 4),
runs AS (SELECT m.* FROM metric m JOIN combos c USING (dataset_generator, dataset_name, metric) WHERE m.seed IS NOT NULL),
stats AS (SELECT dataset_generator, dataset_name, metric, method, avg(score) AS method_mean_score,
            row_number() OVER (PARTITION BY dataset_generator, dataset_name, metric
                               ORDER BY avg(score) DESC NULLS LAST, method) AS method_rank
          FROM runs GROUP BY dataset_generator, dataset_name, metric, method HAVING count(*) > 1)
SELECT r.dataset_generator, r.dataset_name, r.metric, r.method, s.method_rank, s.method_mean_score, r.backend,
       r.run_timestamp, r.seed, r.score
FROM runs r JOIN stats s USING (dataset_generator, dataset_name, metric, method) WHERE s.method_rank <= 8""")
oracle("seed_heatmap", f"""
WITH mets AS (SELECT metric FROM metric GROUP BY metric ORDER BY count(*) DESC, metric NULLS LAST LIMIT 3),
cvs AS ({_SEED_CV("metric, " + DM, "(SELECT * FROM metric WHERE metric IN (SELECT metric FROM mets))")}),
mr AS (SELECT metric, method FROM (SELECT metric, method, row_number() OVER (PARTITION BY metric
         ORDER BY avg(cv_score) DESC NULLS LAST, method) AS r FROM cvs GROUP BY metric, method) t WHERE r <= 12),
dr AS (SELECT metric, dataset_generator, dataset_name FROM (SELECT metric, dataset_generator, dataset_name,
         row_number() OVER (PARTITION BY metric ORDER BY avg(cv_score) DESC NULLS LAST, dataset_generator, dataset_name) AS r
       FROM cvs GROUP BY metric, dataset_generator, dataset_name) t WHERE r <= 8)
SELECT c.* {_CV_PLACES}, {_DS} AS dataset FROM cvs c
WHERE EXISTS (SELECT 1 FROM mr WHERE mr.metric = c.metric AND mr.method = c.method)
  AND EXISTS (SELECT 1 FROM dr WHERE dr.metric = c.metric AND dr.dataset_generator = c.dataset_generator
              AND dr.dataset_name = c.dataset_name)""")

# ---------------------------------------------------------------- comparisons
oracle("avg_time_by_backend", f"SELECT backend, {DM}, avg({_T}) AS avg_execution_time FROM method GROUP BY backend, {DM}")
oracle("avg_score_by_backend", f"SELECT backend, {DMM}, avg(score) AS avg_score FROM metric GROUP BY backend, {DMM}")
_TP = f"""
WITH a AS (SELECT backend, {DM}, avg({_T}) AS v FROM method GROUP BY backend, {DM})
SELECT a.backend AS backend1, b.backend AS backend2, a.dataset_generator, a.dataset_name, a.method,
       a.v AS avg_execution_time_b1, b.v AS avg_execution_time_b2
FROM a JOIN a AS b ON a.backend < b.backend AND {_ns('a', 'b', DM)}"""
_SP = f"""
WITH a AS (SELECT backend, {DMM}, avg(score) AS v FROM metric GROUP BY backend, {DMM})
SELECT a.backend AS backend1, b.backend AS backend2, a.dataset_generator, a.dataset_name, a.method, a.metric,
       a.v AS avg_score_b1, b.v AS avg_score_b2
FROM a JOIN a AS b ON a.backend < b.backend AND {_ns('a', 'b', DMM)}"""
oracle("backend_time_pairs", _TP)
oracle("backend_score_pairs", _SP)
oracle("backend_pairs", """
WITH lv AS (SELECT DISTINCT backend FROM metric WHERE backend IS NOT NULL)
SELECT a.backend AS backend1, b.backend AS backend2 FROM lv a JOIN lv b ON a.backend < b.backend""")
oracle("compare_backends", f"""
SELECT 'execution_time' AS kind, backend1, backend2, dataset_generator, dataset_name, method,
       CAST(NULL AS VARCHAR) AS metric, avg_execution_time_b1 AS value_b1, avg_execution_time_b2 AS value_b2
FROM ({_TP}) t
UNION ALL
SELECT 'score', backend1, backend2, dataset_generator, dataset_name, method, metric, avg_score_b1, avg_score_b2
FROM ({_SP}) s""")

# ---------------------------------------------------------------- joins
oracle("combined_runs", "SELECT * FROM combined")
_TOPDS = lambda n: f"""(SELECT dataset_generator, dataset_name FROM method GROUP BY dataset_generator, dataset_name
  ORDER BY count(*) DESC, dataset_generator NULLS LAST, dataset_name NULLS LAST LIMIT {n})"""  # noqa: E731
_TOPM = lambda src, n: f"""(SELECT method FROM {src} GROUP BY method ORDER BY count(*) DESC, method NULLS LAST LIMIT {n})"""
oracle("semi_join_datasets", f"""
SELECT m.* FROM method m WHERE EXISTS (SELECT 1 FROM {_TOPDS(8)} t
  WHERE t.dataset_generator IS NOT DISTINCT FROM m.dataset_generator AND t.dataset_name IS NOT DISTINCT FROM m.dataset_name)""")
_KEY = "source_dir, backend, run_timestamp, dataset_generator, dataset_name, method, seed"
oracle("key_set_check", f"""
SELECT {_KEY}, 'method_only' AS side FROM (SELECT DISTINCT {_KEY} FROM method) a
 WHERE NOT EXISTS (SELECT 1 FROM metric b WHERE {_ns('a', 'b', _KEY)})
UNION ALL
SELECT {_KEY}, 'metric_only' FROM (SELECT DISTINCT {_KEY} FROM metric) a
 WHERE NOT EXISTS (SELECT 1 FROM method b WHERE {_ns('a', 'b', _KEY)})""")

# ---------------------------------------------------------------- summaries
oracle("method_summary", f"""
SELECT backend, CAST(count(*) AS BIGINT) AS total_runs,
  CAST(count(DISTINCT {{'g': dataset_generator, 'n': dataset_name}}) AS BIGINT) AS datasets,
  CAST(count(DISTINCT method) + max(CAST(method IS NULL AS INTEGER)) AS BIGINT) AS methods,
  avg({_T}) AS avg_execution_time, avg(runtime) AS avg_runtime,
  median({_T}) AS med_execution_time, median(runtime) AS med_runtime
FROM method GROUP BY backend""")
oracle("metric_summary", """
SELECT backend, metric, CAST(count(*) AS BIGINT) AS total_evaluations, avg(score) AS avg_score,
  min(score) AS min_score, max(score) AS max_score, median(score) AS med_score
FROM metric GROUP BY backend, metric""")
_RT = lambda src: f"""
SELECT backend, CAST(count(*) AS BIGINT) AS count, avg(runtime) AS mean_runtime, round(stddev_samp(runtime), 6) AS sd_runtime,
  min(runtime) AS min_runtime, max(runtime) AS max_runtime, median(runtime) AS median_runtime
FROM {src} WHERE runtime IS NOT NULL GROUP BY backend"""  # noqa: E731
oracle("runtime_summary_method", _RT("method"))
oracle("runtime_summary_metric", _RT("metric"))
oracle("peak_rss_range", """
SELECT CAST(count(peak_rss) AS BIGINT) AS n_with_peak_rss, min(peak_rss) AS min_peak_rss, max(peak_rss) AS max_peak_rss FROM method""")
_RSSDATA = f"""
rssd AS (SELECT m.*, {_DS} AS dataset, peak_rss / 1024 AS peak_rss_mb FROM method m
  WHERE peak_rss IS NOT NULL
    AND EXISTS (SELECT 1 FROM {_TOPDS(8)} t WHERE t.dataset_generator IS NOT DISTINCT FROM m.dataset_generator
                AND t.dataset_name IS NOT DISTINCT FROM m.dataset_name)
    AND EXISTS (SELECT 1 FROM {_TOPM('method', 8)} t WHERE t.method IS NOT DISTINCT FROM m.method))"""
oracle("peak_rss_summary", f"""
WITH {_RSSDATA}
SELECT dataset, method, CAST(count(*) AS BIGINT) AS count, avg(peak_rss_mb) AS mean_rss_mb,
  max(peak_rss_mb) AS max_rss_mb, median(peak_rss_mb) AS median_rss_mb
FROM rssd GROUP BY dataset, method ORDER BY mean_rss_mb DESC NULLS LAST, dataset, method LIMIT 10""")
oracle("peak_rss_heatmap", f"""
WITH {_RSSDATA}
SELECT dataset, method, avg(peak_rss_mb) AS mean_rss_mb FROM rssd GROUP BY dataset, method""")
_RMP = f"""
SELECT method, dataset_generator, dataset_name, avg(runtime) AS avg_runtime, avg(peak_rss / 1024) AS avg_peak_rss_mb
FROM {{src}} WHERE runtime IS NOT NULL AND peak_rss IS NOT NULL GROUP BY method, dataset_generator, dataset_name"""
oracle("runtime_memory_points", _RMP.format(src="method"))
_LARGEST = """
SELECT dataset_generator, dataset_name, CAST(count(*) AS BIGINT) AS n_runs, avg(runtime) AS avg_runtime,
  avg(peak_rss) AS avg_memory
FROM method WHERE runtime IS NOT NULL AND peak_rss IS NOT NULL GROUP BY dataset_generator, dataset_name
ORDER BY avg_memory DESC NULLS LAST, dataset_generator, dataset_name LIMIT 1"""
oracle("largest_dataset", _LARGEST)
_CT = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
oracle("quality_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS total_records,
  {_CT('empty_file')} AS empty_files, round({_HUNDRED} * {_CT('empty_file')} / count(*), 2) AS pct_empty_files,
  {_CT('duplicate_k_anomaly')} AS duplicate_k_anomalies,
  round({_HUNDRED} * {_CT('duplicate_k_anomaly')} / count(*), 2) AS pct_duplicate_k_anomalies,
  {_CT('missing_true_k_score')} AS missing_true_k_scores,
  round({_HUNDRED} * {_CT('missing_true_k_score')} / count(*), 2) AS pct_missing_true_k_scores
FROM metric""")
oracle("quality_by_method", f"""
SELECT * FROM (SELECT backend, method, CAST(count(*) AS BIGINT) AS total, {_CT('empty_file')} AS empty_files,
  {_CT('duplicate_k_anomaly')} AS duplicate_k, {_CT('missing_true_k_score')} AS missing_true_k
  FROM metric GROUP BY backend, method) t
WHERE empty_files > 0 OR duplicate_k > 0 OR missing_true_k > 0""")
oracle("data_overview", """
SELECT * FROM (SELECT CAST(count(*) AS BIGINT) AS method_runs, CAST(count(DISTINCT backend) AS BIGINT) AS backends,
  CAST(count(DISTINCT dataset_generator) AS BIGINT) AS dataset_generators,
  CAST(count(DISTINCT dataset_name) AS BIGINT) AS dataset_names, CAST(count(DISTINCT method) AS BIGINT) AS methods,
  CAST(count(DISTINCT seed) AS BIGINT) AS unique_seeds, CAST(count(DISTINCT run_timestamp) AS BIGINT) AS run_timestamps,
  CAST(count(DISTINCT {'g': dataset_generator, 'n': dataset_name}) AS BIGINT) AS unique_datasets FROM method) a,
 (SELECT CAST(count(*) AS BIGINT) AS metric_evaluations, CAST(count(DISTINCT metric) AS BIGINT) AS metrics FROM metric) b""")
oracle("time_overall", f"""
SELECT avg({_T}) AS mean_time, min({_T}) AS min_time, max({_T}) AS max_time, median({_T}) AS median_time FROM method""")
oracle("score_by_metric", "SELECT metric, avg(score) AS mean_score, median(score) AS median_score FROM metric GROUP BY metric")
oracle("completeness", f"""
SELECT round({_HUNDRED} * (1 - {_CT('empty_file')} / count(*)), 1) AS completeness_pct FROM metric""")
oracle("kpi_boxes", """
SELECT CAST(count(DISTINCT backend) AS BIGINT) AS backends,
  CAST(count(DISTINCT {'g': dataset_generator, 'n': dataset_name}) AS BIGINT) AS datasets,
  CAST(count(DISTINCT method) AS BIGINT) AS methods, CAST(count(DISTINCT metric) AS BIGINT) AS metrics,
  avg(score) AS average_score FROM metric""")
oracle("method_backend_scores", "SELECT backend, method, avg(score) AS avg_score FROM metric GROUP BY backend, method")
oracle("dataset_performance", f"""
SELECT {DM}, avg(score) AS avg_score, avg({_T}) AS avg_time FROM combined GROUP BY {DM}""")
oracle("first_metric_heatmap", """
SELECT dataset_name, method, avg(score) AS avg_score FROM metric
WHERE metric = (SELECT min(metric) FROM metric) GROUP BY dataset_name, method""")
_MC = f"""
SELECT method, backend, avg(score) AS avg_score, stddev_samp(score) AS std_dev, min(score) AS min_score,
  max(score) AS max_score, avg({_T}) AS avg_time FROM combined GROUP BY method, backend"""
oracle("method_comparison", f"SELECT * REPLACE (round(std_dev, 6) AS std_dev) FROM ({_MC}) mc")
oracle("radar", f"""
WITH mc AS ({_MC}),
per AS (SELECT method, avg(avg_score) AS score,
          CASE WHEN avg(avg_time) IS NULL THEN NULL WHEN avg(avg_time) = 0 THEN CAST('inf' AS DOUBLE)
               ELSE 1 / avg(avg_time) END AS speed FROM mc GROUP BY method),
b AS (SELECT min(score) AS ls, max(score) AS hs, min(speed) AS lp, max(speed) AS hp FROM per)
SELECT method, round(score, 6) AS score, round(speed, 6) AS speed,
  round(CASE WHEN score IS NULL THEN NULL WHEN hs = ls THEN 0.5 ELSE (score - ls) / (hs - ls) END, 6) AS score_scaled,
  round(CASE WHEN speed IS NULL THEN NULL WHEN hp = lp THEN 0.5 ELSE (speed - lp) / (hp - lp) END, 6) AS speed_scaled
FROM per, b""")
oracle("method_counts", "SELECT method, CAST(count(*) AS BIGINT) AS n FROM method GROUP BY method")
oracle("metric_counts", "SELECT metric, CAST(count(*) AS BIGINT) AS n FROM metric GROUP BY metric")
oracle("distinct_rows", f"SELECT DISTINCT backend, {DMM} FROM metric")
oracle("unique_seeds", "SELECT DISTINCT seed FROM method WHERE seed IS NOT NULL")

# ---------------------------------------------------------------- filters
oracle("project_columns", f"SELECT backend, {DMM}, score FROM metric")
oracle("dataset_key", f"SELECT DISTINCT {_DS} AS dataset FROM method")
oracle("rss_mb", "SELECT source_dir, dataset_generator, dataset_name, method, seed, peak_rss / 1024 AS peak_rss_mb FROM method")
oracle("not_null_filter", "SELECT * FROM metric WHERE seed IS NOT NULL AND score IS NOT NULL AND true_k IS NOT NULL")
oracle("eq_filter", "SELECT * FROM metric WHERE metric = 'ari' AND backend = 'r'")
oracle("in_list_filter", f"SELECT * FROM method WHERE method IN {_TOPM('method', 3)}")
oracle("score_range_filter", "SELECT * FROM metric WHERE score BETWEEN -1 AND 1")
oracle("group_size_filter", """
SELECT m.* FROM metric m JOIN (SELECT dataset_generator, dataset_name, method, metric, backend FROM metric
  WHERE seed IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) g
  ON m.dataset_generator IS NOT DISTINCT FROM g.dataset_generator AND m.dataset_name IS NOT DISTINCT FROM g.dataset_name
 AND m.method IS NOT DISTINCT FROM g.method AND m.metric IS NOT DISTINCT FROM g.metric
 AND m.backend IS NOT DISTINCT FROM g.backend
WHERE m.seed IS NOT NULL""")
oracle("having_filter", "SELECT metric, method, CAST(count(*) AS BIGINT) AS n_runs FROM metric GROUP BY metric, method HAVING count(*) >= 5")
oracle("dashboard_filter", f"""
SELECT * FROM combined WHERE backend = 'n' AND dataset_generator = 'o' AND {_T} BETWEEN 1.0 AND 20.0""")
oracle("has_seed_data", """
SELECT CAST(count(DISTINCT seed) AS BIGINT) AS n_seeds, coalesce(min(seed) < max(seed), false) AS has_seed_data FROM method""")
oracle("multi_backend_guard", """
SELECT CAST(count(DISTINCT backend) AS BIGINT) AS n_backends, coalesce(min(backend) < max(backend), false) AS multi_backend
FROM metric""")
oracle("time_slider_bounds", f"SELECT CAST(0 AS DOUBLE) AS min_time, max({_T}) AS max_time FROM combined")
oracle("filter_choices", """
SELECT DISTINCT 'backend' AS "column", backend AS level FROM metric WHERE backend IS NOT NULL
UNION ALL SELECT DISTINCT 'method', method FROM metric WHERE method IS NOT NULL
UNION ALL SELECT DISTINCT 'dataset_generator', dataset_generator FROM metric WHERE dataset_generator IS NOT NULL
UNION ALL SELECT DISTINCT 'metric', metric FROM metric WHERE metric IS NOT NULL""")
oracle("score_table", f"""
SELECT backend, dataset_generator, dataset_name, method, metric, score, {_T} FROM combined WHERE metric = 'ari'
ORDER BY score DESC NULLS LAST, backend NULLS LAST, dataset_generator NULLS LAST, dataset_name NULLS LAST,
  method NULLS LAST, metric NULLS LAST, {_T} NULLS LAST
LIMIT 10 OFFSET 10""")

# ---------------------------------------------------------------- pareto
_DOM = lambda x, y, extra="": f"""NOT EXISTS (SELECT 1 FROM pts q WHERE {extra} q.{x} <= p.{x} AND q.{y} {{cmp}} p.{y}
  AND (q.{x} <> p.{x} OR q.{y} <> p.{y}))"""  # noqa: E731
_RM_FRONT = f"""
WITH pts AS ({_RMP.format(src="{src}")})
SELECT p.*, {_DOM('avg_runtime', 'avg_peak_rss_mb').format(cmp='<=')} AS is_pareto FROM pts p"""
oracle("pareto_frontier", _RM_FRONT.format(src="method"))
oracle("frontier_step", f"SELECT * FROM ({_RM_FRONT.format(src='method')}) f WHERE is_pareto")
oracle("largest_dataset_frontier", _RM_FRONT.format(
    src=f"(SELECT m.* FROM method m JOIN ({_LARGEST}) l USING (dataset_generator, dataset_name)) lm"))
_PMM = f"""
SELECT method, CAST(count(*) AS BIGINT) AS datasets_on_frontier, avg(avg_runtime) AS avg_runtime_sec,
  avg(avg_peak_rss_mb) AS avg_memory_mb, min(avg_runtime) AS min_runtime_sec, max(avg_runtime) AS max_runtime_sec,
  min(avg_peak_rss_mb) AS min_memory_mb, max(avg_peak_rss_mb) AS max_memory_mb
FROM ({_RM_FRONT.format(src='method')}) f WHERE is_pareto GROUP BY method"""
_PMM_PLACES = "REPLACE (round(avg_runtime_sec, 6) AS avg_runtime_sec, round(avg_memory_mb, 6) AS avg_memory_mb)"
oracle("pareto_memory_methods", f"SELECT * {_PMM_PLACES} FROM ({_PMM}) s")
oracle("fastest_frontier", f"SELECT * EXCLUDE (r) {_PMM_PLACES} FROM (SELECT *, rank() OVER (ORDER BY avg_runtime_sec NULLS LAST) AS r FROM ({_PMM}) s) t WHERE r <= 3")
oracle("leanest_frontier", f"SELECT * EXCLUDE (r) {_PMM_PLACES} FROM (SELECT *, rank() OVER (ORDER BY avg_memory_mb NULLS LAST) AS r FROM ({_PMM}) s) t WHERE r <= 3")
oracle("balanced_frontier", f"""
WITH s AS ({_PMM}),
st AS (SELECT avg(avg_runtime_sec) AS mr, stddev_samp(avg_runtime_sec) AS sr, avg(avg_memory_mb) AS mm,
              stddev_samp(avg_memory_mb) AS sm FROM s)
SELECT s.* {_PMM_PLACES}, round(CASE WHEN avg_memory_mb = 0 THEN NULL ELSE avg_runtime_sec / avg_memory_mb END, 6) AS efficiency_ratio,
  round((avg_runtime_sec - mr) / sr + (avg_memory_mb - mm) / sm, 4) AS balanced_score
FROM s, st ORDER BY balanced_score NULLS LAST, method LIMIT 3""")
_TQP = f"""
SELECT metric, method, dataset_generator, dataset_name, avg({_T}) AS avg_time, avg(score) AS avg_score
FROM {{src}} WHERE {_T} IS NOT NULL AND score IS NOT NULL GROUP BY metric, method, dataset_generator, dataset_name"""
oracle("time_quality_points", _TQP.format(src="combined"))
_PBM_CTES = f"""
mets AS (SELECT metric FROM combined GROUP BY metric ORDER BY count(*) DESC, metric NULLS LAST LIMIT 4),
pts AS ({_TQP.format(src="(SELECT * FROM combined WHERE metric IN (SELECT metric FROM mets)) c")}),
fr AS (SELECT p.* FROM pts p WHERE {_DOM('avg_time', 'avg_score', 'q.metric IS NOT DISTINCT FROM p.metric AND').format(cmp='>=')}),
bym AS (SELECT metric, method, CAST(count(*) AS BIGINT) AS datasets_on_frontier, avg(avg_time) AS avg_execution_time,
  avg(avg_score) AS avg_quality_score FROM fr GROUP BY metric, method)"""
oracle("pareto_by_metric", f"""WITH {_PBM_CTES}
SELECT * REPLACE (round(avg_execution_time, 6) AS avg_execution_time, round(avg_quality_score, 6) AS avg_quality_score) FROM bym""")
oracle("pareto_overall", f"""
WITH {_PBM_CTES}
SELECT method, CAST(count(*) AS BIGINT) AS metrics_on_frontier,
  CAST(sum(datasets_on_frontier) AS BIGINT) AS total_datasets_on_frontier,
  round(avg(avg_execution_time), 6) AS avg_execution_time, round(avg(avg_quality_score), 6) AS avg_quality_score
FROM bym GROUP BY method""")

# ---------------------------------------------------------------- ranking
oracle("top_methods_by_metric", """
SELECT metric, method, avg_score, n_runs FROM (
  SELECT metric, method, avg(score) AS avg_score, CAST(count(*) AS BIGINT) AS n_runs,
    rank() OVER (PARTITION BY metric ORDER BY avg(score) DESC NULLS LAST) AS r
  FROM metric GROUP BY metric, method HAVING count(*) >= 5) t WHERE r <= 10""")
oracle("method_rankings", f"""
WITH means AS (SELECT method, dataset_name, avg(score) AS avg_score, avg({_T}) AS avg_time FROM combined
               GROUP BY method, dataset_name),
r AS (SELECT method,
  CASE WHEN avg_score IS NULL THEN NULL ELSE
    rank() OVER (PARTITION BY dataset_name ORDER BY avg_score DESC NULLS LAST)
    + (count(*) OVER (PARTITION BY dataset_name, avg_score) - 1) / 2.0 END AS score_rank,
  CASE WHEN avg_time IS NULL THEN NULL ELSE
    rank() OVER (PARTITION BY dataset_name ORDER BY avg_time ASC NULLS LAST)
    + (count(*) OVER (PARTITION BY dataset_name, avg_time) - 1) / 2.0 END AS time_rank
  FROM means)
SELECT method, round(avg(score_rank), 6) AS avg_score_rank, round(avg(time_rank), 6) AS avg_time_rank,
  round(avg((score_rank + time_rank) / 2), 6) AS avg_overall_rank FROM r GROUP BY method""")
oracle("first_per_key", "SELECT * FROM method")

# ---------------------------------------------------------------- ingest
# The oracles below parse the raw file texts with DuckDB string, list, regex
# and JSON functions, independently of the Spark plans.

def _anc(col: str, k: int) -> str:
    """D(k) of a path in SQL."""
    return f"regexp_replace({col}, '(/[^/]*){{{k}}}$', '')"


def _base(expr: str) -> str:
    return f"regexp_extract({expr}, '[^/]*$')"


def _norm(expr: str) -> str:
    return f"CASE WHEN starts_with({expr}, 'linkage-') THEN {expr} ELSE replace({expr}, '-', '_') END"


_WS = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

_METHOD_LEVELS = []
for _k in range(1, 6):
    _d = _anc("s.path", _k)
    _b = _base(_d)
    _pb = _base(_anc("s.path", _k + 1))
    _METHOD_LEVELS.append(f"""
    WHEN p{_k}.method IS NOT NULL AND p{_k}.method <> '' AND (NOT p{_k}.has_seed OR p{_k}.seed IS NOT NULL)
      THEN {{'method': {_norm(f'p{_k}.method')}, 'seed': CASE WHEN p{_k}.has_seed THEN p{_k}.seed END}}
    WHEN regexp_matches({_b}, 'method-(.+?)_seed-([0-9]+)')
      THEN {{'method': {_norm(f"regexp_extract({_b}, 'method-(.+?)_seed-([0-9]+)', 1)")},
             'seed': TRY_CAST(regexp_extract({_b}, 'method-(.+?)_seed-([0-9]+)', 2) AS BIGINT)}}
    WHEN starts_with({_b}, 'method-') THEN {{'method': {_norm(f'substr({_b}, 8)')}, 'seed': CAST(NULL AS BIGINT)}}
    WHEN starts_with({_b}, 'linkage-') AND {_pb} IN ('agglomerative', 'fastcluster', 'sklearn')
      THEN CASE WHEN regexp_matches({_b}, 'linkage-(.+?)_seed-([0-9]+)')
        THEN {{'method': {_pb} || '_linkage-' || regexp_extract({_b}, 'linkage-(.+?)_seed-([0-9]+)', 1),
               'seed': TRY_CAST(regexp_extract({_b}, 'linkage-(.+?)_seed-([0-9]+)', 2) AS BIGINT)}}
        ELSE {{'method': {_pb} || '_' || {_b}, 'seed': CAST(NULL AS BIGINT)}} END""")
_METHOD_CASE = "CASE" + "".join(_METHOD_LEVELS) + "\n    ELSE {'method': '', 'seed': CAST(NULL AS BIGINT)} END"
_METHOD_JOINS = "\n".join(f"  LEFT JOIN pj p{k} ON p{k}.dir = {_anc('s.path', k)}" for k in range(1, 6))

_ING = f"""
sf AS (SELECT path, content, regexp_extract(path, '^(/bench/[^/]+)', 1) AS root FROM raw_scores),
sfb AS (SELECT path, content, root, regexp_replace(content, '\\r?\\n$', '') AS body FROM sf),
sfl AS (SELECT path, root, content, string_split(body, chr(10)) AS lines FROM sfb),
sfc AS (SELECT path, root,
          ({_WS.format(x='content')} = '' OR len(lines) < 2) AS empty_file,
          CASE WHEN coalesce(lines[1], '') = '' THEN [] ELSE string_split(lines[1], ',') END AS hdr,
          CASE WHEN coalesce(lines[2], '') = '' THEN [] ELSE string_split(lines[2], ',') END AS dat
        FROM sfl),
pl AS (SELECT path, position, trim(hdr[position], '"') AS label, dat[position] AS raw_value,
          TRY_CAST(dat[position] AS DOUBLE) AS value
       FROM (SELECT path, hdr, dat, unnest(generate_series(1, CASE WHEN empty_file THEN 0
               ELSE least(len(hdr), len(dat)) END)) AS position FROM sfc) t),
plk AS (SELECT *, coalesce(CASE WHEN starts_with(label, 'k=') THEN TRY_CAST(split_part(label, '=', 2) AS BIGINT) END,
          999999) AS k,
          first_value(value) OVER (PARTITION BY path, label ORDER BY position) AS first_val,
          min(position) OVER (PARTITION BY path, label) AS first_pos,
          max(position) OVER (PARTITION BY path, label) AS last_pos FROM pl),
km AS (SELECT path, label AS key, value, k FROM plk WHERE position = last_pos),
ff AS (SELECT c.path, c.empty_file,
          coalesce(bool_or(p.position > p.first_pos AND p.value IS NOT NULL AND p.first_val IS NOT NULL
                           AND abs(p.value - p.first_val) > 0.001), false) AS duplicate_k_anomaly
       FROM sfc c LEFT JOIN plk p ON p.path = c.path GROUP BY c.path, c.empty_file),
lf AS (SELECT path, content FROM raw_sidecars WHERE regexp_matches(path, '/clustbench\\.labels[^/]*\\.gz$')),
lv AS (SELECT path, TRY_CAST(trim(line) AS DOUBLE) AS x FROM
         (SELECT path, unnest(string_split(content, chr(10))) AS line FROM lf) t WHERE trim(line) <> ''),
lper AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dataset_dir, path AS labels_path,
           CAST(count(DISTINCT CASE WHEN trunc(x) <> 0 THEN CAST(trunc(x) AS BIGINT) END) AS BIGINT) AS true_k,
           bool_or(trunc(x) = 0) AS has_noise,
           bool_and(x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) AS valid
         FROM lv GROUP BY path),
lt AS (SELECT dataset_dir, labels_path, true_k, has_noise FROM
         (SELECT *, row_number() OVER (PARTITION BY dataset_dir ORDER BY labels_path) AS rn FROM lper
          WHERE valid AND true_k > 0) t WHERE rn = 1),
pj AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, json_valid(content) AS valid,
          json_extract_string(content, '$.method') AS method,
          json_extract(content, '$.seed') IS NOT NULL AS has_seed,
          CAST(trunc(TRY_CAST(json_extract_string(content, '$.seed') AS DOUBLE)) AS BIGINT) AS seed
       FROM raw_sidecars WHERE path LIKE '%/parameters.json'),
perf AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, content FROM raw_sidecars WHERE path LIKE '%/perf.json'),
tim AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, string_split(content, chr(10)) AS tl
        FROM raw_sidecars WHERE path LIKE '%/clustbench_performance.txt'),
fp AS (SELECT s.path, s.root,
          CASE WHEN regexp_matches({_base('s.root')}, '^out[_-]') THEN s.root
               WHEN regexp_matches(split_part(substr(s.path, length(s.root) + 2), '/', 1), '^out[_-]')
                    AND strpos(substr(s.path, length(s.root) + 2), '/') > 0
               THEN s.root || '/' || split_part(substr(s.path, length(s.root) + 2), '/', 1) END AS run_dir,
          nullif(regexp_extract(s.path, 'dataset_generator-(\\w+)_dataset_name-(\\w+)', 1), '') AS pg,
          nullif(regexp_extract(s.path, 'dataset_generator-(\\w+)_dataset_name-(\\w+)', 2), '') AS pn,
          nullif(regexp_extract(s.path, 'metric-(\\w+)', 1), '') AS pm,
          nullif(regexp_extract(s.path, '^(.*/[^/]*method-[^/]*)/', 1), '') AS method_dir,
          nullif(regexp_extract(s.path, '^(.*/[^/]*dataset_generator-[^/]*dataset_name-[^/]*|.*/[^/]*dataset_name-[^/]*dataset_generator-[^/]*)/', 1), '') AS dataset_dir,
          {_METHOD_CASE} AS mi
        FROM sfc s
{_METHOD_JOINS}),
fp2 AS (SELECT *, {_base('run_dir')} AS source_dir,
          nullif(regexp_extract({_base('run_dir')}, '^out[_-]([^_-]+)[_-]([0-9]+)', 1), '') AS backend,
          nullif(regexp_extract({_base('run_dir')}, '^out[_-]([^_-]+)[_-]([0-9]+)', 2), '') AS run_timestamp
        FROM fp),
fl AS (SELECT f.path, f.run_dir, f.source_dir, f.backend, f.run_timestamp,
          coalesce(f.pg, '') AS dataset_generator, coalesce(f.pn, '') AS dataset_name,
          lt.true_k, lt.has_noise, f.mi.method AS method, f.mi.seed AS seed, coalesce(f.pm, '') AS metric,
          TRY_CAST(t.tl[2] IS NOT NULL AND trim(t.tl[2]) <> '' AND list_position(string_split(trim(t.tl[1]), chr(9)), 's') > 0
                   AND list_position(string_split(trim(t.tl[1]), chr(9)), 's') <= len(string_split(trim(t.tl[2]), chr(9)))
                   AS BOOLEAN) AS has_time,
          CASE WHEN coalesce(trim(t.tl[2]), '') <> '' THEN
            TRY_CAST(string_split(trim(t.tl[2]), chr(9))[list_position(string_split(trim(t.tl[1]), chr(9)), 's')] AS DOUBLE)
          END AS execution_time_seconds,
          TRY_CAST(json_extract_string(mp.content, '$.total_time_secs') AS DOUBLE) AS runtime,
          TRY_CAST(json_extract_string(mp.content, '$.max_threads') AS BIGINT) AS threads,
          TRY_CAST(json_extract_string(mp.content, '$.total_disk_read_bytes') AS BIGINT) AS disk_read,
          TRY_CAST(json_extract_string(mp.content, '$.total_disk_write_bytes') AS BIGINT) AS disk_write,
          TRY_CAST(json_extract_string(mp.content, '$.avg_cpu_usage') AS DOUBLE) AS avg_load,
          TRY_CAST(json_extract_string(mp.content, '$.peak_mem_rss_kb') AS BIGINT) AS peak_rss,
          TRY_CAST(json_extract_string(xp.content, '$.total_time_secs') AS DOUBLE) AS metric_runtime,
          ff.empty_file, ff.duplicate_k_anomaly,
          km.value AS score, km.key IS NOT NULL AS has_key, f.method_dir, f.dataset_dir, lt.labels_path
        FROM fp2 f
        JOIN ff ON ff.path = f.path
        LEFT JOIN lt ON lt.dataset_dir = f.dataset_dir
        LEFT JOIN tim t ON t.dir = {_anc('f.path', 4)}
        LEFT JOIN perf mp ON mp.dir = coalesce(f.method_dir, {_anc('f.path', 4)})
        LEFT JOIN perf xp ON xp.dir = {_anc('f.path', 1)}
        LEFT JOIN km ON km.path = f.path AND km.key = 'k=' || CAST(lt.true_k AS VARCHAR)),
flx AS (SELECT * REPLACE (CASE WHEN true_k IS NOT NULL AND has_key THEN score END AS score),
          (true_k IS NOT NULL AND NOT has_key AND NOT empty_file) AS missing_true_k_score FROM fl),
metric_t AS (SELECT source_dir, backend, run_timestamp, dataset_generator, dataset_name, true_k, has_noise, method,
               seed, metric, score, metric_runtime AS runtime, duplicate_k_anomaly, empty_file, missing_true_k_score,
               path FROM flx WHERE run_dir IS NOT NULL),
method_t AS (SELECT source_dir, backend, run_timestamp, dataset_generator, dataset_name, true_k, has_noise, method,
               seed, execution_time_seconds, runtime, threads, disk_read, disk_write, avg_load, peak_rss FROM
             (SELECT *, row_number() OVER (PARTITION BY source_dir, backend, run_timestamp, dataset_generator,
                dataset_name, method, seed ORDER BY path) AS rn FROM flx WHERE run_dir IS NOT NULL) t WHERE rn = 1)"""


def _ing(select: str) -> str:
    return f"WITH {_ING}\n{select}"


oracle("run_dir_discovery", _ing("SELECT path, root, run_dir, source_dir, backend, run_timestamp FROM fp2"))
oracle("parse_scores", _ing("SELECT path, position, label, raw_value, value, k FROM plk"))
oracle("labels_true_k", _ing("SELECT dataset_dir, labels_path, true_k, has_noise FROM lt"))
oracle("method_perf_json", _ing("SELECT path, runtime, threads, disk_read, disk_write, avg_load, peak_rss FROM flx"))
oracle("metric_perf_json", _ing("SELECT path, metric_runtime AS runtime FROM flx"))
oracle("method_exec_time", _ing("SELECT path, execution_time_seconds FROM flx"))
oracle("parameters_sidecar", _ing("SELECT dir, valid, method, has_seed, seed FROM pj"))
oracle("ingest_errors", _ing("""
SELECT path, 'non_numeric_score' AS kind, label || '=' || raw_value AS detail FROM pl WHERE value IS NULL
UNION ALL SELECT path, 'invalid_json', CAST(NULL AS VARCHAR) FROM raw_sidecars
  WHERE path LIKE '%.json' AND NOT coalesce(json_valid(content) AND starts_with(ltrim(content), '{'), false)
UNION ALL SELECT labels_path, 'invalid_labels', CAST(NULL AS VARCHAR) FROM lper WHERE NOT valid
UNION ALL SELECT path, 'outside_run_dir', CAST(NULL AS VARCHAR) FROM fp2 WHERE run_dir IS NULL"""))
oracle("ingest_report", _ing("""
SELECT CAST(count(*) AS BIGINT) AS records, CAST(count_if(empty_file) AS BIGINT) AS empty_files,
  CAST(count_if(missing_true_k_score) AS BIGINT) AS missing_true_k_scores,
  CAST(count_if(duplicate_k_anomaly) AS BIGINT) AS duplicate_k_anomalies FROM metric_t"""))
oracle("extract_backend_timestamp", _ing("SELECT DISTINCT source_dir, backend, run_timestamp FROM flx"))
oracle("extract_dataset_info", _ing("SELECT path, dataset_generator, dataset_name FROM flx"))
oracle("extract_method_info", _ing("SELECT path, method, seed FROM flx"))
oracle("normalize_method_name", _ing(f"SELECT DISTINCT method AS raw_method, {_norm('method')} AS method FROM pj"))
oracle("extract_metric_info", _ing("SELECT path, metric FROM flx"))
oracle("nearest_ancestor", _ing("SELECT path, method_dir, dataset_dir FROM flx"))
oracle("source_dir", _ing("SELECT path, source_dir FROM flx"))
oracle("k_column_order", _ing("SELECT DISTINCT km.key, km.k FROM km JOIN metric_t m ON m.path = km.path"))
oracle("coerce_seed", _ing("SELECT path, seed FROM flx"))
oracle("duplicate_k_anomaly", _ing("SELECT path, duplicate_k_anomaly FROM ff"))
oracle("k_scores", _ing("SELECT path, key, value FROM km"))
oracle("score_at_true_k", _ing("SELECT path, true_k, score FROM flx"))
oracle("missing_true_k_score", _ing("SELECT path, missing_true_k_score FROM flx"))
oracle("empty_file", _ing("SELECT path, empty_file FROM ff"))
oracle("build_metric_rows", _ing("SELECT * FROM metric_t"))
oracle("build_method_rows", _ing("SELECT * FROM method_t"))
oracle("metric_wide", _ing("""
SELECT m.* EXCLUDE (path), w."k=2", w."k=3" FROM metric_t m LEFT JOIN
  (SELECT path, max(CASE WHEN key = 'k=2' THEN value END) AS "k=2", max(CASE WHEN key = 'k=3' THEN value END) AS "k=3"
   FROM km GROUP BY path) w ON w.path = m.path"""))
oracle("metric_long", _ing("SELECT km.path, km.key, km.k, km.value AS score FROM km JOIN metric_t m ON m.path = km.path"))

# ---------------------------------------------------------------- linear model input
_GLM = f"""
WITH base AS (SELECT *, {_DS} AS dataset, seed AS seed_factor FROM metric
              WHERE seed IS NOT NULL AND score IS NOT NULL AND true_k IS NOT NULL AND score BETWEEN -1 AND 1),
glm AS (SELECT * FROM base b WHERE EXISTS (SELECT 1 FROM (SELECT dataset, method, metric, backend FROM base
          GROUP BY ALL HAVING count(*) >= 3) g WHERE g.dataset IS NOT DISTINCT FROM b.dataset
          AND g.method IS NOT DISTINCT FROM b.method AND g.metric IS NOT DISTINCT FROM b.metric
          AND g.backend IS NOT DISTINCT FROM b.backend))"""
oracle("glm_input", _GLM + "\nSELECT * FROM glm")
oracle("glm_input_counts", _GLM + """
SELECT CAST(count(*) AS BIGINT) AS observations, CAST(count(DISTINCT dataset) AS BIGINT) AS n_dataset,
  CAST(count(DISTINCT method) AS BIGINT) AS n_method, CAST(count(DISTINCT metric) AS BIGINT) AS n_metric,
  CAST(count(DISTINCT backend) AS BIGINT) AS n_backend, CAST(count(DISTINCT seed_factor) AS BIGINT) AS n_seed_factor
FROM glm""")
for _key, _sql in model_oracles(_GLM).items():
    oracle(_key, _sql)

# ---------------------------------------------------------------- chart data


def _hist(src: str, x: str, groups: str, bins: int, panels: str = "") -> str:
    """Equal-width bins over each panel's [min, max]; last bin closed."""
    gsel = f"{groups}, " if groups else ""
    on = " AND ".join(f"d.{c.strip()} IS NOT DISTINCT FROM b.{c.strip()}" for c in panels.split(",")) if panels else "true"
    pgrp = f"GROUP BY {panels}" if panels else ""
    psel = f"{panels}, " if panels else ""
    dcols = ", ".join(f"d.{c.strip()}" for c in groups.split(",")) + ", " if groups else ""
    return f"""
WITH d AS (SELECT {gsel}CAST({x} AS DOUBLE) AS x FROM {src}),
d2 AS (SELECT * FROM d WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)),
b AS (SELECT {psel}min(x) AS lo, max(x) AS hi FROM d2 {pgrp}),
j AS (SELECT {dcols}CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) END AS bin,
        lo, (hi - lo) / {bins} AS w FROM d2 d JOIN b ON {on})
SELECT {gsel}CAST(bin AS INTEGER) AS bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi,
  CAST(count(*) AS BIGINT) AS count
FROM j GROUP BY {gsel}bin, lo, w"""


def _box(src: str, x: str, groups: str) -> str:
    gsel = ", ".join(c.strip() for c in groups.split(","))
    on = " AND ".join(f"d.{c.strip()} IS NOT DISTINCT FROM q.{c.strip()}" for c in groups.split(","))
    dsel = ", ".join(f"d.{c.strip()}" for c in groups.split(","))
    return f"""
WITH d0 AS (SELECT {gsel}, CAST({x} AS DOUBLE) AS x FROM {src}),
d AS (SELECT * FROM d0 WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)),
q AS (SELECT {gsel}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
      FROM d GROUP BY {gsel})
SELECT {dsel}, CAST(count(*) AS BIGINT) AS n,
  round(min(CASE WHEN x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN x END), 6) AS whisker_low,
  round(any_value(q.q1), 6) AS q1, round(any_value(q.med), 6) AS median, round(any_value(q.q3), 6) AS q3,
  round(max(CASE WHEN x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN x END), 6) AS whisker_high,
  CAST(count_if(x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS n_outliers
FROM d JOIN q ON {on} GROUP BY {dsel}"""


def _pos_log10(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN log10({c}) END"


oracle("hist_log_runtime", _hist("method", _pos_log10("runtime"), "backend", 50))
oracle("hist_runtime", _hist("(SELECT 'method' AS level, backend, runtime FROM method WHERE runtime IS NOT NULL "
                             "UNION ALL SELECT 'metric', backend, runtime FROM metric WHERE runtime IS NOT NULL) u",
                             "runtime", "level, backend", 30, "level"))
oracle("hist_rss", "WITH " + _RSSDATA.strip() + ",\n" + _hist("rssd", _pos_log10("peak_rss_mb"),
                                                           "dataset, method, backend", 20, "dataset, method")
       .strip()[5:])
oracle("hist_score", _hist("metric", "score", "metric", 30, "metric"))
oracle("box_time_top_methods", _box(f"(SELECT * FROM method WHERE method IN {_TOPM('method', 10)}) m",
                                    _pos_log10(_T), "method"))
oracle("box_score_backend", _box("metric", "score", "backend"))
oracle("box_time_backend", _box("combined", _T, "backend"))
_SEED_ROWS = """
(WITH combos AS (SELECT DISTINCT dataset_generator, dataset_name, metric FROM metric
                ORDER BY dataset_generator NULLS LAST, dataset_name NULLS LAST, metric NULLS LAST LIMIT 4),
runs AS (SELECT m.* FROM metric m JOIN combos c USING (dataset_generator, dataset_name, metric) WHERE m.seed IS NOT NULL),
stats AS (SELECT dataset_generator, dataset_name, metric, method,
            row_number() OVER (PARTITION BY dataset_generator, dataset_name, metric
                               ORDER BY avg(score) DESC NULLS LAST, method) AS method_rank
          FROM runs GROUP BY dataset_generator, dataset_name, metric, method HAVING count(*) > 1)
SELECT r.*, s.method_rank FROM runs r JOIN stats s USING (dataset_generator, dataset_name, metric, method)
WHERE s.method_rank <= 8) sr"""
oracle("box_seed", _box(_SEED_ROWS, "score", "dataset_generator, dataset_name, metric, method, method_rank"))
oracle("scatter_time_score", f"""
SELECT metric, method, backend, dataset_generator, dataset_name, {_T}, score FROM combined
WHERE metric IN (SELECT metric FROM combined GROUP BY metric ORDER BY count(*) DESC, metric NULLS LAST LIMIT 4)
  AND {_T} IS NOT NULL AND score IS NOT NULL""")
oracle("bar_error", f"""
SELECT method, backend, avg_score, round(std_dev, 6) AS std_dev, round(avg_score - std_dev, 6) AS ymin, round(avg_score + std_dev, 6) AS ymax
FROM ({_MC}) mc""")

# ---------------------------------------------------------------- sorts, limits, sets, misc
oracle("sort_desc", ORACLES["score_variability"])
oracle("limit_n", ORACLES["time_variability"] + f"\nORDER BY cv_execution_time DESC NULLS LAST, {DM} LIMIT 10")
oracle("level_order", f"""
SELECT *, row_number() OVER (PARTITION BY metric ORDER BY avg_score, method) AS level FROM ({ORACLES['top_methods_by_metric']}) t""")
oracle("union_summaries", f"""
SELECT *, 'method' AS level FROM ({_RT('method')}) a UNION ALL SELECT *, 'metric' FROM ({_RT('metric')}) b""")
oracle("group_count_window", """
SELECT m.*, g.group_n FROM metric m LEFT JOIN (SELECT dataset_generator, dataset_name, method, metric, backend,
  CAST(count(*) AS BIGINT) AS group_n FROM metric GROUP BY ALL) g
  ON m.dataset_generator IS NOT DISTINCT FROM g.dataset_generator AND m.dataset_name IS NOT DISTINCT FROM g.dataset_name
 AND m.method IS NOT DISTINCT FROM g.method AND m.metric IS NOT DISTINCT FROM g.metric
 AND m.backend IS NOT DISTINCT FROM g.backend""")
oracle("quality_any_filter", f"""
SELECT * FROM (SELECT backend, metric, {_CT('empty_file')} AS empty_files, {_CT('duplicate_k_anomaly')} AS duplicate_k,
  {_CT('missing_true_k_score')} AS missing_true_k FROM metric GROUP BY backend, metric) t
WHERE empty_files > 0 OR duplicate_k > 0 OR missing_true_k > 0""")
oracle("frontier_filter", f"""
WITH pts AS ({_TQP.format(src="combined")})
SELECT p.* FROM pts p WHERE {_DOM('avg_time', 'avg_score', 'q.metric IS NOT DISTINCT FROM p.metric AND').format(cmp='>=')}""")
oracle("top_k_with_ties", f"""
WITH pts AS ({_TQP.format(src="combined")}),
per AS (SELECT metric, method, avg(avg_time) AS avg_time FROM pts GROUP BY metric, method)
SELECT metric, method, round(avg_time, 6) AS avg_time FROM (SELECT *, rank() OVER (PARTITION BY metric ORDER BY avg_time NULLS LAST) AS r
  FROM per) t WHERE r <= 3""")
oracle("minmax_rescale", """
WITH s AS (SELECT backend, method, avg(score) AS avg_score FROM metric GROUP BY backend, method),
b AS (SELECT min(avg_score) AS lo, max(avg_score) AS hi FROM s)
SELECT backend, method, avg_score,
  round(CASE WHEN avg_score IS NULL THEN NULL WHEN hi = lo THEN 0.5 ELSE (avg_score - lo) / (hi - lo) END, 6) AS avg_score_scaled
FROM s, b""")

# ---------------------------------------------------------------- loaders and aliases
oracle("load_method", "SELECT * FROM method")
oracle("load_metric", "SELECT * FROM metric")
oracle("k_sort", ORACLES["k_column_order"])
