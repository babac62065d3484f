"""The registered query plans, one per operator of the inventory.

Every plan reads the whole views of ``benchscope.plans.views`` (themselves
derived from the whole ``lineitem`` table) and calls one library operator.
"""

from __future__ import annotations

from benchscope.operators import consistency as cons
from benchscope.plans.registry import PLACES, register
from benchscope.plans.views import BenchViews

# ---------------------------------------------------------------- consistency


@register("score_consistency")
def q_score_consistency(v: BenchViews):
    return cons.score_consistency(v.metric)


@register("consistency_rejoin")
def q_consistency_rejoin(v: BenchViews):
    return cons.consistency_rejoin(v.metric)


@register("backend_consistency")
def q_backend_consistency(v: BenchViews):
    return cons.backend_consistency(v.metric)


@register("consistency_overall")
def q_consistency_overall(v: BenchViews):
    return cons.consistency_overall(cons.score_consistency(v.metric))


@register("top_inconsistent")
def q_top_inconsistent(v: BenchViews):
    return cons.top_inconsistent(cons.score_consistency(v.metric))

# ---------------------------------------------------------------- variability
from benchscope.operators import comparisons as cmp  # noqa: E402
from benchscope.operators import filters as flt  # noqa: E402
from benchscope.operators import guards  # noqa: E402
from benchscope.operators import joins  # noqa: E402
from benchscope.operators import pareto  # noqa: E402
from benchscope.operators import ranking  # noqa: E402
from benchscope.operators import summaries as summ  # noqa: E402
from benchscope.operators import variability as var  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@register("time_variability")
def q_time_variability(v: BenchViews):
    return var.time_variability(v.method, check=False)


@register("score_variability")
def q_score_variability(v: BenchViews):
    return var.score_variability(v.metric, check=False)


@register("seed_cv")
def q_seed_cv(v: BenchViews):
    return var.seed_cv(v.metric, check=False)


@register("seed_top_methods")
def q_seed_top_methods(v: BenchViews):
    """The report's seed box plots: first 4 combinations, top 8 methods."""
    return var.seed_top_methods(v.metric, var.first_combinations(v.metric, 4), top_n=8, check=False)


@register("seed_heatmap")
def q_seed_heatmap(v: BenchViews):
    """The report's heatmaps: 3 most common metrics, 12 methods x 8 datasets."""
    return var.seed_heatmap(v.metric, var.most_common(v.metric, "metric", 3), top_methods=12, top_datasets=8, check=False)


# ---------------------------------------------------------------- comparisons

@register("avg_time_by_backend")
def q_avg_time_by_backend(v: BenchViews):
    return cmp.avg_time_by_backend(v.method)


@register("avg_score_by_backend")
def q_avg_score_by_backend(v: BenchViews):
    return cmp.avg_score_by_backend(v.metric)


@register("backend_time_pairs")
def q_backend_time_pairs(v: BenchViews):
    return cmp.backend_time_pairs(v.method, check=False)


@register("backend_score_pairs")
def q_backend_score_pairs(v: BenchViews):
    return cmp.backend_score_pairs(v.metric, check=False)


@register("backend_pairs")
def q_backend_pairs(v: BenchViews):
    return cmp.backend_pairs(v.metric)


@register("compare_backends")
def q_compare_backends(v: BenchViews):
    return cmp.compare_backends(v.method, v.metric, check=False)


# ---------------------------------------------------------------- joins

@register("combined_runs")
def q_combined_runs(v: BenchViews):
    return joins.combined_runs(v.metric, v.method)


@register("semi_join_datasets")
def q_semi_join_datasets(v: BenchViews):
    """Method runs of the 8 most frequent datasets."""
    top = summ.top_by_count(v.method, ["dataset_generator", "dataset_name"], 8)
    return joins.semi_join(v.method, top, ["dataset_generator", "dataset_name"])


@register("key_set_check")
def q_key_set_check(v: BenchViews):
    return joins.key_set_check(v.method, v.metric)


# ---------------------------------------------------------------- summaries

@register("method_summary")
def q_method_summary(v: BenchViews):
    return summ.method_summary(v.method)


@register("metric_summary")
def q_metric_summary(v: BenchViews):
    return summ.metric_summary(v.metric)


@register("runtime_summary_method")
def q_runtime_summary_method(v: BenchViews):
    return summ.runtime_summary(v.method)


@register("runtime_summary_metric")
def q_runtime_summary_metric(v: BenchViews):
    return summ.runtime_summary(v.metric)


@register("peak_rss_range")
def q_peak_rss_range(v: BenchViews):
    return summ.peak_rss_range(v.method)


@register("peak_rss_summary")
def q_peak_rss_summary(v: BenchViews):
    return summ.peak_rss_summary(v.method, 10)


@register("peak_rss_heatmap")
def q_peak_rss_heatmap(v: BenchViews):
    return summ.peak_rss_heatmap(v.method)


@register("runtime_memory_points")
def q_runtime_memory_points(v: BenchViews):
    return summ.runtime_memory_points(v.method)


@register("largest_dataset")
def q_largest_dataset(v: BenchViews):
    return summ.largest_dataset(v.method)


@register("quality_summary")
def q_quality_summary(v: BenchViews):
    return summ.quality_summary(v.metric)


@register("quality_by_method")
def q_quality_by_method(v: BenchViews):
    return summ.quality_by_method(v.metric)


@register("data_overview")
def q_data_overview(v: BenchViews):
    return summ.data_overview(v.method, v.metric)


@register("time_overall")
def q_time_overall(v: BenchViews):
    return summ.time_overall(v.method)


@register("score_by_metric")
def q_score_by_metric(v: BenchViews):
    return summ.score_by_metric(v.metric)


@register("completeness")
def q_completeness(v: BenchViews):
    return summ.completeness(v.metric)


@register("kpi_boxes")
def q_kpi_boxes(v: BenchViews):
    return summ.kpi_boxes(v.metric)


@register("method_backend_scores")
def q_method_backend_scores(v: BenchViews):
    return summ.method_backend_scores(v.metric)


@register("dataset_performance")
def q_dataset_performance(v: BenchViews):
    return summ.dataset_performance(joins.combined_runs(v.metric, v.method))


@register("first_metric_heatmap")
def q_first_metric_heatmap(v: BenchViews):
    return summ.first_metric_heatmap(v.metric)


@register("method_comparison")
def q_method_comparison(v: BenchViews):
    return summ.method_comparison(joins.combined_runs(v.metric, v.method))


@register("radar")
def q_radar(v: BenchViews):
    return ranking.radar(summ.method_comparison(joins.combined_runs(v.metric, v.method)))


@register("method_counts")
def q_method_counts(v: BenchViews):
    return summ.method_counts(v.method, "method")


@register("metric_counts")
def q_metric_counts(v: BenchViews):
    return summ.method_counts(v.metric, "metric")


@register("distinct_rows")
def q_distinct_rows(v: BenchViews):
    return summ.distinct_rows(v.metric, ["backend", "dataset_generator", "dataset_name", "method", "metric"])


@register("unique_seeds")
def q_unique_seeds(v: BenchViews):
    return summ.distinct_rows(v.method.where(F.col("seed").isNotNull()), ["seed"])


# ---------------------------------------------------------------- filters

@register("project_columns")
def q_project_columns(v: BenchViews):
    return flt.project(v.metric, ["backend", "dataset_generator", "dataset_name", "method", "metric", "score"])


@register("dataset_key")
def q_dataset_key(v: BenchViews):
    return flt.with_dataset_key(v.method).select("dataset").distinct()


@register("rss_mb")
def q_rss_mb(v: BenchViews):
    return flt.with_rss_mb(v.method).select("source_dir", "dataset_generator", "dataset_name", "method",
                                            "seed", "peak_rss_mb")


@register("not_null_filter")
def q_not_null_filter(v: BenchViews):
    return flt.not_null(v.metric, ["seed", "score", "true_k"])


@register("eq_filter")
def q_eq_filter(v: BenchViews):
    return flt.equals(v.metric, metric="ari", backend="r")


@register("in_list_filter")
def q_in_list_filter(v: BenchViews):
    """Method runs of the 3 most frequent methods (``method %in% top``)."""
    return flt.in_frame(v.method, summ.top_by_count(v.method, ["method"], 3), ["method"])


@register("score_range_filter")
def q_score_range_filter(v: BenchViews):
    return flt.score_in_range(v.metric)


@register("group_size_filter")
def q_group_size_filter(v: BenchViews):
    keys = ["dataset_generator", "dataset_name", "method", "metric", "backend"]
    return flt.min_group_size(v.metric.where(F.col("seed").isNotNull()), keys, 3)


@register("having_filter")
def q_having_filter(v: BenchViews):
    agg = v.metric.groupBy("metric", "method").agg(F.count(F.lit(1)).cast("bigint").alias("n_runs"))
    return flt.having(agg, F.col("n_runs") >= 5)


@register("dashboard_filter")
def q_dashboard_filter(v: BenchViews):
    runs = joins.combined_runs(v.metric, v.method)
    return flt.filter_runs(runs, backend="n", dataset_generator="o", time_range=(1.0, 20.0))


@register("has_seed_data")
def q_has_seed_data(v: BenchViews):
    return guards.seed_data_flag(v.method)


@register("multi_backend_guard")
def q_multi_backend_guard(v: BenchViews):
    return guards.backend_guard(v.metric)


@register("time_slider_bounds")
def q_time_slider_bounds(v: BenchViews):
    return flt.time_slider_bounds(joins.combined_runs(v.metric, v.method))


@register("filter_choices")
def q_filter_choices(v: BenchViews):
    return flt.filter_choices(v.metric)


@register("score_table")
def q_score_table(v: BenchViews):
    runs = joins.combined_runs(v.metric, v.method)
    return flt.score_table(flt.filter_runs(runs, metric="ari"), page=1)


# ---------------------------------------------------------------- pareto

@register("pareto_frontier")
def q_pareto_frontier(v: BenchViews):
    return pareto.runtime_memory_frontier(summ.runtime_memory_points(v.method))


@register("frontier_step")
def q_frontier_step(v: BenchViews):
    flagged = pareto.runtime_memory_frontier(summ.runtime_memory_points(v.method))
    return pareto.frontier_points(flagged, "avg_runtime")


@register("largest_dataset_frontier")
def q_largest_dataset_frontier(v: BenchViews):
    runs = summ.largest_dataset_runs(v.method)
    return pareto.runtime_memory_frontier(summ.runtime_memory_points(runs))


@register("pareto_memory_methods")
def q_pareto_memory_methods(v: BenchViews):
    return pareto.pareto_memory_methods(summ.runtime_memory_points(v.method))


@register("fastest_frontier")
def q_fastest_frontier(v: BenchViews):
    return pareto.fastest_frontier(pareto.pareto_memory_methods(summ.runtime_memory_points(v.method)))


@register("leanest_frontier")
def q_leanest_frontier(v: BenchViews):
    return pareto.leanest_frontier(pareto.pareto_memory_methods(summ.runtime_memory_points(v.method)))


@register("balanced_frontier")
def q_balanced_frontier(v: BenchViews):
    return pareto.balanced_frontier(pareto.pareto_memory_methods(summ.runtime_memory_points(v.method)))


@register("time_quality_points")
def q_time_quality_points(v: BenchViews):
    return pareto.time_quality_points(joins.combined_runs(v.metric, v.method))


def _pareto_by_metric(v: BenchViews):
    combined = joins.combined_runs(v.metric, v.method)
    return pareto.pareto_by_metric(combined, var.most_common(v.metric, "metric", 4))


@register("pareto_by_metric")
def q_pareto_by_metric(v: BenchViews):
    return _pareto_by_metric(v)


@register("pareto_overall")
def q_pareto_overall(v: BenchViews):
    return pareto.pareto_overall(_pareto_by_metric(v))


# ---------------------------------------------------------------- ranking

@register("top_methods_by_metric")
def q_top_methods_by_metric(v: BenchViews):
    return ranking.top_methods_by_metric(v.metric)


@register("method_rankings")
def q_method_rankings(v: BenchViews):
    return ranking.method_rankings(joins.combined_runs(v.metric, v.method))


@register("first_per_key")
def q_first_per_key(v: BenchViews):
    return v.method


# ---------------------------------------------------------------- ingest
from benchscope.functions import paths as P  # noqa: E402
from benchscope.operators import ingest as ing  # noqa: E402
from benchscope.plans.views import ingest_inputs  # noqa: E402


def _files(v: BenchViews):
    i = ingest_inputs(v)
    return ing.resolve_files(i.scores, i.sidecars, i.label_lines)


def _placed(v: BenchViews, *want: str):
    """The files with what their directories hold of some kinds."""
    i = ingest_inputs(v)
    return ing.resolve(i.scores, i.sidecars, i.label_lines, want)


def _tables(v: BenchViews):
    i = ingest_inputs(v)
    return ing.ingest(i.scores, i.sidecars, i.label_lines)


@register("run_dir_discovery")
def q_run_dir_discovery(v: BenchViews):
    i = ingest_inputs(v)
    fp = ing.file_paths(i.scores.drop("content"))
    return fp.select("path", "root", "run_dir", "source_dir", "backend", "run_timestamp")


@register("parse_scores")
def q_parse_scores(v: BenchViews):
    return ing.score_entries(ing.parse_scores(ingest_inputs(v).scores))


@register("labels_true_k")
def q_labels_true_k(v: BenchViews):
    return ing.labels_true_k(ingest_inputs(v).label_lines)


@register("method_perf_json")
def q_method_perf_json(v: BenchViews):
    return _placed(v, ing.METHOD_PERF).select("path", "runtime", "threads", "disk_read", "disk_write", "avg_load", "peak_rss")


@register("metric_perf_json")
def q_metric_perf_json(v: BenchViews):
    return _placed(v, ing.METRIC_PERF).select("path", F.col("metric_runtime").alias("runtime"))


@register("method_exec_time")
def q_method_exec_time(v: BenchViews):
    return _placed(v, ing.TIMING).select("path", "execution_time_seconds")


@register("parameters_sidecar")
def q_parameters_sidecar(v: BenchViews):
    ps = ing.parse_sidecars(ingest_inputs(v).sidecars).where(F.col("name") == ing.PARAMS_FILE)
    return ps.select("dir", F.col("p.valid").alias("valid"), F.col("p.method").alias("method"),
                     F.col("p.has_seed").alias("has_seed"), F.col("p.seed").alias("seed"))


@register("ingest_errors")
def q_ingest_errors(v: BenchViews):
    return _tables(v).errors


@register("ingest_report")
def q_ingest_report(v: BenchViews):
    return ing.ingest_report(_tables(v).flags)


@register("extract_backend_timestamp")
def q_extract_backend_timestamp(v: BenchViews):
    return ing.file_paths(ingest_inputs(v).scores).select("source_dir", "backend", "run_timestamp").distinct()


@register("extract_dataset_info")
def q_extract_dataset_info(v: BenchViews):
    return _placed(v, ing.DATASET).select("path", "dataset_generator", "dataset_name")


@register("extract_method_info")
def q_extract_method_info(v: BenchViews):
    return _placed(v, ing.METHOD).select("path", "method", "seed")


@register("normalize_method_name")
def q_normalize_method_name(v: BenchViews):
    ps = ing.parse_sidecars(ingest_inputs(v).sidecars).where(F.col("name") == ing.PARAMS_FILE)
    raw = ps.select(F.col("p.method").alias("raw_method")).distinct()
    return raw.select("raw_method", P.normalize_method(F.col("raw_method")).alias("method"))


@register("extract_metric_info")
def q_extract_metric_info(v: BenchViews):
    return _placed(v, ing.METRIC).select("path", "metric")


@register("nearest_ancestor")
def q_nearest_ancestor(v: BenchViews):
    return ing.file_paths(ingest_inputs(v).scores).select("path", "method_dir", "dataset_dir")


@register("source_dir")
def q_source_dir(v: BenchViews):
    return ing.file_paths(ingest_inputs(v).scores).select("path", "source_dir")


@register("k_column_order")
def q_k_column_order(v: BenchViews):
    return ing.k_column_order(_tables(v).scores)


@register("coerce_seed")
def q_coerce_seed(v: BenchViews):
    return _placed(v, ing.METHOD).select("path", "seed")


@register("duplicate_k_anomaly")
def q_duplicate_k_anomaly(v: BenchViews):
    return ing.parse_scores(ingest_inputs(v).scores).select("path", "duplicate_k_anomaly")


@register("k_scores")
def q_k_scores(v: BenchViews):
    parsed = ing.parse_scores(ingest_inputs(v).scores)
    return ing.k_entries(parsed)


@register("score_at_true_k")
def q_score_at_true_k(v: BenchViews):
    return ing.score_at_true_k(_placed(v, ing.LABELS)).select("path", "true_k", "score")


@register("missing_true_k_score")
def q_missing_true_k_score(v: BenchViews):
    return ing.score_at_true_k(_placed(v, ing.LABELS)).select("path", "missing_true_k_score")


@register("empty_file")
def q_empty_file(v: BenchViews):
    return ing.parse_scores(ingest_inputs(v).scores).select("path", "empty_file")


@register("build_metric_rows")
def q_build_metric_rows(v: BenchViews):
    return _tables(v).metric.drop("k_scores")


@register("build_method_rows")
def q_build_method_rows(v: BenchViews):
    return _tables(v).method


@register("metric_wide")
def q_metric_wide(v: BenchViews):
    t = _tables(v)
    return ing.metric_wide(t.metric.drop("path"), ing.label_catalogue(t.scores))


@register("metric_long")
def q_metric_long(v: BenchViews):
    return ing.metric_long(_tables(v).scores)


# ---------------------------------------------------------------- linear models
from benchscope.operators import linear_model as lm  # noqa: E402


def _models(v: BenchViews):
    glm = lm.glm_input(v.metric)
    return glm, lm.fit_models(glm)


@register("glm_input")
def q_glm_input(v: BenchViews):
    return lm.glm_input(v.metric)


@register("glm_input_counts")
def q_glm_input_counts(v: BenchViews):
    return lm.glm_input_counts(lm.glm_input(v.metric))


@register("lm_models")
def q_lm_models(v: BenchViews):
    glm, ms = _models(v)
    return lm.model_aic(glm.sparkSession, ms)


@register("model_aic")
def q_model_aic(v: BenchViews):
    glm, ms = _models(v)
    return lm.model_aic(glm.sparkSession, ms).select("model", "name", "aic", "is_best")


@register("anova")
def q_anova(v: BenchViews):
    glm, ms = _models(v)
    return lm.anova(glm.sparkSession, ms)


@register("coefficients")
def q_coefficients(v: BenchViews):
    glm, ms = _models(v)
    return lm.coefficients(glm.sparkSession, ms)


@register("model_fit")
def q_model_fit(v: BenchViews):
    glm, ms = _models(v)
    return lm.model_aic(glm.sparkSession, ms).where("is_best").select("model", "r_squared", "adj_r_squared")


@register("seed_contribution")
def q_seed_contribution(v: BenchViews):
    glm, ms = _models(v)
    return lm.seed_contribution(glm.sparkSession, ms)


@register("residual_diagnostics")
def q_residual_diagnostics(v: BenchViews):
    glm, ms = _models(v)
    return lm.residual_diagnostics(glm, ms)


@register("coef_effects")
def q_coef_effects(v: BenchViews):
    glm, ms = _models(v)
    return lm.coef_effects(glm.sparkSession, ms)


@register("factor_importance")
def q_factor_importance(v: BenchViews):
    glm, ms = _models(v)
    return lm.factor_importance(glm.sparkSession, ms)


# ---------------------------------------------------------------- chart data
from benchscope.operators import chartdata as chart  # noqa: E402


@register("hist_log_runtime")
def q_hist_log_runtime(v: BenchViews):
    return chart.hist_log_runtime(v.method)


@register("hist_runtime")
def q_hist_runtime(v: BenchViews):
    return chart.hist_runtime(v.method, v.metric)


@register("hist_rss")
def q_hist_rss(v: BenchViews):
    return chart.hist_rss(summ.peak_rss_data(v.method))


@register("hist_score")
def q_hist_score(v: BenchViews):
    return chart.hist_score(v.metric)


@register("box_time_top_methods")
def q_box_time_top_methods(v: BenchViews):
    return chart.box_time_top_methods(v.method, summ.top_by_count(v.method, ["method"], 10))


@register("box_score_backend")
def q_box_score_backend(v: BenchViews):
    return chart.box_by_backend(v.metric, "score")


@register("box_time_backend")
def q_box_time_backend(v: BenchViews):
    return chart.box_by_backend(joins.combined_runs(v.metric, v.method), "execution_time_seconds")


@register("box_seed")
def q_box_seed(v: BenchViews):
    return chart.box_seed(var.seed_top_methods(v.metric, var.first_combinations(v.metric, 4), top_n=8, check=False))


@register("scatter_time_score")
def q_scatter_time_score(v: BenchViews):
    combined = joins.combined_runs(v.metric, v.method)
    return chart.scatter_time_score(combined, var.most_common(v.metric, "metric", 4))


@register("bar_error")
def q_bar_error(v: BenchViews):
    return chart.bar_error(summ.method_comparison(joins.combined_runs(v.metric, v.method)))


# ---------------------------------------------------------------- sorts, limits, sets, misc

@register("sort_desc")
def q_sort_desc(v: BenchViews):
    return var.score_variability(v.metric, check=False)


@register("limit_n")
def q_limit_n(v: BenchViews):
    return var.time_variability(v.method, check=False).limit(10)


@register("level_order")
def q_level_order(v: BenchViews):
    """``reorder(method, avg_score)``: per metric, the top methods with their
    level position (ascending mean score, as the bar chart orders them)."""
    from pyspark.sql import Window
    top = ranking.top_methods_by_metric(v.metric)
    w = Window.partitionBy("metric").orderBy(F.col("avg_score").asc(), F.col("method"))
    return top.withColumn("level", F.row_number().over(w).cast("bigint"))


@register("union_summaries")
def q_union_summaries(v: BenchViews):
    m = summ.runtime_summary(v.method).withColumn("level", F.lit("method"))
    x = summ.runtime_summary(v.metric).withColumn("level", F.lit("metric"))
    return m.unionByName(x)


@register("group_count_window")
def q_group_count_window(v: BenchViews):
    keys = ["dataset_generator", "dataset_name", "method", "metric", "backend"]
    counts = v.metric.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("group_n"))
    from benchscope.functions.columns import null_safe_join
    return null_safe_join(v.metric, counts, keys, "left")


@register("quality_any_filter")
def q_quality_any_filter(v: BenchViews):
    from benchscope.functions.columns import count_true
    agg = v.metric.groupBy("backend", "metric").agg(
        count_true("empty_file").alias("empty_files"), count_true("duplicate_k_anomaly").alias("duplicate_k"),
        count_true("missing_true_k_score").alias("missing_true_k"))
    return flt.having(agg, (F.col("empty_files") > 0) | (F.col("duplicate_k") > 0) | (F.col("missing_true_k") > 0))


@register("frontier_filter")
def q_frontier_filter(v: BenchViews):
    combined = joins.combined_runs(v.metric, v.method)
    pts = pareto.time_quality_points(combined)
    flagged = pareto.pareto_frontier(pts, "avg_time", "avg_score", partition_cols=["metric"])
    return pareto.frontier_points(flagged, "avg_time", ["metric"]).drop("is_pareto")


@register("top_k_with_ties")
def q_top_k_with_ties(v: BenchViews):
    """``slice_min(avg_time, n = 3)`` per metric over method means."""
    pts = pareto.time_quality_points(joins.combined_runs(v.metric, v.method))
    per = pts.groupBy("metric", "method").agg(F.avg("avg_time").alias("avg_time"))
    return ranking.top_k_with_ties(per, ["metric"], "avg_time", 3, descending=False)


@register("minmax_rescale")
def q_minmax_rescale(v: BenchViews):
    return ranking.rescale(summ.method_backend_scores(v.metric), ["avg_score"])


@register("factor_type_case")
def q_factor_type_case(v: BenchViews):
    glm, ms = _models(v)
    c = lm.coefficients(glm.sparkSession, ms, None, None)
    return c.select("factor", lm.factor_type(F.col("factor")).alias("factor_type"))


@register("significance_flag")
def q_significance_flag(v: BenchViews):
    glm, ms = _models(v)
    c = lm.coefficients(glm.sparkSession, ms, None, None)
    return c.select("factor", "p_value", (F.col("p_value") < lm.SIGNIFICANCE).alias("significant"))


# ---------------------------------------------------------------- loaders and aliases
from benchscope.sources import load as loader  # noqa: E402


@register("load_method")
def q_load_method(v: BenchViews):
    """A13's casts (categories as text, flags boolean, NaN -> NULL) applied to
    the method table (the parquet read itself is covered by the tests)."""
    return loader.cast_method(v.method)


@register("load_metric")
def q_load_metric(v: BenchViews):
    """A14's casts applied to the metric table."""
    return loader.cast_metric(v.metric)


@register("k_sort")
def q_k_sort(v: BenchViews):
    """H4: the k labels in numeric column order (the B8 ordering)."""
    return ing.k_column_order(_tables(v).scores)


# ---------------------------------------------------------------- reported places
def _places(columns: str, *keys: str, n: int = 6) -> None:
    for key in keys:
        PLACES.setdefault(key, {}).update(dict.fromkeys(columns.split(), n))


_places("score_sd", "score_consistency", "consistency_rejoin", "top_inconsistent")
_places("avg_score_range", "backend_consistency")
_places("sd_execution_time cv_execution_time", "time_variability", "limit_n")
_places("sd_score cv_score", "score_variability", "sort_desc", "seed_cv", "seed_heatmap")
_places("sd_runtime", "runtime_summary_method", "runtime_summary_metric", "union_summaries")
_places("std_dev", "method_comparison", "bar_error")
_places("ymin ymax", "bar_error")
_places("score speed score_scaled speed_scaled", "radar")
_places("avg_runtime_sec avg_memory_mb", "pareto_memory_methods", "fastest_frontier", "leanest_frontier", "balanced_frontier")
_places("efficiency_ratio", "balanced_frontier")
_places("balanced_score", "balanced_frontier", n=4)
_places("avg_execution_time avg_quality_score", "pareto_by_metric", "pareto_overall")
_places("avg_score_rank avg_time_rank avg_overall_rank", "method_rankings")
_places("bin_lo bin_hi", "hist_log_runtime", "hist_runtime", "hist_rss", "hist_score")
_places("whisker_low q1 median q3 whisker_high", "box_time_top_methods", "box_score_backend", "box_time_backend", "box_seed")
_places("avg_time", "top_k_with_ties")
_places("avg_score_scaled", "minmax_rescale")
_places("aic rss r_squared adj_r_squared", "lm_models")
_places("aic", "model_aic")
_places("r_squared adj_r_squared", "model_fit")
_places("r_squared_no_seed r_squared_with_seed seed_contribution", "seed_contribution")
_places("sum_sq mean_sq f_value p_value", "anova")
_places("coefficient se t_value p_value abs_coefficient", "coefficients", "coef_effects")
_places("prop_significant mean_abs_coef max_abs_coef", "factor_importance")
_places("p_value", "significance_flag")
_places("fitted residual leverage std_residual theoretical_quantile", "residual_diagnostics")
