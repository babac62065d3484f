"""Linear models of the score on categorical factors.

The report fits four ``lm`` models (treatment contrasts, first level as
baseline) and reads AIC, type-I ANOVA, coefficients and diagnostics from the
best one.  All predictors are categorical, so the data reduce to cells:

1. ``groupBy(dataset, method, metric, backend, seed)`` -> n, sum y, sum y^2
   (partial aggregation; one row per cell whatever the data volume);
2. each cell lists its active design columns (intercept, one dummy per
   factor, one interaction dummy -- at most 7), explodes the (i, j) pairs of
   that short list and ``groupBy(i, j).sum(n)`` gives X'X, ``groupBy(i)``
   gives X'y;
3. only the p x p matrix (p = number of factor levels, a catalogue size)
   reaches the driver, where an ordered Cholesky sweep gives the QR effects,
   hence sequential sums of squares, RSS, rank, coefficients and
   (X'X)^-1 for every model -- all four models come from the one X'X.

Per-row diagnostics go back out to the cluster: fitted values and leverages
are cell properties joined onto the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchscope.functions.columns import dataset_key, n_distinct
from benchscope.operators.filters import min_group_size
from benchscope.operators.ordered import exclusive_prefix, stable

# Fixed values that must equal the reference's behaviour ------------------
FACTORS = ["dataset", "method", "metric", "backend", "seed_factor"]
INTERACTION = ("method", "metric")
MODELS = {
    1: ["dataset", "method", "metric", "backend"],
    2: ["dataset", "method", "metric", "backend", "seed_factor"],
    3: ["dataset", "method", "metric", "backend", "method:metric"],
    4: ["dataset", "method", "metric", "backend", "seed_factor", "method:metric"],
}
MODEL_NAMES = {1: "Main effects (no seed)", 2: "Main effects + seed",
               3: "Method:metric interaction (no seed)", 4: "Full model (seed + interactions)"}
MIN_ROWS = 50          # the report fits only with more than 50 rows
MIN_GROUP = 3          # rows per (dataset, method, metric, backend)
QR_TOL = 1e-7          # lm's pivoting tolerance (on column norms)
SIGNIFICANCE = 0.05
FACTOR_TYPES = [("^dataset", "Dataset"), ("^method", "Method"), ("^metric", "Metric"),
                ("^backend", "Backend"), ("^seed_factor", "Seed"), (":", "Interaction")]
# Published coefficients (numerator, denominator) of the normal quantile: both tails, the middle
QNORM_TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
               4.374664141464968e+00, 2.938163982698783e+00],
              [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00])
QNORM_MIDDLE = ([-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
                 -3.066479806614716e+01, 2.506628277459239e+00],
                [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
                 -1.328068155288572e+01])
QNORM_SPLIT = 0.02425
# ---------------------------------------------------------------------------
MAX_COLUMNS = 4000     # p x p values are held and solved on the driver
ALIAS_TOL = max(QR_TOL ** 2, 64 * float(np.finfo(float).eps))   # squared norms


def glm_input(metric: DataFrame) -> DataFrame:
    """M1: rows with seed, score and true k; score in [-1, 1]; groups of at
    least 3 rows; ``dataset`` key and categorical ``seed_factor``."""
    base = metric.where(F.col("seed").isNotNull() & F.col("score").isNotNull() & F.col("true_k").isNotNull())
    base = base.where(F.col("score").between(-1.0, 1.0))
    base = base.withColumn("dataset", dataset_key("_")).withColumn("seed_factor", F.col("seed"))
    return min_group_size(base, ["dataset", "method", "metric", "backend"], MIN_GROUP)


def glm_input_counts(glm: DataFrame) -> DataFrame:
    """rows and distinct levels (NULL is one) after the GLM filters."""
    return glm.agg(F.count(F.lit(1)).cast("bigint").alias("observations"),
                   *[n_distinct(c).alias(f"n_{c}") for c in FACTORS])


def complete_rows(glm: DataFrame) -> DataFrame:
    """The rows a model is fitted on: none with a missing factor or score."""
    return glm.dropna(subset=[*FACTORS, "score"])


# ------------------------------------------------------------ design

@dataclass
class Design:
    levels: dict[str, list]                 # factor -> sorted levels (baseline first)
    columns: list[tuple[str, str]] = field(default_factory=list)   # (term, coefficient name)
    offsets: dict[str, int] = field(default_factory=dict)

    @property
    def p(self) -> int:
        return len(self.columns)


def _r_level_name(v) -> str:
    return str(v)


def design(cells: DataFrame) -> Design:
    """Factor levels, read from the (small, materialised) cell table.  They are
    counted first: more columns than one driver solves are an error, not a collect."""
    counts = cells.agg(*[F.count_distinct(c).alias(c) for c in FACTORS]).first()
    a, b = INTERACTION
    p = 1 + sum(max(counts[c] - 1, 0) for c in FACTORS) + max(counts[a] - 1, 0) * max(counts[b] - 1, 0)
    if p > MAX_COLUMNS:
        raise ValueError(f"{p} design columns exceed the {MAX_COLUMNS} that one driver solves")
    row = cells.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in FACTORS]).first()
    levels = {c: list(row[c] or []) for c in FACTORS}
    d = Design(levels=levels)
    d.columns.append(("(Intercept)", "(Intercept)"))
    for f in FACTORS:
        d.offsets[f] = len(d.columns)
        for lv in levels[f][1:]:
            d.columns.append((f, f"{f}{_r_level_name(lv)}"))
    d.offsets["method:metric"] = len(d.columns)
    for lb in levels[b][1:]:
        for la in levels[a][1:]:
            d.columns.append(("method:metric", f"{a}{la}:{b}{lb}"))
    return d


def _pos(col: str, levels: list) -> Column:
    """1-based position of the value among the sorted levels (literal array)."""
    lit = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<string>")
    return F.array_position(lit, F.col(col)).cast("int")


def cell_stats(glm: DataFrame, center: float = 0.0) -> DataFrame:
    """Cells of identical design rows: n, sum y, sum y^2 of y = score - center."""
    y = F.col("score") - F.lit(center)
    return complete_rows(glm).groupBy(*FACTORS).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"),
                                                    F.sum(y * y).alias("syy"))


def _active(d: Design) -> Column:
    """Array of the design columns a cell activates (baseline levels none)."""
    parts = [F.array(F.lit(0))]
    for f in FACTORS:
        pos = _pos(f, d.levels[f])
        parts.append(F.when(pos > 1, F.array(pos - 2 + d.offsets[f])).otherwise(F.array().cast("array<int>")))
    a, b = INTERACTION
    pa, pb = _pos(a, d.levels[a]), _pos(b, d.levels[b])
    na = max(len(d.levels[a]) - 1, 0)
    inter = (pb - 2) * na + (pa - 2) + d.offsets["method:metric"]
    parts.append(F.when((pa > 1) & (pb > 1), F.array(inter)).otherwise(F.array().cast("array<int>")))
    return F.concat(*parts)


@dataclass
class CrossProducts:
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    n: float
    sum_y: float
    center: float = 0.0           # what was taken off the score; the intercept gets it back


def cross_products(cells: DataFrame, d: Design, center: float = 0.0) -> CrossProducts:
    """X'X, X'y, y'y from the cells; only p x p values reach the driver."""
    act = cells.select(_active(d).alias("a"), "n", "sy", "syy")
    pairs = act.select(F.explode("a").alias("i"), "a", "n").select("i", F.explode("a").alias("j"), "n")
    xtx_rows = pairs.groupBy("i", "j").agg(F.sum("n").alias("v")).toArrow()
    xty_rows = act.select(F.explode("a").alias("i"), "sy").groupBy("i").agg(F.sum("sy").alias("v")).toArrow()
    tot = cells.agg(F.sum("syy").alias("yy"), F.sum("n").alias("n"), F.sum("sy").alias("sy")).first()
    p = d.p
    xtx = np.zeros((p, p))
    xtx[xtx_rows["i"].to_numpy(), xtx_rows["j"].to_numpy()] = xtx_rows["v"].to_numpy()
    xty = np.zeros(p)
    xty[xty_rows["i"].to_numpy()] = xty_rows["v"].to_numpy()
    return CrossProducts(xtx, xty, float(tot["yy"] or 0.0), float(tot["n"] or 0.0), float(tot["sy"] or 0.0), center)


# ------------------------------------------------------------ fitting

@dataclass
class Fit:
    model: int
    terms: list[str]
    columns: list[int]            # design columns in model order
    kept: list[int]               # non-aliased columns (subset of ``columns``)
    effects: dict[int, float]     # QR effect per kept column
    beta: dict[int, float]
    low: np.ndarray               # Cholesky factor of X_A'X_A over ``kept``
    rss: float
    n: float
    tss: float

    @cached_property
    def low_inverse(self) -> np.ndarray:
        return _invert(self.low)

    @property
    def cov_diagonal(self) -> np.ndarray:
        """Diagonal of (X_A'X_A)^-1."""
        return (self.low_inverse ** 2).sum(axis=0)

    @property
    def rank(self) -> int:
        return len(self.kept)

    @property
    def df_resid(self) -> float:
        return self.n - self.rank

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_resid if self.df_resid > 0 else float("nan")

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else float("nan")

    @property
    def adj_r2(self) -> float:
        if self.n - self.rank <= 0:
            return float("nan")
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / (self.n - self.rank)

    @property
    def aic(self) -> float:
        """R ``AIC`` for lm: n (log(2 pi RSS / n) + 1) + 2 (rank + 1); a perfect fit has -inf."""
        if self.rss <= 0:
            return float("-inf")
        return self.n * (math.log(2 * math.pi * self.rss / self.n) + 1) + 2 * (self.rank + 1)


def model_columns(d: Design, terms: list[str]) -> list[int]:
    cols = [0]
    for t in terms:
        cols += [i for i, (term, _n) in enumerate(d.columns) if term == t]
    return cols


def _forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve low @ x = b for a lower triangle, O(k^2)."""
    x = np.zeros(len(b))
    for i in range(len(b)):
        x[i] = (b[i] - low[i, :i] @ x[:i]) / low[i, i]
    return x


def _backward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve low.T @ x = b for a lower triangle, O(k^2)."""
    x = np.array(b, dtype=float)
    for i in range(len(b) - 1, -1, -1):
        x[i] /= low[i, i]
        x[:i] -= low[i, :i] * x[i]
    return x


def _invert(low: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangle, row by row from the rows above."""
    out = np.zeros_like(low)
    for k in range(len(low)):
        out[k, :k] = np.einsum("i,ij->j", low[k, :k], out[:k, :k]) / -low[k, k]
        out[k, k] = 1 / low[k, k]
    return out


def fit(cp: CrossProducts, d: Design, model: int) -> Fit:
    """Ordered Cholesky sweep = R's QR with its pivoting: a column that is a
    combination of earlier columns (relative residual norm below QR_TOL, or
    below what rounding leaves of a zero in X'X) is aliased and dropped."""
    terms = MODELS[model]
    cols = model_columns(d, terms)
    kept: list[int] = []
    L = np.zeros((0, 0))
    c: list[float] = []
    effects: dict[int, float] = {}
    full = np.zeros((len(cols), len(cols)))
    for j in cols:
        g_jj = cp.xtx[j, j]
        if g_jj <= 0:
            continue
        k = len(kept)
        g_aj = cp.xtx[np.ix_(kept, [j])].ravel() if kept else np.zeros(0)
        z = _forward(full[:k, :k], g_aj)
        r = g_jj - float(z @ z)
        if r <= ALIAS_TOL * (k + 1) * g_jj:      # what rounding leaves of a zero grows with the terms summed
            continue
        rt = math.sqrt(r)
        full[k, :k], full[k, k] = z, rt
        L = full[:k + 1, :k + 1]
        cj = (cp.xty[j] - (float(z @ np.array(c)) if kept else 0.0)) / rt
        c.append(cj)
        effects[j] = cj
        kept.append(j)
    cvec = np.array(c)
    beta_vec = _backward(L, cvec)
    if kept and kept[0] == 0:
        beta_vec[0] += cp.center
    rss = max(cp.yty - float(cvec @ cvec), 0.0)
    tss = cp.yty - (cp.sum_y ** 2) / cp.n if cp.n else 0.0
    return Fit(model=model, terms=terms, columns=cols, kept=kept, effects=effects,
               beta=dict(zip(kept, beta_vec.tolist())), low=L, rss=rss, n=cp.n, tss=tss)


@dataclass
class ModelSet:
    design: Design
    cross: CrossProducts
    fits: dict[int, Fit]
    cells: DataFrame | None = None

    @property
    def best(self) -> Fit:
        return min(self.fits.values(), key=lambda f: (f.aic, f.model))


def fit_models(glm: DataFrame) -> ModelSet:
    """M2: the four models from one pass over the cells.  Raises when the
    input has too few rows (the report skips the analysis)."""
    # one pass over the rows: the cells (one row per distinct design row)
    # are materialised once and everything else reads them
    # the mean is taken off first, so that large means cost no digits of the sums
    center = float(complete_rows(glm).agg(F.avg("score").alias("m")).first()["m"] or 0.0)
    cells = stable(cell_stats(glm, center))
    d = design(cells)
    cp = cross_products(cells, d, center)
    if cp.n <= MIN_ROWS:
        raise ValueError(f"a model needs more than {MIN_ROWS} complete rows, there are {int(cp.n)}")
    return ModelSet(design=d, cross=cp, fits={m: fit(cp, d, m) for m in MODELS}, cells=cells)


# ------------------------------------------------------------ distributions (driver, scalar)

def _jvm_dist(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.commons.math3.distribution


def f_sf(spark: SparkSession, f: float, df1: float, df2: float) -> float:
    if not (f == f) or df1 <= 0 or df2 <= 0:
        return float("nan")
    if f == float("inf"):
        return 0.0
    # the upper tail itself (1 - CDF underflows): I_{d2/(d2 + d1 F)}(d2/2, d1/2)
    beta = spark.sparkContext._jvm.org.apache.commons.math3.special.Beta
    return beta.regularizedBeta(float(df2 / (df2 + df1 * f)), float(df2 / 2), float(df1 / 2))


def t_two_sided(spark: SparkSession, t: float, df: float) -> float:
    if not (t == t) or df <= 0:
        return float("nan")
    return 2.0 * _jvm_dist(spark).TDistribution(float(df)).cumulativeProbability(-abs(float(t)))


# ------------------------------------------------------------ result tables

def model_aic(spark: SparkSession, ms: ModelSet) -> DataFrame:
    """M3/M6/M7 inputs: per model AIC, rank, RSS, R^2, adjusted R^2 and
    whether it is the best (lowest AIC)."""
    best = ms.best.model
    rows = [(m, MODEL_NAMES[m], float(f.aic), int(f.rank), float(f.rss), float(f.r2), float(f.adj_r2), m == best)
            for m, f in sorted(ms.fits.items())]
    return spark.createDataFrame(rows, "model int, name string, aic double, rank int, rss double, r_squared double, "
                                       "adj_r_squared double, is_best boolean")


def anova(spark: SparkSession, ms: ModelSet, model: int | None = None) -> DataFrame:
    """M4: sequential (type I) ANOVA of the best model, with each term's share
    of the total sum of squares (residual included)."""
    f = ms.fits[model] if model else ms.best
    d = ms.design
    rows = []
    ms_res = f.sigma2
    for t in f.terms:
        cols = [j for j in f.kept if d.columns[j][0] == t]
        if not cols:
            continue
        ss = float(sum(f.effects[j] ** 2 for j in cols))
        df = len(cols)
        fval = (ss / df) / ms_res if ms_res and ms_res > 0 else float("nan")
        rows.append((t, df, ss, ss / df, fval, f_sf(spark, fval, df, f.df_resid)))
    rows.append(("Residuals", int(f.df_resid), float(f.rss), float(ms_res), None, None))
    total = sum(r[2] for r in rows)
    out = [(t, int(df), ss, msq, fv, pv, round(100.0 * ss / total, 2) if total else None)
           for t, df, ss, msq, fv, pv in rows]
    return spark.createDataFrame(out, "term string, df int, sum_sq double, mean_sq double, f_value double, "
                                      "p_value double, percent_variance double")


def variance_shares(spark: SparkSession, ms: ModelSet, model: int | None = None) -> DataFrame:
    """M4: the terms (no residuals) with their share of the variance, largest first."""
    a = anova(spark, ms, model).where(F.col("term") != "Residuals")
    return a.select("term", "df", "sum_sq", "percent_variance").orderBy(F.desc("percent_variance"), "term")


def dropped_terms(ms: ModelSet, model: int | None = None) -> list[str]:
    """Terms without a column of their own (a single level, or all aliased); ``anova`` leaves them out."""
    f = ms.fits[model] if model else ms.best
    return [t for t in f.terms if not any(ms.design.columns[j][0] == t for j in f.kept)]


def coefficients(spark: SparkSession, ms: ModelSet, model: int | None = None, n: int | None = 20) -> DataFrame:
    """M5: estimate, SE, t and p of every non-aliased coefficient except the
    intercept, by absolute size (top ``n``)."""
    f = ms.fits[model] if model else ms.best
    d = ms.design
    s2 = f.sigma2
    cov = f.cov_diagonal
    rows = []
    for k, j in enumerate(f.kept):
        if j == 0:
            continue
        est = f.beta[j]
        se = math.sqrt(cov[k] * s2) if s2 == s2 else float("nan")
        t = est / se if se > 0 else float("nan")
        rows.append((d.columns[j][1], d.columns[j][0], est, se, t, t_two_sided(spark, t, f.df_resid), abs(est)))
    rows.sort(key=lambda r: (-r[6], r[0]))
    if n:
        rows = rows[:n]
    df = spark.createDataFrame(rows, "factor string, term string, coefficient double, se double, t_value double, "
                                     "p_value double, abs_coefficient double")
    return df


def factor_type(name: Column) -> Column:
    """The report's ``case_when`` on a coefficient name (first match wins,
    so interactions count as Method)."""
    expr = None
    for pattern, label in FACTOR_TYPES:
        expr = F.when(name.rlike(pattern), F.lit(label)) if expr is None else expr.when(name.rlike(pattern), F.lit(label))
    return expr.otherwise(F.lit("Other"))


def coef_effects(spark: SparkSession, ms: ModelSet, n: int = 30) -> DataFrame:
    """Top coefficients with factor type and significance flag."""
    c = coefficients(spark, ms, None, None)
    c = c.withColumn("factor_type", factor_type(F.col("factor"))) \
         .withColumn("significant", F.col("p_value") < SIGNIFICANCE)
    return c.where(F.col("factor_type") != "Other").orderBy(F.col("abs_coefficient").desc(), "factor").limit(n)


def factor_importance(spark: SparkSession, ms: ModelSet) -> DataFrame:
    """per factor type, significant / total coefficients and their sizes."""
    c = coefficients(spark, ms, None, None).withColumn("factor_type", factor_type(F.col("factor")))
    sig = F.count_if(F.col("p_value") < SIGNIFICANCE)
    return (c.groupBy("factor_type").agg(
        sig.cast("bigint").alias("n_significant"), F.count(F.lit(1)).cast("bigint").alias("n_total"),
        (sig / F.count(F.lit(1))).alias("prop_significant"),
        F.avg(F.abs("coefficient")).alias("mean_abs_coef"), F.max(F.abs("coefficient")).alias("max_abs_coef"))
        .orderBy(F.col("mean_abs_coef").desc()))


def seed_contribution(spark: SparkSession, ms: ModelSet) -> DataFrame:
    """M7: R^2 of model 2 minus model 1 (always computed; see README)."""
    r1, r2 = ms.fits[1].r2, ms.fits[2].r2
    return spark.createDataFrame([(float(r1), float(r2), float(r2 - r1))],
                                 "r_squared_no_seed double, r_squared_with_seed double, seed_contribution double")


def _poly(coefs: list[float], x: str) -> str:
    out = repr(coefs[0])
    for k in coefs[1:]:
        out = f"({out} * {x} + {k!r})"
    return out


def normal_quantile_sql(p: str, t: str, q: str) -> str:
    """Standard normal quantile (Acklam's rational approximation, |rel err|
    < 1.2e-9) of the column ``p`` as SQL text; ``t`` names sqrt(-2 ln min(p, 1 - p))
    and ``q`` names p - 0.5."""
    num, den = _poly(QNORM_TAIL[0], t), _poly([*QNORM_TAIL[1], 1.0], t)
    r = f"({q} * {q})"
    mid = f"{_poly(QNORM_MIDDLE[0], r)} * {q} / {_poly([*QNORM_MIDDLE[1], 1.0], r)}"
    return (f"CASE WHEN {p} < {QNORM_SPLIT} THEN {num} / {den} "
            f"WHEN {p} > 1 - {QNORM_SPLIT} THEN -{num} / {den} ELSE {mid} END")


def _with_normal_quantile(df: DataFrame, p: Column, out: str) -> DataFrame:
    low = F.when(F.col("_p") < 0.5, F.col("_p")).otherwise(1 - F.col("_p"))
    return (df.withColumn("_p", p).withColumns({"_t": F.sqrt(-2 * F.log(low)), "_q": F.col("_p") - 0.5})
            .withColumn(out, F.expr(normal_quantile_sql("_p", "_t", "_q"))).drop("_p", "_t", "_q"))


def _ordered_sum(items: Column) -> Column:
    """Sum of ``items[].x`` in ``items[].i`` order (deterministic)."""
    return F.aggregate(F.array_sort(items), F.lit(0.0), lambda acc, e: acc + e["x"])


def _solved_columns(spark: SparkSession, f: Fit) -> DataFrame:
    """Per kept design column ``i`` its coefficient ``b`` and ``row``, entry (i, j) of
    (X'X)^-1 for the design columns j = 0..i (0 where j is not kept).  Arrow buffers
    carry the triangle: p * p * 4 bytes, 64 MB for ``MAX_COLUMNS``."""
    linv, kept = f.low_inverse, np.array(f.kept, dtype=np.int64)
    rows = []
    for k, j in enumerate(f.kept):
        row = np.zeros(j + 1)
        row[kept[:k + 1]] = np.einsum("i,ij->j", linv[k:, k], linv[k:, :k + 1])
        rows.append(row)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0)
    return spark.createDataFrame(pa.table({
        "i": pa.array(f.kept, pa.int32()), "b": pa.array([f.beta[j] for j in f.kept], pa.float64()),
        "row": pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float64()))}))


def residual_diagnostics(glm: DataFrame, ms: ModelSet, model: int | None = None) -> DataFrame:
    """M8: per row fitted value, residual, leverage, standardized residual and
    normal QQ quantile (the data behind ``plot(lm)``), computed on the cluster.

    Fitted values and leverages are cell properties: the cells list their at most
    seven active columns, meet each column's coefficient and its row of (X'X)^-1
    in one join, and are joined onto rows.
    """
    spark = glm.sparkSession
    f = ms.fits[model] if model else ms.best
    d = ms.design
    in_model = set(f.columns)
    glm = complete_rows(glm)
    cells = ms.cells.select(*FACTORS) if ms.cells is not None else glm.select(*FACTORS).distinct()
    act = cells.select(*FACTORS, F.filter(_active(d), lambda x: x.isin(*sorted(in_model))).alias("a"))
    one = act.select(*FACTORS, "a", F.explode("a").alias("i")).join(_solved_columns(spark, f), "i")
    # x'(X'X)^-1 x by the lower triangle: entries off the diagonal count twice
    lever = F.aggregate(F.filter("a", lambda j: j <= F.col("i")), F.lit(0.0),
                        lambda acc, j: acc + F.get("row", j) * F.when(j < F.col("i"), 2.0).otherwise(1.0))
    parts = one.select(*FACTORS, "i", "b", lever.alias("h"))
    # sums over at most 7 terms, added in a fixed order so that recomputation is bit-identical
    cellv = parts.groupBy(*FACTORS).agg(
        _ordered_sum(F.collect_list(F.struct("i", F.col("b").alias("x")))).alias("fitted"),
        _ordered_sum(F.collect_list(F.struct("i", F.col("h").alias("x")))).alias("leverage"))
    rows = glm.select(*FACTORS, "score").join(cellv, FACTORS, "inner")
    sigma = math.sqrt(f.sigma2) if f.sigma2 == f.sigma2 else float("nan")
    rows = rows.withColumn("residual", F.col("score") - F.col("fitted"))
    rows = rows.withColumn("std_residual", F.when(F.col("leverage") < 1.0 - 1e-12,
                                                  F.col("residual") / (F.lit(sigma) * F.sqrt(1 - F.col("leverage")))))
    # equal cells and scores give equal residuals: rank the distinct ones, then the rows by key
    points = rows.groupBy("std_residual").agg(F.count(F.lit(1)).alias("_c")).where(F.col("std_residual").isNotNull())
    before = exclusive_prefix(stable(points), [], ["std_residual"], "_c", how="sum", out="_before")
    ranks = before.select(F.col("std_residual").alias("_s"), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias("_r"))
    ranked = rows.join(ranks, F.col("std_residual") == F.col("_s"), "left").drop("_s")
    n = float(before.agg(F.sum("_c")).first()[0] or 0)   # rows without a standardised residual have no quantile
    a = 3.0 / 8.0 if n <= 10 else 0.5
    pp = (F.col("_r") - a) / (n + 1 - 2 * a)
    return _with_normal_quantile(ranked, pp, "theoretical_quantile").drop("_r")
