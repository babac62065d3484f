"""Linear models from sufficient statistics against numpy least squares."""

import numpy as np
import pandas as pd
import pytest

from benchscope.operators import linear_model as lm


def _design(pdf, terms):
    cols = [np.ones(len(pdf))]
    blocks = []
    for t in terms:
        if t == "method:metric":
            ml = sorted(pdf["method"].unique())[1:]
            kl = sorted(pdf["metric"].unique())[1:]
            block = [((pdf["method"] == a) & (pdf["metric"] == b)).to_numpy(float) for b in kl for a in ml]
        else:
            lv = sorted(pdf[t].unique())[1:]
            block = [(pdf[t] == v).to_numpy(float) for v in lv]
        cols += block
        blocks.append((t, len(block)))
    return np.column_stack(cols), blocks


def _check(glm, ms):
    pdf = glm.select(*lm.FACTORS, "score").toPandas()
    y = pdf["score"].to_numpy()
    for m, terms in lm.MODELS.items():
        X, blocks = _design(pdf, terms)
        beta, _r, rank, _s = np.linalg.lstsq(X, y, rcond=None)
        rss = float(((y - X @ beta) ** 2).sum())
        f = ms.fits[m]
        assert f.rank == rank
        assert f.rss == pytest.approx(rss, rel=1e-9, abs=1e-9)
        prev, start = float(((y - y.mean()) ** 2).sum()), 1
        for t, k in blocks:
            Xs = X[:, :start + k]
            r2 = float(((y - Xs @ np.linalg.lstsq(Xs, y, rcond=None)[0]) ** 2).sum())
            mine = sum(f.effects[j] ** 2 for j in f.kept if ms.design.columns[j][0] == t)
            assert mine == pytest.approx(prev - r2, rel=1e-7, abs=1e-9)
            prev, start = r2, start + k


def test_models_match_numpy(views):
    glm = lm.glm_input(views.metric)
    _check(glm, lm.fit_models(glm))


def test_aliased_columns_are_dropped(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        ds = ["d1", "d2", "d3"][i % 3]
        method = {"d1": "ma", "d2": "mb", "d3": "mc"}[ds]          # method confounded with dataset
        rows.append((ds, method, ["x", "y"][i % 2], ["b1", "b2"][(i // 2) % 2], int(i % 4), float(rng.normal())))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["dataset", "method", "metric", "backend",
                                                           "seed_factor", "score"]))
    ms = lm.fit_models(df)
    _check(df, ms)
    assert ms.fits[1].rank < len(lm.model_columns(ms.design, lm.MODELS[1]))


def test_small_input_raises(spark):
    df = spark.createDataFrame([("d", "m", "x", "b", 1, 0.5)] * 10,
                               "dataset string, method string, metric string, backend string, seed_factor bigint, score double")
    with pytest.raises(ValueError):
        lm.fit_models(df)


def test_anova_and_coefficients_tables(views):
    glm = lm.glm_input(views.metric)
    ms = lm.fit_models(glm)
    spark = glm.sparkSession
    a = lm.anova(spark, ms).toPandas()
    assert a["term"].iloc[-1] == "Residuals"
    assert a["percent_variance"].sum() == pytest.approx(100, abs=0.1)
    c = lm.coefficients(spark, ms).toPandas()
    assert len(c) <= 20 and (c["abs_coefficient"].diff().dropna() <= 0).all()
    d = lm.residual_diagnostics(glm, ms).toPandas()
    assert len(d) == glm.count()
    assert d["leverage"].between(0, 1).all()
    d = d.sort_values("std_residual")
    assert d["theoretical_quantile"].is_monotonic_increasing


def _runs(n, rng):
    return pd.DataFrame({"dataset": rng.choice(["d1", "d2"], n), "method": rng.choice(["ma", "mb", "mc"], n),
                         "metric": rng.choice(["x", "y"], n), "backend": rng.choice(["b1", "b2"], n),
                         "seed_factor": rng.integers(0, 3, n), "score": rng.normal(size=n)})


def test_rows_with_a_missing_factor_are_left_out(spark):
    pdf = _runs(300, np.random.default_rng(2))
    pdf.loc[:99, "backend"] = None
    df = spark.createDataFrame(pdf.where(pdf.notna(), None).astype({"seed_factor": "int64"}),
                               "dataset string, method string, metric string, backend string, seed_factor long, score double")
    ms = lm.fit_models(df)
    assert ms.cross.n == 200
    _check(lm.complete_rows(df), ms)
    assert lm.residual_diagnostics(df, ms).count() == 200
    assert lm.glm_input_counts(df).first()["n_backend"] == 3          # NULL is a level of its own here


def test_perfect_fit(spark):
    score = {"ma": 1.0, "mb": 0.75, "mc": 0.25}
    pdf = _runs(120, np.random.default_rng(3))
    pdf["score"] = pdf["method"].map(score)
    ms = lm.fit_models(spark.createDataFrame(pdf))
    assert ms.best.rss == pytest.approx(0, abs=1e-24)
    assert ms.fits[1].aic == float("-inf") or ms.fits[1].aic < -1000
    zero = lm.Fit(1, [], [0], [0], {}, {0: 1.0}, np.eye(1), 0.0, 100.0, 1.0)
    assert zero.aic == float("-inf")


def test_large_mean_keeps_its_digits(spark):
    pdf = _runs(400, np.random.default_rng(4))
    pdf["score"] = 0.999 + 1e-8 * pdf["score"]
    f = lm.fit_models(spark.createDataFrame(pdf)).fits[1]
    y = pdf["score"].to_numpy()
    X, _ = _design(pdf, lm.MODELS[1])
    c = y - y.mean()
    rss = float(((c - X @ np.linalg.lstsq(X, c, rcond=None)[0]) ** 2).sum())
    assert f.rss == pytest.approx(rss, rel=1e-5) and f.tss == pytest.approx(float((c ** 2).sum()), rel=1e-6)
    assert f.beta[0] == pytest.approx(0.999, abs=1e-6)


def test_small_tails_do_not_underflow(spark):
    assert 0 < lm.f_sf(spark, 500.0, 3, 200) < 1e-80
    assert 0 < lm.t_two_sided(spark, 30.0, 200) < 1e-70
    assert lm.t_two_sided(spark, 0.0, 10) == pytest.approx(1.0)
    assert lm.f_sf(spark, 2.0, 1, 50) == pytest.approx(lm.t_two_sided(spark, 2.0 ** 0.5, 50), rel=1e-9)


def test_variance_shares_are_sorted(spark):
    ms = lm.fit_models(spark.createDataFrame(_runs(200, np.random.default_rng(6))))
    shares = [r["percent_variance"] for r in lm.variance_shares(spark, ms).collect()]
    assert shares == sorted(shares, reverse=True) and len(shares) >= 4
    assert lm.dropped_terms(ms) == []
