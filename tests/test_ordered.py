"""Range-split primitives against pandas / numpy on data with ties, NULLs and
one group holding most rows."""

import numpy as np
import pandas as pd
import pytest

from benchscope.operators.ordered import average_rank, distribution, exact_quantiles, exclusive_prefix
from benchscope.schema import clean_nan


def _frame(rng, n=400):
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    x = rng.integers(0, 40, n).astype(float) / 4
    x[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"g": g, "x": x})


@pytest.mark.parametrize("seed", [1, 2])
def test_exclusive_prefix_max_and_sum(spark, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "a", "b"], 300, p=[0.7, 0.2, 0.1]),
                        "x": rng.permutation(300).astype(float), "v": rng.integers(0, 100, 300).astype(float)})
    df = spark.createDataFrame(pdf)
    for how in ("max", "sum"):
        got = exclusive_prefix(df, ["g"], ["x"], "v", how=how, out="pre").toPandas().sort_values(["g", "x"])
        exp = pdf.sort_values(["g", "x"]).copy()
        if how == "max":
            exp["pre"] = exp.groupby("g")["v"].transform(lambda s: s.cummax().shift(1))
        else:
            exp["pre"] = exp.groupby("g")["v"].transform(lambda s: s.cumsum().shift(1)).fillna(0)
        np.testing.assert_allclose(got["pre"].to_numpy(dtype=float), exp["pre"].to_numpy(dtype=float), equal_nan=True)


def test_exclusive_prefix_without_partition(spark):
    pdf = pd.DataFrame({"x": np.arange(100, dtype=float), "v": (np.arange(100) % 7).astype(float)})
    got = exclusive_prefix(spark.createDataFrame(pdf), [], ["x"], "v", how="max", out="pre").toPandas().sort_values("x")
    exp = pdf["v"].cummax().shift(1)
    np.testing.assert_allclose(got["pre"].to_numpy(dtype=float), exp.to_numpy(dtype=float), equal_nan=True)


@pytest.mark.parametrize("descending", [False, True])
def test_average_rank_matches_pandas(spark, descending):
    rng = np.random.default_rng(3)
    pdf = _frame(rng)
    pdf["id"] = np.arange(len(pdf))
    got = average_rank(clean_nan(spark.createDataFrame(pdf)), ["g"], "x", "r", descending=descending).toPandas().sort_values("id")
    exp = pdf.groupby("g")["x"].rank(method="average", ascending=not descending, na_option="keep")
    np.testing.assert_allclose(got["r"].to_numpy(dtype=float), exp.sort_index().to_numpy(dtype=float), equal_nan=True)


def test_exact_quantiles_type7(spark):
    rng = np.random.default_rng(4)
    pdf = _frame(rng, 600)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0, 0.1]
    got = exact_quantiles(clean_nan(spark.createDataFrame(pdf)), ["g"], {"x": "x"}, probs).toPandas()
    for (g, p), q in got.set_index(["g", "p"])["q"].items():
        vals = pdf.loc[pdf.g == g, "x"].dropna().to_numpy()
        assert q == pytest.approx(np.quantile(vals, p, method="linear"), rel=1e-12, abs=1e-12)
    assert len(got) == len(probs) * pdf.g.nunique()


@pytest.mark.parametrize("keys", [["g"], []])
def test_moments_and_quantiles_from_one_frame_of_counts(spark, tmp_path, keys):
    """Against pandas, with a hot group, NULLs, a group of NULLs and one of a single value; the source is not read again."""
    rng = np.random.default_rng(8)
    pdf = pd.concat([_frame(rng, 700), pd.DataFrame({"g": ["void", "void", "one", None], "x": [np.nan, np.nan, 1e9 + 0.5, -3.0]})])
    clean_nan(spark.createDataFrame(pdf)).write.parquet(str(tmp_path / "t"))
    out = distribution(spark.read.parquet(str(tmp_path / "t")), keys, "x", (0.5, 0.1, 1.0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # the frozen counts feed all results
    got = {r["g"] if keys else "all": r for r in out.collect()}
    pdf["g"] = pdf["g"].map(lambda g: g if isinstance(g, str) else None) if keys else "all"
    assert len(got) == pdf["g"].nunique(dropna=False)
    for g, r in got.items():
        x = pdf["x"][pdf["g"].isna() if g is None else pdf["g"] == g]
        v = x.dropna()
        assert (r["rows"], r["n"]) == (len(x), len(v))
        if v.empty:
            assert r["mean"] is r["sd"] is r["min"] is r["max"] is None and r["q"] == [None] * 3
            continue
        assert (r["min"], r["max"]) == (v.min(), v.max())
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-12)
        assert r["sd"] is None if len(v) == 1 else r["sd"] == pytest.approx(v.std(), rel=1e-10)
        assert r["q"] == pytest.approx([np.quantile(v, p) for p in (0.5, 0.1, 1.0)], rel=1e-12)


def test_distribution_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert distribution(empty, ["g"], "x").count() == 0
    row = distribution(empty, [], "x").first()
    assert (row["rows"], row["n"], row["mean"], row["sd"], row["q"]) == (0, 0, None, None, [None])


def test_global_top_k_keeps_ties_and_needs_no_single_partition(spark):
    """G3 without partitions: as rank() <= k, with NULL last, and no exchange of all rows."""
    from benchscope.operators.ranking import top_k_with_ties
    values = [5.0, 3.0, 5.0, 1.0, None, 3.0, 2.0, None, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double")

    def brute(k, descending):
        key = lambda v: (v is None, 0 if v is None else (-v if descending else v))
        return sorted(i for i, v in enumerate(values) if sum(key(w) < key(v) for w in values) < k)

    for k in (1, 2, 3, 5, 8, 20):
        for descending in (True, False):
            out = top_k_with_ties(df, [], "x", k, descending)
            assert out.columns == df.columns
            assert sorted(r["i"] for r in out.collect()) == brute(k, descending), (k, descending)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
