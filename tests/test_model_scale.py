"""Linear models near the stated number of columns, and beyond it."""

import resource

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from benchscope.operators import linear_model as lm


def _rows(spark, seeds, n):
    """One row a (seed, replicate); the other factors vary with the row."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("d"), i % 3).alias("dataset"), F.concat(F.lit("m"), F.shiftright(i, 2) % 2).alias("method"),
        F.concat(F.lit("k"), F.shiftright(i, 3) % 2).alias("metric"), F.concat(F.lit("b"), F.shiftright(i, 4) % 2).alias("backend"),
        (i % seeds).alias("seed_factor"), (F.pmod(F.hash("id"), F.lit(1009)) / 1009).alias("score"))


def test_more_levels_than_the_driver_solves_are_an_error_before_any_collect(spark):
    with pytest.raises(ValueError, match="design columns exceed"):
        lm.fit_models(_rows(spark, lm.MAX_COLUMNS + 10, 3 * lm.MAX_COLUMNS))


def test_leverage_of_many_columns_matches_numpy(spark):
    seeds, n = 240, 1200
    df = _rows(spark, seeds, n)
    ms = lm.fit_models(df)
    got = lm.residual_diagnostics(df, ms, 4).toPandas()
    pdf = df.toPandas()
    x = pd.get_dummies(pdf[lm.FACTORS].astype(str), drop_first=True).to_numpy(float)
    cross = ((pdf["method"] == "m1") & (pdf["metric"] == "k1")).to_numpy(float)
    u, s, _v = np.linalg.svd(np.column_stack([np.ones(n), x, cross]), full_matrices=False)
    u = u[:, s > 1e-9 * s[0]]
    assert ms.fits[4].rank == u.shape[1] < x.shape[1] + 2      # dataset and method follow from the seed: aliased
    assert len(got) == n and got["leverage"].sum() == pytest.approx(u.shape[1], rel=1e-9)
    pdf["lev"], pdf["fit"] = (u ** 2).sum(axis=1), u @ (u.T @ pdf["score"])
    one = pdf.drop_duplicates([*lm.FACTORS, "score"])
    both = got.drop_duplicates([*lm.FACTORS, "score"]).merge(one, on=[*lm.FACTORS, "score"])
    assert len(both) == len(one)
    assert np.allclose(both["leverage"], both["lev"], atol=1e-9) and np.allclose(both["fitted"], both["fit"], atol=1e-9)


def test_triangle_of_the_full_width_is_shipped_in_buffers(spark):
    p = 2000
    f = lm.Fit(1, [], list(range(p)), list(range(p)), {}, dict.fromkeys(range(p), 1.0), np.eye(p) * 2.0, 1.0, 1e6, 2.0)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    t = lm._solved_columns(spark, f)
    row = t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("row")).alias("v"), F.sum(F.get("row", F.col("i"))).alias("d")).first()
    assert (row["n"], row["v"], row["d"]) == (p, p * (p + 1) // 2, p * 0.25)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000      # KB; tuples took gigabytes
