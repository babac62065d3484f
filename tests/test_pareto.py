"""Pareto frontier (prefix-max formulation) against the quadratic definition."""

import numpy as np
import pandas as pd
import pytest

from benchscope.operators.pareto import pareto_frontier
from benchscope.schema import clean_nan


def brute(pdf, x, y, minimize_x, maximize_y):
    xs, ys = pdf[x].to_numpy(), pdf[y].to_numpy()
    out = []
    for i in range(len(pdf)):
        dominated = False
        for j in range(len(pdf)):
            if i == j:
                continue
            xb = xs[j] <= xs[i] if minimize_x else xs[j] >= xs[i]
            yb = ys[j] >= ys[i] if maximize_y else ys[j] <= ys[i]
            if xb and yb and (xs[j] != xs[i] or ys[j] != ys[i]):
                dominated = True
                break
        out.append(not dominated)
    return np.array(out)


@pytest.mark.parametrize("minimize_x,maximize_y", [(True, True), (True, False), (False, True), (False, False)])
def test_frontier_matches_definition(spark, minimize_x, maximize_y):
    rng = np.random.default_rng(7)
    n = 240
    pdf = pd.DataFrame({"part": rng.choice(["hot", "p1", "p2"], n, p=[0.6, 0.3, 0.1]),
                        "x": rng.integers(0, 25, n) / 2.0, "y": rng.integers(0, 25, n) / 4.0})
    pdf["id"] = np.arange(n)
    got = pareto_frontier(spark.createDataFrame(pdf), "x", "y", minimize_x, maximize_y,
                          partition_cols=["part"]).toPandas().set_index("id").sort_index()
    for part, sub in pdf.groupby("part"):
        exp = brute(sub.reset_index(drop=True), "x", "y", minimize_x, maximize_y)
        np.testing.assert_array_equal(got.loc[sub["id"], "is_pareto"].to_numpy(), exp)


def test_frontier_drops_nulls_and_keeps_equal_points(spark):
    pdf = pd.DataFrame({"x": [1.0, 1.0, 2.0, None, 0.5], "y": [3.0, 3.0, 4.0, 9.0, None]})
    got = pareto_frontier(clean_nan(spark.createDataFrame(pdf)), "x", "y").toPandas().sort_values(["x", "y"])
    assert len(got) == 3
    assert got["is_pareto"].tolist() == [True, True, True]
