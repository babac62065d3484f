"""SQL of the linear-model keys (M2-M9, F41, D11, D16), DuckDB dialect.

The models are fitted without a solver: X'X (with y as one more column) is
inverted in place by a recursive query that sweeps one design column a step.
What a column takes off the y,y entry is its sequential sum of squares; after
the last step the y,y entry is the residual sum of squares, the y column holds
the coefficients and the swept block is the unscaled covariance.  A column
whose pivot has vanished is a combination of earlier ones and stays unswept.
Tails of the t and F distributions come from a second recursive query, the
continued fraction of the incomplete beta function.
"""

from __future__ import annotations

from benchscope.operators import linear_model as lm

BETA_STEPS = 400       # steps of the continued fraction; it needs about sqrt(max(a, b)) of them

_MODEL_TERMS = ", ".join(f"({m}, '{t}')" for m, terms in lm.MODELS.items() for t in terms)
_MODEL_NAMES = "CASE model " + " ".join(f"WHEN {m} THEN '{n}'" for m, n in lm.MODEL_NAMES.items()) + " END"
_LEVELS = "\n  UNION ALL ".join(
    f"SELECT {f} AS f, '{c}' AS factor, CAST({c} AS VARCHAR) AS lv, row_number() OVER (ORDER BY {c}) AS pos "
    f"FROM (SELECT DISTINCT {c} FROM cell) t" for f, c in enumerate(lm.FACTORS, 1))
_A, _B = lm.INTERACTION
_FACTOR_LIST = ", ".join(lm.FACTORS)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in lm.FACTORS)
_ACTIVE = " OR ".join(f"(c.term = '{f}' AND c.name = '{f}' || CAST(e.{f} AS VARCHAR))" for f in lm.FACTORS)
_FACTOR_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(factor, '{p}') THEN '{t}'" for p, t in lm.FACTOR_TYPES) \
    + " ELSE 'Other' END"

# y is column -1 of the swept matrix
_FIT = f"""
obs AS MATERIALIZED (SELECT {_FACTOR_LIST}, score FROM glm WHERE {_COMPLETE} AND score IS NOT NULL),
mu AS MATERIALIZED (SELECT avg(score) AS m FROM obs),
cell AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY {_FACTOR_LIST}) AS cell, *
  FROM (SELECT {_FACTOR_LIST}, CAST(count(*) AS DOUBLE) AS n, sum(score - m) AS sy, sum((score - m) * (score - m)) AS syy
        FROM obs, mu GROUP BY {_FACTOR_LIST}) t),
lvl AS MATERIALIZED ({_LEVELS}),
col AS MATERIALIZED (
  SELECT 0 AS j, '(Intercept)' AS term, '(Intercept)' AS name
  UNION ALL
  SELECT row_number() OVER (ORDER BY f, b, a), term, name FROM (
    SELECT f, 0 AS b, pos AS a, factor AS term, factor || lv AS name FROM lvl WHERE pos > 1
    UNION ALL
    SELECT 9, y.pos, x.pos, '{_A}:{_B}', '{_A}' || x.lv || ':{_B}' || y.lv
    FROM lvl x, lvl y WHERE x.factor = '{_A}' AND y.factor = '{_B}' AND x.pos > 1 AND y.pos > 1) t),
act AS MATERIALIZED (
  SELECT e.cell, e.n, e.sy, c.j FROM cell e JOIN col c ON c.j = 0 OR {_ACTIVE}
    OR (c.term = '{_A}:{_B}' AND c.name = '{_A}' || CAST(e.{_A} AS VARCHAR) || ':{_B}' || CAST(e.{_B} AS VARCHAR))),
gram AS MATERIALIZED (
  SELECT a.j AS i, b.j, sum(a.n) AS v FROM act a JOIN act b ON a.cell = b.cell GROUP BY a.j, b.j
  UNION ALL SELECT j, -1, sum(sy) FROM act GROUP BY j
  UNION ALL SELECT -1, j, sum(sy) FROM act GROUP BY j
  UNION ALL SELECT -1, -1, sum(syy) FROM cell),
model_col AS MATERIALIZED (
  SELECT t.model, c.j, row_number() OVER (PARTITION BY t.model ORDER BY c.j) AS step
  FROM (SELECT * FROM (VALUES {_MODEL_TERMS}) v(model, term)
        UNION ALL SELECT DISTINCT model, '(Intercept)' FROM (VALUES {_MODEL_TERMS}) v(model, term)) t
  JOIN col c ON c.term = t.term),
with_y AS (SELECT model, j FROM model_col UNION ALL SELECT DISTINCT model, -1 FROM model_col),
sweep AS (
  SELECT a.model, CAST(0 AS BIGINT) AS step, a.j AS i, b.j AS j, CAST(coalesce(g.v, 0) AS DOUBLE) AS v
  FROM with_y a JOIN with_y b ON a.model = b.model LEFT JOIN gram g ON g.i = a.j AND g.j = b.j
  UNION ALL
  SELECT a.model, a.step + 1, a.i, a.j,
    CASE WHEN p.v <= {lm.ALIAS_TOL!r} * g.v THEN a.v
         WHEN a.i = t.j AND a.j = t.j THEN 1 / p.v
         WHEN a.i = t.j THEN a.v / p.v
         WHEN a.j = t.j THEN -a.v / p.v
         ELSE a.v - c.v * r.v / p.v END
  FROM sweep a JOIN model_col t ON t.model = a.model AND t.step = a.step + 1
  JOIN sweep p ON p.model = a.model AND p.i = t.j AND p.j = t.j
  JOIN sweep r ON r.model = a.model AND r.i = t.j AND r.j = a.j
  JOIN sweep c ON c.model = a.model AND c.i = a.i AND c.j = t.j
  JOIN gram g ON g.i = t.j AND g.j = t.j),
kept AS MATERIALIZED (
  SELECT t.model, t.j, y.v * y.v / p.v AS ss
  FROM model_col t
  JOIN sweep p ON p.model = t.model AND p.step = t.step - 1 AND p.i = t.j AND p.j = t.j
  JOIN sweep y ON y.model = t.model AND y.step = t.step - 1 AND y.i = t.j AND y.j = -1
  JOIN gram g ON g.i = t.j AND g.j = t.j
  WHERE p.v > {lm.ALIAS_TOL!r} * g.v),
swept AS MATERIALIZED (
  SELECT s.model, s.i, s.j, s.v FROM sweep s
  WHERE s.step = (SELECT max(step) FROM model_col t WHERE t.model = s.model)),
stat AS MATERIALIZED (
  SELECT *, CASE WHEN n > rank THEN rss / (n - rank) END AS sigma2, 1 - rss / tss AS r2,
    1 - (rss / tss) * (n - 1) / (n - rank) AS adj, n * (ln(2 * pi() * rss / n) + 1) + 2 * (rank + 1) AS aic
  FROM (SELECT k.model, k.rank, s.v AS rss, e.n, e.tss
        FROM (SELECT model, count(*) AS rank FROM kept GROUP BY model) k
        JOIN swept s ON s.model = k.model AND s.i = -1 AND s.j = -1,
        (SELECT sum(n) AS n, sum(syy) - sum(sy) * sum(sy) / sum(n) AS tss FROM cell) e) t),
best AS MATERIALIZED (SELECT * FROM stat ORDER BY aic, model LIMIT 1),
coef AS MATERIALIZED (
  SELECT c.j, c.name AS factor, c.term, y.v AS coefficient, sqrt(d.v * b.sigma2) AS se, b.n - b.rank AS df
  FROM best b JOIN kept k ON k.model = b.model JOIN col c ON c.j = k.j
  JOIN swept y ON y.model = b.model AND y.i = k.j AND y.j = -1
  JOIN swept d ON d.model = b.model AND d.i = k.j AND d.j = k.j),
term_ss AS MATERIALIZED (
  SELECT c.term, min(c.j) AS first, count(*) AS df, sum(k.ss) AS ss, any_value(b.sigma2) AS s2, any_value(b.n - b.rank) AS rdf
  FROM best b JOIN kept k ON k.model = b.model JOIN col c ON c.j = k.j WHERE c.j > 0 GROUP BY c.term)"""

# want(name, x, rest, a, b) with rest = 1 - x; tail(name, p) = I_x(a, b)
_TAIL = f"""
side AS MATERIALIZED (
  SELECT name, x < (a + 1) / (a + b + 2) AS direct,
    exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(greatest(x, 1e-300)) + b * ln(greatest(rest, 1e-300))) AS front,
    CASE WHEN x < (a + 1) / (a + b + 2) THEN x ELSE rest END AS x,
    CASE WHEN x < (a + 1) / (a + b + 2) THEN a ELSE b END AS a,
    CASE WHEN x < (a + 1) / (a + b + 2) THEN b ELSE a END AS b FROM want),
fraction AS (
  SELECT name, x, a, b, 0 AS m, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d,
    1 / (1 - (a + b) * x / (a + 1)) AS h FROM side
  UNION ALL
  SELECT name, x, a, b, m + 1, 1 + odd / c1, 1 / (1 + odd * d1), h * d1 * c1 * (1 + odd / c1) / (1 + odd * d1)
  FROM (SELECT *, 1 + even / c AS c1, 1 / (1 + even * d) AS d1
        FROM (SELECT *, (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS even,
                -(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS odd FROM fraction) q) r
  WHERE m < {BETA_STEPS}),
tail AS MATERIALIZED (
  SELECT s.name, CASE WHEN direct THEN front * h / s.a ELSE 1 - front * h / s.a END AS p
  FROM side s JOIN fraction f ON f.name = s.name AND f.m = {BETA_STEPS})"""

_T_TAILS = f"""
want AS MATERIALIZED (
  SELECT factor AS name, df / (df + t * t) AS x, t * t / (df + t * t) AS rest, df / 2 AS a, CAST(0.5 AS DOUBLE) AS b
  FROM (SELECT factor, coefficient / se AS t, df FROM coef WHERE j > 0) q),{_TAIL},
coef_p AS MATERIALIZED (SELECT c.*, t.p AS p_value FROM coef c JOIN tail t ON t.name = c.factor)"""

_F_TAILS = f"""
want AS MATERIALIZED (
  SELECT term AS name, rdf / (rdf + df * f) AS x, df * f / (rdf + df * f) AS rest, rdf / 2 AS a, df / 2 AS b
  FROM (SELECT *, ss / df / s2 AS f FROM term_ss) q),{_TAIL}"""


def model_oracles(glm: str) -> dict[str, str]:
    """Key -> SQL; ``glm`` is the text that starts with WITH and ends with the ``glm`` table."""
    head = "WITH RECURSIVE " + glm.strip()[4:].lstrip() + ","
    aic = f"{_MODEL_NAMES} AS name, round(aic, 6) AS aic"
    flag = "s.model = (SELECT model FROM best) AS is_best"
    ppoint = "(r - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END)"
    return {
        "lm_models": f"""{head}{_FIT}
SELECT s.model, {aic}, CAST(rank AS INTEGER) AS rank, round(rss, 6) AS rss, round(r2, 6) AS r_squared,
  round(adj, 6) AS adj_r_squared, {flag} FROM stat s""",
        "model_aic": f"{head}{_FIT}\nSELECT s.model, {aic}, {flag} FROM stat s",
        "model_fit": f"{head}{_FIT}\nSELECT model, round(r2, 6) AS r_squared, round(adj, 6) AS adj_r_squared FROM best",
        "seed_contribution": f"""{head}{_FIT}
SELECT round(a.r2, 6) AS r_squared_no_seed, round(b.r2, 6) AS r_squared_with_seed,
  round(b.r2 - a.r2, 6) AS seed_contribution FROM stat a, stat b WHERE a.model = 1 AND b.model = 2""",
        "anova": f"""{head}{_FIT},{_F_TAILS},
rows AS (
  SELECT term, CAST(df AS INTEGER) AS df, ss, ss / df AS ms, ss / df / s2 AS f, p FROM term_ss JOIN tail ON tail.name = term
  UNION ALL SELECT 'Residuals', CAST(n - rank AS INTEGER), rss, sigma2, NULL, NULL FROM best)
SELECT term, df, round(ss, 6) AS sum_sq, round(ms, 6) AS mean_sq, round(f, 6) AS f_value, round(p, 6) AS p_value,
  round(100 * ss / (SELECT sum(ss) FROM rows), 2) AS percent_variance FROM rows""",
        "coefficients": f"""{head}{_FIT},{_T_TAILS}
SELECT factor, term, round(coefficient, 6) AS coefficient, round(se, 6) AS se, round(coefficient / se, 6) AS t_value,
  round(p_value, 6) AS p_value, round(abs(coefficient), 6) AS abs_coefficient
FROM coef_p ORDER BY abs(coefficient) DESC, factor LIMIT 20""",
        "coef_effects": f"""{head}{_FIT},{_T_TAILS}
SELECT factor, term, round(coefficient, 6) AS coefficient, round(se, 6) AS se, round(coefficient / se, 6) AS t_value,
  round(p_value, 6) AS p_value, round(abs(coefficient), 6) AS abs_coefficient, {_FACTOR_TYPE} AS factor_type,
  p_value < {lm.SIGNIFICANCE} AS significant
FROM coef_p WHERE {_FACTOR_TYPE} <> 'Other' ORDER BY abs(coefficient) DESC, factor LIMIT 30""",
        "factor_importance": f"""{head}{_FIT},{_T_TAILS}
SELECT {_FACTOR_TYPE} AS factor_type, CAST(count(*) FILTER (p_value < {lm.SIGNIFICANCE}) AS BIGINT) AS n_significant,
  CAST(count(*) AS BIGINT) AS n_total, round(count(*) FILTER (p_value < {lm.SIGNIFICANCE}) / count(*), 6) AS prop_significant,
  round(avg(abs(coefficient)), 6) AS mean_abs_coef, round(max(abs(coefficient)), 6) AS max_abs_coef
FROM coef_p GROUP BY 1""",
        "factor_type_case": f"{head}{_FIT},{_T_TAILS}\nSELECT factor, {_FACTOR_TYPE} AS factor_type FROM coef_p",
        "significance_flag": f"""{head}{_FIT},{_T_TAILS}
SELECT factor, round(p_value, 6) AS p_value, p_value < {lm.SIGNIFICANCE} AS significant FROM coef_p""",
        "residual_diagnostics": f"""{head}{_FIT},
live AS MATERIALIZED (
  SELECT a.cell, a.j, c.coefficient + CASE WHEN a.j = 0 THEN (SELECT m FROM mu) ELSE 0 END AS b FROM act a JOIN coef c ON c.j = a.j),
fitted AS (SELECT cell, list_sum(list(b ORDER BY j)) AS fitted FROM live GROUP BY cell),
lever AS (
  SELECT x.cell, list_sum(list(s.v ORDER BY x.j, y.j)) AS leverage
  FROM live x JOIN live y ON x.cell = y.cell JOIN swept s ON s.model = (SELECT model FROM best) AND s.i = x.j AND s.j = y.j
  GROUP BY x.cell),
pts AS (
  SELECT o.*, fitted, o.score - fitted AS residual, leverage,
    CASE WHEN leverage < 1 - 1e-12 THEN (o.score - fitted) / (sqrt((SELECT sigma2 FROM best)) * sqrt(1 - leverage)) END AS std_residual
  FROM obs o JOIN cell e USING ({_FACTOR_LIST}) JOIN fitted USING (cell) JOIN lever USING (cell)),
ranked AS (
  SELECT *, CASE WHEN std_residual IS NOT NULL THEN rank() OVER (ORDER BY std_residual NULLS LAST)
      + (count(*) OVER (PARTITION BY std_residual) - 1) / 2.0 END AS r, count(std_residual) OVER () AS n FROM pts),
quantile AS (SELECT *, {ppoint} AS p FROM ranked),
half AS (SELECT *, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t, p - 0.5 AS q FROM quantile)
SELECT {_FACTOR_LIST}, score, round(fitted, 6) AS fitted, round(residual, 6) AS residual, round(leverage, 6) AS leverage,
  round(std_residual, 6) AS std_residual, round({lm.normal_quantile_sql('p', 't', 'q')}, 6) AS theoretical_quantile FROM half""",
    }
