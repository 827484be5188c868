"""Model operators bound to the test tables.

Balanced designs have closed forms, which the SQL computes: user x type cell means are complete
tables, so REML and ML estimates follow from sums of squares, with the pooling that a variance
estimate at zero brings. A saturated logit is a table of log odds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import if_else, match_score, matches
from ..models import (
    Factor,
    Model,
    Numeric,
    Random,
    compare_fits,
    fit_glm,
    fit_glmm,
    fit_lmm,
    marginal_means,
    pairwise,
)
from ..operators.units import lookup_join
from .table_queries import query, sales, table, with_k

TYPES = ("click", "error", "purchase", "signup", "view")

CELLS_SQL = """
    c AS (SELECT user_id AS u, event_type AS t, avg(value) AS y FROM events GROUP BY 1, 2),
    g AS (SELECT count(DISTINCT u)::DOUBLE AS ni, count(DISTINCT t)::DOUBLE AS nj, avg(y) AS m,
                 sum((y - (SELECT avg(y) FROM c)) ^ 2) AS sst FROM c),
    mu AS (SELECT u, avg(y) AS y FROM c GROUP BY 1),
    mt AS (SELECT t, avg(y) AS y FROM c GROUP BY 1),
    s AS (SELECT ni, nj, m, sst, nj * (SELECT sum((y - m) ^ 2) FROM mu) AS ssa,
                 ni * (SELECT sum((y - m) ^ 2) FROM mt) AS ssb FROM g),
    q AS (SELECT *, sst - ssa - ssb AS sse FROM s)
"""

BLOCK_SQL = (
    "WITH "
    + CELLS_SQL
    + """,
    v AS (SELECT *, ssa / (ni - 1) < sse / ((ni - 1) * (nj - 1)) AS low FROM q),
    w AS (SELECT ni, nj, CASE WHEN low THEN (ssa + sse) / (ni * nj - nj)
                              ELSE sse / ((ni - 1) * (nj - 1)) END AS s2,
                 CASE WHEN low THEN 0.0 ELSE (ssa / (ni - 1) - sse / ((ni - 1) * (nj - 1))) / nj
                      END AS sa FROM v)
"""
)


def cell_means(spark, d) -> DataFrame:
    """Mean value per user and event type: one row per cell of a complete table."""
    return (
        table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    )


def by_type(coding: str = "treatment", intercept: bool = True) -> Model:
    return Model(
        "v",
        (Factor("event_type", TYPES, coding),),
        (("event_type",),),
        intercept=intercept,
        random=(Random("user_id"),),
    )


@query(
    "lmm_balanced",
    BLOCK_SQL
    + """
    SELECT CASE WHEN t = 'click' THEN '(Intercept)' ELSE 'event_type[' || t || ']' END AS term,
           round(CASE WHEN t = 'click' THEN y ELSE y - (SELECT y FROM mt WHERE t = 'click') END, 4)
             AS estimate,
           round(CASE WHEN t = 'click' THEN sqrt((s2 + sa) / ni) ELSE sqrt(2 * s2 / ni) END, 4)
             AS std_error
    FROM mt, w
    """,
)
def lmm_balanced(spark, d):
    """Fixed effect of type, random intercept of user, REML."""
    out = fit_lmm(cell_means(spark, d), by_type()).coefficients(spark)
    return out.select(
        "term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error")
    )


@query(
    "lmm_components",
    BLOCK_SQL
    + """
    SELECT 'user_id' AS grouping, round(sa, 3) AS covariance FROM w
    UNION ALL SELECT 'Residual', round(s2, 3) FROM w
    """,
)
def lmm_components(spark, d):
    out = fit_lmm(cell_means(spark, d), by_type()).variance_components(spark)
    return out.select("grouping", F.round("covariance", 3).alias("covariance"))


@query(
    "lmm_crossed",
    "WITH "
    + CELLS_SQL
    + """,
    e AS (SELECT *, (ni - 1) AS da, (nj - 1) AS db, (ni - 1) * (nj - 1) AS de FROM q),
    a AS (SELECT *, least(ssa / da, ssb / db) < sse / de AS pool1, ssa / da <= ssb / db AS a_first
          FROM e),
    p AS (SELECT *, CASE WHEN NOT pool1 THEN sse / de
                         WHEN a_first THEN (sse + ssa) / (de + da) ELSE (sse + ssb) / (de + db) END
                    AS s1, CASE WHEN a_first THEN ssb / db ELSE ssa / da END AS other FROM a),
    r AS (SELECT *, CASE WHEN pool1 AND other < s1 THEN sst / (ni * nj - 1) ELSE s1 END AS s2,
                 pool1 AND other < s1 AS pool2 FROM p),
    z AS (SELECT s2, CASE WHEN pool2 OR (pool1 AND a_first) THEN 0.0
                          ELSE (ssa / da - s2) / nj END AS sa,
                 CASE WHEN pool2 OR (pool1 AND NOT a_first) THEN 0.0
                      ELSE (ssb / db - s2) / ni END AS sb FROM r)
    SELECT 'user_id' AS grouping, round(sa, 3) AS covariance FROM z
    UNION ALL SELECT 'event_type', round(sb, 3) FROM z
    UNION ALL SELECT 'Residual', round(s2, 3) FROM z
    """,
)
def lmm_crossed(spark, d):
    """Two crossed random intercepts, REML."""
    model = Model("v", random=(Random("user_id"), Random("event_type")))
    out = fit_lmm(cell_means(spark, d), model).variance_components(spark)
    return out.select("grouping", F.round("covariance", 3).alias("covariance"))


@query(
    "lmm_random_slope",
    """
    WITH c AS (SELECT c_nationkey AS u, o_orderpriority AS r,
                      CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS x,
                      avg(o_totalprice) / 1000 AS y0
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    y AS (SELECT u, x, y0 + 20 * (u % 5) + 10 * (u % 3 - 1) * x AS y FROM c),
    m AS (SELECT u, x, avg(y) AS y, count(*) AS n, sum(y * y) - count(*) * avg(y) ^ 2 AS ss
          FROM y GROUP BY 1, 2),
    s2 AS (SELECT sum(ss) / sum(n - 1) AS v, 2 * max(n) AS per_unit FROM m),
    a AS (SELECT u, avg(y) AS a, avg(x * y) AS d FROM m GROUP BY 1)
    SELECT 'c_nationkey' AS grouping, '(Intercept)' AS term, '(Intercept)' AS with_term,
           round(var_samp(a) - (SELECT v / per_unit FROM s2), 3) AS covariance FROM a
    UNION ALL SELECT 'c_nationkey', 'status[other]', '(Intercept)', round(covar_samp(a, d), 3) FROM a
    UNION ALL SELECT 'c_nationkey', 'status[other]', 'status[other]',
                     round(var_samp(d) - (SELECT v / per_unit FROM s2), 3) FROM a
    UNION ALL SELECT 'Residual', NULL, NULL, round(v, 3) FROM s2
    """,
)
def lmm_random_slope(spark, d):
    """Correlated random intercept and slope of status by nation, on order means with known offsets.

    In the complete nation x status x priority table the covariance of the unit means and unit
    differences gives the estimates.
    """
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, d, "orders").select(
        "o_custkey", "o_orderpriority", "o_totalprice",
        if_else(F.col("o_orderstatus") == "F", "F", "other").alias("status"),
    )
    cells = lookup_join(orders, nation, ["o_custkey"], "inner")
    cells = cells.groupBy("c_nationkey", "o_orderpriority", "status").agg(
        (F.avg("o_totalprice") / 1000).alias("y0")
    )
    n = F.col("c_nationkey")
    tilt = 10 * (n % 3 - 1) * F.when(F.col("status") == "F", -1).otherwise(1)
    cells = cells.withColumn("y", F.col("y0") + 20 * (n % 5) + tilt)
    slope = (("status",),)
    model = Model(
        "y", (Factor("status", ("F", "other"), "sum2"),), slope, random=(Random("c_nationkey", slope),)
    )
    out = fit_lmm(cells, model).variance_components(spark)
    return out.select("grouping", "term", "with_term", F.round("covariance", 3).alias("covariance"))


@query("lmm_no_intercept")
def lmm_no_intercept(spark, d):
    """Crossed random intercepts without a fixed part, against the model with an intercept."""
    random = (Random("user_id"), Random("event_type"))
    cells = cell_means(spark, d)
    fits = {
        "mean": fit_lmm(cells, Model("v", random=random)),
        "zero": fit_lmm(cells, Model("v", intercept=False, random=random)),
    }
    return compare_fits(spark, fits)


@query(
    "lrt",
    "WITH "
    + CELLS_SQL
    + """,
    k AS (SELECT ni, nj, ssa, sse AS e1, sse + ssb AS e0 FROM q),
    f AS (SELECT ni * nj AS n,
                 CASE WHEN ssa / ni < e1 / (ni * (nj - 1)) THEN ni * nj * ln((ssa + e1) / (ni * nj))
                      ELSE ni * ln(ssa / ni) + ni * (nj - 1) * ln(e1 / (ni * (nj - 1))) END AS d1,
                 CASE WHEN ssa / ni < e0 / (ni * (nj - 1)) THEN ni * nj * ln((ssa + e0) / (ni * nj))
                      ELSE ni * ln(ssa / ni) + ni * (nj - 1) * ln(e0 / (ni * (nj - 1))) END AS d0
          FROM k)
    SELECT 'null' AS model, 3 AS parameters, round(d0 + n * (1 + ln(2 * pi())), 4) AS deviance,
           NULL::DOUBLE AS chisq, NULL::INT AS df, NULL::DOUBLE AS p_value FROM f
    UNION ALL
    SELECT 'type', 7, round(d1 + n * (1 + ln(2 * pi())), 4), round(d0 - d1, 4), 4,
           round(exp(-(d0 - d1) / 2) * (1 + (d0 - d1) / 2), 5) FROM f
    """,
)
def likelihood_ratio(spark, d):
    """Effect of type tested by refitting both models by ML."""
    cells = cell_means(spark, d)
    fits = {
        "type": fit_lmm(cells, by_type()),
        "null": fit_lmm(cells, Model("v", random=(Random("user_id"),))),
    }
    out = compare_fits(spark, fits)
    return out.select(
        "model", "parameters", F.round("deviance", 4).alias("deviance"),
        F.round("chisq", 4).alias("chisq"), "df", F.round("p_value", 5).alias("p_value"),
    )


@query(
    "emmeans",
    BLOCK_SQL
    + """
    SELECT t AS event_type, round(y, 4) AS estimate, round(sqrt((s2 + sa) / ni), 4) AS std_error
    FROM mt, w
    """,
)
def emmeans(spark, d):
    """Marginal means from a sum-coded fit; they do not depend on the coding."""
    fit = fit_lmm(cell_means(spark, d), by_type("centered_treatment"))
    out = marginal_means(spark, fit, ["event_type"])
    return out.select(
        "event_type", F.round("estimate", 4).alias("estimate"),
        F.round("std_error", 4).alias("std_error"),
    )


@query(
    "emmeans_pairs",
    BLOCK_SQL
    + """
    SELECT a.t || ' - ' || b.t AS contrast, round(a.y - b.y, 4) AS estimate,
           round(sqrt(2 * s2 / ni), 4) AS std_error
    FROM mt a JOIN mt b ON a.t < b.t, w
    """,
)
def emmeans_pairs(spark, d):
    fit = fit_lmm(cell_means(spark, d), by_type("poly"))
    out = pairwise(spark, fit, ["event_type"])
    return out.select(
        "contrast", F.round("estimate", 4).alias("estimate"),
        F.round("std_error", 4).alias("std_error"),
    )


LOGIT_SQL = """
    t AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'passive' ELSE 'active' END AS syntax,
                 CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
                 (CAST(json_extract_string(props, '$.k') AS INTEGER) < 50)::INT AS y FROM events),
    c AS (SELECT syntax, parity, sum(y)::DOUBLE AS s, (count(*) - sum(y))::DOUBLE AS f,
                 ln(sum(y) / (count(*) - sum(y))) AS l FROM t GROUP BY 1, 2),
    w AS (SELECT max(l) FILTER (syntax = 'active' AND parity = 'even') AS l00,
                 max(l) FILTER (syntax = 'passive' AND parity = 'even') AS l10,
                 max(l) FILTER (syntax = 'active' AND parity = 'odd') AS l01,
                 max(l) FILTER (syntax = 'passive' AND parity = 'odd') AS l11,
                 max(1 / s + 1 / f) FILTER (syntax = 'active' AND parity = 'even') AS v00,
                 max(1 / s + 1 / f) FILTER (syntax = 'passive' AND parity = 'even') AS v10,
                 max(1 / s + 1 / f) FILTER (syntax = 'active' AND parity = 'odd') AS v01,
                 sum(1 / s + 1 / f) AS vall FROM c)
"""
LOGIT_FACTORS = (
    Factor("syntax", ("active", "passive")),
    Factor("parity", ("even", "odd")),
)
LOGIT_TERMS = (("syntax",), ("parity",), ("syntax", "parity"))


def logit_rows(spark, d) -> DataFrame:
    return with_k(table(spark, d, "events")).select(
        if_else(F.col("event_type").isin("click", "view"), "passive", "active").alias("syntax"),
        if_else(F.col("event_id") % 2 == 0, "even", "odd").alias("parity"),
        (F.col("k") < 50).cast("int").alias("y"),
    )


@query(
    "glm_logit_saturated",
    "WITH "
    + LOGIT_SQL
    + """
    SELECT '(Intercept)' AS term, round(l00, 5) AS estimate, round(sqrt(v00), 5) AS std_error,
           round(exp(l00), 5) AS odds_ratio FROM w
    UNION ALL SELECT 'syntax[passive]', round(l10 - l00, 5), round(sqrt(v10 + v00), 5),
                     round(exp(l10 - l00), 5) FROM w
    UNION ALL SELECT 'parity[odd]', round(l01 - l00, 5), round(sqrt(v01 + v00), 5),
                     round(exp(l01 - l00), 5) FROM w
    UNION ALL SELECT 'syntax[passive]:parity[odd]', round(l11 - l10 - l01 + l00, 5),
                     round(sqrt(vall), 5), round(exp(l11 - l10 - l01 + l00), 5) FROM w
    """,
)
def glm_logit_saturated(spark, d):
    fit = fit_glm(logit_rows(spark, d), Model("y", LOGIT_FACTORS, LOGIT_TERMS))
    out = fit.coefficients(spark).select("term", "estimate", "std_error", "odds_ratio")
    for c in ("estimate", "std_error", "odds_ratio"):
        out = out.withColumn(c, F.round(c, 5))
    return out


@query(
    "glm_emmeans",
    "WITH "
    + LOGIT_SQL
    + """
    SELECT syntax, parity, round(s / (s + f), 5) AS estimate,
           round(sqrt(s * f / (s + f) ^ 3), 5) AS std_error,
           round(1 / (1 + exp(-(l - 1.959963984540054 * sqrt(1 / s + 1 / f)))), 5) AS low,
           round(1 / (1 + exp(-(l + 1.959963984540054 * sqrt(1 / s + 1 / f)))), 5) AS high
    FROM c
    """,
)
def glm_emmeans(spark, d):
    """Response-scale marginal means of a saturated logit: the cell proportions."""
    fit = fit_glm(logit_rows(spark, d), Model("y", LOGIT_FACTORS, LOGIT_TERMS))
    out = marginal_means(spark, fit, ["syntax", "parity"], response=True)
    for c in ("estimate", "std_error", "low", "high"):
        out = out.withColumn(c, F.round(c, 5))
    return out.select("syntax", "parity", "estimate", "std_error", "low", "high")


def like_me_rows(spark, d) -> DataFrame:
    """0/1 regional match of customer and supplier per line item, with status and priority."""
    s = sales(spark, d).select(
        F.col("c_custkey").alias("subject"),
        F.col("c_mktsegment").alias("event"),
        F.col("l_returnflag").alias("flag"),
        matches("actor_gender", "ppt_gender").alias("OverallLikeMe"),
        match_score(
            F.col("ppt_gender") == F.col("actor_gender"), F.col("ppt_race") == F.col("actor_race")
        ).alias("distance"),
    )
    return s.withColumn("syntax", if_else(F.col("flag") == "R", "conjoined", "transitive"))


SYNTAX = Factor("syntax", ("conjoined", "transitive"), "sum2")


@query("glmm_single")
def glmm_single(spark, d):
    """Logistic mixed model with one random intercept."""
    model = Model("OverallLikeMe", (SYNTAX,), (("syntax",),), random=(Random("subject"),))
    return fit_glmm(like_me_rows(spark, d), model).coefficients(spark)


@query("glmm_crossed")
def glmm_crossed(spark, d):
    """Logistic mixed model, random intercepts and slopes of two crossed groupings."""
    slopes = (("syntax",),)
    model = Model(
        "OverallLikeMe", (SYNTAX,), slopes, random=(Random("subject", slopes), Random("event", slopes))
    )
    fit = fit_glmm(like_me_rows(spark, d), model)
    return fit.coefficients(spark).withColumns(
        {"deviance": F.lit(fit.deviance), "singular": F.lit(fit.singular)}
    )


@query("lmm_slopes")
def lmm_slopes(spark, d):
    """log time with a random slope of a numeric -1/0/+1 predictor, tested against the null model."""
    e = with_k(table(spark, d, "events")).filter(F.col("value") < 400)
    third = (F.col("k") % 3 - 1).cast("double")
    e = e.select("user_id", F.ln("value").alias("log_rt"), third.alias("distance"))
    x = Numeric("distance")
    slope = Model("log_rt", (x,), (("distance",),), random=(Random("user_id", (("distance",),)),))
    null = Model("log_rt", random=(Random("user_id"),))
    return compare_fits(spark, {"slope": fit_lmm(e, slope), "null": fit_lmm(e, null)})


@query("lmm_ordered")
def lmm_ordered(spark, d):
    """Ordered factor with polynomial contrasts, marginal means on the log scale."""
    e = with_k(table(spark, d, "events")).filter(F.col("value") < 400)
    e = e.select("user_id", F.ln("value").alias("log_rt"), (F.col("k") % 3 - 1).alias("distance"))
    f = Factor("distance", (-1, 0, 1), "poly")
    model = Model("log_rt", (f,), (("distance",),), random=(Random("user_id"),))
    return marginal_means(spark, fit_lmm(e, model), ["distance"])


@query("glmm_family")
def glmm_family(spark, d):
    """The same logistic model for every market segment, on one compressed table."""
    from .analysis import fit_family

    model = Model("OverallLikeMe", (SYNTAX,), (("syntax",),), random=(Random("subject"),))
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    subsets = {s: F.col("event") == s for s in segments}
    return fit_family(spark, like_me_rows(spark, d), model, subsets, keep=["event"])




TILTED_SQL = CELLS_SQL.replace("avg(value) AS y FROM events", "avg(value) + 20 * (user_id % 5) AS y FROM events") + """,
    w AS (SELECT *, ssa / (ni - 1) AS msa, sse / ((ni - 1) * (nj - 1)) AS mse FROM q)
"""


def tilted_means(spark, d) -> DataFrame:
    """Mean value per user and type with known differences between users, so that their variance is not zero."""
    return cell_means(spark, d).withColumn("v", F.col("v") + 20 * (F.col("user_id") % 5))


@query(
    "lmm_satterthwaite",
    "WITH "
    + TILTED_SQL
    + """
    SELECT t AS event_type, round(y, 4) AS estimate, round(sqrt((msa + (nj - 1) * mse) / (ni * nj)), 4) AS std_error,
           round((msa + (nj - 1) * mse) ^ 2 / (msa ^ 2 / (ni - 1) + ((nj - 1) * mse) ^ 2 / ((ni - 1) * (nj - 1))), 1) AS df
    FROM mt, w
    """,
)
def lmm_satterthwaite(spark, d):
    """Marginal means with degrees of freedom from the curvature of the deviance."""
    fit = fit_lmm(tilted_means(spark, d), by_type())
    out = marginal_means(spark, fit, ["event_type"], df="satterthwaite")
    return out.select(
        "event_type", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"), F.round("df", 1).alias("df")
    )


@query(
    "lmm_t_pairs",
    "WITH "
    + TILTED_SQL
    + """,
    pr AS (SELECT a.t || ' - ' || b.t AS contrast, a.y - b.y AS estimate, sqrt(2 * mse / ni) AS se,
                  (ni - 1) * (nj - 1) AS nu, atan(abs(a.y - b.y) / sqrt(2 * mse / ni) / sqrt((ni - 1) * (nj - 1))) AS th
           FROM mt a JOIN mt b ON a.t < b.t, w),
    co AS (SELECT j, exp(sum(CASE WHEN j = 0 THEN 0 ELSE ln((2 * j - 1) / (2.0 * j)) END) OVER (ORDER BY j)) AS c
           FROM range((SELECT ((ni - 1) * (nj - 1) / 2)::BIGINT FROM w)) r(j))
    SELECT contrast, round(estimate, 4) AS estimate, round(se, 4) AS std_error, round(nu, 1) AS df,
           round(1 - sin(th) * sum(c * cos(th) ^ (2 * j)), 5) AS p_value
    FROM pr, co GROUP BY contrast, estimate, se, nu, th
    """,
)
def lmm_t_pairs(spark, d):
    """Pairwise contrasts with p-values of t; for even degrees of freedom the tail is a finite sum."""
    fit = fit_lmm(tilted_means(spark, d), by_type("centered_treatment"))
    out = pairwise(spark, fit, ["event_type"], df="satterthwaite")
    digits = {"estimate": 4, "std_error": 4, "df": 1, "p_value": 5}
    return out.select("contrast", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(
    "lmm_zero_mean",
    "WITH "
    + TILTED_SQL
    + """,
    z AS (SELECT ni, nj, nj * (SELECT sum(y ^ 2) FROM mu) / ni AS la,
                 ((SELECT sum(y ^ 2) FROM c) - nj * (SELECT sum(y ^ 2) FROM mu)) / (ni * nj - ni) AS s2 FROM w),
    e AS (SELECT *, ni * nj * (1 + ln(2 * pi())) + ni * ln(la) + (ni * nj - ni) * ln(s2) AS dev FROM z)
    SELECT 'user_id' AS grouping, round((la - s2) / nj, 3) AS covariance, round(dev, 4) AS deviance FROM e
    UNION ALL SELECT 'Residual', round(s2, 3), round(dev, 4) FROM e
    """,
)
def lmm_zero_mean(spark, d):
    """A model without any fixed part: the units' variance is about zero."""
    fit = fit_lmm(tilted_means(spark, d), Model("v", intercept=False, random=(Random("user_id"),)), reml=False)
    out = fit.variance_components(spark).select("grouping", F.round("covariance", 3).alias("covariance"))
    return out.withColumn("deviance", F.round(F.lit(fit.deviance), 4))


@query(
    "lmm_singular",
    "WITH "
    + CELLS_SQL
    + """
    SELECT 'user_id' AS grouping, 0.0::DOUBLE AS covariance, true AS singular FROM q
    UNION ALL SELECT 'Residual', round(sse / (ni * nj - nj), 3), true FROM q
    """,
)
def lmm_singular(spark, d):
    """Users without any difference in their means: the variance between them is estimated as exactly zero."""
    cells = cell_means(spark, d)
    own = cells.groupBy("user_id").agg(F.avg("v").alias("m"))
    fit = fit_lmm(lookup_join(cells, own, ["user_id"], "inner").withColumn("v", F.col("v") - F.col("m")).drop("m"), by_type())
    out = fit.variance_components(spark)
    return out.select("grouping", F.abs(F.round("covariance", 3)).alias("covariance")).withColumn("singular", F.lit(fit.singular))


@query(
    "lmm_codings",
    "WITH "
    + CELLS_SQL
    + """,
    y AS (SELECT max(y) FILTER (t = 'click') AS a, max(y) FILTER (t = 'error') AS b, max(y) FILTER (t = 'purchase') AS c,
                 max(y) FILTER (t = 'signup') AS d, max(y) FILTER (t = 'view') AS e FROM mt),
    r AS (SELECT 'poly' AS coding, '(Intercept)' AS term, (a + b + c + d + e) / 5 AS v FROM y
    UNION ALL SELECT 'poly', 'event_type.L', (-2 * a - b + d + 2 * e) / sqrt(10) FROM y
    UNION ALL SELECT 'poly', 'event_type.Q', (2 * a - b - 2 * c - d + 2 * e) / sqrt(14) FROM y
    UNION ALL SELECT 'poly', 'event_type.C', (-a + 2 * b - 2 * d + e) / sqrt(10) FROM y
    UNION ALL SELECT 'poly', 'event_type^4', (a - 4 * b + 6 * c - 4 * d + e) / sqrt(70) FROM y
    UNION ALL SELECT 'centered_treatment', '(Intercept)', (a + b + c + d + e) / 5 FROM y
    UNION ALL SELECT 'centered_treatment', 'event_type[error]', b - a FROM y
    UNION ALL SELECT 'centered_treatment', 'event_type[purchase]', c - a FROM y
    UNION ALL SELECT 'centered_treatment', 'event_type[signup]', d - a FROM y
    UNION ALL SELECT 'centered_treatment', 'event_type[view]', e - a FROM y)
    SELECT coding, term, round(v, 4) AS estimate FROM r
    """,
)
def lmm_codings(spark, d):
    """Coefficients under orthogonal polynomials and centred treatment contrasts."""
    out = None
    for coding in ("poly", "centered_treatment"):
        part = fit_lmm(cell_means(spark, d), by_type(coding)).coefficients(spark)
        part = part.select(F.lit(coding).alias("coding"), "term", F.round("estimate", 4).alias("estimate"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "lmm_summary",
    "WITH "
    + TILTED_SQL
    + """,
    v AS (SELECT ni, nj, ni * nj AS n, ni * nj * (1 + ln(2 * pi())) + ni * ln(ssa / ni) + ni * (nj - 1) * ln(sse / (ni * (nj - 1))) AS dev FROM w)
    SELECT round(-dev / 2, 4) AS log_lik, round(dev, 4) AS deviance, round(dev + 14, 4) AS aic, 7 AS parameters,
           n::BIGINT AS n_rows, ni::BIGINT AS n_units, false AS reml, false AS singular, true AS converged FROM v
    """,
)
def lmm_summary(spark, d):
    fit = fit_lmm(tilted_means(spark, d), by_type(), reml=False)
    out = fit.summary(spark)
    return out.withColumns({c: F.round(c, 4) for c in ("log_lik", "deviance", "aic")})


@query(
    "lmm_methods",
    "WITH "
    + TILTED_SQL
    + """,
    z AS (SELECT 'user_id' AS grouping, round((msa - mse) / nj, 3) AS covariance FROM w UNION ALL SELECT 'Residual', round(mse, 3) FROM w)
    SELECT method, grouping, covariance FROM z, (VALUES ('newton'), ('quasi-newton')) m(method)
    """,
)
def lmm_methods(spark, d):
    """Both ways to the minimum give the same variances."""
    cells, out = tilted_means(spark, d), None
    for method in ("newton", "quasi-newton"):
        part = fit_lmm(cells, by_type(), method=method).variance_components(spark)
        part = part.select(F.lit(method).alias("method"), "grouping", F.round("covariance", 3).alias("covariance"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "glm_logit_table",
    "WITH "
    + LOGIT_SQL
    + """,
    r AS (SELECT '(Intercept)' AS term, l00 AS b, sqrt(v00) AS se FROM w
          UNION ALL SELECT 'syntax[passive]', l10 - l00, sqrt(v10 + v00) FROM w
          UNION ALL SELECT 'parity[odd]', l01 - l00, sqrt(v01 + v00) FROM w
          UNION ALL SELECT 'syntax[passive]:parity[odd]', l11 - l10 - l01 + l00, sqrt(vall) FROM w)
    SELECT term, round(b / se, 4) AS statistic, round(b - 1.959963984540054 * se, 5) AS low,
           round(b + 1.959963984540054 * se, 5) AS high FROM r
    """,
)
def glm_logit_table(spark, d):
    """Test statistics and intervals of a saturated logit."""
    out = fit_glm(logit_rows(spark, d), Model("y", LOGIT_FACTORS, LOGIT_TERMS)).coefficients(spark)
    return out.select("term", F.round("statistic", 4).alias("statistic"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))
