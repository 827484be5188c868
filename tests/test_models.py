"""Fits against dense textbook computations and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest

from trialweave.models import (
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
from trialweave.models import schur
from trialweave.models.compare import chi2_tail
from trialweave.models.contrasts import CODINGS
from trialweave.models.marginal import tukey_tail

X = Factor("x", ("a", "b"), "sum2")
SLOPE = (("x",),)


def simulate(seed, units, items, binary):
    rng = np.random.default_rng(seed)
    ua = rng.normal(size=(units, 2)) @ np.array([[0.8, 0.2], [0.0, 0.4]])
    ub = rng.normal(size=items) * 0.6
    rows = []
    for u in range(units):
        for b in range(items):
            for x in ("a", "b"):
                for _ in range(rng.integers(0, 4)):
                    s = -1 if x == "a" else 1
                    eta = 0.3 + 0.4 * s + ua[u, 0] + ua[u, 1] * s + ub[b]
                    y = float(rng.random() < 1 / (1 + math.exp(-eta))) if binary else eta + rng.normal()
                    rows.append((u, b, x, y))
    return pd.DataFrame(rows, columns=["u", "b", "x", "y"])


def dense_lmm(pdf, theta, reml):
    theta = np.append(theta, [0.0] * (6 - len(theta)))
    s = np.where(pdf.x == "a", -1.0, 1.0)
    x = np.c_[np.ones(len(pdf)), s]
    y = pdf.y.to_numpy()
    lam = np.array([[theta[0], 0], [theta[1], theta[2]]])
    v = np.eye(len(pdf)) + (pdf.u.values[:, None] == pdf.u.values) * (x @ lam @ lam.T @ x.T)
    lam = np.array([[theta[3], 0], [theta[4], theta[5]]])
    v += (pdf.b.values[:, None] == pdf.b.values) * (x @ lam @ lam.T @ x.T)
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    df = len(pdf) - 2 if reml else len(pdf)
    dev = np.linalg.slogdet(v)[1] + df * (1 + math.log(2 * math.pi * (r @ vi @ r) / df))
    return dev + (np.linalg.slogdet(a)[1] if reml else 0.0), beta


def dense_laplace(pdf, theta, beta):
    n, units, items = len(pdf), pdf.u.max() + 1, pdf.b.max() + 1
    s = np.where(pdf.x == "a", -1.0, 1.0)
    z = np.zeros((n, 2 * units + items))
    z[np.arange(n), 2 * pdf.u] = 1
    z[np.arange(n), 2 * pdf.u + 1] = s
    z[np.arange(n), 2 * units + pdf.b] = 1
    lam = np.kron(np.eye(units), np.array([[theta[0], 0], [theta[1], theta[2]]]))
    w = np.c_[z[:, : 2 * units] @ lam, z[:, 2 * units :] * theta[3]]
    fixed, y, v = np.c_[np.ones(n), s] @ beta, pdf.y.to_numpy(), np.zeros(w.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-(fixed + w @ v)))
        h = w.T @ ((mu * (1 - mu))[:, None] * w) + np.eye(len(v))
        v = v + np.linalg.solve(h, w.T @ (y - mu) - v)
    eta = fixed + w @ v
    return -2 * (np.sum(y * eta - np.logaddexp(0, eta)) - 0.5 * v @ v) + np.linalg.slogdet(h)[1]


@pytest.fixture(scope="module")
def linear(spark):
    pdf = simulate(1, 40, 5, binary=False)
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.fixture(scope="module")
def logistic(spark):
    pdf = simulate(3, 50, 5, binary=True)
    return pdf, spark.createDataFrame(pdf).repartition(4)


CROSSED = Model("y", (X,), SLOPE, random=(Random("u", SLOPE), Random("b")))


@pytest.mark.parametrize("tile", [schur.TILE, 2])
def test_lmm_is_the_minimum_of_the_dense_deviance(linear, tile, monkeypatch):
    monkeypatch.setattr(schur, "TILE", tile)  # 2: items in three tiles on the cluster
    pdf, df = linear
    for reml in (True, False):
        f = fit_lmm(df, CROSSED, reml=reml)
        dev, beta = dense_lmm(pdf, f.theta, reml)
        assert f.converged and f.deviance == pytest.approx(dev, abs=1e-7)
        assert f.beta == pytest.approx(beta, abs=1e-8)
        for e in np.eye(4):
            assert abs(dense_lmm(pdf, f.theta + 1e-4 * e, reml)[0] - dense_lmm(pdf, f.theta - 1e-4 * e, reml)[0]) < 1e-6


def test_slopes_of_both_groupings(linear):
    pdf, df = linear
    f = fit_lmm(df, Model("y", (X,), SLOPE, random=(Random("u", SLOPE), Random("b", SLOPE))))
    assert f.deviance == pytest.approx(dense_lmm(pdf, f.theta, True)[0], abs=1e-7)
    for e in np.eye(6):
        up, down = (dense_lmm(pdf, f.theta + h * e, True)[0] for h in (1e-4, -1e-4))
        assert abs(up - down) < 1e-5


def test_glmm_is_the_minimum_of_the_dense_laplace_deviance(logistic):
    pdf, df = logistic
    f = fit_glmm(df, CROSSED)
    assert f.converged and f.deviance == pytest.approx(dense_laplace(pdf, f.theta, f.beta), abs=1e-5)
    point, h = np.concatenate([f.theta, f.beta]), 1e-3
    for e in np.eye(len(point)):
        up, down = point + h * e, point - h * e
        slope = (dense_laplace(pdf, up[:4], up[4:]) - dense_laplace(pdf, down[:4], down[4:])) / (2 * h)
        assert abs(slope) < 0.1


def test_no_variance_gives_least_squares_and_logit(spark):
    rng = np.random.default_rng(0)
    # every unit has the same residuals: no variance between units
    rows = [(u, x, float(i % 3) + (x == "b"), int((i + (x == "b") * (i // 2)) % 2))
            for u in range(12) for x in "ab" for i in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(u), str(x), float(y), int(z)) for u, x, y, z in rows], "u int, x string, y double, z int")
    f = fit_lmm(df, Model("y", (X,), SLOPE, random=(Random("u"),)))
    pdf = df.toPandas()
    design = np.c_[np.ones(len(pdf)), np.where(pdf.x == "a", -1, 1)]
    ols, rss = np.linalg.lstsq(design, pdf.y, rcond=None)[:2]
    assert f.singular and f.beta == pytest.approx(ols, abs=1e-7)
    assert f.sigma2 == pytest.approx(rss[0] / (len(pdf) - 2), rel=1e-6)
    m = Model("z", (X,), SLOPE)
    g = fit_glmm(df, Model("z", (X,), SLOPE, random=(Random("u"),)))
    p = fit_glm(df, m)
    assert g.singular and g.beta == pytest.approx(p.beta, abs=1e-3)
    assert np.sqrt(np.diag(g.cov)) == pytest.approx(np.sqrt(np.diag(p.cov)), rel=1e-2)
    assert p.deviance == pytest.approx(g.deviance, abs=1e-2)


def test_larger_model_never_has_larger_deviance(spark, linear):
    _, df = linear
    small = fit_lmm(df, Model("y", random=(Random("u"),)), reml=False)
    mid = fit_lmm(df, Model("y", (X,), SLOPE, random=(Random("u"),)), reml=False)
    full = fit_lmm(df, CROSSED, reml=False)
    assert small.deviance >= mid.deviance >= full.deviance
    t = compare_fits(spark, {"small": small, "mid": mid}).collect()
    assert t[1].df == 1 and t[1].chisq == pytest.approx(small.deviance - mid.deviance)


def test_weights_stand_for_equal_rows(spark, logistic):
    pdf, df = logistic
    counted = spark.createDataFrame(pdf.groupby(["u", "b", "x", "y"]).size().reset_index(name="w"))
    m = Model("y", (X,), SLOPE, random=(Random("u"),))
    assert fit_glmm(counted, m, weight="w").deviance == pytest.approx(fit_glmm(df, m).deviance, abs=1e-6)


def test_codings_agree_on_fit_and_means(spark, linear):
    _, df = linear
    fits = [fit_lmm(df, Model("y", (Factor("b", tuple(range(5)), c),), (("b",),), random=(Random("u"),)), reml=False)
            for c in CODINGS]
    means = [[r.estimate for r in marginal_means(spark, f, ["b"]).collect()] for f in fits]
    for f, m in zip(fits, means):
        assert f.deviance == pytest.approx(fits[0].deviance, abs=1e-6)
        assert m == pytest.approx(means[0], abs=1e-6)


def test_contrast_matrices():
    assert CODINGS["sum2"](2).tolist() == [[-1], [1]]
    assert CODINGS["centered_treatment"](3).sum(axis=0) == pytest.approx([0, 0])
    p = CODINGS["poly"](3)
    assert p.T @ p == pytest.approx(np.eye(2))
    assert p[:, 0] == pytest.approx([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    assert p[:, 1] == pytest.approx(np.array([1, -2, 1]) / math.sqrt(6))


def test_small_sample_tails():
    from trialweave.models.degrees import range_tail, t_quantile, t_tail

    assert t_tail(2.2281388519649385, 10) == pytest.approx(0.05) and t_tail(12.706204736432095, 1) == pytest.approx(0.05)
    assert t_quantile(0.975, 4) == pytest.approx(2.7764451051977987)
    for q, k, df in ((3.877, 3, 10), (3.578, 3, 20), (3.958, 4, 20), (3.977, 5, 60), (3.151, 2, 10)):
        assert range_tail(q, k, df) == pytest.approx(0.05, abs=2e-4)
    assert range_tail(2.5 * 2**0.5, 2, 7) == pytest.approx(t_tail(2.5, 7), abs=1e-5)


def test_both_methods_find_the_same_minimum(linear):
    _, df = linear
    a, b = (fit_lmm(df, CROSSED, method=m) for m in ("newton", "quasi-newton"))
    assert b.converged and b.deviance == pytest.approx(a.deviance, abs=1e-7)
    assert np.abs(b.theta) == pytest.approx(np.abs(a.theta), abs=1e-4)


def test_tails():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert chi2_tail(0.5, 6) == pytest.approx(0.9978, abs=1e-4)
    assert tukey_tail(3.3145 / 2**0.5, 3) == pytest.approx(0.05, abs=1e-4)
    assert tukey_tail(1.959963984540054, 2) == pytest.approx(0.05, abs=1e-6)


def test_tables(spark, logistic):
    _, df = logistic
    f = fit_glmm(df, Model("y", (X,), SLOPE, random=(Random("u"),)))
    row = f.coefficients(spark).filter("term = 'x[b]'").first()
    assert row.odds_ratio == pytest.approx(math.exp(row.estimate))
    assert f.summary(spark).first().n_units == 50
    assert f.variance_components(spark).count() == 1
    means = marginal_means(spark, f, ["x"], response=True).collect()
    assert all(0 < r.low < r.estimate < r.high < 1 for r in means)
    assert pairwise(spark, f, ["x"]).first().estimate == pytest.approx(-2 * f.beta[1])


def test_numeric_predictor_of_many_values(spark):
    """100 000 different values, against least squares with the units' known covariance."""
    rng = np.random.default_rng(11)
    n, units = 100_000, 50
    u, x = rng.integers(0, units, n), rng.normal(size=n)
    y = 1.0 + 0.5 * x + rng.normal(size=units)[u] + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"u": u, "x": x, "y": y}))
    f = fit_lmm(df, Model("y", (Numeric("x"),), (("x",),), random=(Random("u"),)))
    assert f.converged
    design = np.c_[np.ones(n), x]
    a, right, log_det = np.zeros((2, 2)), np.zeros(2), 0.0
    rss = y @ y
    for k in range(units):
        on = u == k
        shrink = f.theta[0] ** 2 / (1 + f.theta[0] ** 2 * on.sum())
        sx, sy = design[on].sum(0), y[on].sum()
        a += design[on].T @ design[on] - shrink * np.outer(sx, sx)
        right += design[on].T @ y[on] - shrink * sx * sy
        rss -= shrink * sy * sy
        log_det += math.log(1 + f.theta[0] ** 2 * on.sum())
    beta = np.linalg.solve(a, right)
    assert f.beta == pytest.approx(beta, abs=1e-8)
    df_ = n - 2
    want = log_det + np.linalg.slogdet(a)[1] + df_ * (1 + math.log(2 * math.pi * (rss - right @ beta) / df_))
    assert f.deviance == pytest.approx(want, abs=1e-5)


def test_ten_thousand_items(spark):
    """Items in lists, each list seen by its own units: only the tiles of a list are filled."""
    from trialweave.models.lmm import Deviance
    from trialweave.models.moments import check, design_of, moments_of

    rng = np.random.default_rng(12)
    lists, per_list, per_unit = 50, 200, 60
    rows = []
    for k in range(lists):
        for j in range(12):
            for i in rng.choice(per_list, per_unit, replace=False):
                rows.append((k * 100 + j, k * per_list + int(i), 2.0 + rng.normal()))
    pdf = pd.DataFrame(rows, columns=["u", "b", "y"])
    seen = pdf.b.nunique()
    design = design_of(spark.createDataFrame(pdf), Model("y", random=(Random("u"), Random("b"))))
    assert design.n_items == seen > 9_500
    dev = Deviance(moments_of(design, *check(design)), True)
    theta, h = np.array([0.8, 0.5]), 1e-5

    def dense(theta):
        """The lists are independent: their dense deviances add up."""
        log_det, a, right, rss, n = 0.0, 0.0, 0.0, 0.0, len(pdf)
        for _, part in pdf.groupby(pdf.u // 100):
            same = [part[c].values[:, None] == part[c].values for c in "ub"]
            v = np.eye(len(part)) + theta[0] ** 2 * same[0] + theta[1] ** 2 * same[1]
            solved = np.linalg.solve(v, np.c_[np.ones(len(part)), part.y])
            log_det += np.linalg.slogdet(v)[1]
            a, right, rss = a + solved[:, 0].sum(), right + solved[:, 1].sum(), rss + part.y @ solved[:, 1]
        rss -= right**2 / a
        return log_det + math.log(a) + (n - 1) * (1 + math.log(2 * math.pi * rss / (n - 1)))

    value, grad, *_ = dev.solve(*dev.borders([theta], True)[0])
    assert value == pytest.approx(dense(theta), abs=1e-6)
    for e, g in zip(np.eye(2), grad):
        assert g == pytest.approx((dense(theta + h * e) - dense(theta - h * e)) / (2 * h), abs=0.05)


def test_tiles_give_what_one_matrix_gives(spark):
    """Complement, log determinant, their derivatives and the solution of a matrix with absent tiles."""
    rng = np.random.default_rng(13)
    n, e, k = 23, 3, 2
    dense = np.zeros((1 + k, n + e, n + e))
    mask = np.zeros((n, n), bool)
    for block in (slice(0, 7), slice(6, 12), slice(12, 20), slice(18, 23)):
        mask[block, block] = True
    a = np.where(mask, rng.normal(size=(n, n)), 0)
    dense[0, :n, :n] = a @ a.T * 0.1 + np.eye(n) * 5
    for layer in dense[1:]:
        s = rng.normal(size=(n, n)) * mask
        layer[:n, :n] = s + s.T
    for layer in dense:
        layer[n:, :n] = rng.normal(size=(e, n))
        layer[:n, n:] = layer[n:, :n].T
        c = rng.normal(size=(e, e))
        layer[n:, n:] = c + c.T + 50 * np.eye(e)
    shape = schur.Shape(n, 1, e, k, tile=4)
    cuts = [*range(0, n, 4), n, n + e]
    tiles = []
    for i in range(len(cuts) - 1):
        for j in range(i + 1):
            t = dense[:, cuts[i] : cuts[i + 1], cuts[j] : cuts[j + 1]]
            if np.abs(t).sum() > 0:
                tiles += [(cand, i, j, np.ascontiguousarray(t).tobytes()) for cand in (0, 1)]
    rows = [bytearray(t[3]) for t in tiles]
    df = spark.createDataFrame([(c, i, j, d) for (c, i, j, _), d in zip(tiles, rows)], schur.TILES).repartition(3)
    rest, logs, solution = schur.eliminate_one(dense[:, :n, :n], dense[:, n:, :n], dense[:, n:, n:])
    h = 1e-6
    moved = dense[0] + h * dense[1], dense[0] - h * dense[1]
    slope = [np.linalg.slogdet(m[:n, :n])[1] for m in moved]
    assert logs[1] == pytest.approx((slope[0] - slope[1]) / (2 * h), rel=1e-5)
    complement = [m[n:, n:] - m[n:, :n] @ np.linalg.solve(m[:n, :n], m[:n, n:]) for m in moved]
    assert rest[1] == pytest.approx((complement[0] - complement[1]) / (2 * h), rel=1e-4, abs=1e-4)
    for found in schur.eliminate(df, shape, 2, 4, solve=True):
        for x, y in zip(found, (rest, logs, solution)):
            assert x == pytest.approx(y, abs=1e-9)
    assert schur.levels_of({(1, 0), (3, 2), (3, 1)}, 4) == [[0, 2], [1], [3]]
    assert len(schur.levels_of({(i + 1, i) for i in range(63)}, 64)) <= 7
    assert schur.levels_of({(i, j) for i in range(4) for j in range(i)}, 4) == [[0], [1], [2], [3]]


def test_glmm_with_items_in_tiles(logistic, monkeypatch):
    """A whole evaluation of the Laplace deviance with items on the cluster."""
    from trialweave.models import glmm
    from trialweave.models.moments import design_of

    pdf, df = logistic
    cells = glmm.Cells(design_of(df, CROSSED))
    point = np.array([0.8, 0.1, 0.4, 0.6, 0.3, 0.4])
    whole = glmm.Laplace(cells)
    monkeypatch.setattr(schur, "TILE", 2)
    tiled = glmm.Laplace(cells)
    want = dense_laplace(pdf, point[:4], point[4:])
    assert whole([point, point * 1.01])[0] == pytest.approx(want, abs=1e-6)
    assert tiled([point, point * 1.01]) == pytest.approx(whole([point, point * 1.01]), abs=1e-6)
    assert tiled.information(point) == pytest.approx(whole.information(point), rel=1e-6)


def test_says_what_is_wrong_with_the_levels(spark, linear):
    _, df = linear
    with pytest.raises(ValueError, match="outside the levels"):
        fit_lmm(df, Model("y", (Factor("x", ("a", "c")),), SLOPE, random=(Random("u"),)))
    with pytest.raises(ValueError, match="rank deficient"):
        fit_lmm(df, Model("y", (Factor("x", ("a", "b", "c")),), SLOPE, random=(Random("u"),)))


def test_separated_data_are_flagged_not_raised(spark):
    rows = [(u, x, int(x == "b")) for u in range(10) for x in "ab" for _ in range(3)]
    df = spark.createDataFrame(rows, "u int, x string, y int")
    f = fit_glmm(df, Model("y", (X,), SLOPE, random=(Random("u"),)))
    assert f.deviance < 1e-3 and f.coefficients(spark).count() == 2


def test_fits_of_different_rows_are_not_compared(spark):
    import pytest

    from trialweave.models import Model, Numeric, Random, fit_lmm
    from trialweave.models.compare import compare_fits, complete_rows

    rng = np.random.default_rng(5)
    rows = [(u, float(rng.normal()) if k % 2 else None, float(rng.normal() + u % 3)) for u in range(30) for k in range(8)]
    df = spark.createDataFrame(rows, "u long, x double, y double")
    models = {"null": Model("y", random=(Random("u"),)), "x": Model("y", (Numeric("x"),), (("x",),), random=(Random("u"),))}
    with pytest.raises(ValueError):
        compare_fits(spark, {n: fit_lmm(df, m) for n, m in models.items()})
    common = complete_rows(df, list(models.values()))
    assert compare_fits(spark, {n: fit_lmm(common, m) for n, m in models.items()}).count() == 2


def test_glm_reports_unfinished_fits(spark):
    from trialweave.models import Factor, Model, fit_glm

    rows = [(g, int(k < n)) for g, n in (("a", 1), ("b", 9)) for k in range(10)]
    df = spark.createDataFrame(rows, "g string, y int")
    model = Model("y", (Factor("g", ("a", "b")),), (("g",),))
    assert fit_glm(df, model).converged and not fit_glm(df, model, max_iter=1).converged


def test_grammar_model_has_three_levels(spark):
    from trialweave.models import fit_lmm
    from trialweave.plans.analysis import catalogue

    rng = np.random.default_rng(6)
    rows = [
        (u, v, s, float(rng.normal() + u % 3 + v % 2 + (s == "passive")))
        for u in range(12) for v in range(4) for s in ("conjoined", "passive", "transitive")
    ]
    df = spark.createDataFrame(rows, "subject long, verb long, syntax string, OverallLikeMe double")
    assert len(fit_lmm(df, catalogue()["grammar"][1]).beta) == 3
