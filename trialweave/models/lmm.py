"""Linear mixed models (REML or ML) with one or two crossed random groupings.

Profiled deviance after Bates, Maechler, Bolker and Walker (2015). For given relative covariance
factors the unit effects are eliminated inside the tasks; what is left is a matrix over item effects,
fixed effects and response. With few item effects it comes back as one sum; with many it stays on the
cluster as tiles, which only those units fill that hold both items, and is eliminated there.
First derivatives are analytic, second ones are differences of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schur
from .design import Model
from .fit import Fit, lower_triangle, newton_direction, theta_start
from .moments import Design, Moments, Sizes, check, design_of, lengths, moments_of, numbers, total_of

_DELTA = 1e-5
_BLOCK = 2_000_000  # numbers in one dense block inside a task
_TILES = 1 << 24  # numbers of tiles that a task adds up before it passes them on


def unit_factors(gram: np.ndarray, lam: np.ndarray, derive: bool) -> tuple[np.ndarray, np.ndarray]:
    """F = L (L'GL + I)^-1 L' of each unit and the log determinant, then their derivatives in L's entries."""
    q = len(lam)
    inner = lam.T @ gram @ lam + np.eye(q)
    half = np.linalg.solve(inner, np.broadcast_to(lam.T, inner.shape))
    f = lam @ half
    factors, logs = [f], [np.linalg.slogdet(inner)[1]]
    if derive:
        rest, turned = np.eye(q) - f @ gram, half @ gram
        for r, c in zip(*np.tril_indices(q)):
            one = rest[:, :, r, None] * half[:, c, None, :]
            factors.append(one + one.transpose(0, 2, 1))
            logs.append(2.0 * turned[:, c, r])
    return np.array(factors), np.array(logs)


class _Units:
    """Unit rows of a batch as arrays."""

    def __init__(self, batch: pa.RecordBatch, sizes: Sizes):
        u, p, q, qb = batch.num_rows, sizes.p, sizes.q, sizes.qb
        self.gram = numbers(batch.column("g")).reshape(u, q, q)
        self.x = numbers(batch.column("x")).reshape(u, q, p)
        self.m = numbers(batch.column("m"))
        self.t = numbers(batch.column("t")).reshape(u, q)
        self.tt = numbers(batch.column("tt")).reshape(u, q, q)
        if qb:
            self.owner = np.repeat(np.arange(u), lengths(batch.column("item")))
            self.item = numbers(batch.column("item")).astype(np.int64)
            self.c = numbers(batch.column("c")).reshape(-1, q, qb)

    def blocks(self, width: int) -> Iterator[slice]:
        step = max(1, _BLOCK // max(1, width))
        return (slice(a, a + step) for a in range(0, len(self.m), step))

    def border(self, own: slice, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """F times [m X, t], and what eliminating the units takes off the border's own products."""
        x, m, p = self.x[own], self.m[own], self.x.shape[2]
        right = np.concatenate([f @ (m[:, None, None] * x), f @ self.t[own][:, :, None]], axis=-1)
        off = np.empty((len(f), p + 1, p + 1))
        off[:, :p] = np.einsum("uqi,fuqj->fij", x, right)
        off[:, p, :p] = off[:, :p, p]
        off[:, p, p] = np.einsum("fuqr,uqr->f", f, self.tt[own])
        return right, off


def unit_sums(m: Moments, lambdas: list[np.ndarray], derive: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per candidate (layers, e, e) and (layers,): what units take off [items, fixed part, response], log determinants.

    For a model whose item effects are few or none.
    """
    sizes = m.sizes
    b, p, q, qb = sizes.effects, sizes.p, sizes.q, sizes.qb
    layers = 1 + (q * (q + 1) // 2 if derive else 0)
    e = b + p + 1

    def part(batch):
        units = _Units(batch, sizes)
        out = np.zeros((len(lambdas), layers, e * e + 1))
        for own in units.blocks(q * (b + p + q) * (layers + 1)):
            gram = units.gram[own]
            items = np.zeros((len(gram), q, sizes.n_items, qb))
            if b:
                on = (units.owner >= own.start) & (units.owner < own.stop)
                items[units.owner[on] - own.start, :, units.item[on]] = units.c[on]
            items = items.reshape(len(gram), q, b)
            for k, lam in enumerate(lambdas):
                f, logs = unit_factors(gram, lam, derive)
                right, off = units.border(own, f)
                whole = np.zeros((layers, e, e))
                whole[:, b:, b:] = off
                if b:
                    flat = items.reshape(-1, b)
                    for d in range(layers):
                        weighted = f[d] @ items * units.m[own][:, None, None]
                        whole[d, :b, :b] = flat.T @ weighted.reshape(-1, b)
                        whole[d, :b, b:] = flat.T @ right[d].reshape(-1, p + 1)
                        whole[d, b:, :b] = whole[d, :b, b:].T
                out[k, :, :-1] += whole.reshape(layers, -1)
                out[k, :, -1] += logs @ units.m[own]
        return out.ravel()

    total = total_of(m.rows, part).reshape(len(lambdas), layers, e * e + 1)
    return [(v[:, :-1].reshape(layers, e, e), v[:, -1]) for v in total]


def item_totals(m: Moments, items: DataFrame) -> np.ndarray:
    """Products of item, fixed and response columns over all rows, of few item effects."""
    b, p, qb = m.sizes.effects, m.sizes.p, m.sizes.qb
    out = np.zeros((b + p + 1, b + p + 1))
    for item, bb, bx, by in items.select("_item", "bb", "bx", "by").collect():
        own = slice(item * qb, (item + 1) * qb)
        out[own, own] = np.reshape(bb, (qb, qb))
        out[own, b:] = np.c_[np.reshape(bx, (qb, p)), by]
        out[b:, own] = out[own, b:].T
    out[b:, b:] = m.total
    return out


class ItemScale:
    """Item matrices in units of their relative covariance factor, with derivatives in its entries."""

    def __init__(self, theta_b: np.ndarray, qb: int, derive: bool):
        self.lam, self.qb, self.derive = lower_triangle(theta_b, qb), qb, derive

    def _right(self, a: np.ndarray, lam: np.ndarray) -> np.ndarray:
        return (a.reshape(*a.shape[:-1], -1, self.qb) @ lam).reshape(a.shape)

    def _left(self, a: np.ndarray, lam: np.ndarray) -> np.ndarray:
        return self._right(a.swapaxes(-1, -2), lam).swapaxes(-1, -2)

    def __call__(self, a: np.ndarray, rows: bool, columns: bool, diagonal: bool) -> np.ndarray:
        """``rows``, ``columns``: whether these are item effects. Layers: value, units' entries, items' entries."""
        right = self._right(a, self.lam) if columns else a
        out = self._left(right, self.lam) if rows else right
        if diagonal:
            out = out.copy()
            out[0] += np.eye(out.shape[1])
        if not self.derive:
            return out
        more = []
        for r, c in zip(*np.tril_indices(self.qb)):
            one = np.zeros((self.qb, self.qb))
            one[r, c] = 1.0
            change = np.zeros(a.shape[1:])
            if columns:
                moved = self._right(a[0], one)
                change = change + (self._left(moved, self.lam) if rows else moved)
            if rows:
                change = change + self._left(right[0], one)
            more.append(change)
        return np.concatenate([out, more]) if more else out


def tile_parts(m: Moments, lambdas: list[np.ndarray], derive: bool, shape: schur.Shape) -> DataFrame:
    """Tiles of what units take off, negative, from the units that hold items of both tiles; i = -1: log determinants."""
    sizes, last = m.sizes, shape.columns
    p, q, qb = sizes.p, sizes.q, sizes.qb
    layers = 1 + (q * (q + 1) // 2 if derive else 0)
    per_tile = shape.width // qb

    def parts(batches):
        held: dict = {}

        def add(key, value):
            held[key] = held[key] + value if key in held else value

        for batch in batches:
            if not batch.num_rows:
                continue
            units = _Units(batch, sizes)
            for own in units.blocks(q * (4 * shape.width + p + q) * (layers + 1)):
                entries = np.flatnonzero((units.owner >= own.start) & (units.owner < own.stop))
                owner, item, c = units.owner[entries] - own.start, units.item[entries], units.c[entries]
                tile = item // per_tile
                dense = {}
                for t in np.unique(tile):
                    on = np.flatnonzero(tile == t)
                    who, at = np.unique(owner[on], return_inverse=True)
                    a = np.zeros((len(who), q, shape.size(t) // qb, qb))
                    a[at, :, item[on] - t * per_tile] = c[on]
                    dense[int(t)] = who, a.reshape(len(who), q, -1)
                for k, lam in enumerate(lambdas):
                    f, logs = unit_factors(units.gram[own], lam, derive)
                    right, off = units.border(own, f)
                    add((k, last, last), -off)
                    add((k, -1, -1), (logs @ units.m[own])[:, None, None])
                    f = f * units.m[own][None, :, None, None]
                    for j, (who, a) in dense.items():
                        flat = a.reshape(-1, a.shape[2])
                        add((k, last, j), -np.stack([r[who].reshape(-1, p + 1).T @ flat for r in right]))
                        for i, (others, c_) in dense.items():
                            if i >= j:
                                both, x, y = np.intersect1d(others, who, assume_unique=True, return_indices=True)
                                if len(both):
                                    left = c_[x].reshape(-1, c_.shape[2])
                                    add((k, i, j), -np.stack([left.T @ (g[both] @ a[y]).reshape(-1, a.shape[2]) for g in f]))
                    if sum(v.size for v in held.values()) > _TILES:
                        yield schur.tile_rows([(*key, v) for key, v in held.items()])
                        held.clear()
        if held:
            yield schur.tile_rows([(*key, v) for key, v in held.items()])

    return m.rows.mapInArrow(parts, schur.TILES)


def item_tiles(m: Moments, candidates: int, layers: int, shape: schur.Shape) -> DataFrame:
    """Tiles of the products of item columns over all rows, the same for each candidate."""
    qb, p, last = m.sizes.qb, m.sizes.p, shape.columns
    per_tile = shape.width // qb

    def parts(batches):
        for batch in batches:
            item = numbers(batch.column("_item")).astype(np.int64)
            bb = numbers(batch.column("bb")).reshape(-1, qb, qb)
            edge = np.concatenate([numbers(batch.column("bx")).reshape(-1, qb, p), numbers(batch.column("by")).reshape(-1, qb, 1)], 2)
            for t in np.unique(item // per_tile):
                on = np.flatnonzero(item // per_tile == t)
                n = shape.size(t) // qb
                diagonal, border = np.zeros((layers, n, qb, n, qb)), np.zeros((layers, p + 1, n, qb))
                at = item[on] - t * per_tile
                diagonal[0, at, :, at] = bb[on]
                border[0][:, at] = edge[on].transpose(2, 0, 1)
                for k in range(candidates):
                    yield schur.tile_rows([(k, int(t), int(t), diagonal), (k, last, int(t), border)])

    return m.items.mapInArrow(parts, schur.TILES)


class Deviance:
    """Profiled deviance and gradient; with ``known_scale`` the residual variance is 1 and not profiled out."""

    def __init__(self, m: Moments, reml: bool, known_scale: bool = False):
        self.m, self.reml, self.known_scale = m, reml, known_scale
        self.qa, self.qb, self.b = m.sizes.q, m.sizes.qb, m.sizes.effects
        self.da = self.qa * (self.qa + 1) // 2
        self.k = self.da + self.qb * (self.qb + 1) // 2
        self.few = self.b <= schur.TILE
        if self.few:
            self.total = item_totals(m, m.items) if self.b else m.total

    def borders(self, thetas: list[np.ndarray], derive: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per candidate: matrix over fixed effects and response without random effects, log determinant."""
        lambdas = [lower_triangle(t[: self.da], self.qa) for t in thetas]
        scales = [ItemScale(t[self.da :], self.qb, derive) for t in thetas]
        if not self.few:
            return self._on_the_cluster(lambdas, scales, derive)
        out = []
        for (taken, logs), scale in zip(unit_sums(self.m, lambdas, derive), scales):
            a = -taken
            a[0] += self.total
            if self.b:
                b = self.b
                parts = scale(a[:, :b, :b], True, True, True), scale(a[:, b:, :b], False, True, False), scale(a[:, b:, b:], False, False, False)
                a, more, _ = schur.eliminate_one(*parts)
                logs = np.append(logs, np.zeros(len(more) - len(logs))) + more
            out.append((a, logs))
        return out

    def _on_the_cluster(self, lambdas, scales, derive):
        m, k = self.m, self.k if derive else 0
        layers = 1 + (self.da if derive else 0)
        shape = schur.Shape(self.b, self.qb, m.sizes.p + 1, k)
        parts = tile_parts(m, lambdas, derive, shape)
        partitions = max(m.rows.rdd.getNumPartitions(), int(m.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        parts, _ = schur.stored(parts, "parts")
        everything = parts.where("i >= 0").unionByName(item_tiles(m, len(lambdas), layers, shape))
        last, total = shape.columns, m.total

        def scaled(cand, i, j, tile):
            if i == j == last:
                tile = tile.copy()
                tile[0] += total
            return scales[cand](tile, i < last, j < last, i == j < last)

        tiles, _ = schur.stored(schur.summed_tiles(everything, shape, layers, partitions, scaled), "tiles")
        logs = [np.zeros(k + 1) for _ in lambdas]
        for r in parts.where("i = -1").collect():  # one row per task and candidate
            logs[r.cand][:layers] += np.frombuffer(r.data)
        found = schur.eliminate(tiles, shape, len(lambdas), partitions)
        return [(a, more + own) for (a, more, _), own in zip(found, logs)]

    def solve(self, a: np.ndarray, logs: np.ndarray):
        """Deviance, gradient, fixed effects, residual variance and information of the fixed effects."""
        p, rows = self.m.sizes.p, self.m.size
        xx, xy = a[0, :p, :p], a[0, :p, p]
        beta = np.linalg.solve(xx, xy)
        rss = a[0, p, p] - xy @ beta
        away = np.append(-beta, 1.0)
        slope = np.einsum("i,dij,j->d", away, a[1:], away)
        if self.known_scale:
            return logs[0] + rss, logs[1:] + slope, beta, 1.0, xx
        df = rows - p if self.reml else rows
        value = logs[0] + df * (1.0 + np.log(2.0 * np.pi * rss / df))
        grad = logs[1:] + df * slope / rss
        if self.reml:
            value = value + np.linalg.slogdet(xx)[1]
            grad = grad + np.array([np.trace(np.linalg.solve(xx, d[:p, :p])) for d in a[1:]])
        return value, grad, beta, rss / df, xx

    def values(self, thetas: list[np.ndarray]) -> list[float]:
        return [self.solve(*found)[0] for found in self.borders(thetas, False)]

    def package(self, theta: np.ndarray):
        """Deviance, gradient and Hessian, all points evaluated side by side."""
        points = [theta] + [theta + _DELTA * e for e in np.eye(self.k)]
        found = [self.solve(*f) for f in self.borders(points, True)]
        grads = np.array([f[1] for f in found])
        hess = (grads[1:] - grads[0]) / _DELTA
        return found[0][0], grads[0], (hess + hess.T) / 2.0


def quasi_newton(dev: Deviance, tolerance: float, max_steps: int) -> tuple[np.ndarray, bool]:
    """The other way to the same minimum: curvature built up from gradients, one point after the other."""
    theta = np.concatenate([theta_start(dev.qa), theta_start(dev.qb) if dev.b else np.zeros(0)])
    k = len(theta)

    def at(point):
        found = dev.solve(*dev.borders([point], True)[0])
        return found[0], found[1]

    value, grad = at(theta)
    inverse = np.eye(k) / max(1.0, float(np.max(np.abs(grad))))
    for _ in range(max_steps):
        step = -inverse @ grad
        step *= min(1.0, 0.5 / max(float(np.max(np.abs(step))), 1e-300))
        if np.max(np.abs(step)) < tolerance or np.max(np.abs(grad)) < tolerance:
            return theta, True
        for _ in range(30):
            trial = at(theta + step)
            if trial[0] <= value + 1e-4 * (grad @ step) + 1e-12 * abs(value):
                break
            step = step / 2.0
        else:
            return theta, bool(np.max(np.abs(grad)) < 1e-4 * (1 + abs(value)))
        moved, turned = step, trial[1] - grad
        theta, value, grad = theta + step, *trial
        along = moved @ turned
        if along > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(turned):
            left = np.eye(k) - np.outer(moved, turned) / along
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / along
    return theta, False


def minimise_theta(dev: Deviance, tolerance: float, max_steps: int) -> tuple[np.ndarray, bool]:
    """Newton steps on the stacked covariance parameters; gives them and whether it converged."""
    theta = np.concatenate([theta_start(dev.qa), theta_start(dev.qb) if dev.b else np.zeros(0)])
    value, grad, hess = dev.package(theta)
    for _ in range(max_steps):
        # the deviance is even in a standard deviation: a long step could land on the mirror image
        step = newton_direction(grad, hess, limit=0.5 * max(1.0, float(np.max(np.abs(theta)))))
        if np.max(np.abs(step)) < tolerance or np.max(np.abs(grad)) < tolerance:
            return theta, True
        trial = dev.package(theta + step)
        if not trial[0] <= value + 1e-4 * (grad @ step) + 1e-12 * abs(value):
            sizes = 0.5 ** np.arange(1, 12)
            values = dev.values([theta + t * step for t in sizes])
            best = int(np.nanargmin(values))
            if not values[best] < value:
                return theta, bool(np.max(np.abs(grad)) < 1e-4 * (1 + abs(value)))
            step = sizes[best] * step
            trial = dev.package(theta + step)
        theta = theta + step
        value, grad, hess = trial
    return theta, False


def fit_lmm(
    df: DataFrame,
    model: Model,
    reml: bool = True,
    weight: str | None = None,
    tolerance: float = 1e-9,
    max_steps: int = 60,
    method: str = "newton",
) -> Fit:
    """Fit by steps on the relative covariance parameters, ``method`` newton or quasi-newton.

    ``weight`` names a column of case counts for rows that stand for several equal ones.
    """
    design = design_of(df, model, weight)
    return _fit(moments_of(design, *check(design)), model, reml, tolerance, max_steps, method)


def _fit(m: Moments, model: Model, reml: bool, tolerance: float, max_steps: int, method: str = "newton") -> Fit:
    dev = Deviance(m, reml)
    minimise = {"newton": minimise_theta, "quasi-newton": quasi_newton}[method]
    theta, converged = minimise(dev, tolerance, max_steps)
    value, _, beta, sigma2, xx = dev.solve(*dev.borders([theta], False)[0])
    covariances = [sigma2 * _gram(lower_triangle(theta[: dev.da], dev.qa))]
    if dev.qb:
        covariances.append(sigma2 * _gram(lower_triangle(theta[dev.da :], dev.qb)))
    return Fit(
        model=model,
        family="gaussian",
        beta=beta,
        cov=sigma2 * np.linalg.inv(xx),
        covariances=covariances,
        sigma2=float(sigma2),
        deviance=float(value),
        reml=reml,
        rows=int(m.size),
        units=m.units,
        theta=theta,
        converged=converged,
        compressed=m,
    )


def linearised_theta(design: Design, beta: np.ndarray) -> np.ndarray:
    """Covariance parameters of a logistic model linearised around its fixed part.

    A weighted linear mixed model on the working response; used as starting values.
    """
    eta = sum((F.lit(float(v)) * c for v, c in zip(beta, design.x)), F.lit(0.0))
    mu = F.lit(1.0) / (1.0 + F.exp(-eta))
    # separated cells would leave nothing to solve
    weight = F.greatest(mu * (1.0 - mu), F.lit(1e-6))
    working = design.cells.withColumn("_wn", F.col("_n") * weight)
    working = working.withColumn("_ws", F.col("_wn") * eta + F.col("_s") - F.col("_n") * mu)
    there = Design(working, design.model, design.n_items)
    x, p = design.x, len(design.x)
    sums = [F.sum(F.col("_wn") * x[i] * x[j]) for i in range(p) for j in range(i + 1)] + [F.sum(F.col("_ws") * c) for c in x]
    total = np.zeros((p + 1, p + 1))
    if p:
        found = working.agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)]).first()
        total[np.tril_indices(p)] = found[: p * (p + 1) // 2]
        total[p, :p] = found[p * (p + 1) // 2 :]
        total = total + np.tril(total, -1).T
    m = moments_of(there, total, 1.0, "_wn", "_ws")
    return minimise_theta(Deviance(m, False, known_scale=True), 1e-2, 12)[0]


def refit_ml(fit: Fit) -> Fit:
    """The same model by ML, on the unit rows already there."""
    if not fit.reml:
        return fit
    return _fit(fit.compressed, fit.model, False, 1e-9, 60)


def _gram(lam: np.ndarray) -> np.ndarray:
    return lam @ lam.T
