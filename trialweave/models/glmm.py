"""Logistic mixed models by the Laplace approximation.

For a candidate (covariance factors, fixed effects, item effects) every unit's conditional modes
are found by Newton steps inside its task, on the unit's cells as flat arrays. Item effects, which
all units share, are updated from summed gradients and curvatures: few of them as one matrix, many
as tiles on the cluster. The deviance is minimised jointly over covariance factors and fixed effects
with Newton steps on a local quadratic; all points one step needs are evaluated side by side in the
same jobs.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schur
from .design import Model
from .fit import Fit, inverse_logit, lower_triangle, newton_direction, theta_start
from .lmm import linearised_theta
from .moments import Design, Sizes, check, design_of, lengths, numbers, spread, total_of

_BLOCK = 2_000_000  # numbers in one dense block inside a task
_TILES = 1 << 24
_UNIT_STEPS, _ITEM_STEPS = 100, 60


class Cells:
    """Unit rows: each unit's different cells, ordered by item, as flat arrays; equal units share a row."""

    def __init__(self, design: Design):
        x, z, b = design.x, design.z, design.b
        self.sizes = Sizes(len(x), len(z), len(b), design.n_items)
        columns: dict[str, list[Column]] = {"x": x, "z": z, "b": b}
        named = [c.alias(f"_{k}{i}") for k, cs in columns.items() for i, c in enumerate(cs)]
        names = [f"_{k}{i}" for k, cs in columns.items() for i in range(len(cs))]
        cells = design.cells.select(design.unit, "_item", "_n", "_s", *named)
        # predictors that the model doesn't tell apart are one cell
        cells = cells.groupBy(design.unit, "_item", *names).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        whole = F.array_sort(F.collect_list(F.struct("_item", *names, "_n", "_s"))).alias("_c")
        flat = [F.col("_c._item").alias("item"), F.col("_c._n").alias("n"), F.col("_c._s").alias("s")]
        for k, cs in columns.items():
            parts = [F.col(f"_c._{k}{i}") for i in range(len(cs))]
            flat.append((F.flatten(F.array(*parts)) if parts else F.array().cast("array<double>")).alias(k))
        rows = cells.groupBy(design.unit).agg(whole).groupBy(*flat).agg(F.count(F.lit(1)).cast("double").alias("m"))
        self.rows = spread(rows, F.size("n") * F.lit(8 * (len(x) + len(z) + len(b))))
        self.units = int(self.rows.agg(F.sum("m")).first()[0])


class _Batch:
    def __init__(self, batch: pa.RecordBatch, c: Sizes):
        count = lengths(batch.column("n"))
        self.m = numbers(batch.column("m"))
        self.at = np.r_[0, np.cumsum(count)]
        self.owner = np.repeat(np.arange(len(count)), count)
        self.n, self.s = numbers(batch.column("n")), numbers(batch.column("s"))
        self.item = numbers(batch.column("item")).astype(np.int64)
        # a unit's columns stand one after the other
        place = np.arange(len(self.n)) - self.at[self.owner]
        self.x, self.z, self.b = (
            numbers(batch.column(k))[(self.at[self.owner] * w + place)[:, None] + count[self.owner][:, None] * np.arange(w)]
            for k, w in (("x", c.p), ("z", c.q), ("b", c.qb))
        )

    def per_unit(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.at[:-1], axis=0)

    def modes(self, fixed: np.ndarray, z: np.ndarray, start: np.ndarray):
        """Newton steps for every unit's modes; eta, mu, weights, unit curvature and the modes."""
        n, s, owner, q = self.n, self.s, self.owner, z.shape[1]
        u = start

        def at(u):
            eta = fixed + (z * u[owner]).sum(1)
            mu = inverse_logit(eta)
            w = n * mu * (1.0 - mu)
            return eta, mu, w, self.per_unit(w[:, None, None] * z[:, :, None] * z[:, None, :]) + np.eye(q)

        for _ in range(_UNIT_STEPS):
            _, mu, _, h = at(u)
            slope = self.per_unit(z * (s - n * mu)[:, None]) - u
            step = np.linalg.solve(h, slope[:, :, None])[:, :, 0]
            u = u + np.clip(step, -3.0, 3.0)
            if np.max(np.abs(step)) < 1e-10:
                break
        return *at(u), u


def _eta(b: _Batch, beta: np.ndarray, effects: np.ndarray | None) -> np.ndarray:
    eta = b.x @ beta
    return eta if effects is None else eta + (b.b * effects[b.item]).sum(1)


def unit_modes(cells: Cells, betas, lambdas, effects, curvature: bool):
    """Per candidate: penalised log-likelihood, log det, score and curvature over [items, fixed part].

    Without ``curvature`` the last two are None. For a model whose item effects are few or none.
    """
    c = cells.sizes
    e = c.effects + c.p if curvature else 0

    def part(batch):
        b = _Batch(batch, c)
        out = []
        u = np.zeros((len(b.m), c.q))  # candidates are close: each starts at the modes before it
        for beta, lam, own in zip(betas, lambdas, effects):
            z = b.z @ lam
            eta, mu, w, h, u = b.modes(_eta(b, beta, own), z, u)
            log_lik = b.per_unit(b.s * eta - b.n * np.logaddexp(0.0, eta)) - 0.5 * (u * u).sum(1)
            found = [np.array([b.m @ log_lik, b.m @ np.linalg.slogdet(h)[1]])]
            if e:
                found += _curvature(b, c, z, mu, w, h)
            out.append(np.concatenate(found))
        return np.concatenate(out)

    total = total_of(cells.rows, part).reshape(len(betas), -1)
    if not e:
        return [(t[0], t[1], None, None) for t in total]
    return [(t[0], t[1], t[2 : 2 + e], t[2 + e :].reshape(e, e)) for t in total]


def _curvature(b: _Batch, c: Sizes, z, mu, w, h) -> list[np.ndarray]:
    """Score and curvature over [items, fixed part], the unit effects eliminated."""
    k, e = c.effects, c.effects + c.p
    score = np.zeros(e)
    info = np.zeros((e, e))
    m = b.m[b.owner]
    score[k:] = (m * (b.s - b.n * mu)) @ b.x
    if k:
        at = b.item[:, None] * c.qb + np.arange(c.qb)
        score[:k] = np.bincount(at.ravel(), (b.b * (m * (b.s - b.n * mu))[:, None]).ravel(), k)
    step = max(1, _BLOCK // max(1, c.q * e))
    for first in range(0, len(b.m), step):
        units = slice(first, min(first + step, len(b.m)))
        on = slice(b.at[units.start], b.at[units.stop])
        cross = np.zeros((units.stop - units.start, c.q, e))
        weighted = w[on, None] * z[on]
        who = b.owner[on] - first
        for i in range(c.p):
            cross[:, :, k + i] = np.add.reduceat(weighted * b.x[on, i, None], b.at[:-1][units] - on.start, axis=0)
        for i in range(c.qb):
            np.add.at(cross, (who, slice(None), b.item[on] * c.qb + i), weighted * b.b[on, i, None])
        left = np.linalg.inv(h[units]) @ cross * b.m[units, None, None]
        info -= cross.reshape(-1, e).T @ left.reshape(-1, e)
    wm = w * m
    info[k:, k:] += b.x.T @ (wm[:, None] * b.x)
    for i in range(c.qb):
        own = b.item * c.qb + i
        for j in range(c.qb):
            np.add.at(info, (own, b.item * c.qb + j), wm * b.b[:, i] * b.b[:, j])
        for j in range(c.p):
            side = np.bincount(own, wm * b.b[:, i] * b.x[:, j], k)
            info[:k, k + j] += side
            info[k + j, :k] += side
    return [score, info.ravel()]


def tile_parts(cells: Cells, betas, lambdas, effects, shape: schur.Shape) -> DataFrame:
    """Tiles of the curvature over item effects and, as border, the score (with the fixed part: its curvature).

    The border's columns are the fixed part's, then the score. Rows of i = -1 hold log-likelihood and log det.
    """
    c = cells.sizes
    qb, last = c.qb, shape.columns
    per_tile = shape.width // qb

    def parts(batches):
        held: dict = {}

        def add(key, value):
            held[key] = held[key] + value if key in held else value[None].copy()

        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch, c)
            u = np.zeros((len(b.m), c.q))
            tile = b.item // per_tile
            for k, (beta, lam, own) in enumerate(zip(betas, lambdas, effects)):
                z = b.z @ lam
                eta, mu, w, h, u = b.modes(_eta(b, beta, own), z, u)
                log_lik = b.per_unit(b.s * eta - b.n * np.logaddexp(0.0, eta)) - 0.5 * (u * u).sum(1)
                add((k, -1, -1), np.array([[b.m @ log_lik, b.m @ np.linalg.slogdet(h)[1]]]))
                inverse, weighted, m = np.linalg.inv(h) * b.m[:, None, None], w[:, None] * z, b.m[b.owner]
                edge = np.stack([b.per_unit(weighted * b.x[:, i, None]) for i in range(c.p)], 2) if c.p else np.zeros((len(b.m), c.q, 0))
                corner = np.zeros((c.p + 1, c.p + 1))
                corner[: c.p, : c.p] = b.x.T @ ((w * m)[:, None] * b.x) - np.einsum("uqi,uqr,urj->ij", edge, inverse, edge)
                add((k, last, last), corner)
                dense = {}
                for t in np.unique(tile):
                    on = np.flatnonzero(tile == t)
                    who, at = np.unique(b.owner[on], return_inverse=True)
                    n, place = shape.size(int(t)) // qb, b.item[on] - int(t) * per_tile
                    a = np.zeros((len(who), c.q, n * qb))
                    full, border = np.zeros((n, qb, n, qb)), np.zeros((c.p + 1, n, qb))
                    for i in range(qb):
                        np.add.at(a, (at, slice(None), place * qb + i), weighted[on] * b.b[on, i, None])
                        for j in range(qb):
                            np.add.at(full, (place, i, place, j), (w * m)[on] * b.b[on, i] * b.b[on, j])
                        for j in range(c.p):
                            np.add.at(border, (j, place, i), (w * m)[on] * b.b[on, i] * b.x[on, j])
                        np.add.at(border, (c.p, place, i), (m * (b.s - b.n * mu))[on] * b.b[on, i])
                    border = border.reshape(c.p + 1, -1)
                    border[: c.p] -= np.einsum("uqi,uqr,urj->ij", edge[who], inverse[who], a)
                    add((k, int(t), int(t)), full.reshape(n * qb, n * qb))
                    add((k, last, int(t)), border)
                    dense[int(t)] = who, a
                for j, (who, a) in dense.items():
                    for i, (others, left) in dense.items():
                        if i >= j:
                            both, x, y = np.intersect1d(others, who, assume_unique=True, return_indices=True)
                            if len(both):
                                taken = left[x].reshape(-1, left.shape[2]).T @ (inverse[both] @ a[y]).reshape(-1, a.shape[2])
                                add((k, i, j), -taken)
                if sum(v.size for v in held.values()) > _TILES:
                    yield schur.tile_rows([(*key, v) for key, v in held.items()])
                    held.clear()
        if held:
            yield schur.tile_rows([(*key, v) for key, v in held.items()])

    return cells.rows.mapInArrow(parts, schur.TILES)


class Laplace:
    """Laplace deviance for batches of (theta, beta); remembers item effects as starting values."""

    def __init__(self, cells: Cells):
        self.cells, self.c = cells, cells.sizes
        c = self.c
        self.da = len(theta_start(c.q))
        self.k = self.da + (len(theta_start(c.qb)) if c.qb else 0)
        self.items = np.zeros(c.effects)
        self.few = c.effects <= schur.TILE
        self.unfinished = 0

    def parts(self, point):
        return point[: self.da], point[self.da : self.k], point[self.k :]

    def _steps(self, batch, effects):
        """Per candidate (log-likelihood, log det of units and items, Newton step of the item effects, curvature of the fixed part)."""
        c, b = self.c, self.c.effects
        lam_a = [lower_triangle(self.parts(p)[0], c.q) for p in batch]
        lam_b = [lower_triangle(self.parts(p)[1], c.qb) for p in batch]
        betas = [self.parts(p)[2] for p in batch]
        own = [(u.reshape(-1, c.qb) @ lam.T) for u, lam in zip(effects, lam_b)]
        out = []
        if self.few:
            for (log_lik, log_det, score, info), lam, u in zip(unit_modes(self.cells, betas, lam_a, own, True), lam_b, effects):
                big = np.kron(np.eye(c.n_items), lam)
                h = big.T @ info[:b, :b] @ big + np.eye(b)
                right = big.T @ info[:b, b:]
                solved = np.linalg.solve(h, np.c_[big.T @ score[:b] - u, right])
                out.append((log_lik, log_det + np.linalg.slogdet(h)[1], solved[:, 0], info[b:, b:] - right.T @ solved[:, 1:]))
            return out
        shape = schur.Shape(b, c.qb, c.p + 1, 0)
        last = shape.columns
        parts, _ = schur.stored(tile_parts(self.cells, betas, lam_a, own, shape), "parts")
        partitions = max(self.cells.rows.rdd.getNumPartitions(), int(self.cells.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def scaled(cand, i, j, tile):
            lam, width = lam_b[cand], c.qb
            if j < last:
                tile = (tile.reshape(1, tile.shape[1], -1, width) @ lam).reshape(tile.shape)
            if i < last:
                turned = tile.transpose(0, 2, 1)
                tile = (turned.reshape(1, turned.shape[1], -1, width) @ lam).reshape(turned.shape).transpose(0, 2, 1)
            elif j < last:  # the score is that of the penalised likelihood
                tile = tile.copy()
                tile[0, -1] -= effects[cand][shape.place(j)]
            if i == j < last:
                tile = tile + np.eye(tile.shape[1])
            return tile

        tiles, _ = schur.stored(schur.summed_tiles(parts.where("i >= 0"), shape, 1, partitions, scaled), "tiles")
        own = [np.zeros(2) for _ in batch]
        for r in parts.where("i = -1").collect():  # one row per task and candidate
            own[r.cand] += np.frombuffer(r.data)
        for (rest, logs, solution), (log_lik, log_det) in zip(schur.eliminate(tiles, shape, len(batch), partitions, True), own):
            out.append((log_lik, log_det + logs[0], solution[:, -1], rest[0, : c.p, : c.p]))
        return out

    def __call__(self, batch: list[np.ndarray]) -> np.ndarray:
        c = self.c
        if not c.effects:
            lam = [lower_triangle(self.parts(p)[0], c.q) for p in batch]
            found = unit_modes(self.cells, [self.parts(p)[2] for p in batch], lam, [None] * len(batch), False)
            return np.array([-2.0 * f[0] + f[1] for f in found])
        effects = [self.items.copy() for _ in batch]
        values = np.full(len(batch), np.nan)
        open_ = list(range(len(batch)))
        for _ in range(_ITEM_STEPS):
            still = []
            for i, (log_lik, log_det, step, _) in zip(open_, self._steps([batch[i] for i in open_], [effects[i] for i in open_])):
                u = effects[i]
                values[i] = -2.0 * (log_lik - 0.5 * u @ u) + log_det
                if np.max(np.abs(step)) > 1e-7:
                    effects[i] = u + np.clip(step, -3.0, 3.0)
                    still.append(i)
            open_ = still
            if not open_:
                break
        self.unfinished += len(open_)
        self.items = effects[0]
        return values

    def information(self, point) -> np.ndarray:
        """Information of the fixed effects at the modes, all random effects eliminated."""
        c = self.c
        if c.effects:
            return self._steps([point], [self.items])[0][3]
        theta_a, _, beta = self.parts(point)
        return unit_modes(self.cells, [beta], [lower_triangle(theta_a, c.q)], [None], True)[0][3]


def fixed_start(design: Design) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-effects logistic fit on the cells: estimates and covariance; one aggregate a step."""
    x = design.x
    p = len(x)
    beta, info = np.zeros(p), np.zeros((p, p))
    for _ in range(50 if p else 0):
        eta = sum((F.lit(float(v)) * c for v, c in zip(beta, x)), F.lit(0.0))
        mu = F.lit(1.0) / (1.0 + F.exp(-eta))
        cells = design.cells.select("_n", "_s", mu.alias("_mu"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
        w = F.col("_n") * F.col("_mu") * (1.0 - F.col("_mu"))
        sums = [F.sum(w * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(p) for j in range(i + 1)]
        sums += [F.sum((F.col("_s") - F.col("_n") * F.col("_mu")) * F.col(f"_x{i}")) for i in range(p)]
        found = np.array(cells.agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)]).first(), float)
        info[np.tril_indices(p)] = found[:-p]
        info = np.tril(info) + np.tril(info, -1).T
        step = np.linalg.lstsq(info, found[-p:], rcond=None)[0]
        beta = beta + np.clip(step, -3.0, 3.0)
        if np.max(np.abs(step), initial=0.0) < 1e-6:  # a start: the joint steps do the rest
            break
    return beta, np.linalg.pinv(info)


def _away_from_zero(theta: np.ndarray, *sizes: int) -> np.ndarray:
    """Starting standard deviations of at least 0.02: zero is stationary by symmetry."""
    theta, at = theta.copy(), 0
    for q in sizes:
        lam = lower_triangle(theta[at : at + q * (q + 1) // 2], q)
        lam = lam * np.where(np.diag(lam) < 0, -1.0, 1.0)
        lam[np.diag_indices(q)] = np.maximum(np.diag(lam), 0.02)
        theta[at : at + q * (q + 1) // 2] = lam[np.tril_indices(q)]
        at += q * (q + 1) // 2
    return theta


def fit_glmm(
    df: DataFrame,
    model: Model,
    weight: str | None = None,
    tolerance: float = 1e-4,
    max_steps: int = 40,
) -> Fit:
    """Fit a 0/1 response; ``tolerance`` bounds the expected gain in deviance of a further step."""
    design = design_of(df, model, weight)
    _, size = check(design)
    cells = Cells(design)
    dev = Laplace(cells)
    beta, cov = fixed_start(design)
    theta = linearised_theta(design, beta)
    theta = _away_from_zero(theta, cells.sizes.q, cells.sizes.qb)
    point = np.concatenate([theta, beta])
    spread_ = np.clip(0.2 * np.sqrt(np.diag(cov)), 1e-4, 0.5)
    width = np.concatenate([np.full(dev.k, 0.01), spread_])
    k = len(point)

    def rescaled(hess):
        """Widths that move the deviance by about a twentieth."""
        return np.clip(np.sqrt(0.1 / np.maximum(np.abs(np.diag(hess)), 1e-12)), 1e-4, 0.01)

    pairs = [(i, j) for i in range(k) for j in range(i)]

    def package(p, w):
        """Deviance, gradient and Hessian from one batch of points around p."""
        shifts = [np.zeros(k)]
        for i in range(k):
            shifts += [np.eye(k)[i], -np.eye(k)[i]]
        shifts += [np.eye(k)[i] + np.eye(k)[j] for i, j in pairs]
        v = dev([p + w * s for s in shifts])
        up, down = v[1 : 2 * k : 2], v[2 : 2 * k + 1 : 2]
        hess = np.diag((up - 2.0 * v[0] + down) / w**2)
        for (i, j), both in zip(pairs, v[2 * k + 1 :]):
            hess[i, j] = hess[j, i] = (both - up[i] - up[j] + v[0]) / (w[i] * w[j])
        return v[0], (up - down) / (2.0 * w), hess

    value, grad, hess = package(point, width)
    converged = False
    for _ in range(max_steps):
        step = newton_direction(grad, hess, limit=1.0)
        gain = -(grad @ step + 0.5 * step @ hess @ step)
        if abs(gain) < tolerance:
            converged = True
            break
        trial = package(point + step, rescaled(hess))
        if not trial[0] < value:
            if abs(gain) < 100 * tolerance:
                converged = True
                break
            sizes = [0.5, 0.25, 0.1, 0.03, 0.01, 0.003]
            values = dev([point + t * step for t in sizes])
            best = int(np.nanargmin(values))
            if not values[best] < value:
                break
            step = sizes[best] * step
            trial = package(point + step, rescaled(hess))
        point = point + step
        value, grad, hess = trial
    step = newton_direction(grad, hess, limit=0.1)
    last = dev([point + step, point])
    if last[0] < last[1]:
        point = point + step
    dev.unfinished = 0
    value = float(dev([point])[0])
    if dev.unfinished:
        warnings.warn("the item effects' modes were still moving when the steps ran out", stacklevel=2)
        converged = False
    theta_a, theta_b, beta = dev.parts(point)
    curvature = np.linalg.eigvalsh(hess)
    if curvature[0] > 1e-6 * curvature[-1]:
        cov = (2.0 * np.linalg.inv(hess))[dev.k :, dev.k :]
    else:  # at the boundary the Hessian is of no use
        cov = np.linalg.pinv(dev.information(point))
    lam = [lower_triangle(theta_a, cells.sizes.q)]
    if cells.sizes.qb:
        lam.append(lower_triangle(theta_b, cells.sizes.qb))
    return Fit(
        model=model,
        family="binomial",
        beta=beta,
        cov=cov,
        covariances=[m @ m.T for m in lam],
        sigma2=1.0,
        deviance=value,
        reml=False,
        rows=int(size),
        units=cells.units,
        theta=point[: dev.k],
        converged=converged,
        compressed=None,
    )
