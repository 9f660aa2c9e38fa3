"""P-spline posteriors by the No-U-Turn sampler within Gibbs steps: one task a series (or a row of the Cholesky factor) and chain.

The prior of each block of weights w: log delta and log phi with Gamma densities (delta; phi given delta) and their
Jacobians, and w normal with precision phi P.  Likelihoods are Whittle's of a periodogram, and the Wishart one of a row of
spectral matrices, which needs the matrices Y alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import bspline, fit_log_spline, penalty
from .knots import density_knots

Density = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Prior:
    alpha_phi: float = 1.0
    beta_phi: float = 1.0
    alpha_delta: float = 1e-4
    beta_delta: float = 1e-4

    def density(self, w: np.ndarray, log_phi: float, log_delta: float, pen: np.ndarray) -> tuple[float, np.ndarray, float, float]:
        """Log density and its gradients by w, log phi, log delta."""
        phi, delta, pw = math.exp(log_phi), math.exp(log_delta), pen @ w
        quad = float(w @ pw)
        lp = self.alpha_delta * (math.log(self.beta_delta) + log_delta) - math.lgamma(self.alpha_delta) - self.beta_delta * delta
        lp += self.alpha_phi * (math.log(self.beta_phi) + log_delta + log_phi) - math.lgamma(self.alpha_phi) - self.beta_phi * delta * phi
        lp += 0.5 * len(w) * log_phi - 0.5 * phi * quad
        by_phi = self.alpha_phi - self.beta_phi * delta * phi + 0.5 * len(w) - 0.5 * phi * quad
        return lp, -phi * pw, by_phi, self.alpha_delta - self.beta_delta * delta + self.alpha_phi - self.beta_phi * delta * phi


    def scales(self, phi: float, size: int, quad: float, rng: np.random.Generator, steps: int = 4) -> tuple[float, float]:
        """phi given the weights, with delta integrated out (slice steps on its log), then delta given phi, which is a Gamma variable."""

        def log_density(t: float) -> float:
            return (self.alpha_phi + size / 2) * t - 0.5 * quad * math.exp(t) - (self.alpha_delta + self.alpha_phi) * math.log(self.beta_delta + self.beta_phi * math.exp(t))

        t = math.log(phi)
        for _ in range(steps):
            edge = log_density(t) + math.log(rng.random() + 1e-300)
            lo = t - 2 * rng.random()
            hi = lo + 2
            while lo > -55 and log_density(lo) > edge:
                lo -= 2
            while hi < 55 and log_density(hi) > edge:
                hi += 2
            while True:
                x = lo + (hi - lo) * rng.random()
                if log_density(x) >= edge:
                    break
                lo, hi = (x, hi) if x < t else (lo, x)
            t = x
        return math.exp(t), max(rng.gamma(self.alpha_delta + self.alpha_phi) / (self.beta_delta + self.beta_phi * math.exp(t)), 1e-25)


def with_prior(likelihood: Callable[[list[np.ndarray]], tuple[float, list[np.ndarray]]], pens: list[np.ndarray], prior: Prior) -> Density:
    """The posterior over (w, log phi, log delta) of each block, one after another."""
    sizes = [len(p) + 2 for p in pens]

    def f(z: np.ndarray) -> tuple[float, np.ndarray]:
        parts = np.split(z, np.cumsum(sizes)[:-1])
        if any(np.abs(p[-2:]).max() > 60 for p in parts):
            return -np.inf, np.zeros_like(z)
        lp, grads = likelihood([p[:-2] for p in parts])
        out = []
        for p, g, pen in zip(parts, grads, pens, strict=True):
            own, by_w, by_phi, by_delta = prior.density(p[:-2], p[-2], p[-1], pen)
            lp += own
            out.append(np.concatenate([g + by_w, [by_phi, by_delta]]))
        return lp, np.concatenate(out)

    return f


def whittle_likelihood(power: np.ndarray, basis: np.ndarray, nh: int = 1):
    def f(w: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        s = basis @ w[0]
        r = power * np.exp(-np.clip(s, -700, 700))
        return float(-0.5 * (nh * s.sum() + r.sum())), [-0.5 * (basis.T @ (nh - r))]

    return f


def wishart_likelihood(y: np.ndarray, row: int, basis: np.ndarray, nb: int, duration: float, nh: int = 1, enbw: float = 1.0, eta: float = 1.0):
    """y: frequencies x channels x channels, sums of u u^H.  Blocks: the log variance of the row, then real and imaginary part of
    the factor of each row before it."""
    own, cross, before = y[:, row, row].real, y[:, row, :row], y[:, :row, :row].transpose(0, 2, 1)
    scale = eta / enbw

    def f(w: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        free = basis @ w[0]
        log_d = np.clip(free, -80, 80)
        t = np.stack([basis @ a + 1j * (basis @ b) for a, b in zip(w[1::2], w[2::2], strict=True)], axis=1) if row else np.zeros((len(own), 0))
        at = (before @ t[:, :, None])[:, :, 0]
        rest = own - 2 * (t.conj() * cross).sum(axis=1).real + (t.conj() * at).sum(axis=1).real
        inv = np.exp(-log_d) / duration
        by_d = (-nb * nh + rest * inv) * (free == log_d)
        by_t = 2 * (cross - at) * inv[:, None]
        grads = [basis.T @ by_d]
        for k in range(row):
            grads += [basis.T @ by_t[:, k].real, basis.T @ by_t[:, k].imag]
        return scale * float(-nb * nh * log_d.sum() - (rest * inv).sum()), [scale * g for g in grads]

    return f


def transition(f: Density, z: np.ndarray, root: np.ndarray, eps: float, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, int, float, bool]:
    """One multinomial No-U-Turn step from z in the metric root @ root.T: (next z, steps, mean acceptance, diverged)."""

    def g(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = f(z + root @ x)
        return value, root.T @ grad

    def turns(x0, p0, x1, p1):
        d = x1 - x0
        return d @ p0 < 0 or d @ p1 < 0

    def tree(x, p, gx, way, j, joint0):
        """(first, last (x, p, gradient), chosen x, log weight, turned or diverged, sum of accept, steps, diverged)"""
        if j == 0:
            p1 = p + 0.5 * way * eps * gx
            x1 = x + way * eps * p1
            lp1, g1 = g(x1)
            p1 = p1 + 0.5 * way * eps * g1
            w = lp1 - 0.5 * p1 @ p1 - joint0 if np.isfinite(lp1) else -np.inf
            bad = not w > -1000
            return (x1, p1, g1), (x1, p1, g1), x1, w if not bad else -np.inf, bad, math.exp(min(0.0, w)), 1, bad
        a = tree(x, p, gx, way, j - 1, joint0)
        if a[4]:
            return a
        b = tree(*a[1], way, j - 1, joint0)
        w = np.logaddexp(a[3], b[3])
        chosen = b[2] if not b[4] and math.log(rng.random() + 1e-300) < b[3] - w else a[2]
        lo, hi = (a[0], b[1]) if way > 0 else (b[1], a[0])
        return a[0], b[1], chosen, w, b[4] or turns(lo[0], lo[1], hi[0], hi[1]), a[5] + b[5], a[6] + b[6], b[7]

    x, p = np.zeros(len(z)), rng.standard_normal(len(z))
    lp, grad = g(x)
    joint0 = lp - 0.5 * p @ p
    left = right = (x, p, grad)
    weight, sums, steps, diverged = 0.0, 0.0, 0, False
    for j in range(depth):
        way = 1 if rng.random() < 0.5 else -1
        t = tree(*(right if way > 0 else left), way, j, joint0)
        sums, steps, diverged = sums + t[5], steps + t[6], diverged or t[7]
        if t[4]:
            break
        if math.log(rng.random() + 1e-300) < t[3] - weight:
            x = t[2]
        weight = np.logaddexp(weight, t[3])
        left, right = (left, t[1]) if way > 0 else (t[1], right)
        if turns(left[0], left[1], right[0], right[1]):
            break
    return z + root @ x, steps, sums / max(steps, 1), diverged


def sample(likelihood, start: list[np.ndarray], pens: list[np.ndarray], information: list[np.ndarray], prior: Prior, draws: int, warm: int, rng: np.random.Generator, depth: int = 8, target: float = 0.8) -> dict[str, np.ndarray]:
    """Draws of all weights, and of both scales of each block.

    Given the weights, the scales of a block are drawn together, apart from the rest; given the scales, the weights take a No-U-Turn step in
    the metric of the blocks' information plus phi P, so neither a rough nor a stiff spline makes the steps small.
    """
    blocks, cuts = list(start), np.cumsum([len(w) for w in start])[:-1]
    phi, delta = [1.0] * len(start), [1.0] * len(start)
    full = with_prior(likelihood, pens, prior)
    kept: dict[str, list] = {k: [] for k in ("z", "lp", "steps", "accept", "diverging", "step_size")}
    eps, h_bar, log_avg = 0.5, 0.0, 0.0
    for it in range(draws + warm):
        root = np.zeros((sum(map(len, blocks)),) * 2)
        at = 0
        for k, (w, pen, info) in enumerate(zip(blocks, pens, information, strict=True)):
            phi[k], delta[k] = prior.scales(phi[k], len(w), float(w @ pen @ w), rng)
            root[at : at + len(w), at : at + len(w)] = np.linalg.cholesky(np.linalg.inv(info + phi[k] * pen + 1e-9 * np.eye(len(w))))
            at += len(w)

        def density(z: np.ndarray) -> tuple[float, np.ndarray]:
            parts = np.split(z, cuts)
            lp, grads = likelihood(parts)
            smooth = [pen @ w for pen, w in zip(pens, parts, strict=True)]
            return lp - 0.5 * sum(f * w @ s for f, w, s in zip(phi, parts, smooth, strict=True)), np.concatenate([g - f * s for g, f, s in zip(grads, phi, smooth, strict=True)])

        z, steps, a, diverged = transition(density, np.concatenate(blocks), root, eps, rng, depth)
        blocks = np.split(z, cuts)
        if it < warm:
            h_bar += (target - a - h_bar) / (it + 11)
            log_eps = math.log(5.0) - math.sqrt(it + 1) / 0.05 * h_bar
            log_avg += (it + 1) ** -0.75 * (log_eps - log_avg)
            eps = math.exp(log_avg if it == warm - 1 else log_eps)
        else:
            point = np.concatenate([np.append(w, [math.log(f), math.log(d)]) for w, f, d in zip(blocks, phi, delta, strict=True)])
            for k, x in zip(kept, (point, full(point)[0], steps, a, diverged, eps), strict=True):
                kept[k].append(x)
    return {k: np.array(x) for k, x in kept.items()}


def _rows(key: dict, found: dict[str, np.ndarray], blocks: list[str], size: int) -> pd.DataFrame:
    """Draws in long form: a row for each block, weight (and -2: log phi, -1: log delta) of each draw."""
    d, b = np.indices(found["z"].shape)
    place = b % (size + 2)
    place = np.where(place >= size, place - size - 2, place)
    stat = {k: np.repeat(found[k], found["z"].shape[1]) for k in ("lp", "steps", "accept", "diverging", "step_size")}
    return pd.DataFrame(key | {"draw": d.ravel(), "block": np.array(blocks)[(b // (size + 2)).ravel()], "b": place.ravel(), "w": found["z"].ravel()} | stat | {"diverging": stat["diverging"].astype(int)})


_DRAWS = "chain long, draw long, block string, b long, w double, lp double, steps long, accept double, diverging long, step_size double"


def spline_grid(power: np.ndarray, n_knots: int, method: str = "density") -> tuple[np.ndarray, np.ndarray]:
    """The basis at the bins of a periodogram, and its penalty."""
    if method not in ("density", "uniform"):
        raise ValueError(f"unknown placement of knots {method!r}")
    at = density_knots(power, np.arange(1.0, len(power) + 1), n_knots) if method == "density" else np.linspace(0, 1, n_knots)
    return bspline(np.linspace(0, 1, len(power)), at, 3), penalty(at)


def fit_univariate(power: DataFrame, chains: int = 2, draws: int = 200, warm: int = 200, n_knots: int = 10, prior: Prior = Prior(), nh: int = 1, key: str = "series_id", method: str = "density") -> DataFrame:
    """Draws of log spline weights for each series of power (key, k, power): key, chain, draw, block, b, w and the sampler's figures.

    method: "density" puts knots where the power changes (see spline_grid), "uniform" evenly.
    """
    kind = dict(power.dtypes)[key]
    many = power.withColumn("chain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chains - 1).cast("long"))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        y, chain = p["power"].to_numpy(), int(p["chain"].iloc[0])
        basis, pen = spline_grid(y, n_knots, method)
        rng = np.random.default_rng([chain, len(y)])
        start = fit_log_spline(y / nh, basis, 1e-2) + 0.577 + 0.05 * rng.standard_normal(len(pen))  # the mean of a log power is so much below the log of its mean
        found = sample(whittle_likelihood(y, basis, nh), [start], [pen], [0.5 * nh * basis.T @ basis], prior, draws, warm, rng)
        return _rows({key: p[key].iloc[0], "chain": chain}, found, ["log_psd"], len(pen))

    return many.groupBy(key, "chain").applyInPandas(run, f"{key} {kind}, {_DRAWS}")


def fit_rows(y: DataFrame, nb: int, duration: float, chains: int = 1, draws: int = 100, warm: int = 150, n_knots: int = 6, prior: Prior = Prior(), nh: int = 1, enbw: float = 1.0, eta: float = 1.0) -> DataFrame:
    """Draws for each row of the Cholesky factor of spectral matrices Y (k, i, j, re, im): row, chain, draw, block, b, w and figures.

    A row needs the channels up to its own; rows and chains are independent tasks.
    """
    rows = y.select(F.max("i")).first()[0] + 1
    dealt = y.withColumn("row", F.explode(F.sequence(F.greatest("i", "j"), F.lit(rows - 1)))).withColumn("chain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chains - 1).cast("long"))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        row, chain = int(p["row"].iloc[0]), int(p["chain"].iloc[0])
        at = {k: n for n, k in enumerate(sorted(p["k"].unique()))}
        m = np.zeros((len(at), row + 1, row + 1), complex)
        m[p["k"].map(at), p["i"], p["j"]] = p["re"] + 1j * p["im"]
        basis, pen = bspline(np.linspace(0, 1, len(at)), np.linspace(0, 1, n_knots), 3), penalty(np.linspace(0, 1, n_knots))
        rng = np.random.default_rng([chain, row])
        size = len(pen)
        scale = eta / enbw
        start = [fit_log_spline(m[:, row, row].real / (nb * nh * duration), basis, 1e-2)]
        information = [scale * nb * nh * basis.T @ basis]
        ridge = np.linalg.solve(basis.T @ basis + 1e-2 * np.eye(size), basis.T)
        if row:
            low = m[:, :row, :row].transpose(0, 2, 1)
            t = np.linalg.solve(low + 1e-6 * np.trace(low, axis1=1, axis2=2).real[:, None, None] * np.eye(row), m[:, row, :row, None])[:, :, 0]
            level = np.exp(-basis @ start[0]) / duration
            for k in range(row):
                start += [ridge @ part for part in (t[:, k].real, t[:, k].imag)]
                information += [2 * scale * basis.T @ (basis * (m[:, k, k].real * level)[:, None])] * 2
        names = ["log_delta2", *(f"theta_{part}_{k}" for k in range(row) for part in ("re", "im"))]
        likelihood = wishart_likelihood(m, row, basis, nb, duration, nh, enbw, eta)
        found = sample(likelihood, start, [pen] * len(names), information, prior, draws, warm, rng)
        return _rows({"row": row, "chain": chain}, found, names, size)

    return dealt.groupBy("row", "chain").applyInPandas(run, f"row long, {_DRAWS}")


def _rank_normal(x: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    order = np.argsort(x.ravel(), kind="stable")
    values = x.ravel()[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    mean = np.cumsum(size) - (size - 1) / 2
    rank = np.empty(x.size)
    rank[order] = mean[group]
    return np.array([NormalDist().inv_cdf((r - 0.375) / (x.size + 0.25)) for r in rank]).reshape(x.shape)


def _split(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return np.concatenate([x[:, :half], x[:, x.shape[1] - half :]])


def _plain_rhat(s: np.ndarray) -> float:
    n = s.shape[1]
    within, between = s.var(axis=1, ddof=1).mean(), n * s.mean(axis=1).var(ddof=1)
    return float(np.sqrt(((n - 1) / n * within + between / n) / within)) if within > 0 else float("nan")


def rhat(x: np.ndarray) -> float:
    """Rank-normalised split R-hat of chains x draws: the larger of the plain and the folded one."""
    s = _split(x)
    return max(_plain_rhat(_rank_normal(s)), _plain_rhat(_rank_normal(np.abs(s - np.median(s)))))


def ess_bulk(x: np.ndarray) -> float:
    """Effective sample size of the rank-normalised split chains, by Geyer's initial monotone sequence."""
    s = _rank_normal(_split(x))
    m, n = s.shape
    c = s - s.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    acov = np.fft.irfft(np.abs(np.fft.rfft(c, size, axis=1)) ** 2, size, axis=1)[:, :n].mean(axis=0) / n
    within = acov[0] * n / (n - 1)
    var = within * (n - 1) / n + (s.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (within - acov * n / (n - 1)) / var
    rho[0] = 1
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = int(np.argmax(pairs < 0)) if (pairs < 0).any() else len(pairs)
    tau = -1 + 2 * np.minimum.accumulate(pairs[:stop]).sum() if stop else 1.0
    return float(s.size / max(tau, 1 / math.log10(max(s.size, 10))))


def summary_table(draws: DataFrame, keys: list[str], depth: int = 8) -> DataFrame:
    """For each group of keys: draws, divergences, hits of the tree's depth, median step size, largest R-hat, least bulk ESS."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        x = p.pivot(index="draw", columns="chain", values="w").sort_index().to_numpy().T
        return pd.DataFrame({k: [p[k].iloc[0]] for k in [*keys, "block", "b"]} | {"rhat": [rhat(x)], "ess": [ess_bulk(x)]})

    kinds = dict(draws.dtypes)
    per = draws.groupBy(*keys, "block", "b").applyInPandas(each, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "block", "b"]) + ", rhat double, ess double")
    per = per.groupBy(*keys).agg(F.max("rhat").alias("max_rhat"), F.min("ess").alias("min_ess"))
    steps = draws.select(*keys, "chain", "draw", "steps", "diverging", "step_size").distinct().groupBy(*keys).agg(
        F.count("*").alias("draws"), F.sum("diverging").alias("divergences"), F.sum((F.col("steps") >= (1 << depth) - 1).cast("long")).alias("depth_hits"), F.percentile("step_size", F.lit(0.5)).alias("step_size")
    )
    return steps.join(per, keys)
