"""Knots where a spectrum changes: denoising, gradient, equal steps of its running sum, and exact counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..plans.steps import Step, step

TOLERANCE = 1e-12


def _odd(n: int) -> int:
    return n if n % 2 else n + 1


def window_widths(n: int) -> tuple[int, int]:
    """Of the median (a twentieth) and of the polynomial (a fiftieth), odd and at least 5."""
    return _odd(max(5, n // 20)), _odd(max(5, n // 50))


def polynomial_rows(width: int, degree: int = 3) -> np.ndarray:
    """Row r gives the least-squares polynomial of a window at its r-th place, as weights of the window's values."""
    a = np.vander(np.arange(width) - width // 2, min(degree, width - 1) + 1).astype(float)
    return a @ np.linalg.pinv(a)


def denoise(x: np.ndarray) -> np.ndarray:
    """A running median (zeros beyond the ends), then a running cubic; the ends take the polynomial of the outermost window."""
    n = len(x)
    if n < 5:
        return x.copy()
    wide, narrow = window_widths(n)
    med = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, wide // 2), wide), axis=1)
    start = np.clip(np.arange(n) - narrow // 2, 0, n - narrow)
    rows = polynomial_rows(narrow)[np.arange(n) - start]
    return (rows * med[start[:, None] + np.arange(narrow)]).sum(axis=1)


def dedup(knots: np.ndarray) -> np.ndarray:
    """Sorted knots without those that follow the last one kept within the tolerance; the borders 0 and 1 win."""
    out: list[float] = []
    for x in map(float, knots):
        if not out or x - out[-1] > TOLERANCE:
            out.append(x)
        else:
            out[-1] = next((b for b in (0.0, 1.0) if abs(x - b) <= TOLERANCE), out[-1])
    return np.array(out)


def exact_count(knots: np.ndarray, n: int) -> np.ndarray:
    """Interior knots in the tightest place go, and midpoints of the widest gap come, until there are n; the first of equals."""
    if n < 2:
        raise ValueError("two knots at least")
    if not len(knots):
        return np.linspace(0, 1, n)
    if knots[0] != 0 or knots[-1] != 1:
        raise ValueError("knots begin with 0 and end with 1")
    while len(knots) > n:
        gap = np.diff(knots)
        knots = np.delete(knots, 1 + np.argmin(np.minimum(gap[:-1], gap[1:])))
    while len(knots) < n:
        k = int(np.argmax(np.diff(knots)))
        knots = np.insert(knots, k + 1, (knots[k] + knots[k + 1]) / 2)
    return knots


def slopes(x: np.ndarray, freq: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.abs(np.gradient(denoise(x), freq)), nan=0.0, posinf=0.0, neginf=0.0)


def density_knots(power: np.ndarray, freq: np.ndarray, n: int, guide: np.ndarray | None = None, strength: float = 1.0) -> np.ndarray:
    """n knots on [0, 1] at equal steps of the running sum of the denoised power's slope and a floor of a hundredth of its mean.
    A guide spectrum adds its own slope, scaled to the mean of the other."""
    if n == 2 or len(power) < 3:
        return np.linspace(0, 1, n)
    z = slopes(power, freq)
    if guide is not None and (own := slopes(guide, freq)).mean() > 0:
        z = z + strength * own * (z.mean() / own.mean() if z.mean() > 0 else 1.0)
    level = np.abs(denoise(power)).mean()
    z = z + (0.01 * level if level > 0 else 1.0)
    at = np.interp(np.linspace(0, 1, n), np.concatenate([[0], np.cumsum(z / z.sum())]), np.concatenate([freq[:1], freq]))
    u = np.clip((at - freq[0]) / (freq[-1] - freq[0]), 0, 1)
    return exact_count(dedup(np.concatenate([[0.0], np.sort(u), [1.0]])), n)


def knots_density(power: Step, n: int, bins: int) -> Step:
    """(idx, u).  On Spark any number of bins, one task a series; as SQL for the given number, which sets the windows."""
    wide, narrow = window_widths(bins)
    rows = polynomial_rows(narrow)
    weights = " UNION ALL ".join(f"SELECT {r} AS r, {c} AS c, CAST({float(rows[r, c])!r} AS DOUBLE) AS w" for r in range(narrow) for c in range(narrow))
    med = step(f"SELECT p.k, p.freq, $pct(coalesce(q.power, 0e0), 0.5) AS v FROM {{p}} p CROSS JOIN $seq({-(wide // 2)}, {wide // 2}) o LEFT JOIN {{p}} q ON q.k = p.k + o.v GROUP BY p.k, p.freq", p=power)
    start = step(f"SELECT k, freq, least(greatest(k - {narrow // 2}, 1), {bins - narrow + 1}) AS s FROM {{m}}", m=med)
    smooth = step(f"SELECT a.k, a.freq, sum(w.w * m.v) AS v FROM {{a}} a JOIN ({weights}) w ON w.r = a.k - a.s JOIN {{m}} m ON m.k = a.s + w.c GROUP BY a.k, a.freq", a=start, m=med)
    near = "coalesce({f}({c}) OVER (ORDER BY k), {c})"
    slope = f"abs(({near.format(f='lead', c='v')} - {near.format(f='lag', c='v')}) / ({near.format(f='lead', c='freq')} - {near.format(f='lag', c='freq')}))"
    z = step(f"SELECT k, freq, {slope} + 1e-2 * avg(abs(v)) OVER () AS z FROM {{s}}", s=smooth)
    cdf = step("SELECT k, freq, sum(z) OVER (ORDER BY k) / sum(z) OVER () AS c1, (sum(z) OVER (ORDER BY k) - z) / sum(z) OVER () AS c0, coalesce(lag(freq) OVER (ORDER BY k), freq) AS f0 FROM {z}", z=z)
    edge = step("SELECT min(freq) AS lo, max(freq) AS hi FROM {z}", z=z)
    found = step(
        f"SELECT g.v AS idx, CASE WHEN g.v = 0 THEN 0e0 WHEN g.v = {n - 1} THEN 1e0 ELSE (f0 + (freq - f0) * (g.v / {n - 1}e0 - c0) / (c1 - c0) - lo) / (hi - lo) END AS u "
        f"FROM $seq(0, {n - 1}) g CROSS JOIN {{e}} JOIN {{c}} c ON (g.v / {n - 1}e0 >= c0 AND g.v / {n - 1}e0 < c1 AND g.v < {n - 1}) OR (g.v = {n - 1} AND c.k = {bins})",
        c=cdf, e=edge,
    )

    def kernel(frame: DataFrame) -> DataFrame:
        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("k")
            u = density_knots(p["power"].to_numpy(), p["freq"].to_numpy(), n)
            return pd.DataFrame({"idx": np.arange(len(u)), "u": u})

        return frame.groupBy().applyInPandas(run, "idx long, u double")

    return Step("SELECT idx, u FROM {f}", {"p": power, "f": found}, kernel)
