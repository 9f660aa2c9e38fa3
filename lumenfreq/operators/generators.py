"""Analytic spectra of models and instruments, as SQL steps, and simulated series, as grouped Arrow tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..plans.steps import Step, step
from .spectral import TAU

#: Arm length (m), speed of light (m/s), laser frequency (Hz), noise levels and knees of the published instrument model.
ARM, LIGHT, LASER = 2.5e9, 299792458.0, 2.81e14


def validate(var: np.ndarray, vma: np.ndarray, sigma: np.ndarray) -> None:
    """Shapes, a symmetric positive definite covariance, and a companion matrix of spectral radius below one."""
    p = sigma.shape[0]
    if var.ndim != 3 or var.shape[1:] != (p, p) or vma.ndim != 3 or vma.shape[1:] != (p, p) or sigma.shape != (p, p):
        raise ValueError("coefficients are (lags, p, p), and the covariance is (p, p)")
    if not np.allclose(sigma, sigma.T) or np.linalg.eigvalsh(sigma).min() <= 0:
        raise ValueError("the covariance must be symmetric and positive definite")
    lags = len(var)
    companion = np.zeros((p * lags, p * lags))
    companion[:p] = np.concatenate(list(var), axis=1)
    companion[p:, :-p] = np.eye(p * (lags - 1))
    if (radius := np.abs(np.linalg.eigvals(companion)).max()) >= 1:
        raise ValueError(f"not stationary: the companion matrix has the spectral radius {radius:.4g}")


def varma_series(runs: DataFrame, var: np.ndarray, vma: np.ndarray, sigma: np.ndarray, n: int, burn_in: int = 101) -> DataFrame:
    """(run, channel, t_idx, y): vector autoregressive moving-average series seeded by run, one task a run."""
    validate(var, vma, sigma)
    root = np.linalg.cholesky(sigma)

    def simulate(p: pd.DataFrame) -> pd.DataFrame:
        run = int(p["run"].iloc[0])
        e = np.random.default_rng(run).standard_normal((n + burn_in, len(sigma))) @ root.T
        x = sum(np.pad(e, ((k, 0), (0, 0)))[: len(e)] @ m.T for k, m in enumerate(vma))
        for t in range(1, len(x)):
            for k, a in enumerate(var[:t], start=1):
                x[t] += a @ x[t - k]
        t, c = np.indices(x[burn_in:].shape)
        return pd.DataFrame({"run": run, "channel": c.ravel(), "t_idx": t.ravel(), "y": x[burn_in:].ravel()})

    return runs.groupBy("run").applyInPandas(simulate, "run long, channel long, t_idx long, y double")


def varma_matrix(freq: np.ndarray, var: np.ndarray, vma: np.ndarray, sigma: np.ndarray, fs: float = 1.0) -> np.ndarray:
    """One-sided spectral matrices at freq (Hz); the bin at half the sampling frequency counts half."""
    w = 2 * np.pi * np.asarray(freq) / fs
    a = np.eye(len(sigma)) - sum(c * np.exp(-1j * k * w)[:, None, None] for k, c in enumerate(var, start=1))
    b = sum(c * np.exp(-1j * k * w)[:, None, None] for k, c in enumerate(vma))
    h = np.linalg.solve(a, b)
    return h @ sigma @ h.conj().transpose(0, 2, 1) * (2 / fs * np.where(np.isclose(freq, fs / 2), 0.5, 1.0))[:, None, None]


def varma_psd2(grid: Step, a1: list[list[float]], a2: list[list[float]], sigma: list[list[float]]) -> Step:
    """(k, freq, i, j, re, im) of two channels with two autoregressive lags, in closed form; grid: (k, freq), in cycles a sample."""
    parts, n = [], {}
    for i in range(2):
        for j in range(2):
            c, s = (f"({a1[i][j]!r}e0 * {f}({TAU} * freq) + {a2[i][j]!r}e0 * {f}(2e0 * {TAU} * freq))" for f in ("cos", "sin"))
            parts += [f"{float(i == j)!r}e0 - {c} AS r{i}{j}", f"{s} AS m{i}{j}"]
    x = step("SELECT k, freq, " + ", ".join(parts) + " FROM {g}", g=grid)
    # The inverse of A: its adjugate over its determinant; the scale takes |det|^2 and leaves the adjugate's product.
    x = step("SELECT *, r00 * r11 - m00 * m11 - r01 * r10 + m01 * m10 AS dr, r00 * m11 + m00 * r11 - r01 * m10 - m01 * r10 AS dm FROM {x}", x=x)
    adj = {(0, 0): ("r11", "m11"), (0, 1): ("-r01", "-m01"), (1, 0): ("-r10", "-m10"), (1, 1): ("r00", "m00")}
    for i in range(2):
        for j in range(2):
            re = " + ".join(f"{sigma[u][v]!r}e0 * (({adj[i, u][0]}) * ({adj[j, v][0]}) + ({adj[i, u][1]}) * ({adj[j, v][1]}))" for u in range(2) for v in range(2))
            im = " + ".join(f"{sigma[u][v]!r}e0 * (({adj[i, u][1]}) * ({adj[j, v][0]}) - ({adj[i, u][0]}) * ({adj[j, v][1]}))" for u in range(2) for v in range(2))
            n[i, j] = (re, im)
    scale = "(CASE WHEN abs(freq - 5e-1) < 1e-9 THEN 1e0 ELSE 2e0 END / (dr * dr + dm * dm))"
    return step(" UNION ALL ".join(f"SELECT k, freq, {i} AS i, {j} AS j, {scale} * ({re}) AS re, {scale} * ({im}) AS im FROM {{x}}" for (i, j), (re, im) in n.items()), x=x)


def xyz_matrix(grid: Step) -> Step:
    """(k, freq, log_sxx, sxy_ratio) of the second-generation XYZ channels: log10 of the diagonal, and the cross term over it.

    All diagonal entries are alike, and so are all others, which are real.
    """
    tau = f"({TAU} * freq)"
    x = step(
        f"SELECT k, freq, {tau} * {ARM / LIGHT!r}e0 AS x, pow(1.5e-11, 2e0) * (1e0 + pow(2e-3 / freq, 4e0)) * pow({tau} * {LASER!r} / {LIGHT!r}e0, 2e0) AS sop, "
        f"pow(3e-15, 2e0) * (1e0 + pow(4e-4 / freq, 2e0)) * (1e0 + pow(freq / 8e-3, 4e0)) / pow({tau}, 4e0) * pow({tau} * {LASER!r} / {LIGHT!r}e0, 2e0) AS spm FROM {{g}}",
        g=grid,
    )
    y = step("SELECT k, freq, 16e0 * pow(sin(x), 2e0) * pow(sin(2e0 * x), 2e0) * 4e0 * (sop + (3e0 + cos(2e0 * x)) * spm) AS sxx, -16e0 * sin(x) * pow(sin(2e0 * x), 3e0) * (sop + 4e0 * spm) AS sxy FROM {x}", x=x)
    return step("SELECT k, freq, log10(sxx) AS log_sxx, sxy / sxx AS sxy_ratio FROM {y}", y=y)
