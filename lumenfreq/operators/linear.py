"""Spectral matrices of any number of channels, a batch of frequencies at a time: eigenvalues, square roots, Cholesky components,
repairs; and series from spectra.  Frames are long: (k, freq, i, j, re, im)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 256
_MATRIX = "k long, freq double, i long, j long, re double, im double"


def batched(psd: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """run(k, freq, matrices) on the complex matrices of about BATCH neighbouring frequencies; they must be whole."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["k", "i", "j"])
        size = math.isqrt(int((p["k"] == p["k"].iloc[0]).sum()))
        if len(p) % (size * size) or p["i"].max() != size - 1:
            raise ValueError("each frequency needs all entries of its matrix")
        m = (p["re"].to_numpy() + 1j * p["im"].to_numpy()).reshape(-1, size, size)
        return run(p["k"].to_numpy()[:: size * size], p["freq"].to_numpy()[:: size * size], m)

    return psd.select("k", "freq", "i", "j", "re", "im").groupBy(F.floor(F.col("k") / BATCH).alias("batch")).applyInPandas(each, schema)


def _long(k: np.ndarray, freq: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    at, i, j = (x.ravel() for x in np.indices(m.shape))
    return pd.DataFrame({"k": k[at], "freq": freq[at], "i": i, "j": j, "re": m.real.ravel(), "im": m.imag.ravel()})


def eigenvalues(psd: DataFrame) -> DataFrame:
    """(k, freq, rank, value): eigenvalues from the largest (rank 0) down; negative ones count as zero."""

    def run(k, freq, m):
        value = np.maximum(np.linalg.eigvalsh(m)[:, ::-1], 0)
        at, rank = (x.ravel() for x in np.indices(value.shape))
        return pd.DataFrame({"k": k[at], "freq": freq[at], "rank": rank, "value": value.ravel()})

    return batched(psd, run, "k long, freq double, rank long, value double")


def square_root(y: DataFrame) -> DataFrame:
    """U with U U^H = Y (columns by falling eigenvalue, unique up to a phase each); Y must be Hermitian."""

    def run(k, freq, m):
        if np.abs(m - m.conj().transpose(0, 2, 1)).max() > 1e-10 * max(1.0, np.abs(m).max()):
            raise ValueError("the matrices are not Hermitian")
        value, vector = np.linalg.eigh(m)
        return _long(k, freq, (vector * np.sqrt(np.maximum(value, 0))[:, None, :])[:, :, ::-1])

    return batched(y, run, _MATRIX)


def cholesky_components(psd: DataFrame) -> DataFrame:
    """(k, freq, i, j, re, im): on the diagonal the log variances of T S T^H, below it the factors theta (T has -theta there).

    A matrix that isn't positive definite gets a multiple of the identity, from 1e-12 of its mean diagonal up by tens.
    """

    def factor(m: np.ndarray) -> np.ndarray:
        level, lift = max(float(np.trace(m).real) / len(m), 1e-300), 0.0
        while True:
            try:
                return np.linalg.cholesky(m + lift * level * np.eye(len(m)))
            except np.linalg.LinAlgError:
                lift = lift * 10 or 1e-12

    def run(k, freq, m):
        low = np.stack([factor(x) for x in m])
        diag = np.diagonal(low, axis1=1, axis2=2).real
        t = np.linalg.inv(low / diag[:, None, :])
        out = -np.tril(t, -1)
        p = m.shape[1]
        out[:, np.arange(p), np.arange(p)] = 2 * np.log(diag)
        return _long(k, freq, out)

    return batched(psd, run, _MATRIX)


def from_components(components: DataFrame) -> DataFrame:
    """The matrices that cholesky_components took apart."""

    def run(k, freq, c):
        p = c.shape[1]
        inv = np.linalg.inv(np.eye(p) - np.tril(c, -1))
        return _long(k, freq, (inv * np.exp(np.diagonal(c, axis1=1, axis2=2).real)[:, None, :]) @ inv.conj().transpose(0, 2, 1))

    return batched(components, run, _MATRIX)


def floor_eigenvalues(psd: DataFrame, fraction: float) -> DataFrame:
    """Eigenvalues raised to at least `fraction` of the trace."""

    def run(k, freq, m):
        value, vector = np.linalg.eigh(m)
        value = np.maximum(value, fraction * np.trace(m, axis1=1, axis2=2).real[:, None])
        return _long(k, freq, (vector * value[:, None, :]) @ vector.conj().transpose(0, 2, 1))

    return batched(psd, run, _MATRIX)


def repair(psd: DataFrame, eps: float) -> DataFrame:
    """(2 eps - smallest eigenvalue) I added where the smallest eigenvalue is below eps."""

    def run(k, freq, m):
        low = np.linalg.eigvalsh(m)[:, 0]
        return _long(k, freq, m + np.where(low < eps, 2 * eps - low, 0.0)[:, None, None] * np.eye(m.shape[1]))

    return batched(psd, run, _MATRIX)


def coloured_noise(psd: DataFrame, n: int, fs: float = 1.0, seed: int = 0) -> DataFrame:
    """(series_id, t_idx, y): Gaussian series of n samples whose one-sided spectrum is psd (series_id, freq, power), straight lines
    between its frequencies, ends held; seeded by series.  One task a series."""
    kind = dict(psd.dtypes)["series_id"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("freq")
        name = p["series_id"].iloc[0]
        rng = np.random.default_rng([seed, *str(name).encode()])
        f = np.fft.rfftfreq(n, 1 / fs)
        s = np.interp(f, p["freq"], p["power"])
        d = np.sqrt(s * n * fs / 4) * (rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f)))
        d[0] = 0
        if n % 2 == 0:
            d[-1] = np.sqrt(s[-1] * n * fs / 2) * rng.standard_normal()
        return pd.DataFrame({"series_id": name, "t_idx": np.arange(n), "y": np.fft.irfft(d, n)})

    return psd.groupBy("series_id").applyInPandas(run, f"series_id {kind}, t_idx long, y double")


def normality(coefficients: DataFrame, psd: DataFrame) -> DataFrame:
    """(series_id, n, statistic, p_value): whether real and imaginary parts of coefficients (series_id, freq, re, im), over the root of
    half the psd (freq, power), are standard normal, by Kolmogorov and Smirnov's statistic; only frequencies that both have count."""
    joined = coefficients.join(psd.select("freq", "power"), "freq")
    kind = dict(coefficients.dtypes)["series_id"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.concatenate([p["re"], p["im"]]) / np.sqrt(np.tile(p["power"], 2) / 2))
        cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
        n = len(x)
        d = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
        z = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
        value = 2 * sum((-1) ** (m - 1) * math.exp(-2 * m * m * z * z) for m in range(1, 101)) if z > 0.2 else 1.0
        return pd.DataFrame({"series_id": [p["series_id"].iloc[0]], "n": [n], "statistic": [d], "p_value": [min(max(value, 0.0), 1.0)]})

    return joined.groupBy("series_id").applyInPandas(run, f"series_id {kind}, n long, statistic double, p_value double")
