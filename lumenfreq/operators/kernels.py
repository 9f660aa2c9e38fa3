"""What SQL can't say well: long transforms, simulated series and splines' penalties, as Arrow tasks.

A task handles one series at least; a series is never split over tasks, so it must fit into one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.series import hourly_events
from .spectral import standardise, total

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def fft_periodogram(series: DataFrame, key: str = "series_id", fs: float = 1.0) -> DataFrame:
    """(key, k, freq, power) of whole series by fast Fourier transform, one task a series: n log n where the join takes n^2."""
    kind = dict(series.dtypes)[key]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y = p.sort_values("t_idx")["y"].to_numpy()
        n = len(y)
        power = 2 * np.abs(np.fft.rfft(y)[1:]) ** 2 / n / fs
        return pd.DataFrame({key: p[key].iloc[0], "k": np.arange(1, len(power) + 1), "freq": np.arange(1, len(power) + 1) * fs / n, "power": power})

    return series.groupBy(key).applyInPandas(run, f"{key} {kind}, k long, freq double, power double")


def ar_series(runs: DataFrame, coefs: list[float], n: int, burn_in: int = 200) -> DataFrame:
    """(run, t_idx, y): autoregressive series, seeded by run, the burn-in thrown away."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r = int(p["run"].iloc[0])
        e = np.random.default_rng(r).standard_normal(n + burn_in)
        y = np.zeros(n + burn_in)
        for t in range(n + burn_in):
            y[t] = e[t] + sum(a * y[t - k - 1] for k, a in enumerate(coefs) if t > k)
        return pd.DataFrame({"run": r, "t_idx": np.arange(n), "y": y[burn_in:]})

    return runs.groupBy("run").applyInPandas(run, "run long, t_idx long, y double")


def bspline(u: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Clamped B-splines at u by the Cox-de Boor recursion: points x functions."""
    t = np.concatenate([np.repeat(knots[0], degree), knots, np.repeat(knots[-1], degree)])
    last = len(t) - degree - 2
    b = ((u[:, None] >= t[:-1]) & (u[:, None] < t[1:])).astype(float)
    b[u >= knots[-1], :] = 0
    b[u >= knots[-1], last] = 1
    for d in range(1, degree + 1):
        left, right = t[d:-1] - t[: -d - 1], t[d + 1 :] - t[1:-d]
        up = np.divide(u[:, None] - t[: -d - 1], left, out=np.zeros((len(u), len(left))), where=left > 0)
        down = np.divide(t[d + 1 :] - u[:, None], right, out=np.zeros((len(u), len(right))), where=right > 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def penalty(knots: np.ndarray, degree: int = 3, order: int = 2, eps: float = 1e-6) -> np.ndarray:
    """Integrals of products of derivatives, exact by Gauss-Legendre within knot spans; scaled to a largest entry of 1, plus eps I."""
    t = np.concatenate([np.repeat(knots[0], degree), knots, np.repeat(knots[-1], degree)])
    x, w = np.polynomial.legendre.leggauss(degree + 1)
    total_ = 0.0
    for a, b in zip(knots, knots[1:], strict=False):
        u = (b - a) / 2 * x + (a + b) / 2
        m = np.eye(len(t) - degree - 1)
        for d in range(order):  # control points of the derivative
            gap = t[degree + 1 : -1 - d] - t[1 + d : len(t) - degree - 1] if d else t[degree + 1 : -1] - t[1 : len(t) - degree - 1]
            m = (degree - d) * np.diff(m, axis=0) / np.where(gap > 0, gap, np.inf)[: len(m) - 1, None]
        v = bspline(u, knots, degree - order) @ m
        total_ = total_ + v.T @ (v * (w * (b - a) / 2)[:, None])
    return total_ / total_.max() + eps * np.eye(len(total_))


def fit_log_spline(power: np.ndarray, basis: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    gram = basis.T @ basis
    return np.linalg.solve(gram + ridge * max(np.trace(gram) / len(gram), 1.0) * np.eye(len(gram)), basis.T @ np.log(np.maximum(power, 1e-300)))


def array_periodograms(rows: DataFrame, key: str, values: str, fs: float = 1.0) -> DataFrame:
    """(key, k, freq, power) of a column of arrays, one series each: transformed a batch at a time where the rows are, without a shuffle.

    Arrays of one length are one transform; null arrays, and those of fewer than two samples, give no rows.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            size = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()])
            for n in np.unique(size[size > 1]):
                at = pa.array(np.flatnonzero(size == n))
                y = column.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                power = 2 * np.abs(np.fft.rfft(y, axis=1)[:, 1:]) ** 2 / n / fs
                k = np.arange(1, power.shape[1] + 1)
                ids = b.column(0).take(pa.array(np.repeat(at.to_numpy(), len(k))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(k, len(at))), pa.array(np.tile(k * fs / n, len(at))), pa.array(power.ravel())], names=[key, "k", "freq", "power"])

    return rows.select(key, F.col(values).cast("array<double>")).mapInArrow(run, f"{key} {kind}, k long, freq double, power double")


def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = standardise(total(hourly_events())).frame(spark, sf_dir).withColumn("series_id", F.lit("events"))
    return fft_periodogram(s.select("series_id", "t_idx", "y"))


def _fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_power(spark, sf_dir).select("k", "freq", "power"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(array_periodograms(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))


def _ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ar_series(spark.range(4).withColumnRenamed("id", "run"), [0.9, -0.4], 256))


def _penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = penalty(np.linspace(0, 1, 10))
    i, j = np.indices(p.shape)
    return rounded(spark.createDataFrame(pd.DataFrame({"b": i.ravel(), "b2": j.ravel(), "v": p.ravel()})))


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        w = fit_log_spline(p["power"].to_numpy(), bspline(np.linspace(0, 1, len(p)), np.linspace(0, 1, 10), 3))
        return pd.DataFrame({"b": np.arange(len(w)), "w": w})

    return rounded(_power(spark, sf_dir).groupBy("series_id").applyInPandas(run, "b long, w double"))


QUERIES: dict[str, Query] = {"fft_periodogram": _fft, "embedding_periodograms": _embeddings, "ar_series": _ar, "bspline_penalty": _penalty, "spline_fit_ls": _fit}
#: Queries whose rows must equal those of a plan.
SAME_AS = {"fft_periodogram": "periodogram"}
#: Transforms of the arrays by definition.
EMBEDDING_SQL = """
WITH e AS (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS t, len(embedding) AS n FROM embeddings),
k AS (SELECT unnest(generate_series(1, 32)) AS k),
d AS (SELECT vec_id, k, n, sum(CAST(y AS DOUBLE) * cos(2 * pi() * ((t * k) % n) / n)) AS re, sum(CAST(y AS DOUBLE) * sin(2 * pi() * ((t * k) % n) / n)) AS im FROM e JOIN k ON k <= n // 2 GROUP BY vec_id, k, n)
SELECT vec_id, CAST(k AS BIGINT) AS k, round(k / n, 6) AS freq, round(2 * (re * re + im * im) / n, 6) + CAST(0 AS DOUBLE) AS power FROM d"""
