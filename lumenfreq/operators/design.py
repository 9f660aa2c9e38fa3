"""Weights before any data: fitted to a design spectrum, carried from a coarse grid to a fine one, and drawn from the prior."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import bspline, penalty
from .sampler import Prior


def least_squares(values: np.ndarray, basis: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    gram = basis.T @ basis
    return np.linalg.solve(gram + ridge * max(float(np.trace(gram)) / len(gram), 1.0) * np.eye(len(gram)), basis.T @ values)


def unit(freq: np.ndarray) -> np.ndarray:
    """A frequency grid on [0, 1]."""
    span = freq[-1] - freq[0]
    return (freq - freq[0]) / span if span > 0 else np.zeros(len(freq))


def design_weights(components: DataFrame, knots: np.ndarray, degree: int = 3) -> DataFrame:
    """(component, b, w) for the components (k, freq, i, j, re, im) of a design: splines of delta_i, theta_re_i_j and theta_im_i_j.

    One task a component; where the design has a null or non-finite value, its neighbours on a straight line stand in.
    """
    x = components.filter("j <= i").select(
        "k", "freq", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.format_string("delta_%d", "i").alias("component"), F.col("re").alias("v")))).otherwise(
            F.array(*(F.struct(F.format_string(f"theta_{p}_%d_%d", "i", "j").alias("component"), F.col(p).alias("v")) for p in ("re", "im")))
        )).alias("e")
    ).select("k", "freq", "e.component", "e.v")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        f, v = p["freq"].to_numpy(), p["v"].to_numpy(dtype=float)
        fine = np.isfinite(v)
        v = np.interp(f, f[fine], v[fine]) if fine.any() else np.zeros(len(v))
        w = least_squares(v, bspline(unit(f), knots, degree))
        return pd.DataFrame({"component": p["component"].iloc[0], "b": np.arange(len(w)), "w": w})

    return x.groupBy("component").applyInPandas(fit, "component string, b long, w double")


def transfer_weights(w: np.ndarray, coarse: tuple[np.ndarray, np.ndarray], fine: tuple[np.ndarray, np.ndarray], log_ratio: float = 0.0, degree: int = 3) -> np.ndarray:
    """Weights on the knots of the fine grid whose spline follows the coarse one: evaluated, carried over on straight lines, and fitted.

    coarse, fine: (frequencies, knots).  log_ratio: the log of the coarse data's scale over the fine data's.
    """
    value = bspline(unit(coarse[0]), coarse[1], degree) @ w
    return least_squares(np.interp(fine[0], coarse[0], value) + log_ratio, bspline(unit(fine[0]), fine[1], degree))


def prior_predictive(spark: SparkSession, components: list[str], n_freq: int, knots: np.ndarray, prior: Prior = Prior(), draws: int = 500, seed: int = 42, clip: float = 20.0, centre: dict[str, np.ndarray] | None = None, tau: float | None = None) -> DataFrame:
    """(component, k, q05, q50, q95) of splines drawn from the prior, a task each component: scales from their Gamma densities, weights
    around `centre` with precision phi P + 1e-6 I, and 1 / tau^2 more if tau is given."""
    basis, pen = bspline(np.linspace(0, 1, n_freq), knots, 3), penalty(knots)

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        name = p["component"].iloc[0]
        rng = np.random.default_rng([seed, *name.encode()])
        mean = (centre or {}).get(name, np.zeros(len(pen)))
        curves = []
        for _ in range(draws):
            delta = max(rng.gamma(prior.alpha_delta, 1 / prior.beta_delta), 1e-12)
            phi = max(rng.gamma(prior.alpha_phi, 1 / (prior.beta_phi * delta)), 1e-12)
            precision = phi * pen + (1e-6 + (1 / tau**2 if tau else 0.0)) * np.eye(len(pen))
            root = np.linalg.cholesky(precision)
            curves.append(np.clip(basis @ (mean + np.linalg.solve(root.T, rng.standard_normal(len(pen)))), -clip, clip))
        q = np.quantile(np.array(curves), [0.05, 0.5, 0.95], axis=0)
        return pd.DataFrame({"component": name, "k": np.arange(1, n_freq + 1), "q05": q[0], "q50": q[1], "q95": q[2]})

    names = spark.createDataFrame([(c,) for c in components], "component string")
    return names.groupBy("component").applyInPandas(draw, "component string, k long, q05 double, q50 double, q95 double")
