"""From series to posterior spectra in one call, and runs saved as Parquet.

    result = run_univariate(series, RunConfig(n_knots=20))     # series_id, t_idx, y: any number of series
    result = run_multivariate(series, RunConfig(blocks=4))     # channel, t_idx, y: one series of several channels
    save_run(result, path); load_run(spark, path)
"""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import apply, given
from .operators import bands as B
from .operators import spectral as S
from .operators.kernels import bspline, fft_periodogram
from .operators.sampler import Prior, fit_rows, fit_univariate, spline_grid, summary_table


@dataclass(frozen=True)
class RunConfig:
    """What a run needs; checked when it is made."""

    n_knots: int = 10
    method: str = "density"
    chains: int = 2
    draws: int = 200
    warm: int = 200
    fs: float = 1.0
    fmin: float | None = None
    fmax: float | None = None
    #: Bands (lo, hi) whose bins are left out, borders included.
    exclude: tuple[tuple[float, float], ...] = ()
    #: Bins summed into one; it must divide the bins that are kept.
    coarse: int = 1
    #: Blocks of a multivariate run; they must divide the series.
    blocks: int = 1
    window: str = "hann"
    #: The likelihood's exponent.
    eta: float = 1.0
    prior: Prior = field(default_factory=Prior)

    def __post_init__(self) -> None:
        for name in ("n_knots", "chains", "draws", "warm", "coarse", "blocks"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < (2 if name == "n_knots" else 1):
                raise ValueError(f"{name} must be a whole number, and large enough")
        if self.method not in ("density", "uniform") or self.window not in ("hann", "tukey", "rect"):
            raise ValueError("unknown method or window")
        if self.fs <= 0 or not 0 < self.eta <= 1:
            raise ValueError("fs must be positive, and eta in (0, 1]")
        if self.fmin is not None and self.fmax is not None and self.fmax < self.fmin:
            raise ValueError("fmin must not exceed fmax")


@dataclass
class Result:
    """Lazy frames: the data that the likelihood saw, the draws, spectra as quantiles over draws, and the sampler's table."""

    config: RunConfig
    data: DataFrame
    draws: DataFrame
    psd: DataFrame
    summary: DataFrame


def kept_bins(x: DataFrame, config: RunConfig) -> DataFrame:
    """Rows of (k, freq, ...) within the bounds and outside the excluded bands."""
    if config.fmin is not None:
        x = x.filter(F.col("freq") >= config.fmin)
    if config.fmax is not None:
        x = x.filter(F.col("freq") <= config.fmax)
    for lo, hi in config.exclude:
        x = x.filter((F.col("freq") < min(lo, hi)) | (F.col("freq") > max(lo, hi)))
    return x


def _coarse(p: pd.DataFrame, nh: int) -> pd.DataFrame:
    """Powers of nh neighbours summed; the bin in the middle (the earlier one of two) gives place and frequency."""
    p = p.sort_values("k")
    if len(p) % nh:
        raise ValueError(f"{nh} does not divide the {len(p)} bins that are kept")
    mid = p.iloc[(nh - 1) // 2 :: nh].copy()
    mid["power"] = p["power"].to_numpy().reshape(-1, nh).sum(axis=1)
    return mid


def run_univariate(series: DataFrame, config: RunConfig = RunConfig()) -> Result:
    """series (series_id, t_idx, y): each is standardised, transformed, sampled and summed up by itself, in tasks of its own."""
    moments = series.groupBy("series_id").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    std = series.join(moments, "series_id").select("series_id", "t_idx", ((F.col("y") - F.col("m")) / F.col("sd")).alias("y"))
    data = kept_bins(fft_periodogram(std, fs=config.fs), config)
    if config.coarse > 1:
        nh, kind = config.coarse, data.schema
        data = data.groupBy("series_id").applyInPandas(lambda p: _coarse(p, nh), kind)
    draws = fit_univariate(data, config.chains, config.draws, config.warm, config.n_knots, config.prior, config.coarse, "series_id", config.method)
    kind = dict(series.dtypes)["series_id"]

    def spectra(d: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        basis, _ = spline_grid(p["power"].to_numpy(), config.n_knots, config.method)
        w = d[d["b"] >= 0].pivot(index=["chain", "draw"], columns="b", values="w").to_numpy()
        q = np.quantile(np.exp(w @ basis.T), [0.05, 0.5, 0.95], axis=0)
        return pd.DataFrame({"series_id": p["series_id"].to_numpy(), "k": p["k"].to_numpy(), "freq": p["freq"].to_numpy(), "q05": q[0], "q50": q[1], "q95": q[2]})

    psd = draws.groupBy("series_id").cogroup(data.groupBy("series_id")).applyInPandas(spectra, f"series_id {kind}, k long, freq double, q05 double, q50 double, q95 double")
    scale = moments.select("series_id", (F.col("sd") * F.col("sd")).alias("scale"))  # back in the units of the series
    psd = psd.join(scale, "series_id").select("series_id", "k", "freq", *((F.col(c) * F.col("scale")).alias(c) for c in ("q05", "q50", "q95")))
    return Result(config, data, draws, psd, summary_table(draws.filter("b >= 0"), ["series_id"]))


def spectra_of_rows(draws: DataFrame, freq: list[float], nh: int, duration: float) -> DataFrame:
    """(chain, draw, k, freq, i, j, re, im): spectral matrices of draws of all rows, T^-1 D T^-H.  freq: the bins' frequencies."""

    def build(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["b"] >= 0]
        rows = int(p["row"].max()) + 1
        basis = bspline(np.linspace(0, 1, len(freq)), np.linspace(0, 1, int(p["b"].max()) - 1), 3)
        curve = {key: basis @ g.sort_values("b")["w"].to_numpy() for key, g in p.groupby(["row", "block"])}
        t = np.tile(np.eye(rows, dtype=complex), (len(freq), 1, 1))
        d = np.stack([np.exp(curve[r, "log_delta2"]) for r in range(rows)], axis=1)
        for r in range(rows):
            for c in range(r):
                t[:, r, c] = -(curve[r, f"theta_re_{c}"] + 1j * curve[r, f"theta_im_{c}"])
        inv = np.linalg.inv(t)
        s = (inv * d[:, None, :]) @ inv.conj().transpose(0, 2, 1)
        k, i, j = (x.ravel() for x in np.indices(s.shape))
        return pd.DataFrame({"chain": p["chain"].iloc[0], "draw": p["draw"].iloc[0], "k": k + 1, "freq": np.array(freq)[k], "i": i, "j": j, "re": s.real.ravel(), "im": s.imag.ravel()})

    return draws.groupBy("chain", "draw").applyInPandas(build, "chain long, draw long, k long, freq double, i long, j long, re double, im double")


def run_multivariate(series: DataFrame, config: RunConfig = RunConfig(blocks=4)) -> Result:
    """series (channel, t_idx, y): standardised by channel, cut into blocks, summed to matrices Y, and sampled row by row."""
    n = series.agg(F.max("t_idx")).first()[0] + 1
    if n % config.blocks:
        raise ValueError(f"{config.blocks} blocks do not divide {n} samples")
    length = n // config.blocks
    duration = length / config.fs
    std = S.standardise_channels(given(series))
    y = kept_bins(S.wishart(S.detrend(S.blocks(std, length)), length, config.window, config.fs).frame(series.sparkSession, ""), config)
    if config.coarse > 1:
        bins = y.select("k").distinct().count()
        B.resolve_bins(bins, nh=config.coarse)  # or an error
        if config.exclude:
            raise ValueError("coarse bins need neighbouring bins: leave bands out or sum bins, not both")
        y = apply(B.coarse_wishart, y, config.coarse)
    freq = [r["freq"] for r in y.select("k", "freq").distinct().orderBy("k").collect()]  # one number a bin
    w = {"hann": 1.5, "rect": 1.0}.get(config.window) or float(S.nenbw(S.window("tukey", length), length).frame(series.sparkSession, "").first()[0])
    draws = fit_rows(y, config.blocks, duration, config.chains, config.draws, config.warm, config.n_knots, config.prior, config.coarse, w, config.eta)
    own = spectra_of_rows(draws, freq, config.coarse, duration)
    std_of = series.groupBy("channel").agg(F.stddev_pop("y").alias("sd"))
    q = own.groupBy("k", "freq", "i", "j").agg(*(F.percentile(c, F.lit(p)).alias(f"{c}{n}") for c in ("re", "im") for p, n in ((0.05, "05"), (0.5, "50"), (0.95, "95"))))
    a, b = std_of.select(F.col("channel").alias("i"), F.col("sd").alias("si")), std_of.select(F.col("channel").alias("j"), F.col("sd").alias("sj"))
    names = [c for c in q.columns if c[:2] in ("re", "im")]
    psd = q.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("k", "freq", "i", "j", *((F.col(c) * F.col("si") * F.col("sj")).alias(c) for c in names))  # a row for each channel
    return Result(config, y, draws, psd, summary_table(draws.filter("b >= 0"), ["row"]))


def plain(value: Any) -> Any:
    """Anything as JSON can say it: arrays as lists, numpy scalars as numbers, what isn't finite as null, the rest as text."""
    if dataclasses.is_dataclass(value):
        value = dataclasses.asdict(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


_FRAMES = ("data", "draws", "psd", "summary")


def save_run(result: Result, path: str, **attrs: Any) -> None:
    """The frames as Parquet and the configuration as one JSON row, under a path that Spark can write."""
    for name in _FRAMES:
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = result.data.sparkSession
    spark.createDataFrame([(json.dumps(plain(result.config)), json.dumps(plain(attrs)))], "config string, attrs string").coalesce(1).write.mode("overwrite").json(f"{path}/run")


def load_run(spark: SparkSession, path: str) -> tuple[Result, dict[str, Any]]:
    row = spark.read.schema("config string, attrs string").json(f"{path}/run").first()
    config = json.loads(row["config"])
    config |= {"prior": Prior(**config["prior"]), "exclude": tuple(map(tuple, config["exclude"]))}
    return Result(RunConfig(**config), *(spark.read.parquet(f"{path}/{name}") for name in _FRAMES)), json.loads(row["attrs"])


def run_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """One row for each saved run whose folder matches the pattern: path, config and attrs as JSON."""
    x = spark.read.schema("config string, attrs string").json(f"{pattern}/run")
    return x.select(F.regexp_extract(F.input_file_name(), r"^(.*)/run/[^/]*$", 1).alias("path"), "config", "attrs")
