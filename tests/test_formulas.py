"""Spectral operators and samplers against numpy written from the formulas, not from the plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfreq.functions import apply
from lumenfreq.operators import bands, generators, kernels, knots, sampler
from lumenfreq.operators import spectral as S
from lumenfreq.operators import wishart as W
from lumenfreq.plans.steps import step
from lumenfreq.sources import series as X
from lumenfreq.streaming import series as T

SF = "/root/testdata/sf0.01"


def frame(spark, plan):
    return plan.frame(spark, SF).toPandas()


def matrix(df, p):
    out = np.zeros((df["k"].max(), p, p), complex)
    out[df["k"] - 1, df["i"], df["j"]] = df["re"] + 1j * df["im"]
    return out


@pytest.fixture(scope="module")
def events(spark):
    df = frame(spark, X.hourly_events())
    return df.pivot(index="t_idx", columns="channel", values="y").sort_index().to_numpy()


def standardised(x):
    return (x - x.mean(axis=0)) / x.std(axis=0)


def test_grid_is_the_tables(events):
    assert events.shape == (720, 5) and np.isfinite(events).all()


def segments(x, length, hop):
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    parts = np.stack([x[a : a + length] for a in range(0, len(x) - length + 1, hop)])
    d = np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w[:, None], axis=1)[:, 1:]
    scale = np.full(d.shape[1], 2 / (w**2).sum())
    scale[-1] /= 2
    return d, scale


def test_wishart_matrices(spark, events):
    d, scale = segments(standardised(events), 180, 180)
    want = np.einsum("bki,bkj->kij", d, d.conj()) * (scale * 180)[:, None, None]
    std = S.standardise_channels(X.hourly_events())
    got = matrix(frame(spark, S.wishart(S.detrend(S.blocks(std, 180)), 180)), 5)
    assert np.allclose(got, want, atol=1e-6)


def test_welch_matrices_have_the_usual_sign(spark, events):
    d, scale = segments(standardised(events), 360, 180)
    want = np.einsum("bki,bkj->kij", d.conj(), d) / len(d) * scale[:, None, None]  # conj(x) y
    got = matrix(frame(spark, S.welch(S.standardise_channels(X.hourly_events()), 360, 180)), 5)
    assert np.allclose(got, want, atol=1e-6) and np.abs(want.imag).max() > 0.1


def test_smoothing_repeats_the_ends(spark):
    psd = step("SELECT g.v AS k, g.v / 1e1 AS freq, i.v AS i, j.v AS j, exp(sin(g.v * 1e0)) + i.v AS re, CASE WHEN i.v = j.v THEN 0e0 ELSE cos(g.v * 1e0) END AS im FROM $seq(1, 9) g CROSS JOIN $seq(0, 1) i CROSS JOIN $seq(0, 1) j")
    got = matrix(frame(spark, S.smooth(psd, 5)), 2)
    k = np.arange(1, 10)
    average = lambda x: np.convolve(np.pad(x, 2, mode="edge"), np.ones(5) / 5, mode="valid")
    assert np.allclose(got[:, 0, 0], np.exp(average(np.sin(k))))
    assert np.allclose(got[:, 1, 0], average(np.exp(np.sin(k)) + 1) + 1j * average(np.cos(k)))


def test_amplitude_range_has_three_digits(spark):
    r = S.amplitude_range(step("SELECT 131.678e0 AS y UNION ALL SELECT -0.0123456e0 AS y UNION ALL SELECT 1617.94e0 AS y")).frame(spark, SF).first()
    assert np.allclose([r.lo, r.hi], [-0.0123, 1620.0])


def test_stationarity(spark):
    rng = np.random.default_rng(0)
    for unit in (0.3, 1.0):
        x = np.zeros((129, 2))
        for t in range(1, 129):
            x[t] = unit * x[t - 1] + rng.standard_normal(2)
        rows = [(c, t, float(x[t, c])) for t in range(129) for c in range(2)]
        spark.createDataFrame(rows, "channel long, t_idx long, y double").createOrReplaceTempView("two_channels")
        r = S.stationarity(step("SELECT * FROM two_channels")).frame(spark, SF).first()
        a, b = x[:64], x[-64:]
        z = np.max(np.abs(b.mean(0) - a.mean(0)) / x.std(0))
        ratio = np.max(np.maximum(a.var(0), b.var(0)) / np.minimum(a.var(0), b.var(0)))
        ca, cb = np.cov(a.T), np.cov(b.T)
        drift = np.linalg.norm(ca - cb) / np.linalg.norm((ca + cb) / 2)
        assert np.allclose([r.max_mean_shift_z, r.max_var_ratio, r.covariance_rel_drift], [z, ratio, drift])
        assert r.passes == (z < 0.75 and ratio < 2 and drift < 0.5) and r.n_samples_used == 128


def test_inverse_transform(spark):
    p = np.abs(np.sin(np.arange(1, 20))) + 1
    values = " UNION ALL ".join(f"SELECT {k} AS k, {k} / 4e1 AS freq, {float(x)!r}D AS power" for k, x in enumerate(p, 1))
    got = S.inverse(step(values)).frame(spark, SF).orderBy("t").toPandas()["y"]
    assert np.allclose(got, np.fft.irfft(p))


def test_coherence(spark, events):
    d, scale = segments(standardised(events), 180, 180)
    y = np.einsum("bki,bkj->kij", d, d.conj())
    want = np.abs(y) ** 2 / np.einsum("kii,kjj->kij", y, y).real
    std = S.standardise_channels(X.hourly_events())
    blocked = S.detrend(S.blocks(std, 180))
    df = frame(spark, S.coherence(S.to_psd(S.wishart(blocked, 180), blocked, 1, 180)))
    got = np.zeros_like(want)
    got[df["k"] - 1, df["i"], df["j"]] = df["coh"]
    assert np.allclose(got, want, atol=1e-6)


def _wishart(n=40, reps=6, p=3):
    rng = np.random.default_rng(3)
    u = rng.standard_normal((n, reps, p)) + 1j * rng.standard_normal((n, reps, p))
    u[:, :, 1] += (0.5 + 0.2j) * u[:, :, 0]
    return u, np.einsum("fri,frj->fij", u, u.conj())


def test_row_likelihood_from_matrices_alone(spark):
    u, y = _wishart()
    k = np.arange(1, 41)
    rows = [(int(f + 1), (f + 1) / 80, i, j, float(y[f, i, j].real), float(y[f, i, j].imag)) for f in range(40) for i in range(3) for j in range(3)]
    spark.createDataFrame(rows, "k long, freq double, i long, j long, re double, im double").createOrReplaceTempView("y_rows")
    params = step("SELECT k, sin(k / 9e0) AS log_d, 3e-1 * cos(k / 7e0) AS t, 1e-1 * sin(k / 5e0) AS ti FROM (SELECT DISTINCT k FROM y_rows)")
    blocked = step("SELECT 5 AS block")
    log_d, theta = np.sin(k / 9), 0.3 * np.cos(k / 7) + 0.1j * np.sin(k / 5)
    for row, rest in ((0, u[:, :, 0]), (1, u[:, :, 1] - theta[:, None] * u[:, :, 0])):
        want = -6 * log_d.sum() - ((np.abs(rest) ** 2).sum(axis=1) / (2.0 * np.exp(log_d))).sum()
        got = W.row_loglik(step("SELECT * FROM y_rows"), params, row, blocked, 2.0).frame(spark, SF).first().loglik
        assert abs(got - want) < 1e-6


@pytest.mark.parametrize("row", [0, 1, 2])
def test_sampler_likelihood_and_gradient(row):
    u, y = _wishart()
    basis, pen = kernels.bspline(np.linspace(0, 1, 40), np.linspace(0, 1, 6), 3), kernels.penalty(np.linspace(0, 1, 6))
    likelihood = sampler.wishart_likelihood(y, row, basis, 6, 2.0, eta=0.7, enbw=1.5)
    n = 1 + 2 * row
    z = 0.3 * np.random.default_rng(row).standard_normal(n * (len(pen) + 2))
    w = [x[:-2] for x in np.split(z, n)]
    log_d, rest = basis @ w[0], u[:, :, row].copy()
    for k in range(row):
        rest -= (basis @ w[1 + 2 * k] + 1j * (basis @ w[2 + 2 * k]))[:, None] * u[:, :, k]
    want = (-6 * log_d.sum() - ((np.abs(rest) ** 2).sum(axis=1) / (2.0 * np.exp(log_d))).sum()) * 0.7 / 1.5
    assert abs(likelihood(w)[0] - want) < 1e-8
    f = sampler.with_prior(likelihood, [pen] * n, sampler.Prior())
    slope = [(f(z + e)[0] - f(z - e)[0]) / 2e-5 for e in 1e-5 * np.eye(len(z))]
    assert np.allclose(slope, f(z)[1], atol=1e-4 * np.abs(f(z)[1]).max())


def test_no_u_turn_draws_of_a_normal():
    a, rng, z = np.diag([1.0, 4.0, 0.25]), np.random.default_rng(1), [np.ones(3)]
    for _ in range(4000):
        z.append(sampler.transition(lambda x: (float(-0.5 * x @ a @ x), -a @ x), z[-1], np.eye(3), 0.6, rng, 6)[0])
    z = np.array(z[100:])
    assert np.allclose(z.var(axis=0), [1, 0.25, 4], rtol=0.15) and np.abs(z.mean(axis=0)).max() < 0.2


def ar4(n, seed):
    coefs = [0.6, -0.5, 0.3, -0.3]
    e, y = np.random.default_rng(seed).standard_normal(n + 500), np.zeros(n + 500)
    for t in range(4, n + 500):
        y[t] = e[t] + sum(c * y[t - 1 - k] for k, c in enumerate(coefs))
    f = np.arange(1, n // 2 + 1) / n
    return y[500:], 2 / np.abs(1 - sum(c * np.exp(-2j * np.pi * f * (k + 1)) for k, c in enumerate(coefs))) ** 2


def test_sampler_recovers_an_autoregressive_spectrum(spark):
    y, truth = ar4(2048, 42)
    rows = [("a", t, float(v)) for t, v in enumerate(y)]
    power = kernels.fft_periodogram(spark.createDataFrame(rows, "series_id string, t_idx long, y double"))
    draws = sampler.fit_univariate(power, n_knots=20, draws=300, warm=200)
    w = draws.filter("b >= 0").toPandas()
    basis, _ = sampler.spline_grid(power.orderBy("k").toPandas()["power"].to_numpy(), 20)
    log_s = w.pivot(index=["chain", "draw"], columns="b", values="w").to_numpy() @ basis.T
    q05, q50, q95 = np.quantile(np.exp(log_s), [0.05, 0.5, 0.95], axis=0)
    assert np.abs(q50 - truth).sum() / truth.sum() < 0.5 and np.linalg.norm(q50 - truth) / np.linalg.norm(truth) < 0.5
    assert ((q05 <= truth) & (truth <= q95)).mean() > 0.8
    table = sampler.summary_table(draws.filter("b >= 0"), ["series_id"]).first()
    assert table.draws == 600 and table.divergences == 0 and table.max_rhat < 1.1 and table.min_ess > 40


def test_rows_sampler_finds_variances_and_factors(spark):
    u, y = _wishart(n=64, reps=8)
    rows = [(f + 1, i, j, float(y[f, i, j].real), float(y[f, i, j].imag)) for f in range(64) for i in range(3) for j in range(3)]
    draws = sampler.fit_rows(spark.createDataFrame(rows, "k long, i long, j long, re double, im double"), 8, 1.0).filter("b >= 0").toPandas()
    basis = kernels.bspline(np.linspace(0, 1, 64), np.linspace(0, 1, 6), 3)
    mean = draws.groupby(["row", "block", "b"])["w"].mean().unstack()
    curve = {key: basis @ x for key, x in zip(mean.index, mean.to_numpy(), strict=True)}
    assert abs(curve[1, "theta_re_0"].mean() - 0.5) < 0.1 and abs(curve[1, "theta_im_0"].mean() - 0.2) < 0.1
    assert all(abs(curve[r, "log_delta2"].mean() - np.log(2)) < 0.2 for r in range(3))


def test_rank_normalised_diagnostics():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4, 500))
    assert sampler.rhat(x) < 1.01 and 1500 < sampler.ess_bulk(x) < 2600
    assert sampler.rhat(x + np.arange(4)[:, None]) > 1.5 and sampler.rhat(x * (1 + 3 * np.arange(4))[:, None]) > 1.1
    slow = np.zeros((4, 500))
    for t in range(1, 500):
        slow[:, t] = 0.9 * slow[:, t - 1] + rng.standard_normal(4)
    assert 40 < sampler.ess_bulk(slow) < 250


def test_varma_series_have_their_spectrum(spark):
    var, vma, sigma = np.array([[[0.5, 0.0], [0.0, -0.3]], [[0.0, 0.0], [0.0, -0.5]]]), np.array([np.eye(2), 0.3 * np.eye(2)]), np.array([[1.0, 0.9], [0.9, 1.0]])
    df = generators.varma_series(spark.range(4).withColumnRenamed("id", "run"), var, vma, sigma, 4096).toPandas()
    f = np.arange(1, 2049) / 4096
    s = generators.varma_matrix(f, var, vma, sigma)
    assert np.allclose(s, s.conj().transpose(0, 2, 1)) and (np.linalg.eigvalsh(s) > 0).all()
    for c in (0, 1):
        assert abs(df[df["channel"] == c].groupby("run")["y"].var().mean() / (s[:, c, c].real.sum() / 4096) - 1) < 0.1
    with pytest.raises(ValueError):
        generators.validate(np.array([[[1.05, 0.0], [0.0, 0.2]]]), vma, sigma)
    with pytest.raises(ValueError):
        generators.validate(var, vma, np.array([[1.0, 2.0], [2.0, 1.0]]))


def test_varma_closed_form(spark):
    a1, a2, sigma = [[0.5, 0.1], [0.2, -0.3]], [[0.0, 0.05], [0.0, -0.5]], [[1.0, 0.9], [0.9, 1.0]]
    df = frame(spark, generators.varma_psd2(step("SELECT v AS k, v / 1e2 AS freq FROM $seq(1, 50) g"), a1, a2, sigma))
    want = generators.varma_matrix(np.arange(1, 51) / 100, np.array([a1, a2]), np.eye(2)[None], np.array(sigma))
    assert np.allclose(matrix(df, 2), want)


def test_xyz_matrix(spark):
    f = 10 ** np.linspace(-4, -1.2, 30)
    rows = " UNION ALL ".join(f"SELECT {k} AS k, {float(x)!r}D AS freq" for k, x in enumerate(f))
    df = generators.xyz_matrix(step(rows)).frame(spark, SF).orderBy("k").toPandas()
    w, x = 2 * np.pi * f, 2 * np.pi * f * 2.5e9 / 299792458
    to_freq = (w * 2.81e14 / 299792458) ** 2
    sop, spm = 1.5e-11**2 * (1 + (2e-3 / f) ** 4) * to_freq, 3e-15**2 * (1 + (4e-4 / f) ** 2) * (1 + (f / 8e-3) ** 4) / w**4 * to_freq
    sxx = 16 * np.sin(x) ** 2 * np.sin(2 * x) ** 2 * (4 * sop + 4 * (3 + np.cos(2 * x)) * spm)
    sxy = -16 * np.sin(x) * np.sin(2 * x) ** 3 * (sop + 4 * spm)
    assert np.allclose(df["log_sxx"], np.log10(sxx)) and np.allclose(df["sxy_ratio"], sxy / sxx)


def test_knots():
    f = np.linspace(0.01, 0.5, 400)
    power = 1 + 50 * np.exp(-(((f - 0.2) / 0.01) ** 2))
    u = knots.density_knots(power, f, 12)
    assert len(u) == 12 and u[0] == 0 and u[-1] == 1 and (np.diff(u) > 0).all()
    at = (0.2 - f[0]) / (f[-1] - f[0])
    assert (np.abs(u - at) < 0.08).sum() >= 6
    plain, guided = (knots.density_knots(np.linspace(1, 2, 400), f, 12, guide=g) for g in (None, power))
    assert (np.abs(guided - at) < 0.08).sum() >= (np.abs(plain - at) < 0.08).sum() + 2
    cubic = np.arange(50.0) ** 3
    assert np.allclose(knots.polynomial_rows(7) @ cubic[:7], cubic[:7])
    assert knots.dedup(np.array([0, 1e-13, 0.5, 0.5 + 1e-13, 1 - 1e-13, 1])).tolist() == [0, 0.5, 1]
    assert knots.exact_count(np.array([0, 0.1, 0.15, 0.6, 1]), 4).tolist() == [0, 0.15, 0.6, 1]
    assert knots.exact_count(np.array([0, 0.2, 1.0]), 4).tolist() == [0, 0.2, 0.6, 1]
    with pytest.raises(ValueError):
        knots.exact_count(np.array([0.1, 1.0]), 4)


def test_operators_on_a_frame_of_ones_own(spark):
    y = np.random.default_rng(7).standard_normal(50)
    series = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t_idx long, y double")
    got = apply(S.periodogram, series).orderBy("k").toPandas()
    assert np.allclose(got["power"], 2 * np.abs(np.fft.rfft(y)[1:]) ** 2 / 50) and np.allclose(got["freq"], np.arange(1, 26) / 50)
    bins = apply(bands.interpolate, apply(S.periodogram, series).select("k", "freq", got_value("power")), series.selectExpr("t_idx / 100e0 AS freq")).toPandas()
    assert np.allclose(bins.sort_values("freq")["value"], np.interp(np.arange(50) / 100, got["freq"], got["power"]))


def got_value(name):
    return F.col(name).alias("value")


def test_array_periodograms(spark):
    rng = np.random.default_rng(1)
    rows = [(0, rng.standard_normal(64).tolist()), (1, rng.standard_normal(7).tolist()), (2, None), (3, [1.0]), (4, rng.standard_normal(64).tolist())]
    got = kernels.array_periodograms(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").toPandas()
    assert set(got["id"]) == {0, 1, 4}
    for i in (0, 1, 4):
        y = np.array(rows[i][1])
        assert np.allclose(got[got["id"] == i].sort_values("k")["power"], 2 * np.abs(np.fft.rfft(y)[1:]) ** 2 / len(y))


def test_stream_of_events_drops_what_is_too_late(spark, tmp_path):
    rows = lambda hours: spark.createDataFrame([("a", h, 1.0) for h in hours], "event_type string, hour long, value double").select("event_type", F.timestamp_seconds(F.col("hour") * 3600 + 60).alias("ts"), "value")
    at = f"{tmp_path}/events.parquet"
    rows([0, 0, 1, 5]).coalesce(1).write.parquet(at)
    stream = T.windowed(T.read_events(spark, at))
    out, log = f"{tmp_path}/out", f"{tmp_path}/log"

    def turn():
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted((int(r.start.timestamp()) // 3600, r.n) for r in spark.read.parquet(out).collect())

    assert turn() == [(0, 2), (1, 1)]  # hour 5 is open
    rows([1, 4, 9]).coalesce(1).write.mode("append").parquet(at)  # hour 1 is closed: that row is late
    assert turn() == [(0, 2), (1, 1), (4, 1), (5, 1)]
