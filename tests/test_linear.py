"""Matrices of four channels against numpy, and series with the spectrum asked for."""

import numpy as np
import pytest

from lumenfreq.operators import linear


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((300, 4, 4)) + 1j * rng.standard_normal((300, 4, 4))
    return a @ a.conj().transpose(0, 2, 1)


def frame(spark, m):
    k, i, j = (x.ravel() for x in np.indices(m.shape))
    rows = zip((k + 1).tolist(), (k / 600).tolist(), i.tolist(), j.tolist(), m.real.ravel().tolist(), m.imag.ravel().tolist(), strict=True)
    return spark.createDataFrame(list(rows), "k long, freq double, i long, j long, re double, im double")


def back(df):
    p = df.toPandas()
    out = np.zeros((p["k"].max(), p["i"].max() + 1, p["j"].max() + 1), complex)
    out[p["k"] - 1, p["i"], p["j"]] = p["re"] + 1j * p["im"]
    return out


def test_eigenvalues_and_roots(spark, matrices):
    x = frame(spark, matrices)
    e = linear.eigenvalues(x).toPandas().pivot(index="k", columns="rank", values="value").to_numpy()
    assert np.allclose(e, np.linalg.eigvalsh(matrices)[:, ::-1])
    u = back(linear.square_root(x))
    assert np.allclose(u @ u.conj().transpose(0, 2, 1), matrices)
    with pytest.raises(Exception, match="Hermitian"):
        linear.square_root(frame(spark, matrices + 1j)).count()
    with pytest.raises(Exception, match="all entries"):
        linear.eigenvalues(x.filter("i > 0")).count()


def test_components_round_trip(spark, matrices):
    parts = linear.cholesky_components(frame(spark, matrices))
    assert np.allclose(back(linear.from_components(parts)), matrices)
    c = back(parts)
    t = np.eye(4) - np.tril(c, -1)
    assert np.allclose(t @ matrices @ t.conj().transpose(0, 2, 1), np.exp(np.einsum("kii->ki", c).real)[:, :, None] * np.eye(4))
    flat = np.ones((2, 3, 3), complex)  # rank one
    assert np.allclose(back(linear.from_components(linear.cholesky_components(frame(spark, flat)))), flat, atol=1e-3)


def test_floors_and_repairs(spark, matrices):
    x = frame(spark, matrices)
    m = back(linear.floor_eigenvalues(x, 0.1))
    assert (np.linalg.eigvalsh(m)[:, 0] >= 0.1 * np.trace(matrices, axis1=1, axis2=2).real - 1e-9).all()
    low = np.linalg.eigvalsh(matrices)[:, 0]
    got = np.linalg.eigvalsh(back(linear.repair(x, 0.5)))[:, 0]
    assert np.allclose(got, np.where(low < 0.5, 1.0, low))


def test_coloured_noise_has_its_spectrum_and_is_normal(spark):
    f = np.linspace(0.001, 0.5, 200)
    power = 1 + 20 * f
    psd = spark.createDataFrame([("a", float(x), float(p)) for x, p in zip(f, power, strict=True)], "series_id string, freq double, power double")
    y = linear.coloured_noise(psd, 4096, seed=3).orderBy("t_idx").toPandas()["y"].to_numpy()
    d = np.fft.rfft(y)[1:-1]
    at = np.arange(1, 2048) / 4096
    assert abs(np.mean(2 * np.abs(d) ** 2 / 4096 / np.interp(at, f, power)) - 1) < 0.1
    c = spark.createDataFrame([("a", float(x), float(z.real), float(z.imag)) for x, z in zip(at, d * np.sqrt(2 / 4096), strict=True)], "series_id string, freq double, re double, im double")
    s = spark.createDataFrame([(float(x), float(p)) for x, p in zip(at, np.interp(at, f, power), strict=True)], "freq double, power double")
    assert linear.normality(c, s).first().p_value > 1e-3
    assert linear.normality(c, s.selectExpr("freq", "power * 2 AS power")).first().p_value < 1e-6
