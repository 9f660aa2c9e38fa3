"""Whole runs on simulated series, and runs saved and read again."""

import numpy as np
import pytest

from lumenfreq import run
from lumenfreq.operators import generators


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, a, scale in (("x", 0.6, 1.0), ("y", -0.4, 1e-21)):
        e, y = rng.standard_normal(712), np.zeros(712)
        for t in range(1, 712):
            y[t] = e[t] + a * y[t - 1]
        rows += [(name, t, float(v * scale)) for t, v in enumerate(y[200:])]
    return spark.createDataFrame(rows, "series_id string, t_idx long, y double")


def test_univariate_run(spark, series, tmp_path):
    config = run.RunConfig(n_knots=6, draws=100, warm=100, coarse=2, exclude=((0.2, 0.2),), fmin=2 / 512, method="uniform")
    with pytest.raises(Exception, match="does not divide"):
        run.run_univariate(series, config).data.collect()
    result = run.run_univariate(series, run.RunConfig(n_knots=6, draws=100, warm=100, coarse=2, method="uniform"))
    psd = result.psd.toPandas()
    assert len(psd) == 2 * 128 and (psd["q05"] <= psd["q50"]).all() and (psd["q50"] <= psd["q95"]).all()
    for name, a, scale in (("x", 0.6, 1.0), ("y", -0.4, 1e-21)):
        p = psd[psd["series_id"] == name]
        truth = 2 * scale**2 / np.abs(1 - a * np.exp(-2j * np.pi * p["freq"])) ** 2
        assert np.abs(p["q50"] - truth).sum() / truth.sum() < 0.3
    assert result.summary.count() == 2
    run.save_run(result, str(tmp_path / "a"), label="first", bad=float("nan"), numbers=np.arange(3))
    again, attrs = run.load_run(spark, str(tmp_path / "a"))
    assert again.config == result.config and attrs == {"label": "first", "bad": None, "numbers": [0, 1, 2]}
    assert again.psd.count() == 256 and again.draws.count() == 2 * 2 * 100 * 10
    assert run.run_summaries(spark, str(tmp_path / "*")).count() == 1


def test_multivariate_run(spark):
    var, vma, sigma = np.array([[[0.5, 0.0], [0.0, -0.3]]]), np.eye(2)[None], np.array([[1.0, 0.6], [0.6, 1.0]])
    x = generators.varma_series(spark.range(1).withColumnRenamed("id", "run"), var, vma, sigma, 2048).drop("run")
    result = run.run_multivariate(x, run.RunConfig(n_knots=6, blocks=8, coarse=4, chains=1, draws=100, warm=100))
    psd = result.psd.toPandas()
    freq = np.sort(psd["freq"].unique())
    assert len(freq) == 32 and np.allclose(freq, (np.arange(32) * 4 + 2) / 256)  # the earlier of the two in the middle
    truth = generators.varma_matrix(freq, var, vma, sigma)
    got = np.zeros_like(truth)
    at = {f: n for n, f in enumerate(freq)}
    got[psd["freq"].map(at), psd["i"], psd["j"]] = psd["re50"] + 1j * psd["im50"]
    assert np.linalg.norm(got - truth) / np.linalg.norm(truth) < 0.3


@pytest.mark.parametrize("bad", [{"n_knots": 1}, {"draws": 0}, {"method": "odd"}, {"fmin": 0.3, "fmax": 0.1}, {"eta": 0.0}, {"fs": -1.0}])
def test_configurations_are_checked(bad):
    with pytest.raises(ValueError):
        run.RunConfig(**bad)
