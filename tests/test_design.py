"""Design weights, transfer between grids, and the prior's draws."""

import numpy as np

from lumenfreq.operators import design, generators, linear
from lumenfreq.operators.kernels import bspline


def test_design_weights_follow_the_components(spark):
    f = np.arange(1, 100) / 200  # without the last bin, which counts half
    s = generators.varma_matrix(f, np.array([[[0.4, 0.0], [0.1, -0.3]]]), np.eye(2)[None], np.array([[1.0, 0.5], [0.5, 1.0]]))
    k, i, j = (x.ravel() for x in np.indices(s.shape))
    rows = list(zip((k + 1).tolist(), f[k].tolist(), i.tolist(), j.tolist(), s.real.ravel().tolist(), s.imag.ravel().tolist(), strict=True))
    parts = linear.cholesky_components(spark.createDataFrame(rows, "k long, freq double, i long, j long, re double, im double"))
    knots = np.linspace(0, 1, 10)
    w = design.design_weights(parts, knots).toPandas()
    assert set(w["component"]) == {"delta_0", "delta_1", "theta_re_1_0", "theta_im_1_0"}
    curve = {c: bspline(design.unit(f), knots, 3) @ g.sort_values("b")["w"].to_numpy() for c, g in w.groupby("component")}
    theta = curve["theta_re_1_0"] + 1j * curve["theta_im_1_0"]
    want = s[:, 1, 0] / s[:, 0, 0].real
    assert np.abs(theta - want).max() < 0.02 and np.abs(curve["delta_0"] - np.log(s[:, 0, 0].real)).max() < 0.05


def test_transfer_keeps_the_curve():
    coarse, fine = (np.arange(2, 100, 4) / 200, np.linspace(0, 1, 8)), (np.arange(1, 101) / 200, np.linspace(0, 1, 9))
    w = np.sin(np.arange(10.0))
    got = bspline(design.unit(fine[0]), fine[1], 3) @ design.transfer_weights(w, coarse, fine, np.log(2))
    want = np.interp(fine[0], coarse[0], bspline(design.unit(coarse[0]), coarse[1], 3) @ w) + np.log(2)
    assert np.sqrt(np.mean((got - want) ** 2)) < 0.1


def test_prior_predictive(spark):
    knots = np.linspace(0, 1, 6)
    kw = {"draws": 100, "centre": {"b": np.full(8, 3.0)}, "tau": 0.5}
    q = design.prior_predictive(spark, ["a", "b"], 20, knots, **kw).toPandas()
    assert len(q) == 40 and (q["q05"] <= q["q50"]).all() and (q["q50"] <= q["q95"]).all() and q[["q05", "q95"]].abs().max().max() <= 20
    mid = q.groupby("component")["q50"].mean()
    assert abs(mid["a"]) < 0.3 and abs(mid["b"] - 3) < 0.3
    again = design.prior_predictive(spark, ["b"], 20, knots, **kw).toPandas()
    assert np.allclose(again["q50"], q[q["component"] == "b"]["q50"])
