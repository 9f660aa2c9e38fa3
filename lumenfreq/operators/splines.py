"""B-spline bases and their use, as SQL steps: clamped knots on [0, 1], Cox-de Boor recursion by degree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..plans.steps import Step, step
from .kernels import bspline


def knots_uniform(n: int) -> Step:
    return step(f"SELECT v AS idx, v / {n - 1}e0 AS u FROM $seq(0, {n - 1}) g")


def knots_log(n: int, lo: float) -> Step:
    """0, then powers of ten evenly spaced in the exponent from lo to 1."""
    return step(f"SELECT v AS idx, CASE WHEN v = 0 THEN 0e0 WHEN v = {n - 1} THEN 1e0 ELSE pow(1e1, log10({lo!r}e0) * (1e0 - (v - 1) / {n - 2}e0)) END AS u FROM $seq(0, {n - 1}) g")


def basis(knots: Step, grid: Step, degree: int = 3, n_knots: int = 0) -> Step:
    """(k, b, v) for a grid (k, u), zeros left out.  n_knots: for evenly spaced knots, their number."""
    n = step("SELECT count(*) AS n FROM {k}", k=knots)
    pad = f"SELECT CAST(v AS BIGINT) AS m, 0e0 AS u FROM $seq(0, {degree - 1}) a UNION ALL SELECT v + n AS m, 1e0 AS u FROM {{n}} CROSS JOIN $seq({degree}, {2 * degree - 1}) b UNION ALL " if degree else ""
    t = step(pad + f"SELECT idx + {degree} AS m, u FROM {{k}}", k=knots, n=n)
    last = step("SELECT max(m) AS m FROM {t}", t=t)
    b = step(
        f"SELECT g.k, a.m AS b, 1e0 AS v FROM {{g}} g JOIN {{t}} a ON g.u >= a.u JOIN {{t}} z ON z.m = a.m + 1 CROSS JOIN {{l}} l WHERE (g.u < z.u OR (g.u >= 1e0 AND a.m = l.m - {degree} - 1)) AND a.u < z.u",
        g=grid, t=t, l=last,
    )
    for d in range(1, degree + 1):
        spread = step("SELECT k, b, v FROM {b} UNION ALL SELECT k, b - 1 AS b, CAST(0 AS DOUBLE) AS v FROM {b}", b=b)
        pairs = step("SELECT k, b, sum(v) AS v FROM {s} WHERE b >= 0 GROUP BY k, b", s=spread)
        nxt = step("SELECT p.k, p.b, p.v AS v0, coalesce(n.v, 0e0) AS v1 FROM {p} p LEFT JOIN {b} n ON n.k = p.k AND n.b = p.b + 1", p=pairs, b=b)
        b = step(
            "SELECT x.k, x.b, (CASE WHEN t1.u > t0.u THEN (g.u - t0.u) / (t1.u - t0.u) * x.v0 ELSE 0e0 END) + (CASE WHEN t3.u > t2.u THEN (t3.u - g.u) / (t3.u - t2.u) * x.v1 ELSE 0e0 END) AS v "
            f"FROM {{x}} x JOIN {{g}} g ON g.k = x.k JOIN {{t}} t0 ON t0.m = x.b JOIN {{t}} t1 ON t1.m = x.b + {d} JOIN {{t}} t2 ON t2.m = x.b + 1 JOIN {{t}} t3 ON t3.m = x.b + {d} + 1",
            x=nxt, g=grid, t=t,
        )
    done = step("SELECT k, b, v FROM {b} WHERE v > 0e0", b=b)
    return Step("SELECT k, b, v FROM {b}", {"g": grid, "b": done}, _kernel(n_knots, degree)) if n_knots else done


def _kernel(n_knots: int, degree: int):
    """The same basis from numpy, a batch of grid points at a time."""

    def make(grid: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                v = bspline(p["u"].to_numpy(), np.linspace(0, 1, n_knots), degree)
                row, b = np.nonzero(v > 0)
                yield pd.DataFrame({"k": p["k"].to_numpy()[row], "b": b, "v": v[row, b]})

        return grid.select("k", "u").mapInPandas(run, "k long, b long, v double")

    return make


def gram(b: Step) -> Step:
    return step("SELECT x.b, y.b AS b2, sum(x.v * y.v) AS v FROM {b} x JOIN {b} y ON x.k = y.k GROUP BY x.b, y.b", b=b)


def evaluate(b: Step, weights: Step) -> Step:
    return step("SELECT b.k, sum(b.v * w.w) AS log_psd FROM {b} b JOIN {w} w ON w.b = b.b GROUP BY b.k", b=b, w=weights)


def whittle_terms(power: Step, log_psd: Step, nh: int = 1) -> Step:
    return step(f"SELECT p.k, -5e-1 * ({nh}e0 * s.log_psd + exp(ln(p.power) - s.log_psd)) AS term FROM {{p}} p JOIN {{s}} s ON s.k = p.k", p=power, s=log_psd)


def second_differences(n: int) -> Step:
    """(b, b2, v): the penalty of squared second differences of n weights, plus 1e-6 on the diagonal."""
    d = np.diff(np.eye(n), 2, axis=0)
    p = d.T @ d + 1e-6 * np.eye(n)
    return step(" UNION ALL ".join(f"SELECT {i} AS b, {j} AS b2, CAST({p[i, j]!r} AS DOUBLE) AS v" for i in range(n) for j in range(n) if p[i, j]).replace("np.float64(", "(") )


def log_spaced(x: Step, most: int) -> Step:
    """(k, freq) of the first bin at or after each of `most` frequencies evenly spaced in the logarithm."""
    edge = step("SELECT ln(min(freq)) AS a, ln(max(freq)) AS b FROM {x}", x=x)
    goals = step(f"SELECT a + (b - a) * g.v / {most - 1}e0 AS goal FROM {{e}} CROSS JOIN $seq(0, {most - 1}) g", e=edge)
    return step("SELECT DISTINCT k, freq FROM (SELECT goal, min(k) AS k, min(freq) AS freq FROM {g} JOIN {x} x ON ln(x.freq) >= goal - 1e-12 GROUP BY goal)", g=goals, x=x)
