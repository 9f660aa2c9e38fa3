"""The likelihood of spectral matrices, a row of the Cholesky factor at a time, its prior, and its geometry, as SQL steps."""

from __future__ import annotations

import math

from ..plans.steps import Step, step
from .matrices import entries


def row_loglik(y: Step, params: Step, row: int, blocked: Step, duration: float, nh: int = 1, enbw: float = 1.0, eta: float = 1.0) -> Step:
    """(loglik) of row 0 or 1 of Y at params (k, log_d; t, ti for row 1): the log of the row's variance and the complex factor of
    the row before it.  The residual power |u1 - t u0|^2 follows from Y alone, so its square root is never needed."""
    nb = step("SELECT max(block) + 1 AS nb FROM {b}", b=blocked)
    left = "s00" if row == 0 else "s11 - 2e0 * (t * s10 + ti * s10i) + (t * t + ti * ti) * s00"
    held = "greatest(-8e1, least(8e1, log_d))"
    return step(
        f"SELECT (-max(nb) * {nh}e0 * sum({held}) - sum(({left}) * exp(-{held}) / {duration}e0)) * {eta!r}e0 / {enbw!r}e0 AS loglik FROM {{e}} e JOIN {{p}} p ON p.k = e.k CROSS JOIN {{n}}",
        e=entries(y, 2), p=params, n=nb,
    )


def prior_logdensity(weights: Step, penalty: Step, log_phi: float = 0.3, log_delta: float = -0.2, alpha_phi: float = 1.0, beta_phi: float = 1.0, alpha_delta: float = 1e-4, beta_delta: float = 1e-4) -> Step:
    """(log_prior) of P-spline weights (b, w) with penalty (b, b2, v) at one point of the two log scales: Gamma densities of both with
    their Jacobians, and the weights' normal density up to a constant."""
    gamma = lambda a, b, x: f"({a!r}e0 * ln({b}) - {math.lgamma(a)!r} + {a!r}e0 * {x})"
    delta, phi = repr(math.exp(log_delta)), repr(math.exp(log_phi))
    scales = f"{gamma(alpha_delta, f'{beta_delta!r}', f'({log_delta!r})')} - {beta_delta!r} * {delta} + {gamma(alpha_phi, f'({beta_phi!r} * {delta})', f'({log_phi!r})')} - {beta_phi!r} * {delta} * {phi}"
    scales = scales.replace("1.0e0", "1e0").replace("0.0001e0", "1e-4")
    quad = step("SELECT sum(x.w * p.v * y.w) AS q FROM {p} p JOIN {w} x ON x.b = p.b JOIN {w} y ON y.b = p.b2", p=penalty, w=weights)
    size = step("SELECT count(*) AS n FROM {w}", w=weights)
    return step(f"SELECT {scales} + 5e-1 * n * ({log_phi!r}) - 5e-1 * {phi} * q AS log_prior FROM {{q}} CROSS JOIN {{n}}", q=quad, n=size)


def geometry(length: Step) -> Step:
    """Block counts that divide the series, with the block length, its positive bins, and the coarse bins that divide those."""
    nb = step("SELECT $span(1, 12) AS nb, n FROM {n}", n=length)
    x = step("SELECT nb, floor(n / (nb * 1e0)) AS lb, floor(floor(n / (nb * 1e0)) / 2e0) AS n_ell FROM {b} WHERE n % nb = 0", b=nb)
    y = step("SELECT nb, lb, n_ell, $span(1, 6) AS nh FROM {x}", x=x)
    return step("SELECT nb, lb, n_ell, nh, n_ell / nh AS nc FROM {y} WHERE n_ell % nh = 0", y=y)
