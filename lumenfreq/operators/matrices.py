"""Closed forms for 2 x 2 and 3 x 3 spectral matrices: eigenvalues, Cholesky components, floors and repairs."""

from __future__ import annotations

from ..plans.steps import Step, step


def entries(psd: Step, p: int) -> Step:
    """One row a frequency: s00, s10, s10i, s11 (s20, s20i, s21, s21i, s22)."""
    cols = [f"max(CASE WHEN i = {a} AND j = {b} THEN {part} END) AS s{a}{b}{'i' if part == 'im' else ''}" for a in range(p) for b in range(a + 1) for part in (("re",) if a == b else ("re", "im"))]
    return step(f"SELECT k, freq, {', '.join(cols)} FROM {{p}} WHERE i < {p} AND j < {p} GROUP BY k, freq", p=psd)


def eigenvalues2(psd: Step) -> Step:
    half = "sqrt(((s00 - s11) / 2e0) * ((s00 - s11) / 2e0) + s10 * s10 + s10i * s10i)"
    return step(f"SELECT k, freq, greatest(0e0, (s00 + s11) / 2e0 + {half}) AS l1, greatest(0e0, (s00 + s11) / 2e0 - {half}) AS l2 FROM {{e}}", e=entries(psd, 2))


def eigenvalues3(psd: Step) -> Step:
    off = "(s10 * s10 + s10i * s10i + s20 * s20 + s20i * s20i + s21 * s21 + s21i * s21i)"
    a = step(f"SELECT *, (s00 + s11 + s22) / 3e0 AS q, {off} AS o2 FROM {{e}}", e=entries(psd, 3))
    b = step("SELECT *, s00 - q AS d0, s11 - q AS d1, s22 - q AS d2 FROM {a}", a=a)
    c = step("SELECT *, sqrt((d0 * d0 + d1 * d1 + d2 * d2 + 2e0 * o2) / 6e0) AS w FROM {b}", b=b)
    # det(S - qI) = d0 d1 d2 + 2 Re(s10 s21 conj(s20)) - d0 |s21|^2 - d1 |s20|^2 - d2 |s10|^2
    det = (
        "(d0 * d1 * d2 + 2e0 * ((s10 * s21 - s10i * s21i) * s20 + (s10 * s21i + s10i * s21) * s20i) "
        "- d0 * (s21 * s21 + s21i * s21i) - d1 * (s20 * s20 + s20i * s20i) - d2 * (s10 * s10 + s10i * s10i))"
    )
    d = step(f"SELECT *, acos(greatest(-1e0, least(1e0, CASE WHEN w = 0e0 THEN 1e0 ELSE {det} / (2e0 * w * w * w) END))) / 3e0 AS phi FROM {{c}}", c=c)
    f = step("SELECT k, freq, q, q + 2e0 * w * cos(phi) AS l1, q + 2e0 * w * cos(phi + 2e0 * pi() / 3e0) AS l3 FROM {d}", d=d)
    return step("SELECT k, freq, greatest(0e0, l1) AS l1, greatest(0e0, 3e0 * q - l1 - l3) AS l2, greatest(0e0, l3) AS l3 FROM {f}", f=f)


def ratios(eig: Step) -> Step:
    return step("SELECT k, freq, CASE WHEN l1 > 0e0 THEN l2 / l1 END AS ratio FROM {e}", e=eig)


def ratio_summary(r: Step, warn: float = 0.8) -> Step:
    return step(
        f"SELECT count(ratio) AS n, avg(CASE WHEN ratio > {warn!r}e0 THEN 1e0 ELSE 0e0 END) AS frac_high, min(ratio) AS lo, max(ratio) AS hi, "
        "$pct(ratio, 0.05) AS q05, $pct(ratio, 0.5) AS q50, $pct(ratio, 0.95) AS q95 FROM {r} WHERE ratio IS NOT NULL",
        r=r,
    )


def separated(eig: Step, q: float) -> Step:
    """Only frequencies whose largest eigenvalue is above its q-quantile."""
    return step(f"SELECT e.* FROM {{e}} e CROSS JOIN (SELECT $pct(l1, {q!r}) AS edge FROM {{e}}) t WHERE l1 > edge", e=eig)


def cholesky2(psd: Step) -> Step:
    return step("SELECT k, freq, ln(s00) AS log_d0, s10 / s00 AS t10, s10i / s00 AS t10i, ln(s11 - (s10 * s10 + s10i * s10i) / s00) AS log_d1 FROM {e}", e=entries(psd, 2))


def cholesky3(psd: Step) -> Step:
    a = step("SELECT k, freq, s00 AS a, s10 / s00 AS l10, s10i / s00 AS l10i, s20 / s00 AS l20, s20i / s00 AS l20i, s11 - (s10 * s10 + s10i * s10i) / s00 AS d2, s22, s10, s10i, s20, s20i, s21, s21i FROM {e}", e=entries(psd, 3))
    b = step("SELECT *, (s21 - (s20 * s10 + s20i * s10i) / a) / d2 AS l21, (s21i - (s20i * s10 - s20 * s10i) / a) / d2 AS l21i FROM {a}", a=a)
    return step(
        "SELECT k, freq, ln(a) AS log_d0, ln(d2) AS log_d1, ln(s22 - (l20 * l20 + l20i * l20i) * a - (l21 * l21 + l21i * l21i) * d2) AS log_d2, l10 AS t10, l10i AS t10i, l21 AS t21, l21i AS t21i, "
        "l20 - (l10 * l21 - l10i * l21i) AS t20, l20i - (l10 * l21i + l10i * l21) AS t20i FROM {b}",
        b=b,
    )


def reconstruct2(c: Step) -> Step:
    """Long-form spectral matrices from the components of two channels."""
    x = step("SELECT k, freq, exp(log_d0) AS s00, exp(log_d0) * t10 AS s10, exp(log_d0) * t10i AS s10i, exp(log_d1) + exp(log_d0) * (t10 * t10 + t10i * t10i) AS s11 FROM {c}", c=c)
    part = "SELECT k, freq, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {re} AS re, {im} AS im FROM {{x}}"
    rows = [("0", "0", "s00", "0e0"), ("0", "1", "s10", "-s10i"), ("1", "0", "s10", "s10i"), ("1", "1", "s11", "0e0")]
    return step(" UNION ALL ".join(part.format(i=i, j=j, re=re, im=im) for i, j, re, im in rows), x=x)


def floor2(psd: Step, fraction: float) -> Step:
    """Eigenvalues of two channels held to at least fraction of the trace, by S + c P with P the projector on the smaller."""
    e = step("SELECT *, (s00 + s11) / 2e0 AS m, sqrt(((s00 - s11) / 2e0) * ((s00 - s11) / 2e0) + s10 * s10 + s10i * s10i) AS h FROM {e}", e=entries(psd, 2))
    f = step(f"SELECT *, greatest(0e0, {fraction!r}e0 * (s00 + s11) - (m - h)) AS lift FROM {{e}}", e=e)
    g = "CASE WHEN h = 0e0 THEN 0e0 ELSE lift / (2e0 * h) END"
    return step(f"SELECT k, freq, s00 + {g} * (m + h - s00) AS s00, s11 + {g} * (m + h - s11) AS s11, s10 - {g} * s10 AS s10, s10i - {g} * s10i AS s10i FROM {{f}}", f=f)


def repair2(psd: Step, eps: float) -> Step:
    """(2 eps - smallest eigenvalue) I added where the smallest eigenvalue is below eps."""
    e = step("SELECT *, (s00 + s11) / 2e0 - sqrt(((s00 - s11) / 2e0) * ((s00 - s11) / 2e0) + s10 * s10 + s10i * s10i) AS low FROM {e}", e=entries(psd, 2))
    add = f"CASE WHEN low < {eps!r}e0 THEN 2e0 * {eps!r}e0 - low ELSE 0e0 END"
    return step(f"SELECT k, freq, s00 + {add} AS s00, s11 + {add} AS s11, s10, s10i FROM {{e}}", e=e)
