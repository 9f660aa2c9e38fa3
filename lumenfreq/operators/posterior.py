"""Summaries over draws and accuracy against a truth, as SQL steps.

draws: (draw, k, freq, value).  Quantiles are exact with linear interpolation.
"""

from __future__ import annotations

from ..plans.steps import Step, step


def quantiles(draws: Step) -> Step:
    return step("SELECT k, $pct(value, 0.05) AS q05, $pct(value, 0.5) AS q50, $pct(value, 0.95) AS q95 FROM {d} GROUP BY k", d=draws)


def sigma_bands(draws: Step) -> Step:
    ps = (("s3_lo", 0.0015), ("s2_lo", 0.025), ("s1_lo", 0.16), ("med", 0.5), ("s1_hi", 0.84), ("s2_hi", 0.975), ("s3_hi", 0.9985))
    return step("SELECT k, " + ", ".join(f"$pct(value, {p}) AS {n}" for n, p in ps) + " FROM {d} GROUP BY k", d=draws)


def uniform_band(draws: Step, alpha: float = 0.1) -> Step:
    """median -/+ c std with one c for all k: the (1 - alpha) quantile over draws of the largest deviation in units of std."""
    m = step("SELECT k, $pct(value, 0.5) AS med, stddev_pop(value) AS sd FROM {d} GROUP BY k", d=draws)
    worst = step("SELECT d.draw, max(abs(d.value - m.med) / m.sd) AS w FROM {d} d JOIN {m} m ON m.k = d.k WHERE m.sd > 0e0 GROUP BY d.draw", d=draws, m=m)
    c = step(f"SELECT $pct(w, {1 - alpha!r}) AS c FROM {{w}}", w=worst)
    return step("SELECT k, med - c * sd AS lo, med, med + c * sd AS hi FROM {m} CROSS JOIN {c}", m=m, c=c)


def ci_width(q: Step) -> Step:
    return step("SELECT round(avg(q95 - q05), 2) AS mean_width, round($pct(q95 - q05, 0.5), 2) AS median_width, round(max(q95 - q05), 2) AS max_width FROM {q}", q=q)


def integrals(x: Step, values: list[str], h: str, by: str = "") -> Step:
    """Integrals of the named columns over a uniform grid of n points in order of k, in one pass: Simpson's rule, with the published
    end correction for even n.  by: a column each of whose values has integrals of its own."""
    part, lead = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    p = step(f"SELECT {lead}{', '.join(values)}, row_number() OVER ({part} ORDER BY k) AS r, count(*) OVER ({part}) AS n FROM {{x}}", x=x)
    w = (
        "(CASE WHEN r > m THEN 0e0 WHEN m < 3 THEN 0e0 WHEN r = 1 OR r = m THEN 1e0 / 3e0 WHEN r % 2 = 0 THEN 4e0 / 3e0 ELSE 2e0 / 3e0 END "
        "+ CASE WHEN n % 2 = 1 THEN 0e0 WHEN r = n THEN 5e0 / 12e0 WHEN r = n - 1 THEN 8e0 / 12e0 WHEN r = n - 2 THEN -1e0 / 12e0 ELSE 0e0 END)"
    )
    q = step("SELECT *, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END AS m FROM {p}", p=p)
    return step(f"SELECT {lead}{', '.join(f'sum({v} * {h} * {w}) AS {v}' for v in values)} FROM {{q}}" + (f" GROUP BY {by}" if by else ""), q=q)


def riae(est: Step, truth: Step, spacing: float) -> Step:
    """integral of |estimate - truth| over integral of truth; both (k, value)."""
    x = step("SELECT t.k, abs(e.value - t.value) AS d, t.value AS s FROM {t} t JOIN {e} e ON e.k = t.k", t=truth, e=est)
    return step("SELECT d / s AS riae FROM {a}", a=integrals(x, ["d", "s"], f"{spacing!r}e0"))


def matrix_error(est: Step, truth: Step, spacing: float) -> Step:
    """riae: ratio of integrated squared Frobenius norms; l2: its root."""
    x = step(
        "SELECT t.k, sum((e.re - t.re) * (e.re - t.re) + (e.im - t.im) * (e.im - t.im)) AS d, sum(t.re * t.re + t.im * t.im) AS s FROM {t} t JOIN {e} e ON e.k = t.k AND e.i = t.i AND e.j = t.j GROUP BY t.k",
        t=truth, e=est,
    )
    return step("SELECT d / s AS riae, sqrt(d / s) AS l2 FROM {a}", a=integrals(x, ["d", "s"], f"{spacing!r}e0"))


def coverage(q: Step, truth: Step) -> Step:
    return step("SELECT avg(CASE WHEN t.value >= q05 AND t.value <= q95 THEN 1e0 ELSE 0e0 END) AS coverage, count(*) AS n FROM {q} q JOIN {t} t ON t.k = q.k", q=q, t=truth)


def inflation(q: Step, truth: Step, target: float = 0.9) -> Step:
    """The least factor on the distances from the median at which the interval covers `target` of the truth, 20 at most."""
    x = step("SELECT CASE WHEN t.value >= q50 THEN (t.value - q50) / nullif(q95 - q50, 0e0) ELSE (t.value - q50) / nullif(q05 - q50, 0e0) END AS c FROM {q} q JOIN {t} t ON t.k = q.k", q=q, t=truth)
    y = step("SELECT c, row_number() OVER (ORDER BY c) AS r, count(*) OVER () AS n FROM {x} WHERE c IS NOT NULL", x=x)
    return step(f"SELECT least(20e0, min(c)) AS factor FROM {{y}} WHERE r >= ceil({target!r}e0 * n)", y=y)


def encode_real(psd: Step) -> Step:
    """Upper triangle with the diagonal: real parts; below it: imaginary parts."""
    return step("SELECT k, i, j, CASE WHEN i <= j THEN re ELSE im END AS value FROM {p}", p=psd)


def matrix_quantiles(draws: Step) -> Step:
    """(k, i, j, re05, re50, re95, im05, im50, im95) of draws (draw, k, i, j, re, im)."""
    qs = ", ".join(f"$pct({c}, {p}) AS {c}{n}" for c in ("re", "im") for p, n in ((0.05, "05"), (0.5, "50"), (0.95, "95")))
    return step(f"SELECT k, i, j, {qs} FROM {{d}} GROUP BY k, i, j", d=draws)


def coherence_quantiles(draws: Step) -> Step:
    """(k, i, j, q05, q50, q95) of the squared coherence of each draw, for i < j."""
    rows = step("SELECT draw, k, i, j, re, im, max(CASE WHEN i = j THEN re END) OVER (PARTITION BY draw, k, i) AS si, max(CASE WHEN i = j THEN re END) OVER (PARTITION BY draw, k, j) AS sj FROM {d}", d=draws)
    coh = step("SELECT k, i, j, CASE WHEN si * sj = 0e0 THEN 0e0 ELSE least(1e0, (re * re + im * im) / (si * sj)) END AS coh FROM {r} WHERE i < j", r=rows)
    return step("SELECT k, i, j, $pct(coh, 0.05) AS q05, $pct(coh, 0.5) AS q50, $pct(coh, 0.95) AS q95 FROM {c} GROUP BY k, i, j", c=coh)


def coverage_detailed(draws: Step, truth: Step) -> Step:
    """(part, coverage, n) of the truth's real encoding by the draws' 5 % to 95 % intervals: overall, diagonal, real and imaginary off it."""
    own = step("SELECT draw, k, i, j, CASE WHEN i <= j THEN re ELSE im END AS value FROM {d}", d=draws)
    q = step("SELECT k, i, j, $pct(value, 0.05) AS q05, $pct(value, 0.95) AS q95 FROM {o} GROUP BY k, i, j", o=own)
    part = "CASE WHEN t.i = t.j THEN 'diagonal' WHEN t.i < t.j THEN 'real' ELSE 'imaginary' END"
    x = step(f"SELECT {part} AS part, CASE WHEN t.value >= q05 AND t.value <= q95 THEN 1e0 ELSE 0e0 END AS hit FROM {{t}} t JOIN {{q}} q ON q.k = t.k AND q.i = t.i AND q.j = t.j", t=encode_real(truth), q=q)
    return step("SELECT 'overall' AS part, avg(hit) AS coverage, count(*) AS n FROM {x} UNION ALL SELECT part, avg(hit) AS coverage, count(*) AS n FROM {x} GROUP BY part", x=x)


def width_by_part(q: Step, coherence: Step) -> Step:
    """Widths of the 5 % to 95 % intervals: diagonal, off-diagonal (real and imaginary parts), coherence."""
    x = step(
        "SELECT 'diagonal' AS part, re95 - re05 AS w FROM {q} WHERE i = j UNION ALL SELECT 'off-diagonal' AS part, re95 - re05 AS w FROM {q} WHERE i < j "
        "UNION ALL SELECT 'off-diagonal' AS part, im95 - im05 AS w FROM {q} WHERE i < j UNION ALL SELECT 'coherence' AS part, q95 - q05 AS w FROM {c}",
        q=q, c=coherence,
    )
    return step("SELECT part, avg(w) AS mean_width, $pct(w, 0.5) AS median_width, max(w) AS max_width FROM {x} GROUP BY part", x=x)


def riae_errorbars(draws: Step, truth: Step, spacing: float) -> Step:
    """Quantiles over draws of each draw's relative integrated absolute error."""
    x = step("SELECT d.draw, t.k, abs(d.value - t.value) AS e, t.value AS s FROM {t} t JOIN {d} d ON d.k = t.k", t=truth, d=draws)
    each = step("SELECT e / s AS r FROM {a}", a=integrals(x, ["e", "s"], f"{spacing!r}e0", "draw"))
    return step("SELECT " + ", ".join(f"$pct(r, {p}) AS {n}" for p, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))) + " FROM {e}", e=each)


def riae_bundle(est: Step, truth: Step, spacing: float, channels: int) -> Step:
    """(part, riae): the matrices as a whole (squared Frobenius norms), each channel, the off-diagonal part, and each quarter of the
    frequencies (borders belong to both sides)."""
    x = step("SELECT t.k, t.freq, t.i, t.j, (e.re - t.re) * (e.re - t.re) + (e.im - t.im) * (e.im - t.im) AS d2, t.re * t.re + t.im * t.im AS s2, abs(e.re - t.re) AS d1, t.re AS s1 FROM {t} t JOIN {e} e ON e.k = t.k AND e.i = t.i AND e.j = t.j", t=truth, e=est)
    pct = ", ".join(f"$pct(freq, {p}) AS f{n}" for n, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))
    edge = step(f"SELECT {pct} FROM {{t}} WHERE i = 0 AND j = 0", t=truth)
    kinds = " UNION ALL ".join(f"SELECT '{name}' AS part, {kind} AS kind, {c} AS c" for name, kind, c in [("matrix", 0, 0), ("off-diagonal", 1, 0), *((f"channel {c}", 2, c) for c in range(channels)), *((f"quarter {c}", 3, c) for c in range(4))])
    parts = step(
        f"SELECT p.part, x.k, sum(CASE WHEN p.kind = 2 THEN x.d1 ELSE x.d2 END) AS d, sum(CASE WHEN p.kind = 2 THEN x.s1 ELSE x.s2 END) AS s FROM {{x}} x CROSS JOIN ({kinds}) p CROSS JOIN {{e}} e "
        "WHERE p.kind = 0 OR (p.kind = 1 AND x.i <> x.j) OR (p.kind = 2 AND x.i = p.c AND x.j = p.c) OR (p.kind = 3 AND x.freq >= CASE p.c WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END "
        "AND x.freq <= CASE p.c WHEN 0 THEN f1 WHEN 1 THEN f2 WHEN 2 THEN f3 ELSE f4 END) GROUP BY p.part, x.k",
        x=x, e=edge,
    )
    return step("SELECT part, d / s AS riae FROM {a}", a=integrals(parts, ["d", "s"], f"{spacing!r}e0", "part"))


def truth_metrics(q: Step, truth: Step, spacing: float) -> Step:
    """(riae, l2, coverage) of quantiles (k, q05, q50, q95) against a truth (k, value)."""
    x = step("SELECT t.k, abs(q.q50 - t.value) AS d, t.value AS s, (q.q50 - t.value) * (q.q50 - t.value) AS d2, t.value * t.value AS s2 FROM {t} t JOIN {q} q ON q.k = t.k", t=truth, q=q)
    return step("SELECT d / s AS riae, sqrt(d2 / s2) AS l2, coverage FROM {a} CROSS JOIN {c}", a=integrals(x, ["d", "s", "d2", "s2"], f"{spacing!r}e0"), c=coverage(q, truth))


def run_summary(runs: Step) -> Step:
    """Runs (mode, seed, metric) by mode: seeds, mean, sample deviation, least and largest."""
    return step("SELECT mode, count(DISTINCT seed) AS seeds, avg(metric) AS mean, stddev_samp(metric) AS sd, min(metric) AS lo, max(metric) AS hi FROM {r} GROUP BY mode", r=runs)


def factors(names: Step) -> Step:
    """(name, factor): the row of the Cholesky factor that a variable's name tells, empty if it tells none."""
    return step("SELECT name, $x(name, '(?:delta|theta_re|theta_im|block)_([0-9]+)') AS factor FROM {n}", n=names)


def elbo_window(trace: Step, window: int, tail: int) -> Step:
    """(factor, improvement, slope) of losses (factor, step, loss): the fall over the last window, and the slope over the tail."""
    x = step("SELECT factor, step, loss, row_number() OVER (PARTITION BY factor ORDER BY step DESC) AS back FROM {t}", t=trace)
    return step(f"SELECT factor, max(CASE WHEN back = {window} THEN loss END) - max(CASE WHEN back = 1 THEN loss END) AS improvement, regr_slope(CASE WHEN back <= {tail} THEN loss END, CAST(step AS DOUBLE)) AS slope FROM {{x}} GROUP BY factor", x=x)


def thin_even(draws: Step, keep: int) -> Step:
    ids = step("SELECT draw, row_number() OVER (ORDER BY draw) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT draw FROM {d})", d=draws)
    return step(f"SELECT DISTINCT i.draw FROM {{i}} i JOIN $seq(0, {keep - 1}) g ON i.r = CAST(floor(g.v * (i.n - 1) / {max(keep - 1, 1)}e0) AS BIGINT)", i=ids)


def thin_stride(draws: Step, thin: int) -> Step:
    return step(f"SELECT draw FROM (SELECT draw, row_number() OVER (ORDER BY draw) - 1 AS r FROM (SELECT DISTINCT draw FROM {{d}})) WHERE r % {thin} = 0", d=draws)
