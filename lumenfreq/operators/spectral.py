"""Standardising, tapering, transforms and matrix statistics of series (channel, t_idx, y), as SQL steps.

Spectral matrices are long: (k, freq, i, j, re, im), one row for each pair of channels.  The DFT is a join of samples
with frequencies and a sum, which Spark aggregates partially before it shuffles; blocks keep the length bounded, so the
work grows in proportion to the series.
"""

from __future__ import annotations

from ..plans.steps import Step, step

TAU = "(2e0 * pi())"


def total(series: Step) -> Step:
    """All channels summed: one univariate series (t_idx, y)."""
    return step("SELECT t_idx, sum(y) AS y FROM {s} GROUP BY t_idx", s=series)


def standardise(series: Step) -> Step:
    """Univariate: (y - mean) / population deviation, with both and the scaling factor."""
    m = step("SELECT avg(y) AS mean, stddev_pop(y) AS std FROM {s}", s=series)
    return step("SELECT t_idx, (y - mean) / std AS y, mean, std, std * std AS scaling_factor FROM {s} CROSS JOIN {m}", s=series, m=m)


def standardise_channels(series: Step) -> Step:
    """By channel; the scaling factor is the variance of all values together."""
    m = step("SELECT channel, avg(y) AS mean, stddev_pop(y) AS std FROM {s} GROUP BY channel", s=series)
    g = step("SELECT var_pop(y) AS scaling_factor FROM {s}", s=series)
    return step("SELECT s.channel, t_idx, (y - mean) / std AS y, mean, std, scaling_factor FROM {s} s JOIN {m} m ON s.channel = m.channel CROSS JOIN {g} g", s=series, m=m, g=g)


def blocks(series: Step, length: int) -> Step:
    """(channel, block, t, y); samples beyond the last whole block go."""
    n = step("SELECT CAST(floor((max(t_idx) + 1) / {n}e0) AS BIGINT) AS nb FROM {{s}}".format(n=length), s=series)
    return step(f"SELECT channel, CAST(floor(t_idx / {length}e0) AS BIGINT) AS block, t_idx % {length} AS t, y FROM {{s}} CROSS JOIN {{n}} WHERE t_idx < nb * {length}", s=series, n=n)


def detrend(blocked: Step, kind: str = "constant") -> Step:
    if kind == "linear":
        m = step("SELECT channel, block, regr_slope(y, CAST(t AS DOUBLE)) AS slope, regr_intercept(y, CAST(t AS DOUBLE)) AS base FROM {b} GROUP BY channel, block", b=blocked)
        return step("SELECT b.channel, b.block, t, y - base - slope * t AS y FROM {b} b JOIN {m} m ON b.channel = m.channel AND b.block = m.block", b=blocked, m=m)
    m = step("SELECT channel, block, avg(y) AS base FROM {b} GROUP BY channel, block", b=blocked)
    return step("SELECT b.channel, b.block, t, y - base AS y FROM {b} b JOIN {m} m ON b.channel = m.channel AND b.block = m.block", b=blocked, m=m)


def window_weight(kind: str, length: int, alpha: float = 0.1) -> str:
    """The weight of sample t of a periodic window, as an expression over t."""
    if kind == "rect":
        return "CAST(1 AS DOUBLE)"
    if kind == "hann":
        return f"(5e-1 - 5e-1 * cos({TAU} * t / {length}e0))"
    if kind == "tukey":
        edge = f"({alpha!r}e0 * {length}e0)"
        return (
            f"(CASE WHEN t <= floor({edge} / 2e0) THEN 5e-1 * (1e0 + cos(pi() * (-1e0 + 2e0 * t / {edge}))) "
            f"WHEN t >= {length}e0 - floor({edge} / 2e0) THEN 5e-1 * (1e0 + cos(pi() * (-2e0 / {alpha!r}e0 + 1e0 + 2e0 * t / {edge}))) ELSE 1e0 END)"
        )
    raise ValueError(f"unknown window {kind!r}")


def window(kind: str, length: int) -> Step:
    return step(f"SELECT t, {window_weight(kind, length)} AS weight FROM (SELECT v AS t FROM $seq(0, {length - 1}) g)")


def nenbw(w: Step, length: int) -> Step:
    return step(f"SELECT {length}e0 * sum(weight * weight) / (sum(weight) * sum(weight)) AS enbw FROM {{w}}", w=w)


def length_of(series: Step) -> Step:
    return step("SELECT max(t_idx) + 1 AS n FROM {s}", s=series)


def head(series: Step, n: int) -> Step:
    """The first n samples."""
    return step(f"SELECT * FROM {{s}} WHERE t_idx < {n}", s=series)


def dft(series: Step) -> Step:
    """(k, n, re, im) of a univariate series of n samples for k = 1 .. n / 2, by definition: for short series (see kernels.py for others)."""
    bins = step("SELECT $span(1, floor(n / 2e0)) AS k, n FROM {n}", n=length_of(series))
    angle = f"({TAU} * ((t_idx * k) % n) / n)"
    return step(f"SELECT k, n, sum(y * cos({angle})) AS re, -sum(y * sin({angle})) AS im FROM {{s}} CROSS JOIN {{g}} GROUP BY k, n", s=series, g=bins)


def periodogram(series: Step, fs: float = 1.0) -> Step:
    """One-sided: 2 |rfft|^2 / n / fs at every kept bin, the last included."""
    return step(f"SELECT k, k * {fs}e0 / n AS freq, 2e0 * (re * re + im * im) / n / {fs}e0 AS power FROM {{d}}", d=dft(series))


def block_dft(blocked: Step, length: int, kind: str = "hann") -> Step:
    """(channel, block, k, re, im) of tapered blocks."""
    tapered = step(f"SELECT channel, block, t, y * {window_weight(kind, length)} AS y FROM {{b}}", b=blocked)
    angle = f"({TAU} * ((t * g.v) % {length}) / {length}e0)"
    return step(
        f"SELECT channel, block, g.v AS k, sum(y * cos({angle})) AS re, -sum(y * sin({angle})) AS im FROM {{x}} CROSS JOIN $seq(1, {length // 2}) g GROUP BY channel, block, g.v", x=tapered
    )


def wishart(blocked: Step, length: int, kind: str = "hann", fs: float = 1.0) -> Step:
    """Y = sum over blocks of d d^H, scaled to one-sided power times duration; the last bin of an even length is halved."""
    power = step("SELECT sum(weight * weight) AS w2 FROM {w}", w=window(kind, length))
    scale = f"(2e0 / (w2 * {fs}e0) * {length / fs}e0 * (CASE WHEN {length} % 2 = 0 AND a.k = {length // 2} THEN 5e-1 ELSE 1e0 END))"
    return step(
        f"SELECT a.k, a.k * {fs}e0 / {length}e0 AS freq, a.channel AS i, b.channel AS j, sum({scale} * (a.re * b.re + a.im * b.im)) AS re, sum({scale} * (a.im * b.re - a.re * b.im)) AS im "
        "FROM {d} a JOIN {d} b ON a.block = b.block AND a.k = b.k CROSS JOIN {p} GROUP BY a.k, a.channel, b.channel",
        d=block_dft(blocked, length, kind), p=power,
    )


def to_psd(y: Step, blocked: Step, nh: int, duration: float, factor: float = 1.0) -> Step:
    """Y / (blocks x nh x duration); blocked: the blocks that y sums over."""
    nb = step("SELECT max(block) + 1 AS nb FROM {b}", b=blocked)
    return step(f"SELECT k, freq, i, j, re * {factor}e0 / (nb * {nh}e0 * {duration}e0) AS re, im * {factor}e0 / (nb * {nh}e0 * {duration}e0) AS im FROM {{y}} CROSS JOIN {{n}}", y=y, n=nb)


def conjugate(psd: Step) -> Step:
    """From one order of cross-spectra (x conj y) to the other (conj x y)."""
    return step("SELECT k, freq, i, j, re, CASE WHEN i = j THEN 0e0 ELSE -im END AS im FROM {p}", p=psd)


def block_matrices(blocked: Step, length: int, kind: str = "hann", fs: float = 1.0) -> Step:
    """(draw, k, freq, i, j, re, im): the spectral matrix of each block for itself, in density units."""
    power = step("SELECT sum(weight * weight) AS w2 FROM {w}", w=window(kind, length))
    scale = f"(2e0 / (w2 * {fs}e0) * (CASE WHEN {length} % 2 = 0 AND a.k = {length // 2} THEN 5e-1 ELSE 1e0 END))"
    return step(
        f"SELECT a.block AS draw, a.k, a.k * {fs}e0 / {length}e0 AS freq, a.channel AS i, b.channel AS j, {scale} * (a.re * b.re + a.im * b.im) AS re, {scale} * (a.im * b.re - a.re * b.im) AS im "
        "FROM {d} a JOIN {d} b ON a.block = b.block AND a.k = b.k CROSS JOIN {p}",
        d=block_dft(blocked, length, kind), p=power,
    )


def physical(psd: Step, scaled: Step) -> Step:
    """Spectral matrices of standardised channels back in the units of the channels."""
    std = step("SELECT DISTINCT channel, std FROM {s}", s=scaled)
    return step("SELECT k, freq, i, j, re * a.std * b.std AS re, im * a.std * b.std AS im FROM {p} p JOIN {s} a ON a.channel = p.i JOIN {s} b ON b.channel = p.j", p=psd, s=std)


def coherence(psd: Step, squared: bool = True) -> Step:
    # The two diagonals of a pair come from windows over one frequency's rows: one shuffle by k, no join with itself.
    rows = step("SELECT k, freq, i, j, re, im, max(CASE WHEN i = j THEN re END) OVER (PARTITION BY k, i) AS si, max(CASE WHEN i = j THEN re END) OVER (PARTITION BY k, j) AS sj FROM {p}", p=psd)
    value = "least(1e0, greatest(0e0, (re * re + im * im) / (si * sj)))"
    value = value if squared else f"sqrt({value})"
    return step(f"SELECT k, freq, i, j, CASE WHEN i = j THEN 1e0 WHEN si * sj = 0e0 THEN 0e0 ELSE {value} END AS coh FROM {{r}}", r=rows)


def segments(series: Step, length: int, overlap: int) -> Step:
    """(channel, block, t, y): overlapping segments.  A sample goes to its own segments only: no join with all of them."""
    hop = length - overlap
    placed = step(f"SELECT channel, t_idx, y, greatest(0, floor((t_idx - {length}) / {hop}e0) + 1) AS lo, least(floor(t_idx / {hop}e0), floor((n - {length}) / {hop}e0)) AS hi FROM {{s}} CROSS JOIN {{n}}", s=series, n=length_of(series))
    spread = step("SELECT channel, t_idx, y, $span(lo, hi) AS block FROM {p} WHERE lo <= hi", p=placed)
    return step(f"SELECT channel, block, t_idx - block * {hop} AS t, y FROM {{s}}", s=spread)


def welch(series: Step, length: int, overlap: int, kind: str = "hann", fs: float = 1.0) -> Step:
    """Averaged cross-spectra of overlapping segments, density scaling, constant detrend.  Cross-spectra are conj(x) y, the
    order that Welch estimates usually have; Wishart matrices here are x conj(y) (see conjugate)."""
    parts = segments(series, length, overlap)
    return conjugate(to_psd(wishart(detrend(parts), length, kind, fs), parts, 1, length / fs))


def blocked_welch(series: Step, block: int, length: int, overlap: int) -> Step:
    """Welch estimates within each whole block, averaged over the blocks."""
    own = step("SELECT channel, block, t AS t_idx, y FROM {b}", b=blocks(series, block))
    hop, each = length - overlap, (block - length) // (length - overlap) + 1
    placed = step(f"SELECT channel, block, t_idx, y, greatest(0, floor((t_idx - {length}) / {hop}e0) + 1) AS lo, least(floor(t_idx / {hop}e0), {each - 1}) AS hi FROM {{s}}", s=own)
    spread = step("SELECT channel, block, t_idx, y, $span(lo, hi) AS part FROM {p} WHERE lo <= hi", p=placed)
    parts = step(f"SELECT channel, block * {each} + part AS block, t_idx - part * {hop} AS t, y FROM {{s}}", s=spread)
    return conjugate(to_psd(wishart(detrend(parts), length), parts, 1, length))


def rotate(psd: Step, matrix: list[list[float]]) -> Step:
    """M S M^T for a real matrix M."""
    rows = " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS a, CAST({i} AS BIGINT) AS i, CAST({v!r} AS DOUBLE) AS m" for a, r in enumerate(matrix) for i, v in enumerate(r))
    return step("SELECT k, freq, x.a AS i, z.a AS j, sum(x.m * z.m * re) AS re, sum(x.m * z.m * im) AS im FROM {p} p JOIN {m} x ON x.i = p.i JOIN {m} z ON z.i = p.j GROUP BY k, freq, x.a, z.a", p=psd, m=step(rows))


def amplitude_range(series: Step) -> Step:
    """Least and largest value, rounded to three significant digits."""
    digits = "CASE WHEN {x} = 0e0 THEN 0e0 ELSE round({x} / pow(1e1, floor(log10(abs({x}))) - 2e0), 0) * pow(1e1, floor(log10(abs({x}))) - 2e0) END"
    return step(f"SELECT {digits.format(x='lo')} AS lo, {digits.format(x='hi')} AS hi FROM (SELECT min(y) AS lo, max(y) AS hi FROM {{s}})", s=series)


def stationarity(series: Step) -> Step:
    """One verdict for all channels, from the drift between the two halves: means by the whole deviation, variances, and covariances
    by the Frobenius norm.  Fewer than 32 samples pass."""
    n = length_of(series)
    h = step("SELECT channel, t_idx, y, CASE WHEN t_idx < floor(n / 2e0) THEN 0 ELSE 1 END AS h, n FROM {s} CROSS JOIN {n} WHERE t_idx < floor(n / 2e0) OR t_idx >= n - floor(n / 2e0)", s=series, n=n)
    m = step("SELECT channel, h, avg(y) AS m, var_pop(y) AS v FROM {h} GROUP BY channel, h", h=h)
    sd = step("SELECT channel, stddev_pop(y) AS sd FROM {s} GROUP BY channel", s=series)
    by = step(
        "SELECT max(abs(b.m - a.m) / (sd + 1e-12)) AS z, max(greatest(a.v, b.v) / (least(a.v, b.v) + 1e-12)) AS r FROM {m} a JOIN {m} b ON b.channel = a.channel AND a.h = 0 AND b.h = 1 JOIN {d} d ON d.channel = a.channel",
        m=m, d=sd,
    )
    cov = step("SELECT a.channel AS i, b.channel AS j, a.h, covar_samp(a.y, b.y) AS c FROM {h} a JOIN {h} b ON b.t_idx = a.t_idx GROUP BY a.channel, b.channel, a.h", h=h)
    drift = step("SELECT sqrt(sum((a.c - b.c) * (a.c - b.c))) / (sqrt(sum((a.c + b.c) * (a.c + b.c) / 4e0)) + 1e-12) AS d FROM {c} a JOIN {c} b ON b.i = a.i AND b.j = a.j AND a.h = 0 AND b.h = 1", c=cov)
    x = step("SELECT CASE WHEN n < 32 THEN 0e0 ELSE z END AS z, CASE WHEN n < 32 THEN 1e0 ELSE r END AS r, CASE WHEN n < 32 THEN 0e0 ELSE d END AS d, CASE WHEN n < 32 THEN n ELSE 2 * floor(n / 2e0) END AS used FROM {b} CROSS JOIN {d} CROSS JOIN {n}", b=by, d=drift, n=n)
    return step("SELECT z AS max_mean_shift_z, r AS max_var_ratio, d AS covariance_rel_drift, used AS n_samples_used, CASE WHEN z < 75e-2 AND r < 2e0 AND d < 5e-1 THEN 1 ELSE 0 END AS passes FROM {x}", x=x)


def smooth(psd: Step, width: int) -> Step:
    """Centred moving averages whose window repeats the first and the last bin: of logs on the diagonal, plain off it."""
    half = width // 2
    edge = step("SELECT min(k) AS k0, max(k) AS k1 FROM {p}", p=psd)
    near = step(f"SELECT k, freq, i, j, least(greatest(k + o.v, k0), k1) AS q FROM {{p}} CROSS JOIN {{e}} CROSS JOIN $seq({-half}, {half}) o", p=psd, e=edge)
    return step(
        "SELECT n.k, n.freq, n.i, n.j, CASE WHEN n.i = n.j THEN exp(avg(ln(greatest(p.re, 1e-300)))) ELSE avg(p.re) END AS re, CASE WHEN n.i = n.j THEN 0e0 ELSE avg(p.im) END AS im "
        "FROM {n} n JOIN {p} p ON p.k = n.q AND p.i = n.i AND p.j = n.j GROUP BY n.k, n.freq, n.i, n.j",
        n=near, p=psd,
    )


def inverse(periodogram: Step) -> Step:
    """(t, y): the inverse real transform of the powers taken as m coefficients, of length 2 (m - 1)."""
    m = step("SELECT max(k) AS m, 2 * (max(k) - 1) AS n FROM {p}", p=periodogram)
    places = step("SELECT $span(0, n - 1) AS t, m, n FROM {m}", m=m)
    return step(f"SELECT t, sum(power * (CASE WHEN k = 1 OR k = m THEN 1e0 ELSE 2e0 END) * cos({TAU} * (((k - 1) * t) % n) / n)) / n AS y FROM {{g}} CROSS JOIN {{p}} GROUP BY t, n", g=places, p=periodogram)
