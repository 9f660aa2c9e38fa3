"""Frequency filters, coarse graining and alignment of grids, as SQL steps."""

from __future__ import annotations

from ..plans.steps import Step, step


def cut(x: Step, lo: float, hi: float) -> Step:
    if hi < lo:
        raise ValueError("cut needs lo <= hi")
    return step(f"SELECT * FROM {{x}} WHERE freq >= {lo!r}e0 AND freq <= {hi!r}e0", x=x)


def band_limit(x: Step, lo: float, hi: float) -> Step:
    """The band clamped to the grid.  If its borders are swapped, the upper one counts for both and must be a bin: then that bin
    stays, and else nothing does."""
    edge = step("SELECT min(freq) AS f0, max(freq) AS f1 FROM {x}", x=x)
    if hi < lo:
        return step(f"SELECT x.* FROM {{x}} x CROSS JOIN {{e}} WHERE abs(freq - greatest(least({hi!r}e0, f1), f0)) < 1e-12", x=x, e=edge)
    return step(f"SELECT x.* FROM {{x}} x CROSS JOIN {{e}} WHERE freq >= greatest({lo!r}e0, f0) AND freq <= least({hi!r}e0, f1)", x=x, e=edge)


def highpass(x: Step, lo: float) -> Step:
    return step(f"SELECT * FROM {{x}} WHERE freq > {lo!r}e0", x=x)


def interior(x: Step) -> Step:
    """Without the first and the last bin, if there are more than three."""
    edge = step("SELECT min(k) AS k0, max(k) AS k1, count(DISTINCT k) AS n FROM {x}", x=x)
    return step("SELECT x.* FROM {x} x CROSS JOIN {e} WHERE n <= 3 OR (k > k0 AND k < k1)", x=x, e=edge)


def bands(pairs: list[tuple[float, float]]) -> Step:
    return step(" UNION ALL ".join(f"SELECT CAST({a!r} AS DOUBLE) AS lo, CAST({b!r} AS DOUBLE) AS hi" for a, b in pairs))


def merge_bands(b: Step) -> Step:
    """Swapped borders put right, sorted, overlapping or touching bands merged."""
    right = step("SELECT least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM {b}", b=b)
    reach = step("SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {r}", r=right)
    group = step("SELECT lo, hi, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {r}", r=reach)
    return step("SELECT min(lo) AS lo, max(hi) AS hi FROM {g} GROUP BY g", g=group)


def exclude(x: Step, b: Step) -> Step:
    """Rows in no band; borders belong to the band."""
    return step("SELECT x.* FROM {x} x WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE x.freq >= b.lo AND x.freq <= b.hi)", x=x, b=merge_bands(b))


def null_bands(travel_time: float, lo: float, hi: float, half_width: float) -> Step:
    """Bands around the nulls k / (4 T) that lie between lo and hi."""
    gap = 1 / (4 * travel_time)
    first, last = int(-(-lo // gap)), int(hi // gap)
    return step(f"SELECT g.v AS n, g.v * {gap!r}e0 AS freq, g.v * {gap!r}e0 - {half_width!r}e0 AS lo, g.v * {gap!r}e0 + {half_width!r}e0 AS hi FROM $seq({max(first, 1)}, {last}) g")


def coarse_bins(x: Step, nh: int) -> Step:
    """(h, freq, n): groups of nh bins and the frequency of the member in the middle (the earlier one of two)."""
    middle = nh // 2 if nh % 2 else nh // 2 - 1
    placed = _placed(x)
    return step(f"SELECT CAST(floor(p / {nh}e0) AS BIGINT) AS h, max(CASE WHEN p % {nh} = {middle} THEN freq END) AS freq, count(*) AS n FROM (SELECT DISTINCT k, freq, p FROM {{p}}) GROUP BY floor(p / {nh}e0)", p=placed)


def _placed(x: Step) -> Step:
    """x with p, the place of its bin: bins are dense, so it is k less the first k, and no row waits for another."""
    return step("SELECT x.*, k - k0 AS p FROM {x} x CROSS JOIN (SELECT min(k) AS k0 FROM {x})", x=x)


def resolve_bins(n: int, nc: int | None = None, nh: int | None = None) -> tuple[int, int]:
    """(nc, nh) from exactly one of them, which must divide n."""
    if (nc is None) == (nh is None):
        raise ValueError("give exactly one of nc and nh")
    given = nc if nc is not None else nh
    if isinstance(given, bool) or not isinstance(given, int) or given < 1:
        raise ValueError("nc and nh are positive whole numbers")
    if n % given:
        near = min((d for d in range(1, n + 1) if n % d == 0), key=lambda d: (abs(d - given), d))
        raise ValueError(f"{given} does not divide {n}; the nearest that does is {near}")
    return (given, n // given) if nc is not None else (n // given, given)


def coarse_power(x: Step, nh: int) -> Step:
    """Power summed within groups of nh bins."""
    placed = step(f"SELECT power, freq, CAST(floor(p / {nh}e0) AS BIGINT) AS h FROM {{x}}", x=_placed(x))
    return step("SELECT s.h, b.freq, s.power FROM (SELECT h, sum(power) AS power FROM {p} GROUP BY h) s JOIN {b} b ON b.h = s.h", p=placed, b=coarse_bins(x, nh))


def coarse_wishart(y: Step, nh: int) -> Step:
    placed = step(f"SELECT i, j, re, im, CAST(floor(p / {nh}e0) AS BIGINT) AS h FROM {{y}}", y=_placed(y))
    return step("SELECT s.h AS k, b.freq, i, j, re, im FROM (SELECT h, i, j, sum(re) AS re, sum(im) AS im FROM {p} GROUP BY h, i, j) s JOIN {b} b ON b.h = s.h", p=placed, b=coarse_bins(y, nh))


def interpolate(source: Step, grid: Step) -> Step:
    """(freq, value) at the grid's frequencies: the first row of each source frequency, straight lines between, ends held."""
    one = step("SELECT freq, min_by(value, k) AS value FROM {s} GROUP BY freq", s=source)
    seg = step("SELECT freq AS f0, value AS v0, lead(freq) OVER (ORDER BY freq) AS f1, lead(value) OVER (ORDER BY freq) AS v1 FROM {o}", o=one)
    edge = step("SELECT min(freq) AS lo, max(freq) AS hi, min_by(value, freq) AS vlo, max_by(value, freq) AS vhi FROM {o}", o=one)
    inner = step("SELECT g.freq, v0 + (v1 - v0) * (g.freq - f0) / (f1 - f0) AS value FROM {g} g JOIN {s} s ON g.freq >= s.f0 AND g.freq < s.f1", g=grid, s=seg)
    return step(
        "SELECT g.freq, CASE WHEN g.freq <= lo THEN vlo WHEN g.freq >= hi THEN vhi ELSE i.value END AS value FROM {g} g LEFT JOIN {i} i ON i.freq = g.freq CROSS JOIN {e}", g=grid, i=inner, e=edge
    )
