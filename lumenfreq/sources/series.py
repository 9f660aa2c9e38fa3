"""Regular series from event and order tables: (channel, t_idx, y), gaps filled with 0.

A grid begins and ends with its table: at the first and last day that has rows (hourly grids are of whole days).
"""

from __future__ import annotations

from ..plans.steps import Step, step


def gridded(rows: Step, whole: int = 1) -> Step:
    """rows (name, place, y) to (channel, t_idx, y): channels in the order of their names, sums at each place of the grid.

    whole: the grid is made of so many places at a time.
    """
    channels = step("SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS channel FROM (SELECT DISTINCT name FROM {r})", r=rows)
    sums = step("SELECT name, place, sum(y) AS y FROM {r} GROUP BY name, place", r=rows)
    edge = step(f"SELECT floor(min(place) / {whole}e0) * {whole} AS lo, (floor(max(place) / {whole}e0) + 1) * {whole} - 1 AS hi FROM {{s}}", s=sums)
    grid = step("SELECT $span(lo, hi) AS place, CAST(lo AS BIGINT) AS lo FROM {e}", e=edge)
    return step(
        "SELECT c.channel, g.place - g.lo AS t_idx, coalesce(s.y, CAST(0 AS DOUBLE)) AS y FROM {c} c CROSS JOIN {g} g LEFT JOIN {s} s ON s.name = c.name AND s.place = g.place",
        c=channels, g=grid, s=sums,
    )


def hourly_events() -> Step:
    return gridded(step("SELECT event_type AS name, CAST(floor($us(ts) / 3600000000e0) AS BIGINT) AS place, value AS y FROM {t}", t="events"), 24)


def daily_orders() -> Step:
    return gridded(step("SELECT 'all' AS name, CAST(floor($us(o_orderdate) / 86400000000e0) AS BIGINT) AS place, o_totalprice AS y FROM {t}", t="orders"))


def daily_lineitem() -> Step:
    return gridded(step("SELECT l_returnflag AS name, CAST(floor($us(l_shipdate) / 86400000000e0) AS BIGINT) AS place, l_quantity AS y FROM {t}", t="lineitem"))
