"""The operators on DataFrames of one's own.

    apply(spectral.periodogram, series)                          # (t_idx, y) -> (k, freq, power)
    apply(spectral.welch, series, 1024, 512)                     # (channel, t_idx, y) -> (k, freq, i, j, re, im)
    apply(lambda s: spectral.coherence(...), series)

Frames have the columns that an operator's docstring names; results are lazy, and Catalyst sees one plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.steps import Step, step


def given(frame: DataFrame) -> Step:
    """A DataFrame as the input of operators."""
    return step("SELECT * FROM {t}", t=frame)


def apply(operator: Callable[..., Step], frame: DataFrame, *args, **kw) -> DataFrame:
    """operator(frame, *args, **kw) as a DataFrame; further DataFrames among the arguments are inputs too."""
    args = [given(a) if isinstance(a, DataFrame) else a for a in args]
    kw = {k: given(v) if isinstance(v, DataFrame) else v for k, v in kw.items()}
    return operator(given(frame), *args, **kw).frame(frame.sparkSession, "")
