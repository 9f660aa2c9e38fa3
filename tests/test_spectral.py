"""Queries against their SQL in DuckDB, and kernels against plain numpy."""

import glob
import os

import duckdb
import numpy as np
import pytest

from lumenfreq.operators import bands, kernels
from lumenfreq.plans import catalogue

SF = "/root/testdata/sf0.01"
SOME = ["series_hourly_events", "standardise_multivar", "detrend_linear", "periodogram", "fft_periodogram", "wishart_blocks", "coarse_grain_wishart", "merge_bands", "interp_truth", "cholesky_components_3ch", "uniform_band", "inflation_factor", "bspline_gram"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    a, b = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def test_basis_is_a_partition_of_unity():
    assert np.allclose(kernels.bspline(np.linspace(0, 1, 50), np.linspace(0, 1, 8), 3).sum(axis=1), 1)


def test_penalty_has_the_null_space_of_straight_lines():
    p = kernels.penalty(np.linspace(0, 1, 8), eps=0)
    assert (np.abs(np.linalg.eigvalsh(p)) < 1e-10).sum() == 2


def test_coarse_bins_must_divide():
    assert bands.resolve_bins(90, nh=3) == (30, 3)
    with pytest.raises(ValueError):
        bands.resolve_bins(90, nh=7)
    with pytest.raises(ValueError):
        bands.resolve_bins(90, nc=3, nh=3)
