"""The named queries.  Each is a plan of steps; the same plan gives the DataFrame and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import generators as G
from ..operators import kernels as K
from ..operators import knots as Z
from ..operators import matrices as M
from ..operators import posterior as P
from ..operators import sampler as N
from ..operators import spectral as S
from ..operators import splines as L
from ..operators import wishart as W
from ..sources import series as X
from ..streaming import series as T

from .steps import Step, step

#: Samples of a block, in all block plans.
LB = 180
TAU = S.TAU


def _plans() -> dict[str, tuple[Step, str]]:
    """name -> (plan, columns); a column is name:type with i for ids, d for doubles, s for strings."""
    ev, orders, items = X.hourly_events(), X.daily_orders(), X.daily_lineitem()
    tot = S.total(ev)
    std1, std = S.standardise(tot), S.standardise_channels(ev)
    blocked, item_blocks = S.blocks(std, LB), S.detrend(S.blocks(S.standardise_channels(items), LB))
    flat = S.detrend(blocked)
    y = S.wishart(flat, LB)
    psd = S.to_psd(y, blocked, 1, LB)
    y3 = S.wishart(item_blocks, LB)
    psd3 = S.to_psd(y3, item_blocks, 1, LB)
    pg = S.periodogram(std1)
    welch = S.welch(std, 360, 180)
    welch180 = S.conjugate(S.welch(std, LB, LB // 2))  # in the order of the Wishart matrices
    null = B.bands([(0.08, 0.05), (0.075, 0.12), (0.3, 0.31), (0.31, 0.32), (0.4, 0.41)])
    diag = step("SELECT k, freq, re AS value FROM {p} WHERE i = 0 AND j = 0", p=psd)
    truth = step("SELECT k, freq, re AS value FROM {p} WHERE i = 0 AND j = 0", p=welch180)
    est_same = step("SELECT p.k, p.freq, p.i, p.j, p.re, p.im FROM {p} p", p=psd)
    bins = step("SELECT $span(0, floor(n / 2e0) - 1) AS k, n FROM {n}", n=S.length_of(std1))
    grid = step("SELECT k, k / (floor(n / 2e0) - 1e0) AS u FROM {b}", b=bins)
    basis = L.basis(L.knots_uniform(10), grid, n_knots=10)
    weights = step("SELECT v AS b, sin(v + 1e0) AS w FROM $seq(0, 11) g")
    log_psd = step("SELECT k + 1 AS k, log_psd FROM {e}", e=L.evaluate(basis, weights))
    draws = step(
        f"SELECT user_id % 40 AS draw, CAST(floor($us(ts) / 3600000000e0) AS BIGINT) % 24 AS k, (CAST(floor($us(ts) / 3600000000e0) AS BIGINT) % 24) / 24e0 AS freq, sum(value) AS value FROM {{t}} "
        f"GROUP BY user_id % 40, CAST(floor($us(ts) / 3600000000e0) AS BIGINT) % 24", t="events",
    )
    draw_truth = step("SELECT k, avg(value) AS value FROM {d} GROUP BY k", d=draws)
    q = P.quantiles(draws)
    q_est = step("SELECT k, q50 AS value FROM {q}", q=q)
    coarse_grid = step("SELECT DISTINCT freq FROM {x}", x=S.periodogram(S.head(std1, 100)))
    source = step("SELECT k, freq, power AS value FROM {p}", p=pg)
    aet = [[-(0.5**0.5), 0.0, 0.5**0.5], [6**-0.5, -2 * 6**-0.5, 6**-0.5], [3**-0.5, 3**-0.5, 3**-0.5]]
    fgrid = step("SELECT v AS k, v / 1000e0 AS freq FROM $seq(1, 500) g")
    lgrid = step("SELECT v AS k, pow(1e1, -4e0 + 3e0 * v / 200e0) AS freq FROM $seq(0, 200) g")
    eig3 = M.eigenvalues3(psd3)
    rat = M.ratios(eig3)
    med = step("SELECT k, freq, power, $pct(power, 0.5) OVER (ORDER BY k ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS med FROM {p}", p=pg)
    lines_ = step("SELECT k, power / med AS ratio FROM {m}", m=med)
    iqr = step("SELECT $pct(ratio, 0.75) AS q3, $pct(ratio, 0.75) - $pct(ratio, 0.25) AS iqr FROM {l}", l=lines_)
    mat = "k:i freq:d i:i j:i re:d im:d"
    # Draws of spectral matrices: blocks averaged in five groups.
    single = S.block_matrices(item_blocks, LB)
    matrix_draws = step("SELECT draw % 5 AS draw, k, freq, i, j, avg(re) AS re, avg(im) AS im FROM {s} GROUP BY draw % 5, k, freq, i, j", s=single)
    truth3 = S.conjugate(S.welch(S.standardise_channels(items), LB, LB // 2))
    coh_ci = P.coherence_quantiles(matrix_draws)
    row_params = step("SELECT k, sin(k / 9e0) / 2e0 AS log_d, 3e-1 * cos(k / 7e0) AS t, 1e-1 * sin(k / 5e0) AS ti FROM (SELECT DISTINCT k FROM {y})", y=y)
    runs = step("SELECT event_type AS mode, user_id % 10 AS seed, avg(value) AS metric FROM {t} GROUP BY event_type, user_id % 10", t="events")
    names = step(" UNION ALL ".join(f"SELECT '{n}' AS name" for n in ("weights_delta_0", "phi_delta_1", "weights_theta_re_1_0", "delta_theta_im_2_1", "log_likelihood_block_2", "lp")))
    trace = step("SELECT f.factor, g.v AS step, 1e3 / (g.v + 1e0) + f.o * sin(g.v / 3e0) AS loss FROM (SELECT 'a' AS factor, 1e0 AS o UNION ALL SELECT 'b' AS factor, 2e0 AS o) f CROSS JOIN $seq(0, 399) g")
    stats = step("SELECT user_id % 3 AS chain, user_id % 20 AS draw, event_type AS factor, avg(value) AS energy, avg(abs(sin(value))) AS accept, max(CASE WHEN value > 3e0 THEN 1 ELSE 0 END) AS diverging FROM {t} GROUP BY user_id % 3, user_id % 20, event_type", t="events")
    durations = step("SELECT user_id % 9 + 1e-1 AS duration, CASE WHEN user_id % 4 = 0 THEN NULL ELSE (user_id % 4) / 4e0 END AS eta, avg(value) AS riae FROM {t} GROUP BY user_id % 9 + 1e-1, CASE WHEN user_id % 4 = 0 THEN NULL ELSE (user_id % 4) / 4e0 END", t="events")
    out: dict[str, tuple[Step, str]] = {
        "series_hourly_events": (ev, "channel:i t_idx:i y:d"),
        "series_daily_orders": (orders, "channel:i t_idx:i y:d"),
        "series_daily_lineitem": (items, "channel:i t_idx:i y:d"),
        "standardise_univar": (std1, "t_idx:i y:d mean:d std:d scaling_factor:d"),
        "standardise_multivar": (std, "channel:i t_idx:i y:d mean:d std:d scaling_factor:d"),
        "detrend_constant": (flat, "channel:i block:i t:i y:d"),
        "detrend_linear": (S.detrend(blocked, "linear"), "channel:i block:i t:i y:d"),
        "block_trim": (S.blocks(std, 168), "channel:i block:i t:i y:d"),
        "taper_hann": (S.window("hann", LB), "t:i weight:d"),
        "taper_tukey": (S.window("tukey", LB), "t:i weight:d"),
        "nenbw": (step("SELECT 'hann' AS kind, enbw FROM {a} UNION ALL SELECT 'tukey' AS kind, enbw FROM {b}", a=S.nenbw(S.window("hann", LB), LB), b=S.nenbw(S.window("tukey", LB), LB)), "kind:s enbw:d"),
        "dft": (step("SELECT k, re, im FROM {d}", d=S.dft(std1)), "k:i re:d im:d"),
        "periodogram": (pg, "k:i freq:d power:d"),
        "periodogram_scaled": (step("SELECT k, freq, power * 3e0 / 2e0 AS power FROM {p}", p=pg), "k:i freq:d power:d"),
        "periodogram_band": (B.band_limit(pg, 0.1, 0.2), "k:i freq:d power:d"),
        "periodogram_band_inverted": (B.band_limit(pg, 0.3, 0.2), "k:i freq:d power:d"),
        "periodogram_highpass": (B.highpass(pg, 0.25), "k:i freq:d power:d"),
        "cut_band": (B.cut(y, 0.1, 0.2), mat),
        "interior_slice": (B.interior(pg), "k:i freq:d power:d"),
        "dominant_periods": (step("SELECT freq, 1e0 / freq AS period_h, power FROM {p} ORDER BY power DESC, k LIMIT 10", p=pg), "freq:d period_h:d power:d"),
        "amplitude_range": (S.amplitude_range(tot), "lo:d hi:d"),
        "block_dft": (S.block_dft(flat, LB), "channel:i block:i k:i re:d im:d"),
        "wishart_blocks": (y, mat),
        "wishart_tukey": (S.wishart(flat, LB, "tukey"), mat),
        "wishart_psd": (S.physical(psd, std), mat),
        "welch_psd": (step("SELECT k, freq, i, re FROM {w} WHERE i = j", w=welch), "k:i freq:d i:i re:d"),
        "welch_csd": (welch, mat),
        "welch_overlay": (B.exclude(B.cut(welch, 0.02, 0.45), null), mat),
        "coherence": (S.coherence(psd), "k:i freq:d i:i j:i coh:d"),
        "magnitude_coherence": (S.coherence(psd, squared=False), "k:i freq:d i:i j:i coh:d"),
        "encode_real": (P.encode_real(psd), "k:i i:i j:i value:d"),
        "coarse_bins": (B.coarse_bins(pg, 3), "h:i freq:d n:i"),
        "coarse_bins_even": (B.coarse_bins(pg, 4), "h:i freq:d n:i"),
        "coarse_grain_power": (B.coarse_power(pg, 3), "h:i freq:d power:d"),
        "coarse_grain_wishart": (B.coarse_wishart(y, 2), mat),
        "merge_bands": (B.merge_bands(null), "lo:d hi:d"),
        "exclude_bands": (B.exclude(pg, null), "k:i freq:d power:d"),
        "null_bands": (B.null_bands(8.3, 0.01, 0.5, 0.002), "n:i freq:d lo:d hi:d"),
        "interp_truth": (B.interpolate(source, coarse_grid), "freq:d value:d"),
        "aet_rotation": (S.rotate(psd3, aet), "k:i freq:d i:i j:i re:d im:d"),
        "ar_psd": (step(f"SELECT k, freq, 2e0 / (pow(1e0 - 9e-1 * cos({TAU} * freq) + 4e-1 * cos(2e0 * {TAU} * freq), 2e0) + pow(9e-1 * sin({TAU} * freq) - 4e-1 * sin(2e0 * {TAU} * freq), 2e0)) AS psd FROM {{g}}", g=fgrid), "k:i freq:d psd:d"),
        "lisa_noise": (step(
            f"SELECT k, freq, log10(pow(1.5e-11, 2e0) * (1e0 + pow(2e-3 / freq, 4e0)) * pow({TAU} * freq / 299792458e0, 2e0)) AS log_oms, "
            f"log10(pow(3e-15, 2e0) * (1e0 + pow(4e-4 / freq, 2e0)) * (1e0 + pow(freq / 8e-3, 4e0)) / pow({TAU} * freq * 299792458e0, 2e0)) AS log_acc FROM {{g}}", g=lgrid), "k:i freq:d log_oms:d log_acc:d"),
        "stationarity_check": (S.stationarity(ev), "max_mean_shift_z:d max_var_ratio:d covariance_rel_drift:d n_samples_used:i passes:i"),
        "eigvals_2ch": (M.eigenvalues2(psd), "k:i freq:d l1:d l2:d"),
        "eigvals_3ch": (eig3, "k:i freq:d l1:d l2:d l3:d"),
        "eig_ratios": (rat, "k:i freq:d ratio:d"),
        "eig_ratio_summary": (M.ratio_summary(rat), "n:i frac_high:d lo:d hi:d q05:d q50:d q95:d"),
        "worst_ratios": (step("SELECT k, freq, ratio FROM {r} WHERE ratio IS NOT NULL ORDER BY ratio DESC, k LIMIT 10", r=rat), "k:i freq:d ratio:d"),
        "eigen_gap_mask": (M.separated(eig3, 0.25), "k:i freq:d l1:d l2:d l3:d"),
        "cholesky_components_2ch": (M.cholesky2(psd), "k:i freq:d log_d0:d t10:d t10i:d log_d1:d"),
        "cholesky_components_3ch": (M.cholesky3(psd3), "k:i freq:d log_d0:d log_d1:d log_d2:d t10:d t10i:d t21:d t21i:d t20:d t20i:d"),
        "reconstruct_psd": (M.reconstruct2(M.cholesky2(psd)), mat),
        "eigen_floor_2ch": (M.floor2(psd, 0.4), "k:i freq:d s00:d s11:d s10:d s10i:d"),
        "pd_repair_2ch": (M.repair2(psd, 0.5), "k:i freq:d s00:d s11:d s10:d s10i:d"),
        "bspline_basis": (basis, "k:i b:i v:d"),
        "bspline_gram": (L.gram(basis), "b:i b2:i v:d"),
        "spline_eval": (L.evaluate(basis, weights), "k:i log_psd:d"),
        "knots_uniform": (L.knots_uniform(10), "idx:i u:d"),
        "knots_log": (L.knots_log(10, 0.01), "idx:i u:d"),
        "knots_density": (Z.knots_density(pg, 10, 360), "idx:i u:d"),
        "line_bins": (step("SELECT k, ratio, CAST(CASE WHEN ratio > q3 + 4e0 * iqr THEN 1 ELSE 0 END AS BIGINT) AS is_line FROM {l} CROSS JOIN {q}", l=lines_, q=iqr), "k:i ratio:d is_line:i"),
        "whittle_pointwise": (L.whittle_terms(pg, log_psd), "k:i term:d"),
        "whittle_loglik": (step("SELECT sum(term) AS loglik FROM {w}", w=L.whittle_terms(pg, log_psd)), "loglik:d"),
        "wishart_loglik_row": (step("SELECT 0 AS channel, loglik FROM {a} UNION ALL SELECT 1 AS channel, loglik FROM {b}", a=W.row_loglik(y, row_params, 0, blocked, LB), b=W.row_loglik(y, row_params, 1, blocked, LB)), "channel:i loglik:d"),
        "psd_quantiles": (q, "k:i q05:d q50:d q95:d"),
        "sigma_bands": (P.sigma_bands(draws), "k:i s3_lo:d s2_lo:d s1_lo:d med:d s1_hi:d s2_hi:d s3_hi:d"),
        "uniform_band": (P.uniform_band(draws), "k:i lo:d med:d hi:d"),
        "ci_width": (P.ci_width(q), "mean_width:d median_width:d max_width:d"),
        "riae": (P.riae(q_est, draw_truth, 1 / 24), "riae:d"),
        "riae_odd": (P.riae(step("SELECT k, value FROM {d} WHERE k <= 89", d=diag), step("SELECT k, value FROM {d} WHERE k <= 89", d=truth), 1 / LB), "riae:d"),
        "matrix_riae": (P.matrix_error(est_same, welch180, 1 / LB), "riae:d l2:d"),
        "coverage": (P.coverage(q, draw_truth), "coverage:d n:i"),
        "coverage_detailed": (P.coverage_detailed(matrix_draws, truth3), "part:s coverage:d n:i"),
        "inflation_factor": (P.inflation(q, draw_truth), "factor:d"),
        "thin_draws_even": (P.thin_even(draws, 7), "draw:i"),
        "thin_draws_stride": (P.thin_stride(draws, 3), "draw:i"),
        "run_summary": (P.run_summary(runs), "mode:s seeds:i mean:d sd:d lo:d hi:d"),
        "smooth_psd": (S.smooth(psd, 5), mat),
        "dip_mask": (step("SELECT k, i, re / max(re) OVER (PARTITION BY i) AS share, CAST(CASE WHEN re / max(re) OVER (PARTITION BY i) < 5e-2 THEN 1 ELSE 0 END AS BIGINT) AS dip FROM {p} WHERE i = j", p=psd), "k:i i:i share:d dip:i"),
        "geometry": (W.geometry(S.length_of(std1)), "nb:i lb:i n_ell:i nh:i nc:i"),
        "bias_by_decade": (step("SELECT CAST(floor(log10(t.freq) * 2e0) AS BIGINT) AS band, $pct(e.value / t.value, 0.5) AS ratio, CAST(count(*) AS BIGINT) AS n FROM {e} e JOIN {t} t ON t.k = e.k WHERE t.value > 0e0 GROUP BY floor(log10(t.freq) * 2e0)", e=diag, t=truth), "band:i ratio:d n:i"),
        "factor_split": (P.factors(names), "name:s factor:s"),
        "factor_labels": (step("SELECT DISTINCT factor FROM {f} WHERE factor <> ''", f=P.factors(names)), "factor:s"),
        "left_merge": (step("SELECT a.mode AS factor, a.seeds, a.mean, b.worst FROM {a} a LEFT JOIN {b} b ON b.mode = a.mode", a=P.run_summary(runs), b=step("SELECT mode, max(metric) AS worst FROM {r} WHERE mode <> 'view' GROUP BY mode", r=runs)), "factor:s seeds:i mean:d worst:d"),
        "varma_psd": (G.varma_psd2(fgrid, [[0.5, 0.0], [0.0, -0.3]], [[0.0, 0.0], [0.0, -0.5]], [[1.0, 0.9], [0.9, 1.0]]), mat),
        "tdi_xyz_matrix": (G.xyz_matrix(lgrid), "k:i freq:d log_sxx:d sxy_ratio:d"),
        "blocked_welch": (S.blocked_welch(std, 240, 120, 60), mat),
        "inverse_transform": (S.inverse(pg), "t:i y:d"),
        "periodogram_times_array": (step("SELECT p.k, p.freq, p.power * w.weight AS power FROM {p} p JOIN {w} w ON w.k = p.k", p=pg, w=step("SELECT k, 1e0 + sqrt(k) AS weight FROM {p}", p=pg)), "k:i freq:d power:d"),
        "unit_scaling": (step("SELECT p.k, p.freq, p.power * s.value AS power FROM {p} p JOIN {s} s ON s.freq = p.freq", p=pg, s=B.interpolate(step("SELECT k, freq, 1e0 / freq AS value FROM {p} WHERE k % 7 = 1", p=pg), step("SELECT DISTINCT freq FROM {p}", p=pg))), "k:i freq:d power:d"),
        "mask_rows": (step("SELECT k, freq, power FROM {p} WHERE k % 3 <> 0 AND power > 1e-2", p=pg), "k:i freq:d power:d"),
        "positive_finite": (step("SELECT CAST(sum(CASE WHEN power > 0e0 AND abs(power) < 1e300 THEN 0 ELSE 1 END) AS BIGINT) AS bad, sum(greatest(power, 1e-10)) AS floored FROM {p}", p=pg), "bad:i floored:d"),
        "masked_matrix_riae": (P.matrix_error(B.exclude(est_same, null), B.exclude(welch180, null), 1 / LB), "riae:d l2:d"),
        "matrix_quantiles": (P.matrix_quantiles(matrix_draws), "k:i i:i j:i re05:d re50:d re95:d im05:d im50:d im95:d"),
        "ci_summary": (step("SELECT q.k, q.i, q.j, re05, re50, re95, im05, im50, im95, t.re AS true_re, t.im AS true_im FROM {q} q JOIN {t} t ON t.k = q.k AND t.i = q.i AND t.j = q.j", q=P.matrix_quantiles(matrix_draws), t=truth3), "k:i i:i j:i re05:d re50:d re95:d im05:d im50:d im95:d true_re:d true_im:d"),
        "coherence_ci": (coh_ci, "k:i i:i j:i q05:d q50:d q95:d"),
        "coherence_coverage": (step("SELECT avg(CASE WHEN t.coh >= q.q05 AND t.coh <= q.q95 THEN 1e0 ELSE 0e0 END) AS coverage, count(*) AS n FROM {q} q JOIN {t} t ON t.k = q.k AND t.i = q.i AND t.j = q.j", q=coh_ci, t=S.coherence(truth3)), "coverage:d n:i"),
        "ci_width_parts": (P.width_by_part(P.matrix_quantiles(matrix_draws), coh_ci), "part:s mean_width:d median_width:d max_width:d"),
        "riae_errorbars": (P.riae_errorbars(draws, draw_truth, 1 / 24), "q05:d q25:d q50:d q75:d q95:d"),
        "riae_bundle": (P.riae_bundle(psd3, truth3, 1 / LB, 3), "part:s riae:d"),
        "truth_metrics": (P.truth_metrics(q, draw_truth, 1 / 24), "riae:d l2:d coverage:d"),
        "nearest_percentile": (step("SELECT k, p, min_by(value, gap) AS value FROM (SELECT k, p, value, abs(c - p) + 1e-9 * value AS gap FROM (SELECT k, value, cume_dist() OVER (PARTITION BY k ORDER BY value) AS c FROM {d}) CROSS JOIN (SELECT 5e-2 AS p UNION ALL SELECT 5e-1 AS p UNION ALL SELECT 95e-2 AS p)) GROUP BY k, p", d=draws), "k:i p:d value:d"),
        "elbo_window": (P.elbo_window(trace, 50, 200), "factor:s improvement:d slope:d"),
        "loss_shift": (step("SELECT factor, step, loss - (min(loss) OVER (PARTITION BY factor) - 1e-1 * abs(min(loss) OVER (PARTITION BY factor))) AS shifted FROM {t} WHERE step < 40", t=trace), "factor:s step:i shifted:d"),
        "sum_over_factors": (step("SELECT chain, draw, sum(energy) AS energy, avg(accept) AS accept, CAST(max(diverging) AS BIGINT) AS diverging FROM {s} GROUP BY chain, draw", s=stats), "chain:i draw:i energy:d accept:d diverging:i"),
        "group_by_duration": (step("SELECT CAST(round(duration) AS BIGINT) AS days, eta, row_number() OVER (PARTITION BY round(duration) ORDER BY eta) AS place, riae FROM {r} WHERE eta IS NOT NULL AND duration IS NOT NULL AND riae IS NOT NULL", r=durations), "days:i eta:d place:i riae:d"),
        "common_frequencies": (step("SELECT a.freq, a.power FROM {a} a JOIN (SELECT DISTINCT freq FROM {b}) b ON round(b.freq, 12) = round(a.freq, 12)", a=pg, b=psd), "freq:d power:d"),
        "log_spaced": (L.log_spaced(pg, 20), "k:i freq:d"),
        "subsample_draws": (step("SELECT draw FROM (SELECT DISTINCT draw FROM {d}) ORDER BY md5(CAST(draw AS STRING)) LIMIT 15", d=draws), "draw:i"),
        "run_union": (step("SELECT mode, seed FROM (SELECT mode, seed FROM {r} WHERE seed < 6 UNION SELECT mode, seed FROM {r} WHERE seed > 3)", r=runs), "mode:s seed:i"),
        "adjacent_ratios": (step("SELECT k, freq, CASE WHEN l1 > 0e0 THEN l2 / l1 END AS r21, CASE WHEN l2 > 0e0 THEN l3 / l2 END AS r32 FROM {e}", e=eig3), "k:i freq:d r21:d r32:d"),
        "eigen_gap_warnings": (step("SELECT k, freq, ratio FROM {r} CROSS JOIN (SELECT avg(CASE WHEN ratio > 8e-1 THEN 1e0 ELSE 0e0 END) AS share FROM {r} WHERE ratio IS NOT NULL) WHERE share >= 25e-2 AND ratio > 8e-1 ORDER BY ratio DESC, k LIMIT 10", r=rat), "k:i freq:d ratio:d"),
        "prior_logdensity": (W.prior_logdensity(weights, L.second_differences(12)), "log_prior:d"),
    }
    return out


def _final(plan: Step, columns: str) -> Step:
    kinds = {"i": "CAST({c} AS BIGINT) AS {c}", "d": "$r({c}) AS {c}", "s": "{c}"}
    cols = [kinds[t].format(c=c) for c, t in (x.split(":") for x in columns.split())]
    return step("SELECT " + ", ".join(cols) + " FROM {x}", x=plan)


def _run(plan: Step) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan.frame(spark, sf_dir)


_FINAL = {k: _final(*v) for k, v in _plans().items()}
def _varma(spark: SparkSession, sf_dir: str) -> DataFrame:
    var, vma, sigma = np.array([[[0.5, 0.0], [0.0, -0.3]], [[0.0, 0.0], [0.0, -0.5]]]), np.eye(2)[None], np.array([[1.0, 0.9], [0.9, 1.0]])
    return K.rounded(G.varma_series(spark.range(3).withColumnRenamed("id", "run"), var, vma, sigma, 512))


def _events_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodograms of the event types, a series each."""
    s = S.standardise_channels(X.hourly_events()).frame(spark, sf_dir)
    return K.fft_periodogram(s.select(F.col("channel").alias("series_id"), "t_idx", "y")).filter("power > 0")


def _nuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rounded(N.fit_univariate(_events_power(spark, sf_dir)))


def _nuts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = N.fit_univariate(_events_power(spark, sf_dir))
    return K.rounded(N.summary_table(draws, ["series_id"]))


def _nuts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = S.wishart(S.detrend(S.blocks(S.standardise_channels(X.daily_lineitem()), LB)), LB).frame(spark, sf_dir)
    return K.rounded(N.fit_rows(y, 13, LB, enbw=1.5))


#: Samplers and simulations: no SQL says them; tests hold them against numpy.
_OTHERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"varma_series": _varma, "nuts_univar": _nuts, "nuts_summary": _nuts_summary, "nuts_wishart_rows": _nuts_rows, "stream_hourly_events": T.hourly}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _run(v) for k, v in _FINAL.items()} | K.QUERIES | _OTHERS
ORACLES: dict[str, str] = {k: v.statement() for k, v in _FINAL.items()} | {k: _FINAL[same].statement() for k, same in K.SAME_AS.items()} | {"embedding_periodograms": K.EMBEDDING_SQL, "stream_hourly_events": T.HOURLY_SQL}
