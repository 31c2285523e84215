"""Kernels against closed forms, literal loops and curves known by hand."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimwatch.operators import baselines, kernels, processes
from tests.test_operators import curve


PROCESSES = [processes.oscillator_of_sigma(0.05, 200.0, 0.7), processes.oscillator(1.0, 0.1, 0.3), processes.oscillator(1.0, 0.1, 0.5), processes.exponentials((0.01, 5.0), (0.02, 300.0))]


def literal_sho(sigma2, w0, q, lag):
    """Covariance of the oscillator by its textbook formula."""
    t, eta = w0 * np.abs(lag), np.sqrt(abs(1 - 1 / (4 * q * q)))
    if q == 0.5:
        return sigma2 * np.exp(-t) * (1 + t)
    even, odd = (np.cos, np.sin) if q > 0.5 else (np.cosh, np.sinh)
    return sigma2 * np.exp(-t / (2 * q)) * (even(eta * t) + odd(eta * t) / (2 * eta * q))


def dense(process, t, y, variance, at):
    """Mean and variance of the process at some times by the inverse of the whole covariance."""
    inverse = np.linalg.inv(process.covariance(t[:, None] - t) + np.diag(variance))
    across = process.covariance(t[:, None] - at)
    return across.T @ inverse @ y, process.covariance(np.zeros(1))[0] - np.einsum("ij,ik,kj->j", across, inverse, across)


def test_covariances_are_those_of_the_formulas():
    lags = np.array([0.0, 3.0, -50.0, 400.0])
    assert np.allclose(PROCESSES[0].covariance(lags), literal_sho(0.05**2, 2 * np.pi / 200, 0.7, lags), atol=1e-15)
    assert all(np.allclose(p.covariance(lags), literal_sho(0.1 * q, 0.1, q, lags), atol=1e-14) for p, q in zip(PROCESSES[1:3], (0.3, 0.5)))
    assert np.allclose(PROCESSES[3].covariance(lags), 0.01 * np.exp(-abs(lags) / 5) + 0.02 * np.exp(-abs(lags) / 300), atol=1e-15)
    near, at = processes.oscillator(1.0, 0.1, 0.5 + 1e-6).covariance(lags), PROCESSES[2].covariance(lags)
    assert np.allclose(near, at, atol=1e-5) and np.allclose(processes.oscillator(1.0, 0.1, 0.5 - 1e-6).covariance(lags), at, atol=1e-5)


@pytest.mark.parametrize("process", PROCESSES)
def test_smoothing_equals_the_dense_solution(process):
    rng = np.random.default_rng(0)
    starts = np.cumsum([0, 500, 3, 1, 77])
    t = np.concatenate([np.sort(rng.choice(rng.uniform(0, 900, n), n)) for n in np.diff(starts)])  # some times repeat
    y, error, used = rng.normal(0, 0.05, len(t)), rng.uniform(1e-4, 0.05, len(t)), rng.random(len(t)) < 0.8
    mean, variance = processes.smoothed(process, t, y, np.where(used, error**2, np.inf), starts)
    for a, b in zip(starts[:-1], starts[1:]):
        own = used[a:b]
        expected = dense(process, t[a:b][own], y[a:b][own], error[a:b][own] ** 2, t[a:b])
        assert np.abs(expected[0] - mean[a:b]).max() < 1e-8 and np.abs(expected[1] - variance[a:b]).max() < 1e-8


def test_many_points_of_a_camera_take_linear_time():
    rng, n = np.random.default_rng(1), 50_000
    t = np.sort(rng.uniform(0, 5000, n))
    began = time.process_time()
    mean, _ = processes.smoothed(PROCESSES[0], t, np.sin(t / 300) * 0.05, np.full(n, 1e-4), np.array([0, n]))
    assert time.process_time() - began < 10 and np.abs(mean - np.sin(t / 300) * 0.05).max() < 0.01


def test_gp_baseline_of_odd_points_equals_the_dense_solution(spark):
    rng = np.random.default_rng(5)
    mags = [None if i % 13 == 3 else float(13 + rng.normal(0, 0.05)) for i in range(60)]
    errors = [None if i % 7 == 2 else float(rng.uniform(0.01, 0.05)) for i in range(60)]
    rows = [("a", "c", None if i == 40 else float(i // 2), m, e, i) for i, (m, e) in enumerate(zip(mags, errors))]
    points = spark.createDataFrame(rows, "source_id string, camera string, jd double, mag double, error double, seq long")
    got = baselines.BASELINES["per_camera_gp"](points, sigma_floor=0.0).toPandas().sort_values("seq")
    table = points.toPandas().sort_values("seq")
    fits = table["jd"].notna() & table["mag"].notna()
    e = table["error"][fits].fillna(table["error"][fits].median()).to_numpy()
    t, y = table["jd"][fits].to_numpy(), table["mag"][fits].to_numpy()
    mean, variance = dense(PROCESSES[0], t, y - y.mean(), e**2, table["jd"].fillna(t[0]).to_numpy())
    assert np.allclose(got["baseline"], mean + y.mean(), atol=1e-10)
    whole = table["error"].fillna(table["error"].median()).to_numpy()
    assert np.allclose(got["sigma_eff"], np.sqrt(whole**2 + variance), atol=1e-10) and got["resid"].isna().sum() == table["mag"].isna().sum()


def test_gp_baseline_of_flat_and_of_few_points(spark):
    flat = baselines.BASELINES["per_camera_gp"](curve(spark, [13.0] * 40)).collect()
    assert all(abs(r["resid"]) < 1e-9 and r["baseline_source"] == "gp_sho" for r in flat)
    few = baselines.BASELINES["per_camera_gp"](curve(spark, [13.0, 13.2, 13.1])).collect()
    assert {(r["baseline"], r["baseline_source"]) for r in few} == {(13.1, "median_fallback")}


def test_masked_gp_ignores_a_brightening(spark):
    mags = [13.0] * 200 + [12.0] * 5 + [13.0] * 200
    out = baselines.BASELINES["per_camera_gp_masked"](curve(spark, mags)).where("mag < 12.5").collect()
    assert len(out) == 5 and all(abs(r["resid"] + 1) < 0.02 for r in out)


def test_event_probability_equals_leaving_one_out(spark):
    mags = [13.0, 13.01, 12.99, 13.4, 13.5, 13.02, 12.98, 13.0]
    based = baselines.global_median(curve(spark, mags))
    got = kernels.mixture_posterior(based, "dip", n_mags=7, n_shares=5).orderBy("seq").toPandas()
    from dimwatch.operators.bayes import grid_ends

    rows = grid_ends(based, "dip").orderBy("seq").toPandas()
    grid = np.linspace(rows["grid_start"][0], rows["grid_stop"][0], 7)
    shares = 1 / (1 + np.exp(-np.linspace(0, np.log((1 - 1e-4) / 1e-4), 5)))
    density = lambda x, m: np.exp(-0.5 * ((x - m) / 0.02) ** 2) / (0.02 * np.sqrt(2 * np.pi))
    for j in range(len(mags)):
        bright = faint = 0.0
        for m in grid:
            for p in shares:
                others = np.prod([p * density(x, rows["baseline"][0]) + (1 - p) * density(x, m) for i, x in enumerate(mags) if i != j])
                bright += others * p * density(mags[j], rows["baseline"][0])
                faint += others * (1 - p) * density(mags[j], m)
        assert abs(got["event_probability"][j] - faint / (bright + faint)) < 1e-5


@pytest.mark.parametrize("kind", ["dip", "jump"])
def test_posterior_of_many_points_in_bounded_memory(kind):
    rng, n = np.random.default_rng(2), 100_000
    base, sigma = np.full(n, 13.0), np.full(n, 0.02)
    mag = 13.0 + rng.normal(0, 0.02, n) + (0.5 if kind == "dip" else -0.5) * (np.arange(n) % 1000 == 7)
    mags, shares = (13.02 + np.linspace(0, 1, 60) if kind == "dip" else 11.98 + np.linspace(0, 1, 60)), np.linspace(0.01, 0.99, 80)
    tracemalloc.start()
    probability, factor, best, share = kernels.event_posterior(mag, sigma, base, mags, shares, kind)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    event = np.arange(n) % 1000 == 7
    assert (probability[event] > 0.99).all() and (probability[~event] < 0.01).all() and factor > 0 and abs(abs(best - 13) - 0.5) < 0.02 and min(share, 1 - share) < 0.02


def test_posterior_of_far_points_and_blocks_equals_logarithms():
    rng = np.random.default_rng(3)
    mag, sigma, base = rng.normal(13, 2, 1100), rng.uniform(1e-4, 0.1, 1100), rng.normal(13, 0.1, 1100)
    mags, shares = np.linspace(13, 16, 5), np.array([0.5, 0.9, 0.9999])
    log = lambda x, m: -0.5 * ((x - m) / sigma) ** 2
    mixed = np.array([[np.logaddexp(np.log(p) + log(mag, base), np.log1p(-p) + log(mag, m)) for m in mags] for p in shares])
    likelihood = mixed.sum(2)
    weight = np.exp(likelihood - likelihood.max())
    event = np.array([[np.log1p(-p) + log(mag, m) for m in mags] for p in shares])
    expected = (weight[:, :, None] * np.exp(event - mixed)).sum((0, 1)) / weight.sum()
    got = kernels.event_posterior(mag, sigma, base, mags, shares, "dip")
    factor = likelihood.max() + np.log(weight.sum()) - np.log(weight.size) - log(mag, base).sum()
    assert np.allclose(got[0], expected, atol=1e-9) and abs(got[1] / factor - 1) < 1e-9


def test_sliding_deviations_of_wide_windows_are_quick():
    rng, n = np.random.default_rng(4), 40_000
    t, x = np.sort(rng.uniform(0, 1000, n)), rng.normal(size=n)
    began = time.perf_counter()
    found = baselines.sliding(t, x, 1000.0, 0.0, 10, deviation=True)
    assert time.perf_counter() - began < 5
    for i in (10, 5_000, n - 1):
        assert found[i] == pytest.approx(np.median(np.abs(x[: i + 1] - np.median(x[: i + 1]))))


def test_shapes_of_runs(spark):
    t = np.arange(40.0)
    bell = 13.0 + 0.5 * np.exp(-0.5 * ((t - 20) / 2) ** 2)
    lens = 13.0 - 0.8 / np.sqrt(1 + ((t - 20) / 2) ** 2)
    runs = spark.createDataFrame([("a", 0, 17, 23)], "source_id string, run int, start_idx int, end_idx int")
    dip = kernels.run_shapes(curve(spark, bell), runs, "dip").first()
    assert dip["morphology"] == "gaussian" and abs(dip["amp"] - 0.5) < 1e-3 and abs(dip["t0"] - 20) < 1e-3
    assert kernels.run_shapes(curve(spark, lens), runs, "jump").first()["morphology"] == "paczynski"
    assert kernels.run_shapes(curve(spark, [13.0] * 40), runs, "dip").first()["morphology"] == "noise"
    assert kernels.run_shapes(curve(spark, bell), runs.where(F.lit(False)), "dip").count() == 0


def test_percentiles_of_groups_match_numpy():
    from dimwatch.operators.groups import percentiles

    rng = np.random.default_rng(4)
    x, starts = np.where(rng.random(40) < 0.2, np.nan, rng.integers(0, 9, 40)), np.array([0, 1, 7, 20, 40])
    x[0] = np.nan
    for share, found in zip((0.05, 0.5, 0.95), percentiles(x, starts, 0.05, 0.5, 0.95), strict=True):
        own = [x[a:b][~np.isnan(x[a:b])] for a, b in zip(starts[:-1], starts[1:])]
        assert np.allclose(found, [np.percentile(o, 100 * share) if len(o) else np.nan for o in own], equal_nan=True)
