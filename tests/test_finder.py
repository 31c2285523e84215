"""Peak finders, rolling windows, noise floor, filter chain and command line against literal loops."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dimwatch.operators import baselines, bayes, filters, finder, kernels, rows
from dimwatch.sources.adapters import points


def _literal_peaks(x, height, distance, prominence, width):
    """Peaks by walking from point to point."""
    found = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1] and x[i] >= height:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        sides = []
        for step in (-1, 1):
            i = base = p
            while 0 <= i < len(x) and x[i] <= x[p]:
                if x[i] < x[base]:
                    base = i
                i += step
            sides.append(base)
        rise = x[p] - max(x[b] for b in sides)
        level, ends = x[p] - rise / 2, []
        for step, base in zip((-1, 1), sides):
            i = p
            while i != base and x[i] > level:
                i += step
            ends.append(i if x[i] >= level else i - step * (level - x[i]) / (x[i - step] - x[i]))
        if rise >= prominence and ends[1] - ends[0] >= width:
            out.append(p)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_peaks_match_a_literal_walk(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, 80).astype(float) if seed % 2 else rng.normal(0, 1, 80).round(2)
    rules = (float(rng.uniform(-1, 3)), int(rng.integers(1, 12)), float(rng.uniform(0, 2)), float(rng.uniform(0, 3)))
    assert finder.find_peaks(x, *rules).tolist() == _literal_peaks(x.tolist(), *rules)


def test_plateau_ends_and_short_curves():
    assert finder.find_peaks(np.array([1.0, 2, 2, 2, 1]), 0).tolist() == [2]
    assert finder.find_peaks(np.array([3.0, 1, 3]), 0).tolist() == finder.find_peaks(np.zeros(0), 0).tolist() == []


@pytest.mark.parametrize("deviation", [False, True])
def test_sliding_windows_match_loops(deviation):
    rng = np.random.default_rng(2)
    t, x = np.sort(rng.integers(0, 60, 200) / 2.0), rng.normal(size=200).round(1)
    x[rng.integers(0, 200, 20)] = np.nan
    for before, after in ((5.0, 0.0), (2.5, 2.5), (1000.0, 0.0)):
        found = baselines.sliding(t, x, before, after, 4, deviation)
        for i in range(200):
            own = x[(t >= t[i] - before) & (t <= t[i] + after)]
            own = own[~np.isnan(own)]
            expected = math.nan if len(own) < 4 else np.median(np.abs(own - np.median(own))) if deviation else np.median(own)
            assert found[i] == pytest.approx(expected, nan_ok=True)


def _literal_floor(resid, error, variance):
    rows = [(r, e, v) for r, e, v in zip(resid, error, variance) if all(map(math.isfinite, (r, e, v)))]
    if len(rows) < 30:
        return 0.0
    sigma = lambda xs: 1.4826 * np.median([abs(x - np.median(xs)) for x in xs])
    quiet = rows
    for _ in range(3):
        if len(quiet) < 30:
            break
        values = [r for r, _, _ in quiet]
        middle, reach = np.median(values), 3 * max(sigma(values), 1e-12)
        quiet = [x for x in rows if abs(x[0] - middle) <= reach]
    quiet = quiet if len(quiet) >= 30 else rows
    return math.sqrt(max(sigma([r for r, _, _ in quiet]) ** 2 - np.median([e * e for _, e, _ in quiet]) - np.median([v for *_, v in quiet]), 0))


@pytest.mark.parametrize("seed", range(8))
def test_noise_floor_matches_a_loop(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(25, 90))
    resid, error, variance = rng.normal(0, 0.2, n) + (rng.random(n) < 0.2) * 2, rng.uniform(0.01, 0.05, n), rng.uniform(0, 1e-4, n)
    resid[:3], error[3] = np.nan, np.inf
    assert kernels.noise_floor(resid, error, variance) == pytest.approx(_literal_floor(resid, error, variance))


def test_log_factors_match_a_loop(spark):
    row = (14.0, 13.5, 0.1, 13.52, 15.0)
    found = spark.createDataFrame([row, (None, *row[1:])], "m double, b double, s double, lo double, hi double").select(bayes.log_factor(7)(*map(F.col, ("m", "b", "s", "lo", "hi"))).alias("x")).collect()
    normal = lambda mu: math.exp(-0.5 * ((14.0 - mu) / 0.1) ** 2)
    assert found[0]["x"] == pytest.approx(math.log(sum(normal(13.52 + k * 1.48 / 6) for k in range(7)) / 7 / normal(13.5))) and found[1]["x"] is None


def test_scores_of_a_bell_and_of_a_microlensing_curve():
    jd = np.arange(200.0)
    bell = 10 * np.exp(-0.5 * ((jd - 100) / 6) ** 2)
    lens = 8 / np.sqrt(1 + ((jd - 90) / 12) ** 2)
    for kind, delta, fwhm in (("dips", bell, 2.3548 * 6), ("peaks", lens, 2 * math.sqrt(3) * 12)):
        at = finder.find_peaks(delta, 3.0, 25)
        found = finder.scored(kind, [(jd, delta, at)], 3.0)[0]
        assert len(at) == 1 and found["fwhm"][0] == pytest.approx(fwhm, rel=1e-3) and found["chi2_red"][0] < 1e-6
        n = found["n_det"][0]
        assert found["scores"][0] == pytest.approx(delta[at[0]] / 2 * found["fwhm"][0] * n / 1e-6)


def test_source_rows_of_both_bands(spark):
    """A dip in g, too few points in V."""
    jd = np.arange(300.0)
    g = pd.DataFrame({"source_id": "a", "band": 0, "camera": "c", "jd": jd, "mag": 13 + 0.5 * np.exp(-0.5 * ((jd - 150) / 4) ** 2) + 0.001 * (jd % 3), "error": 0.02, "seq": range(300)})
    v = g.iloc[:20].assign(band=1, seq=range(300, 320))
    found = finder.source_rows(spark.createDataFrame(pd.concat([g, v])).withColumn("saturated", F.lit(0))).first()
    assert found["g_n_peaks"] == 1 and found["g_peaks_jd"] == [150.0] and found["v_n_peaks"] == 0 and (found["n_rows_g"], found["n_rows_v"]) == (300, 20)
    assert found["g_total_score"] == pytest.approx(found["g_best_score"] / math.log(2))


def _median_before(t, x, days, least):
    """Rolling medians over the days before each time."""
    own = [[v for u, v in zip(t, x) if now - days <= u <= now] for now in t]
    return [float(np.median(w)) if len(w) >= least else math.nan for w in own]


def _literal_baseline(rows, trend):
    out = {}
    for cam in {r["camera"] for r in rows}:
        own = [r for r in rows if r["camera"] == cam]
        t, x = [r["jd"] for r in own], [r["mag"] for r in own]
        if trend:
            short, long = _median_before(t, x, 50.0, 10), _median_before(t, x, 800.0, 10)
            base = [a if math.isfinite(a) and (not math.isfinite(b) or abs(a - b) > 0.05) else b for a, b in zip(short, long)]
        else:
            base = _median_before(t, x, 300.0, 10)
        out |= {r["seq"]: b for r, b in zip(own, base)}
    return [out[r["seq"]] for r in rows]


def _biweight_scale(values):
    x = np.array([v for v in values if math.isfinite(v)])
    d = x - np.median(x)
    mad = np.median(abs(d))
    if mad == 0:
        return 0.0
    u = d / (6 * mad)
    d, u = d[abs(u) < 1], u[abs(u) < 1]
    return math.sqrt(len(x) * (d**2 * (1 - u**2) ** 4).sum()) / abs(((1 - u**2) * (1 - 5 * u**2)).sum())


def _literal_metrics(rows, base, threshold):
    """Runs of neighbouring points, of those with a baseline, that are so far from it."""
    placed = [(r["jd"], r["mag"] - b) for r, b in zip(rows, base) if math.isfinite(b)]
    out = {}
    for kind, sign in (("dip", 1), ("jump", -1)):
        groups, now = [], []
        for jd, off in [*placed, (None, -math.inf * sign)]:
            if sign * off >= threshold:
                now.append((jd, sign * off))
            elif now:
                groups.append(now)
                now = []
        out |= {f"n_{kind}_runs": len(groups), f"n_{kind}_points": sum(map(len, groups)), f"most_recent_{kind}": max((g[-1][0] for g in groups), default=None), f"max_{kind}_duration": max((g[-1][0] - g[0][0] for g in groups), default=None),
                {"dip": "max_depth", "jump": "max_height"}[kind]: max((x for g in groups for _, x in g), default=None)}
    total = out["n_dip_runs"] + out["n_jump_runs"]
    out |= {"dip_fraction": out["n_dip_runs"] / total if total else None, "jump_fraction": out["n_jump_runs"] / total if total else None}
    return out | {"is_dip_dominated": bool(total) and out["dip_fraction"] >= 0.66}


def _literal_source(rows, naive, sigma):
    """The finder's row of one source, band by band."""
    out = {}
    for band, name in enumerate("gv"):
        raw = sorted((r for r in rows if r["band"] == band), key=lambda r: (math.inf if r["jd"] is None else r["jd"], r["seq"]))
        good = [r for r in raw if r["mag"] is not None and r["error"] is not None and 0 < r["error"] < 1 and r["saturated"] == 0]
        counted = good if naive else raw
        out[f"n_rows_{name}"] = len(counted)
        found, metrics = [], dict.fromkeys(finder.METRICS) | {c: 0 for c in finder.METRICS[:4]} | {"is_dip_dominated": False}
        if good and (naive or len(raw) >= 30):
            base = _literal_baseline(good, naive)
            off = [r["mag"] - b for r, b in zip(good, base)]
            if naive:
                x = [v if math.isfinite(v) else 0.0 for v in off]
                found = _literal_peaks(x, 0.3, 25, 0.17, 2.0)
                span = good[-1]["jd"] - good[0]["jd"]
                if not 0 < len(found) < 10 or not span > 0 or len(found) / span > 0.015 or np.std(x) > 0.15:
                    found = []
            else:
                scale = _biweight_scale(off)
                x = [v / math.hypot(r["error"], scale) if math.isfinite(v) else 0.0 for r, v in zip(good, off)]
                found = _literal_peaks(x, sigma, 50, 0.0, 0.0)
                out[f"{name}_biweight_R"] = float(np.nanmedian(base)) if any(map(math.isfinite, base)) else None
            metrics = _literal_metrics(good, base, 0.3 if naive else sigma)
        out |= {f"{name}_n_peaks": len(found), f"{name}_peaks_idx": found or None} | {f"{name}_{k}": v for k, v in metrics.items()}
    return out


@pytest.mark.parametrize("naive", [False, True])
def test_source_rows_match_a_literal_loop(spark, naive):
    rng, rows = np.random.default_rng(8), []
    for source in range(50):
        for band in range(2):
            n = int(rng.integers(20, 200))
            for i in range(n):
                depth = (0.5 if naive else 0.9) * (1 if source % 3 else -1) * math.exp(-0.5 * ((i - n / 2) / 3) ** 2) * (source % 5 > 0)
                mag = None if rng.random() < 0.03 else float(13 + depth + rng.normal(0, 0.02 if naive else 0.04))
                rows.append((str(source), band, "ab"[int(rng.integers(0, 2))], float(2.5 * (i if source % 2 else rng.integers(0, n))), mag, None if rng.random() < 0.03 else float(rng.uniform(0.01, 0.06)), int(rng.random() < 0.05), len(rows)))
    points = spark.createDataFrame(rows, "source_id string, band int, camera string, jd double, mag double, error double, saturated int, seq long").repartition(7)
    sigma = 0.5
    got = {r["source_id"]: r for r in finder.source_rows(points, naive=naive, sigma=sigma).collect()}
    table = [r.asDict() for r in points.collect()]
    found = 0
    for source in map(str, range(50)):
        expected = _literal_source([r for r in table if r["source_id"] == source], naive, sigma)
        found += expected["g_n_peaks"] + expected["v_n_peaks"]
        for c, v in expected.items():
            own = got[source][c] or None if c.endswith("idx") else got[source][c]
            assert own == (pytest.approx(v) if isinstance(v, float) else v), (source, c)
    assert found > 5


def test_prominences_of_long_curves_are_quick():
    x = np.random.default_rng(6).normal(size=200_000)
    began = time.perf_counter()
    assert len(finder.find_peaks(x, 0.0, 1, 0.5, 1.0)) > 1000
    assert len(finder.find_peaks(np.concatenate([np.arange(100_000.0), np.arange(100_000.0)[::-1]]), 0.0, 1, 0.5, 1.0)) == 1
    assert time.perf_counter() - began < 6


def test_fits_together_equal_fits_alone():
    rng = np.random.default_rng(7)
    for kind in ("dips", "peaks"):
        curves = []
        for n in (40, 90, 300):
            jd, delta = np.sort(rng.uniform(0, 900, n)), rng.normal(0, 1, n)
            curves.append((jd, delta, finder.find_peaks(delta, 1.0, 9)))
        together = finder.scored(kind, curves, 1.0)
        for curve, own in zip(curves, together):
            alone = finder.scored(kind, [curve], 1.0)[0]
            assert own["n_det"] == alone["n_det"] and own["delta_peak"] == alone["delta_peak"]
            for p in range(len(curve[2])):
                one = finder.scored(kind, [(*curve[:2], curve[2][p : p + 1])], 1.0)[0]
                assert own["chi2_red"][p] == pytest.approx(one["chi2_red"][0], rel=1e-4, abs=1e-6)


def test_gate_drops_frequent_peaks(spark):
    rows = spark.createDataFrame([("a", 50.0, 0.1, [1]), ("b", 500.0, 0.1, [1]), ("c", 500.0, 0.2, [1]), ("d", 500.0, 0.1, [])], "source_id string, span double, std double, peaks_idx array<int>")
    assert {r["source_id"]: (r["n_peaks"], r["peaks_idx"]) for r in finder.gated(rows).collect()} == {"a": (0, []), "b": (1, [1]), "c": (0, []), "d": (0, [])}


def test_whole_rows_agree_with_the_scan(spark, sf_dir):
    p = points(spark, sf_dir, "lineitem")
    whole, scan = (df.toPandas().set_index("source_id").sort_index() for df in (rows.scan_rows(p, days=300.0), bayes.scan(p, days=300.0)))
    assert len(whole.columns) == 34 and len(whole) == len(scan) and set(whole["status"]) == {"ok"}
    for c in scan.columns:
        if c not in ("baseline_source", "trigger_mode"):
            assert whole[c].astype(float).fillna(0).to_numpy() == pytest.approx(scan[c].astype(float).fillna(0).to_numpy()), c


def test_every_source_has_a_row_with_its_reason(spark):
    def source(name, n=15, mag=13.0, error=0.02):
        return [(name, "c", float(i), mag, error, i) for i in range(n)]

    nan = float("nan")
    made = source("fine") + source("no mag", mag=None) + source("nan mag", mag=nan) + source("no error", error=nan) + source("zero error", error=0.0) + source("few", 9) + source("wide error", error=20.0)
    made += source("sigma nan") + source("sigma negative") + source("baseline nan") + source("split") + source("far", mag=1e200)
    points = spark.createDataFrame(made, "source_id string, camera string, jd double, mag double, error double, seq long")
    got = {r["source_id"]: r for r in rows.scan_rows(points, "tests.plugins:broken").collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "fine": "ok", "no mag": "all magnitudes are missing", "nan mag": "all magnitudes are missing", "no error": "all errors are missing", "zero error": "no error is positive", "few": "too few valid points",
        "wide error": "no valid points", "sigma nan": "the baseline gave no sigma_eff", "sigma negative": "the baseline gave no positive sigma_eff", "baseline nan": "the baseline is missing everywhere",
        "split": "no valid points after the baseline", "far": "no point has a likelihood",
    }
    assert got["fine"]["used_sigma_eff"] and got["fine"]["dip_count"] == 0 and got["few"]["dip_count"] is None
    with pytest.raises(ValueError, match="makes no sigma_eff"):
        rows.scan_rows(points, "global_median", require_sigma_eff=True)
    with pytest.raises(ValueError, match="unknown baseline"):
        rows.scan_rows(points, "none")


def test_chain_matches_one_step_after_another(spark):
    df = spark.createDataFrame([(str(i % 13), i % 5 / 4.0, i % 3, i * 10.0, 0.02 * i, i % 4) for i in range(60)], "source_id string, dip_fraction double, n_cameras int, time_span_days double, points_per_day double, k int")
    joined = spark.createDataFrame([(i,) for i in range(3)], "k int")
    steps = [("dip", filters.ByRule(lambda d: filters.dip_dominated_rule(d, 0.5))), ("cam", filters.ByRule(lambda d: filters.multi_camera_rule(d, 1))), ("join", lambda d: d.join(joined, "k").select(d.columns)),
             ("none", filters.ByRule(filters.periodic_rule)), ("sparse", filters.ByRule(lambda d: filters.sparse_rule(d, 100.0, 0.3)))]
    kept, log = filters.chain(df, steps)
    expected, now = set(), df
    for label, step in steps:
        after = step(now)
        expected |= {tuple(r) for r in filters.rejected(now, after, label).collect()}
        now = after
    assert sorted(map(tuple, kept.select(sorted(kept.columns)).collect())) == sorted(map(tuple, now.select(sorted(now.columns)).collect()))
    assert sorted(map(tuple, log.collect())) == sorted(expected)


def test_commands_read_and_write(spark, tmp_path):
    from dimwatch.__main__ import main

    rng = np.random.default_rng(1)
    for name, dip in (("11", 0.0), ("12", 0.8), ("13", 4.0)):
        lines = [f"{2458000 + i} {13 + rng.normal(0, 0.01) + (dip if 60 <= i < 66 else 0):.4f} 0.02 1 3 0 0 ba/F1" for i in range(120)]
        (tmp_path / f"{name}.dat2").write_text("\n".join(lines) + "\n")
    main(["scan", f"{tmp_path}/*.dat2", "--baseline", "global_median", "--output", f"{tmp_path}/scan"])
    found = {r["path"]: r for r in spark.read.parquet(f"{tmp_path}/scan").collect()}
    assert found["12"]["dip_significant"] and not found["11"]["dip_significant"] and len(found["12"]) == 35 and found["12"]["dip_max_run_points"] == 6
    main(["stats", f"{tmp_path}/*.dat2", "--output", f"{tmp_path}/stats"])
    assert spark.read.parquet(f"{tmp_path}/stats").count() == 3
    main(["find", f"{tmp_path}/*.dat2", "--output", f"{tmp_path}/found", "--format", "csv"])
    peaks = {r["source_id"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/found").collect()}
    assert int(peaks["12"]["g_n_peaks"]) > 0 and peaks["13"]["g_is_dip_dominated"] == "true" and peaks["12"]["g_is_dip_dominated"] == "false"
    main(["filter", f"{tmp_path}/found/*.csv", "--output", f"{tmp_path}/kept", "--rejections", f"{tmp_path}/log"])
    assert {r["source_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()} == {"13"}  # runs count from the finder's sigma, in magnitudes
    main(["find", f"{tmp_path}/*.dat2", "--output", f"{tmp_path}/lower", "--sigma", "0.5", "--baseline", "global_median"])
    main(["filter", f"{tmp_path}/lower", "--output", f"{tmp_path}/kept"])
    assert {r["source_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()} == {"12", "13"}
