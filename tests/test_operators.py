"""Small light curves whose results are known by hand."""

from functools import reduce

from pyspark.sql import functions as F

from dimwatch.operators import baselines, bayes, clean, filters, peaks, runs, sky, stats
from dimwatch.sources import layout
from dimwatch.sources.adapters import points
from tests.compare import difference

SCHEMA = "source_id string, band int, camera string, jd double, mag double, error double, saturated int, good_bad int, seq long"


def curve(spark, mags, name="a", camera="x", days=None):
    days = days or range(len(mags))
    return spark.createDataFrame([(name, 0, camera, float(t), float(m), 0.02, 0, 1, i) for i, (t, m) in enumerate(zip(days, mags, strict=True))], SCHEMA)


def test_clean_bounds(spark):
    rows = [("a", 0, "x", float(i), 13.0, e, s, 1, i) for i, (e, s) in enumerate([(0.02, 0), (0.02, 1), (0.0, 0), (1.0, 0), (None, 0), (float("nan"), 0)])]
    assert [r["seq"] for r in clean.clean_lc(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_dip_is_one_run(spark):
    mags = [13.0] * 18 + [13.5] * 5 + [13.0] * 17
    r = runs.run_metrics(baselines.global_median(curve(spark, mags))).first()
    assert (r["n_dip_runs"], r["n_dip_points"], r["n_jump_runs"], r["max_dip_duration"]) == (1, 5, 0, 4.0)
    s = bayes.scan(curve(spark, mags), baseline="global_median").first()
    assert s["dip_significant"] and s["dip_max_run_points"] == 5 and not s["jump_significant"]


def test_flat_curve_has_no_run(spark):
    s = bayes.scan(curve(spark, [13.0] * 40), baseline="global_median").first()
    assert s["dip_run_count"] == 0 and s["jump_run_count"] == 0


def test_cameras_have_their_own_baselines(spark):
    both = curve(spark, [13.0] * 12).unionByName(curve(spark, [13.2] * 12, camera="y"))
    assert baselines.per_camera_mean(both).where("abs(resid) > 1e-9").count() == 0
    assert baselines.global_mean(both).where("abs(abs(resid) - 0.1) > 1e-9").count() == 0


def test_seasons_split_after_more_than_thirty_days(spark):
    assert stats.seasons(curve(spark, [13] * 4, days=[0, 30, 61, 62])).count() == 2


def test_plateau_peaks_in_its_middle(spark):
    found = peaks.local_maxima(curve(spark, [1, 2, 2, 2, 1]), "mag", 0.0).collect()
    assert [r["idx"] for r in found] == [2]


def test_sky_pairs_wrap_and_are_strict(spark):
    left = spark.createDataFrame([("a", 0.0, 0.0), ("b", 359.9999, 10.0), ("c", 10.0, 89.9999)], "source_id string, ra double, dec double")
    right = spark.createDataFrame([(1, 2.999 / 3600, 0.0), (2, 3.001 / 3600, 0.0), (3, 0.0001, 10.0), (4, 190.0, 89.9999)], "k int, ra2 double, dec2 double")
    assert {(r["source_id"], r["k"]) for r in sky.pairs(left, right, 3.0).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_chain_logs_what_it_drops(spark):
    df = spark.createDataFrame([("a", 0.9, 3), ("b", 0.9, 1), ("c", 0.1, 3), ("d", None, 3)], "source_id string, dip_fraction double, n_cameras int")
    kept, log = filters.chain(df, filters.default_steps())
    assert [r["source_id"] for r in kept.collect()] == ["a"]
    assert {tuple(r) for r in log.collect()} == {("b", "multi_camera"), ("c", "dip_dominated"), ("d", "dip_dominated")}


def test_latest_file_of_each_bin(spark):
    names = [("peaks_12_12_5_20250101_000000+0000.csv",), ("peaks_12_12_5_20250102_000000+0000.csv",), ("other.csv",)]
    r = filters.latest_per_bin(spark.createDataFrame(names, "file string")).collect()
    assert [(x["low"], x["high"], x["file"]) for x in r] == [("12", "12_5", names[1][0])]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_statistics_need_one_exchange_or_none(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("mag", F.when(F.col("seq") % 11 > 0, F.col("mag"))).withColumn("error", F.when(F.col("seq") % 7 > 0, F.col("error")))
    whole = stats.source_statistics(p)
    assert exchanges(whole) == 1
    parts = (stats.summary, stats.weighted_mean, stats.robust_sigma, stats.clipped, stats.noise, stats.reduced_chi2, stats.von_neumann, stats.lag1_autocorrelation, stats.linear_trend, stats.cadence, stats.duty_cycle)
    expected = reduce(lambda a, b: a.join(b, "source_id"), (f(p) for f in parts)).toPandas()
    assert not difference(whole.toPandas(), expected)
    spark.sql("drop table if exists laid_points")
    layout.write_points(p, "laid_points", 4)
    laid = layout.read_points(spark, "laid_points")
    try:
        assert exchanges(stats.source_statistics(laid)) == 0 and exchanges(baselines.global_median(laid)) == 0 and exchanges(bayes.grid_ends(baselines.global_median(laid), "dip")) == 0
        assert not difference(stats.source_statistics(laid).toPandas(), expected)
    finally:
        spark.sql("drop table laid_points")
