"""DuckDB SQL for the registered queries."""

from __future__ import annotations

# Common tables: e and l are the points of events and line items, ce and cl the clean ones.
_JD = "epoch_us({}) / 86400e6::DOUBLE + 2440587.5::DOUBLE"
_POINTS = {
    "e": f"""SELECT user_id::VARCHAR AS source_id, (event_id % 2)::INT AS band, event_type AS camera, {_JD.format('ts')} AS jd,
      25 - 2.5::DOUBLE * log10(greatest(value, 0.01::DOUBLE)) AS mag, (regexp_extract(props, '[0-9]+')::DOUBLE + 1) / 200 AS error,
      (event_id % 50 = 0)::INT AS saturated, (event_id % 10 <> 0)::INT AS good_bad, event_id AS seq FROM events""",
    "l": f"""SELECT l_suppkey::VARCHAR AS source_id, (l_linestatus = 'O')::INT AS band, l_returnflag AS camera,
      {_JD.format('l_shipdate')} + ((l_orderkey * 7 + l_linenumber) % 1000) / 2000::DOUBLE AS jd, 25 - 2.5::DOUBLE * log10(l_extendedprice) AS mag,
      0.01::DOUBLE + l_tax AS error, (l_orderkey % 50 = 0)::INT AS saturated, (l_orderkey % 10 <> 0)::INT AS good_bad,
      (l_orderkey * 10 + l_linenumber) * 100000000 + round(l_extendedprice * 100)::BIGINT AS seq FROM lineitem""",
}
_CLEAN = "saturated = 0 AND isfinite(jd) AND isfinite(mag) AND error > 0 AND error < 1"
_CTE = ", ".join(f"{k} AS ({v}), c{k} AS (SELECT * FROM {k} WHERE {_CLEAN})" for k, v in _POINTS.items())


def _sql(body: str, plain: str, doubles: str = "", more: str = "", places: int = 6) -> str:
    """The rows of body; its columns in `doubles` rounded."""
    named = ", ".join([*plain.split(), *(f"round({c}, {places}) AS {c}" for c in doubles.split())])
    return f"WITH {_CTE}{', ' + more if more else ''}, result AS ({body}) SELECT {named} FROM result"


_PREVIOUS = "p AS (SELECT *, lag(jd) OVER w AS jd_before, lag(mag) OVER w AS mag_before, jd - lag(jd) OVER w AS dt FROM {} WINDOW w AS (PARTITION BY {} ORDER BY jd, seq))"
_PREV = _PREVIOUS.format("e", "source_id")
_CADENCE = "SELECT {0}, avg(dt) dt_mean, median(dt) dt_median, quantile_cont(dt, 0.05) dt_p05, quantile_cont(dt, 0.95) dt_p95, max(jd) - min(jd) span FROM p GROUP BY {0}"
_QUANTILES = ", ".join(f"quantile_cont(mag, {s / 100}) AS p{s:02d}" for s in (5, 16, 25, 75, 84, 95))
_DEVIATION = "d AS (SELECT *, median(mag) OVER (PARTITION BY source_id) AS med, abs(mag - median(mag) OVER (PARTITION BY source_id)) AS dev FROM e)"


def _baseline(value: str, of: str = "ce", keys: str = "source_id") -> tuple[str, str]:
    """Tables that end in `f`: points with baseline, resid and sigma_resid; and the statement's body."""
    more = f"""b AS (SELECT *, {value} AS baseline FROM {of}), r AS (SELECT *, mag - baseline AS resid FROM b),
      m AS (SELECT *, abs(resid - median(resid) OVER (PARTITION BY {keys})) AS dev FROM r),
      f AS (SELECT *, resid / greatest(sqrt((1.4826 * coalesce(median(dev) OVER (PARTITION BY {keys}), 0)) ** 2 + coalesce(median(error) OVER (PARTITION BY {keys}), 0) ** 2), 1e-6) AS sigma_resid FROM m)"""
    return more, "SELECT * FROM f"


def _rolling(days: float, keys: str, least: int, aggregate: str = "median(mag)") -> str:
    over = f"(PARTITION BY {keys} ORDER BY jd RANGE BETWEEN {days} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(mag) OVER {over} >= {least} THEN {aggregate} OVER {over} END"


def _baseline_sql(value: str, of: str = "ce", keys: str = "source_id") -> str:
    more, body = _baseline(value, of, keys)
    return _sql(body, "source_id seq", "baseline resid sigma_resid", more)


_CAMERA = "source_id, camera"
_EVENT_BASED = _baseline(_rolling(5.0, _CAMERA, 3), keys=_CAMERA)[0]
_PLACED = _EVENT_BASED + ", i AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY jd, seq) - 1 AS idx FROM {})"


def _metrics(source: str) -> str:
    """Tables that end in `t`: run metrics of the points `source`, which have a baseline."""
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY jd, seq) - 1 AS idx FROM {source} WHERE baseline IS NOT NULL),
      k AS (SELECT *, CASE WHEN mag >= baseline + 0.3 THEN 'dip' WHEN mag <= baseline - 0.3 THEN 'jump' END AS kind, abs(mag - baseline) AS size FROM i),
      h AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY source_id, kind ORDER BY idx) > 1 THEN 1 ELSE 0 END AS fresh FROM k WHERE kind IS NOT NULL),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, kind ORDER BY idx) AS run FROM h),
      u AS (SELECT source_id, kind, run, count(*) n, max(jd) AS last, max(size) AS most, max(jd) - min(jd) AS days FROM g GROUP BY ALL),
      v AS (SELECT source_id, count(*) FILTER (kind = 'dip') n_dip_runs, count(*) FILTER (kind = 'jump') n_jump_runs, sum(n) FILTER (kind = 'dip') n_dip_points, sum(n) FILTER (kind = 'jump') n_jump_points,
        max(last) FILTER (kind = 'dip') most_recent_dip, max(last) FILTER (kind = 'jump') most_recent_jump, max(most) FILTER (kind = 'dip') max_depth, max(most) FILTER (kind = 'jump') max_height,
        max(days) FILTER (kind = 'dip') max_dip_duration, max(days) FILTER (kind = 'jump') max_jump_duration FROM u GROUP BY source_id),
      z AS (SELECT o.source_id, coalesce(n_dip_runs, 0)::BIGINT n_dip_runs, coalesce(n_jump_runs, 0)::BIGINT n_jump_runs, coalesce(n_dip_points, 0)::BIGINT n_dip_points, coalesce(n_jump_points, 0)::BIGINT n_jump_points,
        most_recent_dip, most_recent_jump, max_depth, max_height, max_dip_duration, max_jump_duration FROM (SELECT DISTINCT source_id FROM {source}) o LEFT JOIN v USING (source_id)),
      t AS (SELECT *, CASE WHEN n_dip_runs + n_jump_runs > 0 THEN n_dip_runs / (n_dip_runs + n_jump_runs) END AS dip_fraction, CASE WHEN n_dip_runs + n_jump_runs > 0 THEN n_jump_runs / (n_dip_runs + n_jump_runs) END AS jump_fraction FROM z)"""


_BIWEIGHT = """bm AS (SELECT *, median(mag) OVER (PARTITION BY source_id) AS med FROM {0}), ba AS (SELECT *, median(abs(mag - med)) OVER (PARTITION BY source_id) AS mad, mag - med AS d FROM bm),
  bu AS (SELECT *, d / (6 * nullif(mad, 0)) AS u FROM ba), bq AS (SELECT *, u * u AS u2, 1 - u * u AS q, abs(u) < 1 AS inside FROM bu),
  bs AS (SELECT source_id, CASE WHEN any_value(mad) > 0 THEN any_value(med) + sum(d * q * q) FILTER (inside) / sum(q * q) FILTER (inside) ELSE any_value(med) END AS biweight_location,
    CASE WHEN any_value(mad) > 0 THEN sqrt(count(mag) * sum(d * d * q * q * q * q) FILTER (inside)) / abs(sum(q * (1 - 5 * u2)) FILTER (inside)) ELSE 0 END AS biweight_scale FROM bq GROUP BY source_id),
  bd AS (SELECT {0}.*, (mag - biweight_location) / greatest(sqrt(coalesce(error, 0) ** 2 + biweight_scale ** 2), 1e-6) AS delta FROM {0} JOIN bs USING (source_id))"""

_SKY = """sa AS (SELECT c_custkey::VARCHAR AS source_id, c_custkey * 0.37::DOUBLE AS a, c_custkey * (0.37::DOUBLE * 0.61803::DOUBLE) AS b, 0::DOUBLE AS s FROM customer),
  sb AS (SELECT s_suppkey::VARCHAR AS source_id, s_suppkey * 0.37::DOUBLE + 0.0004::DOUBLE AS a, s_suppkey * (0.37::DOUBLE * 0.61803::DOUBLE) AS b, 0.0004::DOUBLE AS s FROM supplier),
  ka AS (SELECT source_id, a - 360 * floor(a / 360) AS ra, b - 170 * floor(b / 170) - 85 + s AS dec FROM sa), kb AS (SELECT source_id AS other_id, a - 360 * floor(a / 360) AS ra2, b - 170 * floor(b / 170) - 85 + s AS dec2 FROM sb),
  kp AS (SELECT source_id, other_id, 3600 * degrees(2 * asin(least(1, sqrt(sin(radians(dec2 - dec) / 2) ** 2 + cos(radians(dec)) * cos(radians(dec2)) * sin(radians(ra2 - ra) / 2) ** 2)))) AS sep_arcsec
    FROM ka JOIN kb ON dec2 BETWEEN dec - 0.001 AND dec + 0.001),
  kn AS (SELECT * FROM kp WHERE sep_arcsec < 3)"""

_CANDIDATES = _baseline("median(mag) OVER (PARTITION BY source_id)")[0] + ", " + _metrics("f") + """,
  ca AS (SELECT source_id, count(DISTINCT camera) AS n_cameras, max(jd) - min(jd) AS time_span_days, count(*) / (max(jd) - min(jd)) AS points_per_day, stddev_pop(mag) AS std_mag FROM ce GROUP BY source_id),
  cb AS (SELECT ca.*, t.dip_fraction, t.n_dip_runs, t.n_dip_runs / time_span_days AS peaks_per_time FROM ca JOIN t USING (source_id)),
  s1 AS (SELECT * FROM cb WHERE dip_fraction >= 0.5), s2 AS (SELECT * FROM s1 WHERE n_cameras >= 5), s3 AS (SELECT * FROM s2 WHERE time_span_days >= 29 AND points_per_day >= 2), s4 AS (SELECT * FROM s3 WHERE n_dip_runs BETWEEN 1 AND 17 AND peaks_per_time <= 0.6 AND std_mag <= 1.35)"""


#: The mean error rounded to six places, exactly.
_MEAN_ERROR = "((2 * sum((error * 1e9)::BIGINT)::HUGEINT + 1000 * count(*)) // (2000 * count(*)))::DOUBLE / 1000000"


def _grouping(name: str, keys: str, camera: str, band: str) -> str:
    by = ", ".join(["source_id", *keys.split()])
    return f"""SELECT source_id, '{name}' AS grouping, {camera} AS g_camera, {band} AS g_band, count(*) n_obs, any_value(gm) med_mag, 1.4826 * median(abs(mag - gm)) mad_sigma, {_MEAN_ERROR} AS mean_err, any_value(gm) - any_value(sm) AS "offset"
      FROM (SELECT *, median(mag) OVER (PARTITION BY source_id) AS sm, median(mag) OVER (PARTITION BY {by}) AS gm FROM e) GROUP BY {by}"""


def _kind(kind: str) -> str:
    """Tables of one kind of event that end in `<kind>_row`: scores of points, their runs, and a row per source."""
    k = kind
    a, z = ("b + 0.02", "greatest(b + 0.02, hi + 0.5 * spread)") if kind == "dip" else ("least(b - 0.02, lo - 0.5 * spread)", "b - 0.02")
    return f"""{k}_grid AS (SELECT source_id, {a} AS a, CASE WHEN {a} = {z} THEN ({a}) {'+' if kind == 'dip' else '-'} 0.1 ELSE {z} END AS z FROM ends),
      {k}_each AS (SELECT source_id, seq, any_value(idx) AS idx, any_value(jd) AS jd, any_value(cadence) AS cadence, list(-0.5 * ((mag - (a + k * (z - a) / 59)) / error) ** 2) AS le, any_value(-0.5 * ((mag - baseline) / error) ** 2) AS lb
        FROM placed JOIN {k}_grid USING (source_id) CROSS JOIN (SELECT unnest(range(60)) AS k) WHERE baseline IS NOT NULL GROUP BY source_id, seq),
      {k}_scores AS (SELECT *, list_max(le) + ln(list_sum(list_transform(le, lambda x: exp(x - list_max(le))))) - ln(60) - lb AS score FROM {k}_each),
      {k}_hits AS (SELECT *, CASE WHEN idx - lag(idx) OVER w > 2 OR jd - lag(jd) OVER w > greatest(coalesce(cadence, 0) * 5, 5) THEN 1 ELSE 0 END AS fresh FROM {k}_scores WHERE score >= 5 WINDOW w AS (PARTITION BY source_id ORDER BY idx)),
      {k}_in AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY idx) AS run FROM {k}_hits),
      {k}_runs AS (SELECT source_id, count(*) AS n, max(jd) - min(jd) AS days, max(score) AS most, sum(score) AS total FROM {k}_in GROUP BY source_id, run
        HAVING n >= 3 AND days >= greatest(coalesce(any_value(cadence), 0) * 2, 2) AND most >= 5 AND total >= 12.5),
      {k}_row AS (SELECT source_id, max(score) AS {k}_max_log_bf_local, count(*) FILTER (score >= 5) AS {k}_count, any_value(r.c) AS c, coalesce(any_value(r.c), 0)::BIGINT AS {k}_run_count, any_value(r.n) AS {k}_max_run_points, any_value(r.days) AS {k}_max_run_duration,
        any_value(r.total) AS {k}_max_run_sum, any_value(r.most) AS {k}_max_run_max, coalesce(any_value(r.c), 0) > 0 AS {k}_significant
        FROM {k}_scores LEFT JOIN (SELECT source_id, count(*) AS c, max(n) AS n, max(days) AS days, max(total) AS total, max(most) AS most FROM {k}_runs GROUP BY source_id) r USING (source_id) GROUP BY source_id)"""


_SCAN = f"""valid AS (SELECT * FROM l WHERE error > 0 AND error < 10 QUALIFY count(*) OVER (PARTITION BY source_id) >= 10),
  based AS (SELECT *, {_rolling(300.0, _CAMERA, 10)} AS baseline FROM valid),
  spaced AS (SELECT *, row_number() OVER w - 1 AS idx, jd - lag(jd) OVER w AS dt FROM based WHERE baseline IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY jd, seq)),
  placed AS (SELECT *, median(dt) FILTER (dt > 0) OVER (PARTITION BY source_id) AS cadence FROM spaced),
  ends AS (SELECT source_id, median(baseline) AS b, quantile_cont(mag, 0.05) AS lo, quantile_cont(mag, 0.95) AS hi, greatest(quantile_cont(mag, 0.95) - quantile_cont(mag, 0.05), 0.05) AS spread FROM placed WHERE baseline IS NOT NULL GROUP BY source_id),
  {_kind('dip')}, {_kind('jump')}"""


SQL: dict[str, str] = {
    "clean_lc": _sql("SELECT * FROM ce", "source_id seq", "jd mag error"),
    "scoring_status": _sql("""SELECT source_id, count(*) FILTER (isfinite(jd) AND isfinite(mag) AND error > 0 AND error < 10) AS n_valid,
      CASE WHEN n_valid >= 10 THEN 'ok' WHEN n_valid = 0 THEN 'no valid points' ELSE 'too few points' END AS status FROM e GROUP BY source_id""", "source_id n_valid status"),
    "valid_for_scoring": _sql("SELECT * FROM e WHERE error > 0 AND error < 10 QUALIFY count(*) OVER (PARTITION BY source_id) >= 60", "source_id seq"),
    "stats_quality": _sql("SELECT * FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source_id, jd ORDER BY seq) = 1) WHERE good_bad = 1 AND saturated = 0", "source_id seq"),
    "quality_totals": _sql("""SELECT source_id, n_before, coalesce(n_whole, 0) AS n_whole, coalesce(n_good, 0) AS n_good FROM (SELECT source_id, count(*) AS n_before FROM e GROUP BY source_id)
      LEFT JOIN (SELECT source_id, count(*) AS n_whole, count(*) FILTER (good_bad = 1 AND saturated = 0) AS n_good FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source_id, jd ORDER BY seq) = 1) GROUP BY source_id) USING (source_id)""", "source_id n_before n_whole n_good"),
    "plot_quality": _sql("SELECT * FROM ce WHERE good_bad = 1", "source_id seq"),
    "plot_times": _sql("SELECT *, jd - CASE WHEN median(jd) OVER (PARTITION BY source_id) > 2000000 THEN 2458000 ELSE 8000 END AS jd_plot FROM e WHERE error < 5", "source_id seq", "jd_plot"),
    "band_clipped": _sql("SELECT * FROM e WHERE error <= 1 WINDOW w AS (PARTITION BY source_id, band) QUALIFY abs(mag - median(mag) OVER w) <= 2 * stddev_samp(mag) OVER w", "source_id seq"),
    "baseline_line": _sql("SELECT source_id, jd, median(b) AS baseline FROM (SELECT *, median(mag) OVER (PARTITION BY source_id) AS b FROM e) GROUP BY source_id, jd", "source_id", "jd baseline"),
    "weighted_mean": _sql("SELECT source_id, sum(mag / (error * error)) / sum(1 / (error * error)) AS wmean, sqrt(1 / sum(1 / (error * error))) AS wsem FROM e WHERE error > 0 GROUP BY source_id", "source_id", "wmean wsem"),
    "robust_sigma": _sql("SELECT source_id, 1.4826 * mad(mag) AS robust_sigma FROM e GROUP BY source_id", "source_id", "robust_sigma"),
    "summary": _sql(f"SELECT *, p75 - p25 AS iqr FROM (SELECT source_id, count(mag) n, avg(mag) mean, median(mag) AS median, stddev_samp(mag) std, {_QUANTILES} FROM e GROUP BY source_id)", "source_id n", "mean median std p05 p16 p25 p75 p84 p95 iqr"),
    "clipped": _sql("""SELECT source_id, avg(mag) FILTER (dev <= 3 * s) clipped_mean, stddev_samp(mag) FILTER (dev <= 3 * s) clipped_std, count(*) FILTER (NOT dev <= 3 * s) n_outliers
      FROM (SELECT *, 1.4826 * median(dev) OVER (PARTITION BY source_id) AS s FROM d) GROUP BY source_id""", "source_id n_outliers", "clipped_mean clipped_std", _DEVIATION),
    "noise": _sql(f"SELECT source_id, {_MEAN_ERROR} err_mean, median(error) err_median, min(error) err_min, max(error) err_max, avg(1.0857 / error) snr_mean, median(1.0857 / error) snr_median, max(1.0857 / error) snr_max FROM e WHERE error > 0 GROUP BY source_id",
                  "source_id", "err_mean err_median err_min err_max snr_mean snr_median snr_max"),
    "reduced_chi2": _sql("SELECT source_id, CASE WHEN count(*) >= 2 THEN sum(((mag - m) / error) ** 2) / (count(*) - 1) END AS chi2_red FROM e JOIN wm USING (source_id) WHERE error > 0 GROUP BY source_id", "source_id", "chi2_red",
                         "wm AS (SELECT source_id, sum(mag / (error * error)) / sum(1 / (error * error)) AS m FROM e WHERE error > 0 GROUP BY source_id)"),
    "von_neumann": _sql("SELECT source_id, CASE WHEN count(mag) >= 3 AND var_samp(mag) > 0 THEN avg((mag - mag_before) ** 2) / var_samp(mag) END AS von_neumann FROM p GROUP BY source_id", "source_id", "von_neumann", _PREV),
    "lag1_autocorrelation": _sql("SELECT source_id, CASE WHEN count(mag) >= 3 THEN corr(mag_before, mag) END AS lag1 FROM p GROUP BY source_id", "source_id", "lag1", _PREV),
    "linear_trend": _sql("SELECT source_id, regr_slope(mag, t) slope, regr_intercept(mag, t) intercept, regr_r2(mag, t) r2, regr_slope(mag, t) * 365.25 slope_per_year FROM (SELECT *, jd - min(jd) OVER (PARTITION BY source_id) AS t FROM e) GROUP BY source_id",
                         "source_id", "slope intercept r2 slope_per_year"),
    "cadence": _sql(_CADENCE.format("source_id"), "source_id", "dt_mean dt_median dt_p05 dt_p95 span", _PREV),
    "cadence_by_camera": _sql(_CADENCE.format(_CAMERA), "source_id camera", "dt_mean dt_median dt_p05 dt_p95 span", _PREVIOUS.format("e", _CAMERA)),
    "positive_cadence": _sql("SELECT source_id, median(dt) FILTER (dt > 0) AS cadence FROM p GROUP BY source_id", "source_id", "cadence", _PREV),
    "nightly": _sql("SELECT source_id, floor(jd)::BIGINT night, count(*) n_exp, median(mag) med_mag, median(error) med_err FROM e GROUP BY ALL", "source_id night n_exp", "med_mag med_err"),
    "duty_cycle": _sql("SELECT source_id, count(DISTINCT floor(jd)) nights, count(DISTINCT floor(jd)) / (floor(max(jd)) - floor(min(jd)) + 1) duty_cycle FROM e GROUP BY source_id", "source_id nights", "duty_cycle"),
    "tumbling_counts": _sql("SELECT source_id, floor(t / 3)::BIGINT AS bin, count(*) n FROM (SELECT *, jd - min(jd) OVER (PARTITION BY source_id) AS t FROM e) GROUP BY ALL", "source_id bin n"),
    "trailing_counts": _sql("SELECT *, count(*) OVER (PARTITION BY source_id ORDER BY jd RANGE BETWEEN 3.0 PRECEDING AND CURRENT ROW) AS n_trailing FROM e", "source_id seq n_trailing"),
    "seasons": _sql("SELECT source_id, season, min(jd) start_jd, max(jd) end_jd, count(*) n_obs, max(jd) - min(jd) span FROM (SELECT *, sum(CASE WHEN dt > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY jd, seq)::BIGINT AS season FROM p) GROUP BY ALL",
                    "source_id season n_obs", "start_jd end_jd span", _PREVIOUS.format("l", "source_id")),
    "top_gaps": _sql("SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY dt DESC, jd, seq)::INT AS rank FROM p WHERE dt IS NOT NULL QUALIFY rank <= 10", "source_id rank", "jd_before jd dt", _PREV),
    "per_camera_raw": _sql("SELECT source_id, camera, median(mag) AS median, quantile_cont(mag, 0.16) sig1_low, quantile_cont(mag, 0.84) sig1_high, quantile_cont(mag, 0.05) p90_low, quantile_cont(mag, 0.95) p90_high FROM e GROUP BY ALL",
                           "source_id camera", "median sig1_low sig1_high p90_low p90_high"),
    "raw_summary": _sql("SELECT source_id, min(m) raw_median_min, arg_min(camera, (m, camera)) raw_min_camera, max(m) raw_median_max, arg_max(camera, (m, camera)) raw_max_camera, max(m) - min(m) raw_median_range, median(s) raw_robust_scatter FROM rs GROUP BY source_id",
                        "source_id raw_min_camera raw_max_camera", "raw_median_min raw_median_max raw_median_range raw_robust_scatter",
                        "rs AS (SELECT source_id, camera, median(mag) m, quantile_cont(mag, 0.84) - quantile_cont(mag, 0.16) s FROM e GROUP BY ALL)"),
    "by_camera_and_band": _sql(" UNION ALL ".join((_grouping("camera", "camera", "camera", "NULL::INT"), _grouping("band", "band", "NULL", "band"), _grouping("camera_band", "camera band", "camera", "band"))),
                               "source_id grouping g_camera g_band n_obs", "med_mag mad_sigma mean_err").replace(" FROM result", ', round("offset", 6) AS "offset" FROM result'),
    "counts_by_grouping_sets": _sql("SELECT source_id, camera, band, count(*) n_obs, avg(mag) mean_mag FROM e GROUP BY GROUPING SETS ((source_id, camera), (source_id, band), (source_id, camera, band))", "source_id camera band n_obs", "mean_mag"),
    "global_mean_baseline": _baseline_sql("avg(mag) OVER (PARTITION BY source_id)"),
    "global_median_baseline": _baseline_sql("median(mag) OVER (PARTITION BY source_id)"),
    "global_rolling_median_baseline": _baseline_sql(_rolling(5.0, "source_id", 10)),
    "global_rolling_mean_baseline": _baseline_sql(_rolling(5.0, "source_id", 10, "avg(mag)")),
    "per_camera_mean_baseline": _baseline_sql(f"avg(mag) OVER (PARTITION BY {_CAMERA})", keys=_CAMERA),
    "per_camera_median_baseline": _baseline_sql(_rolling(300.0, _CAMERA, 10), "cl", _CAMERA),
    "masked_points": _sql("SELECT *, max(flagged::INT) OVER (PARTITION BY source_id, camera ORDER BY jd RANGE BETWEEN 1.0 PRECEDING AND 1.0 FOLLOWING) = 1 AS masked FROM fl", "source_id seq flagged masked", "",
                          _baseline(f"median(mag) OVER (PARTITION BY {_CAMERA})", "e", _CAMERA)[0] + ", fl AS (SELECT *, sigma_resid < -1 AS flagged FROM f)"),
    "biweight": _sql("SELECT * FROM bs", "source_id", "biweight_location biweight_scale", _BIWEIGHT.format("e")),
    "biweight_delta": _sql("SELECT * FROM bd", "source_id seq", "delta", _BIWEIGHT.format("e")),
    "dip_peaks": _sql("SELECT *, row_number() OVER w - 1 AS idx, lag(delta) OVER w < delta AND lead(delta) OVER w < delta AND delta >= 0.5 AS top FROM bd WINDOW w AS (PARTITION BY source_id ORDER BY jd, seq) QUALIFY top", "source_id seq idx::INT@idx", "delta",
                      _BIWEIGHT.format("ce")).replace("idx::INT@idx", "idx::INT AS idx"),
    "find_runs": _sql("SELECT source_id, min(idx)::INT start_idx, max(idx)::INT end_idx, count(*) n_points FROM (SELECT *, idx - row_number() OVER (PARTITION BY source_id ORDER BY idx) AS island FROM i WHERE resid >= 0.3) GROUP BY source_id, island",
                      "source_id start_idx end_idx n_points", "", _PLACED.format("f")),
    "build_runs": _sql("""SELECT source_id, min(idx)::INT start_idx, max(idx)::INT end_idx, count(*) n_points, min(jd) start_jd, max(jd) end_jd, max(jd) - min(jd) duration_days, max(abs(resid)) run_max, sum(abs(resid)) run_sum
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY idx) AS run FROM j) GROUP BY source_id, run""", "source_id start_idx end_idx n_points", "start_jd end_jd duration_days run_max run_sum",
                       _PLACED.format("f") + ", j AS (SELECT *, CASE WHEN idx - lag(idx) OVER w > 2 OR jd - lag(jd) OVER w > 2 THEN 1 ELSE 0 END AS fresh FROM i WHERE abs(resid) >= 0.3 WINDOW w AS (PARTITION BY source_id ORDER BY idx))"),
    "naive_dip_runs": _sql("SELECT * FROM t", "source_id n_dip_runs n_jump_runs n_dip_points n_jump_points", "most_recent_dip most_recent_jump max_depth max_height max_dip_duration max_jump_duration dip_fraction jump_fraction",
                           _EVENT_BASED + ", " + _metrics("f")),
    "local_log_bf": _sql("""SELECT source_id, seq, max(le) + ln(sum(exp(le - top))) - ln(60) - any_value(lb) AS log_bf FROM (SELECT *, max(le) OVER (PARTITION BY source_id, seq) AS top FROM ev) GROUP BY source_id, seq""", "source_id seq", "log_bf",
                         """g0 AS (SELECT source_id, median(mag) + 0.02 AS a, greatest(median(mag) + 0.02, quantile_cont(mag, 0.95) + 0.5 * greatest(quantile_cont(mag, 0.95) - quantile_cont(mag, 0.05), 0.05)) AS z, median(mag) AS b FROM ce GROUP BY source_id),
      g1 AS (SELECT source_id, b, a, CASE WHEN a = z THEN a + 0.1 ELSE z END AS z FROM g0), gi AS (SELECT unnest(range(60)) AS k),
      ev AS (SELECT ce.source_id, seq, -0.5 * ((mag - (a + k * (z - a) / 59)) / error) ** 2 - ln(error) AS le, -0.5 * ((mag - b) / error) ** 2 - ln(error) AS lb FROM ce JOIN g1 USING (source_id) CROSS JOIN gi)"""),
    "sky_pairs": _sql("SELECT * FROM kn", "source_id other_id", "sep_arcsec", _SKY, 3),
    "sky_nearest": _sql("SELECT source_id, other_id, sep_arcsec FROM ka LEFT JOIN (SELECT source_id, arg_min(other_id, sep_arcsec) AS other_id, min(sep_arcsec) AS sep_arcsec FROM kn GROUP BY source_id) USING (source_id)", "source_id other_id", "sep_arcsec", _SKY, 3),
    "candidates": _sql("SELECT * FROM cb", "source_id n_cameras n_dip_runs", "time_span_days points_per_day std_mag dip_fraction peaks_per_time", _CANDIDATES),
    "filter_chain": _sql("SELECT * FROM s4", "source_id", "", _CANDIDATES),
    "rejection_log": _sql("""SELECT source_id, 'dip_dominated' AS filter FROM cb ANTI JOIN s1 USING (source_id) UNION ALL SELECT source_id, 'multi_camera' FROM s1 ANTI JOIN s2 USING (source_id)
      UNION ALL SELECT source_id, 'sparse' FROM s2 ANTI JOIN s3 USING (source_id) UNION ALL SELECT source_id, 'box' FROM s3 ANTI JOIN s4 USING (source_id)""", "source_id filter", "", _CANDIDATES),
    "retention": _sql("SELECT (SELECT count(*) FROM cb) AS n_before, (SELECT count(DISTINCT source_id) FROM s4) AS n_kept", "n_before n_kept n_kept/n_before@retention", "", _CANDIDATES).replace("n_kept/n_before@retention", "round(n_kept / n_before, 6) AS retention"),
    "fp_summary": """WITH q AS (SELECT p_brand AS mag_bin, p_size % 3 > 0 AS g, CASE WHEN p_size % 5 > 0 THEN p_size % 2 ELSE 0 END > 0 AS v FROM part)
      SELECT mag_bin, count(*) n, count(*) FILTER (g) n_g, count(*) FILTER (v) n_v, count(*) FILTER (g OR v) n_either, count(*) FILTER (g AND v) n_both FROM q GROUP BY ROLLUP (mag_bin)""",
    "custom_id": _sql("""SELECT source_id, concat('J', lpad(floor(h)::BIGINT::VARCHAR, 2, '0'), lpad(floor(m)::BIGINT::VARCHAR, 2, '0'), lpad(round((m - floor(m)) * 60)::BIGINT::VARCHAR, 2, '0'), CASE WHEN dec < 0 THEN '-' ELSE '+' END,
      lpad(floor(d)::BIGINT::VARCHAR, 2, '0'), lpad(floor(p)::BIGINT::VARCHAR, 2, '0'), lpad(round((p - floor(p)) * 60)::BIGINT::VARCHAR, 2, '0')) AS custom_id
      FROM (SELECT *, (h - floor(h)) * 60 AS m, (d - floor(d)) * 60 AS p FROM (SELECT *, ra / 15 AS h, abs(dec) AS d FROM ka))""", "source_id custom_id", "", _SKY),
    "bayes_scan": _sql("SELECT *, 'per_camera_median' AS baseline_source, 'logbf' AS trigger_mode FROM (SELECT DISTINCT source_id FROM valid) LEFT JOIN dip_row USING (source_id) LEFT JOIN jump_row USING (source_id)",
                       "source_id baseline_source trigger_mode " + " ".join(f"{k}_{c}" for k in ("dip", "jump") for c in ("count", "run_count", "max_run_points", "significant")),
                       " ".join(f"{k}_{c}" for k in ("dip", "jump") for c in ("max_log_bf_local", "max_run_duration", "max_run_sum", "max_run_max")), _SCAN, 3),
}

_PARTS = ("summary", "weighted_mean", "robust_sigma", "clipped", "noise", "reduced_chi2", "von_neumann", "lag1_autocorrelation", "linear_trend", "cadence", "duty_cycle")
SQL["source_statistics"] = "SELECT * FROM " + " LEFT JOIN ".join(f"({SQL[part]}) q{i}" + (" USING (source_id)" if i else "") for i, part in enumerate(_PARTS))
