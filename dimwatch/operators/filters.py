"""The candidate filter chain. Steps take and return candidate rows; a step whose columns are missing passes all."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import first_col

LOG = logging.getLogger(__name__)

# The names of columns below, which must match those of candidate files.
ID = "source_id"
Step = tuple[str, Callable[[DataFrame], DataFrame]]


def as_number(df: DataFrame, name: str) -> Column:
    """A column as a double; text that isn't one is null."""
    return F.col(f"`{name}`").try_cast("double")


def _first(df: DataFrame, *names: str) -> Column | None:
    found = first_col(df, *names)
    return as_number(df, found) if found else None


def with_peaks(df: DataFrame, band: str = "either", source_file: str | None = None) -> DataFrame:
    """Candidates with peaks in a band: `g`, `v`, `both` or `either`; missing counts are 0."""
    has = {b: F.coalesce(as_number(df, f"{b}_n_peaks"), F.lit(0.0)) > 0 for b in "gv"}
    rule = {"g": has["g"], "v": has["v"], "both": has["g"] & has["v"], "either": has["g"] | has["v"]}
    if band not in rule:
        raise ValueError(f"unknown band {band}")
    out = df.where(rule[band])
    return out.withColumn("source_file", F.lit(source_file)) if source_file else out


def dip_dominated_rule(df: DataFrame, least: float = 0.66) -> Column | None:
    fractions = [F.coalesce(as_number(df, c) >= least, F.lit(False)) for c in ("g_dip_fraction", "v_dip_fraction", "dip_fraction") if c in df.columns]
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("g_is_dip_dominated", "v_is_dip_dominated", "g_dip_dominated", "v_dip_dominated", "g_dipdom", "v_dipdom") if c in df.columns]
    tests = fractions + flags
    return reduce(Column.__or__, tests) if tests else None


def multi_camera_rule(df: DataFrame, least: int = 2) -> Column | None:
    n = _first(df, "n_cameras", "num_cameras", "camera_count", "n_cams", "ncam")
    return None if n is None else n >= least


def periodic_rule(df: DataFrame, most_power: float = 0.5, least_period: float | None = None, most_period: float | None = None) -> Column | None:
    power, period = _first(df, "ls_max_power", "max_power"), _first(df, "best_period", "ls_best_period", "period")
    if power is None:
        return None
    keep = power <= most_power
    if period is not None and least_period is not None:
        keep &= period >= least_period
    if period is not None and most_period is not None:
        keep &= period <= most_period
    return keep


def sparse_rule(df: DataFrame, least_span: float = 200.0, least_rate: float = 0.05) -> Column | None:
    span, rate = _first(df, "time_span_days", "time_span"), _first(df, "points_per_day", "cadence_per_day")
    tests = ([span >= least_span] if span is not None else []) + ([rate >= least_rate] if rate is not None else [])
    return reduce(Column.__and__, tests) if tests else None


def box_rule(df: DataFrame, least_dips: int = 1, most_dips: int = 9, most_rate: float = 0.015, most_std: float = 0.15) -> Column | None:
    dips, rate, std = _first(df, "n_dip_runs", "n_dips", "number of dips"), _first(df, "peaks_per_time", "peaks per time"), _first(df, "std_mag", "std mag", "std")
    if dips is None or rate is None or std is None:
        return None
    return dips.between(least_dips, most_dips) & (rate <= most_rate) & (std <= most_std)


def _of_rule(rule: Callable[..., Column | None], what: str) -> Callable[..., DataFrame]:
    def kept(df: DataFrame, *args: float | None, **parameters: float | None) -> DataFrame:
        return ByRule(lambda d: rule(d, *args, **parameters))(df)

    kept.__doc__ = what
    return kept


dip_dominated = _of_rule(dip_dominated_rule, "Candidates dominated by dips in some band, by fraction or by flag; an empty result is empty, not an error.")
multi_camera = _of_rule(multi_camera_rule, "Candidates that enough cameras saw.")
periodic = _of_rule(periodic_rule, "Candidates without a strong period; a missing power fails.")
sparse = _of_rule(sparse_rule, "Candidates that were seen long and often enough.")
box = _of_rule(box_rule, "Few, sparse dips on a quiet source; all three values must be there.")


def sigma_resid(df: DataFrame, raw: DataFrame, least: float = 3.0, key: str = ID) -> DataFrame:
    """Candidates whose depth in some band is so many times the median camera scatter; raw has a row per camera."""
    scatter = raw.groupBy(key).agg(F.median(F.col("sig1_high") - F.col("sig1_low")).alias("_scatter"))
    depths = [as_number(df, c) for c in ("g_max_depth", "v_max_depth", "max_depth") if c in df.columns]
    deep = reduce(Column.__or__, [F.coalesce(d / F.col("_scatter") >= least, F.lit(False)) for d in depths], F.lit(False))
    return df.join(scatter, key).where((F.col("_scatter") > 0) & deep).drop("_scatter")


def with_catalog(df: DataFrame, catalog: DataFrame, key: str = ID) -> DataFrame:
    """Candidates with position and proper motion of the catalog, where the motion is known; repeated catalog rows repeat them."""
    known = catalog.select(F.col(key).cast("string").alias(key), "ra", "dec", "pm_ra", "pm_dec").dropna(subset=["pm_ra", "pm_dec"])
    return df.withColumn(key, F.col(key).cast("string")).join(known, key)


def with_vsx_class(df: DataFrame, vsx: DataFrame, radius_arcsec: float = 3.0) -> DataFrame:
    """Candidates with the class and separation of the nearest catalogued variable within the radius, null without one."""
    from .sky import nearest

    return nearest(df, vsx.select("ra", "dec", "class"), radius_arcsec, {"class": "vsx_class"}, "vsx_sep_arcsec")


def rejected(before: DataFrame, after: DataFrame, label: str, key: str = ID) -> DataFrame:
    """The ids that a step dropped, with its name."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti").withColumn("filter", F.lit(label))


def chain(df: DataFrame, steps: Sequence[Step], key: str = ID) -> tuple[DataFrame, DataFrame]:
    """What passes all steps, and the rejection log: the ids that a step leaves no row of, with the step's name.

    Rows are numbered by the steps that they have passed, in one pass and without joins beyond the steps' own: a step
    that only filters becomes a mark, as its condition holds or not whatever came before; a step that joins is run on
    what is left. An id's rejection is the last step that any of its rows reached."""
    log, marked = None, df.withColumn(_FAILED, F.lit(None).cast("int"))
    labels = [label for label, _ in steps]
    for i, (_, step) in enumerate(steps):
        rule = getattr(step, "rule", None)
        if rule is not None:
            test = rule(marked)
            if test is None:
                LOG.warning("step %s passes all rows: its columns are missing", labels[i])
            else:
                marked = marked.withColumn(_FAILED, F.when(F.col(_FAILED).isNull() & ~F.coalesce(test, F.lit(False)), i).otherwise(F.col(_FAILED)))
            continue
        own = _logged(marked, labels, key)
        left = marked.where(F.col(_FAILED).isNull())
        after = step(left)
        own = own.unionByName(rejected(left, after, labels[i], key))
        log, marked = own if log is None else log.unionByName(own), after
    own = _logged(marked, labels, key)
    return marked.where(F.col(_FAILED).isNull()).drop(_FAILED), own if log is None else log.unionByName(own)


_FAILED = "_failed_step"


def _logged(marked: DataFrame, labels: Sequence[str], key: str) -> DataFrame:
    """Ids of which no row is left, with the last step that failed one."""
    last = marked.groupBy(key).agg(F.max(_FAILED).alias("_last"), F.count_if(F.col(_FAILED).isNull()).alias("_left")).where("_left = 0")
    return last.select(key, F.get(F.array(*map(F.lit, [*labels, ""])), F.col("_last")).alias("filter"))


class ByRule:
    """A step that keeps the rows for which a condition on their own columns holds; no condition keeps all."""

    def __init__(self, rule: Callable[[DataFrame], Column | None]) -> None:
        self.rule = rule

    def __call__(self, df: DataFrame) -> DataFrame:
        test = self.rule(df)
        return df if test is None else df.where(test)


def default_steps(*, raw: DataFrame | None = None, catalog: DataFrame | None = None, vsx: DataFrame | None = None, least_dip_fraction: float = 0.66, least_cameras: int = 2, most_power: float = 0.5, use_box: bool = False, skip: Sequence[str] = (),
                  least_period: float | None = None, most_period: float | None = None, least_span: float = 200.0, least_rate: float = 0.05, least_dips: int = 1, most_dips: int = 9, most_rate: float = 0.015, most_std: float = 0.15, least_sigma: float = 3.0, radius_arcsec: float = 3.0) -> list[Step]:
    """The chain's usual steps in order, cheap ones first; joins only with their tables."""
    steps: list[Step] = [("dip_dominated", ByRule(lambda d: dip_dominated_rule(d, least_dip_fraction))), ("multi_camera", ByRule(lambda d: multi_camera_rule(d, least_cameras)))]
    if use_box:
        steps.append(("box", ByRule(lambda d: box_rule(d, least_dips, most_dips, most_rate, most_std))))
    steps.append(("sparse", ByRule(lambda d: sparse_rule(d, least_span, least_rate))))
    if catalog is not None:
        steps.append(("bns", lambda d: with_catalog(d, catalog)))
    if raw is not None:
        steps.append(("sigma", lambda d: sigma_resid(d, raw, least_sigma)))
    if vsx is not None:
        steps.append(("vsx_class", lambda d: with_vsx_class(d, vsx, radius_arcsec)))
    steps.append(("periodic", ByRule(lambda d: periodic_rule(d, most_power, least_period, most_period))))
    return [s for s in steps if s[0] not in skip]


def latest_per_bin(files: DataFrame, name: str = "file") -> DataFrame:
    """The newest peaks file of each magnitude bin, by the time stamp in its name."""
    pattern = r"peaks_(\d+(?:_5)?)_(\d+(?:_5)?)_(\d{8}_\d{6}[+-]\d{4})"
    part = lambda i: F.regexp_extract(name, pattern, i)
    named = files.withColumns({"low": part(1), "high": part(2), "ts": part(3)}).where(F.col("ts") != "")
    return named.groupBy("low", "high").agg(F.max_by(name, "ts").alias(name), F.max("ts").alias("ts"))


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql import Window as W

    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def fp_summary(df: DataFrame) -> DataFrame:
    """Candidates by magnitude bin, with a total (mag_bin null): n, and with peaks in g, V, either and both."""
    g, v = (F.coalesce(as_number(df, f"{b}_n_peaks"), F.lit(0.0)) > 0 for b in "gv")
    flagged = df.select("mag_bin", g.alias("g"), v.alias("v"))
    return flagged.rollup("mag_bin").agg(F.count("*").alias("n"), F.count_if("g").alias("n_g"), F.count_if("v").alias("n_v"), F.count_if(F.col("g") | F.col("v")).alias("n_either"), F.count_if(F.col("g") & F.col("v")).alias("n_both"))


def retention(before: DataFrame, after: DataFrame, key: str = ID) -> DataFrame:
    """One row: rows before, distinct ids kept, and their ratio."""
    kept = before.select(key).intersect(after.select(key)).agg(F.count("*").alias("n_kept"))
    return before.agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(kept)).withColumn("retention", F.when(F.col("n_before") > 0, F.col("n_kept") / F.col("n_before")))
