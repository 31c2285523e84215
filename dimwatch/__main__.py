"""Command line: `python -m dimwatch COMMAND ...`. Each command is one read, one plan and one write."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import candidates, reports, vsx
from .operators import bayes, filters, finder, rows, sky, stats
from .operators.baselines import BASELINES
from .sources import bins, files, sinks


def _scan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    points = files.read_light_curves(spark, files.expanded(spark, a.inputs))
    limits = {"logbf": a.logbf_threshold, "probability": a.significance_threshold}
    return rows.scan_rows(points, a.baseline, a.trigger_mode, min_points=a.run_min_points, **limits).withColumnRenamed("source_id", "path")


def _find(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    points = files.read_light_curves(spark, files.expanded(spark, a.inputs))
    raw = files.read_raw(spark, files.expanded(spark, a.raw)) if a.raw else None
    found = finder.source_rows(points, a.mode, raw, a.naive, a.baseline, a.sigma, a.distance)
    lists = [c for c, kind in found.dtypes if kind.startswith("array")]
    return found.withColumns({c: finder.in_order(F.col(c)) for c in lists}) if a.format == "csv" else found


def _find_bins(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    def rows_of(sources: DataFrame) -> DataFrame:
        found = finder.source_rows(bins.light_curves_of(sources, files.read_light_curves), a.mode, None, a.naive, a.baseline, a.sigma, a.distance)
        return found.where((F.col("g_n_peaks") > 0) | (F.col("v_n_peaks") > 0))

    manifest = files.read_manifest(spark, a.manifest)
    manifest = manifest.where(F.col("dat_exists").cast("boolean"))
    return bins.run_bins(manifest.where(F.col("mag_bin").isin(a.mag_bin)) if a.mag_bin else manifest, rows_of, a.root, a.together)


def _filter(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    paths = files.expanded(spark, a.inputs, a.include, a.exclude)
    if a.latest:
        named = spark.createDataFrame([(p,) for p in paths], "file string")
        paths = sorted(r["file"] for r in filters.latest_per_bin(named).collect())
    if a.dry_run:
        return spark.createDataFrame([(p,) for p in paths], "file string")
    df = files.read_many(spark, paths)
    if df is None:
        raise SystemExit("no input files")
    catalog = files.read_csv(spark, a.catalog, ("ra", "dec", "pm_ra", "pm_dec")) if a.catalog else None
    variables = files.read_vsx(spark, a.vsx) if a.vsx else None
    raw = files.read_raw(spark, files.expanded(spark, a.raw)) if a.raw else None
    steps = filters.default_steps(
        raw=raw, catalog=catalog, vsx=variables, least_dip_fraction=a.min_dip_fraction, least_cameras=a.min_cameras, most_power=a.max_power, use_box=a.box, skip=a.skip, least_period=a.min_period, most_period=a.max_period,
        least_span=a.min_time_span, least_rate=a.min_points_per_day, least_dips=a.box_min_dips, most_dips=a.box_max_dips, most_rate=a.box_max_peaks_per_time, most_std=a.box_max_std_mag, least_sigma=a.min_sigma, radius_arcsec=a.match_radius_arcsec,
    )
    kept, log = filters.chain(filters.with_peaks(df, a.band) if "g_n_peaks" in df.columns else df, steps)
    if a.rejections:
        sinks.append_rejections(log, a.rejections)
    return kept


def _manifest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return files.manifest(files.read_indexes(spark, a.index_root, a.mag_bin or files.MAG_BINS), a.lc_root, files.files(spark, f"{a.lc_root}/*/lc*_cal/*.dat2"), a.id_column)


def _stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    points = files.read_light_curves(spark, files.expanded(spark, a.inputs))
    for name, made in stats.child_tables(points).items() if a.tables else ():
        sinks.write_results(made, f"{a.tables}/{name}")
    return stats.source_statistics(points)


def _vsx(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return vsx.clean_catalog(files.read_vsx(spark, a.catalog))


def _crossmatch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    left = files.read_catalog(spark, a.inputs).withColumnsRenamed({"asas_sn_id": "source_id", "ra_deg": "ra", "dec_deg": "dec"})
    return filters.with_vsx_class(sky.propagated(left), vsx.clean_catalog(files.read_vsx(spark, a.catalog)), a.radius)


def _reproduce(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The report on labelled targets, of detections that there are, or of a method run on the targets' light curves."""
    targets = files.read_csv(spark, a.targets).withColumn("expected_detected", F.col("expected_detected").cast("boolean")) if a.targets else candidates.labelled(spark)
    manifest = files.read_manifest(spark, a.manifest)
    if not a.method:
        return reports.reproduction_report(targets, manifest, files.read_many(spark, files.expanded(spark, a.inputs)))
    own = manifest.where(F.col("dat_exists").cast("boolean")).join(F.broadcast(targets.select("source_id").distinct()), "source_id", "left_semi")
    points = files.read_light_curves(spark, sorted(r["dat_path"] for r in own.select("dat_path").collect()))
    if a.method == "bayes":
        found = rows.scan_rows(points, a.baseline or "per_camera_gp")
    else:
        found = finder.source_rows(points, naive=a.method == "naive", baseline=a.baseline)
    return reports.reproduction_report(targets, manifest, found.join(own.select("source_id", "mag_bin"), "source_id"))


def parser() -> argparse.ArgumentParser:
    # Names and defaults of the options, which users type.
    top = argparse.ArgumentParser(prog="dimwatch", description="Event search in light curves")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *inputs: str) -> argparse.ArgumentParser:  # noqa: ANN001
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if "inputs" in inputs:
            p.add_argument("inputs", nargs="+")
        p.add_argument("--output", required=True)
        p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
        return p

    scan = command("scan", _scan, "inputs")
    scan.add_argument("--baseline", default="per_camera_gp", help=f"module:function, or one of {', '.join(sorted(BASELINES))}")
    scan.add_argument("--trigger-mode", choices=("logbf", "posterior_prob"), default="logbf")
    scan.add_argument("--logbf-threshold", type=float, default=bayes.LOGBF_THRESHOLD)
    scan.add_argument("--significance-threshold", type=float, default=100 * bayes.PROBABILITY_THRESHOLD)
    scan.add_argument("--run-min-points", type=int, default=3)
    find, by_bin = command("find", _find, "inputs"), command("find-bins", _find_bins)
    for p in (find, by_bin):
        p.add_argument("--mode", choices=("dips", "peaks"), default="dips")
        p.add_argument("--naive", action="store_true")
        p.add_argument("--baseline", help="a name, or module:function; by default that of the mode")
        p.add_argument("--sigma", type=float, default=finder.BAND["height"])
        p.add_argument("--distance", type=int, default=finder.BAND["distance"])
    find.add_argument("--raw", nargs="*")
    by_bin.add_argument("--manifest", required=True)
    by_bin.add_argument("--root", required=True, help="where finished bins are kept; a run that is started again goes on from them")
    by_bin.add_argument("--mag-bin", action="append")
    by_bin.add_argument("--together", type=int, default=1)
    keep = command("filter", _filter, "inputs")
    for name, kind, default in (("include", str, "*"), ("exclude", str, None), ("catalog", str, None), ("vsx", str, None), ("rejections", str, None), ("min-dip-fraction", float, 0.66), ("min-cameras", int, 2), ("max-power", float, 0.5), ("min-period", float, None), ("max-period", float, None), ("min-time-span", float, 200.0), ("min-points-per-day", float, 0.05),
                                ("box-min-dips", int, 1), ("box-max-dips", int, 9), ("box-max-peaks-per-time", float, 0.015), ("box-max-std-mag", float, 0.15), ("min-sigma", float, 3.0), ("match-radius-arcsec", float, 3.0)):
        keep.add_argument(f"--{name}", type=kind, default=default)
    keep.add_argument("--band", choices=("g", "v", "both", "either"), default="either")
    keep.add_argument("--box", action="store_true")
    keep.add_argument("--skip", nargs="*", default=[])
    keep.add_argument("--raw", nargs="*")
    keep.add_argument("--latest", action="store_true", help="of each magnitude bin the newest peaks file only")
    keep.add_argument("--dry-run", action="store_true", help="only list the input files")
    listing = command("manifest", _manifest)
    listing.add_argument("--index-root", required=True)
    listing.add_argument("--lc-root", required=True)
    listing.add_argument("--mag-bin", action="append")
    listing.add_argument("--id-column", default="asas_sn_id")
    command("stats", _stats, "inputs").add_argument("--tables", help="where the tables that go with the statistics are written")
    cleaned, match = command("clean-vsx", _vsx), command("crossmatch", _crossmatch, "inputs")
    cleaned.add_argument("--catalog", required=True)
    for p in (cleaned, match):
        p.add_argument("--stamp", help="output is a folder that gets a CSV named by command and stamp")
    match.add_argument("--catalog", required=True)
    match.add_argument("--radius", type=float, default=3.0)
    again = command("reproduce", _reproduce)
    again.add_argument("inputs", nargs="*")
    again.add_argument("--targets", help="by default the labelled candidates")
    again.add_argument("--method", choices=("naive", "biweight", "bayes"))
    again.add_argument("--baseline")
    again.add_argument("--manifest", required=True)
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("dimwatch").getOrCreate()
    out = a.run(spark, a)
    if getattr(a, "stamp", None):
        sinks.write_stamped(out, a.output, a.command.replace("-", "_"), a.stamp)
    elif a.format == "csv":
        out.write.mode("overwrite").option("header", True).csv(a.output)
    else:
        sinks.write_results(out, a.output)


if __name__ == "__main__":
    main()
