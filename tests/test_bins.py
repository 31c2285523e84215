"""Runs over bins that break off and go on, and the commands that use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimwatch.__main__ import main
from dimwatch.functions import candidates
from dimwatch.sources import bins


def sources(spark):
    rows = [(str(i), f"{12 + i % 4}_{13 + i % 4}") for i in range(40)] + [("1", "13_14"), ("99", None)]
    return spark.createDataFrame(rows, "source_id string, mag_bin string")


def test_a_broken_run_goes_on(spark, tmp_path):
    own, made, fail_at = sources(spark), [], ["14_15"]

    def rows_of(part):
        names = sorted({r["mag_bin"] for r in part.collect()})
        made.append(names)
        rows = part.where("mag_bin <> '13_14' or source_id <> '5'").select("source_id", F.length("source_id").alias("n")).distinct()
        if names == fail_at:  # breaks while rows are made
            return rows.withColumn("n", F.raise_error(F.lit("lost")))
        return rows

    with pytest.raises(Exception, match="lost"):
        bins.run_bins(own, rows_of, f"{tmp_path}/a")
    assert [r["mag_bin"] for r in bins.commits(spark, f"{tmp_path}/a").orderBy("mag_bin").collect()] == ["12_13", "13_14"]
    # rows of a bin that were written without a commit, as if the driver had died in between
    spark.createDataFrame([("left over", 1, "14_15")], "source_id string, n int, mag_bin string").write.mode("append").partitionBy("mag_bin").parquet(f"{tmp_path}/a/rows")
    assert bins.committed_rows(spark, f"{tmp_path}/a").where("mag_bin = '14_15'").count() == 0
    fail_at.clear()
    again = bins.run_bins(own, rows_of, f"{tmp_path}/a")
    whole = bins.run_bins(own, rows_of, f"{tmp_path}/b", together=4)
    assert sorted(map(tuple, again.select("source_id", "n", "mag_bin").collect())) == sorted(map(tuple, whole.select("source_id", "n", "mag_bin").collect()))
    assert made == [["12_13"], ["13_14"], ["14_15"], ["14_15"], ["15_16"], ["12_13", "13_14", "14_15", "15_16"]]
    counts = {r["mag_bin"]: r["n_rows"] for r in bins.commits(spark, f"{tmp_path}/b").collect()}
    assert counts == {"12_13": 10, "13_14": 9, "14_15": 10, "15_16": 10} and whole.count() == 39
    assert bins.run_bins(own, rows_of, f"{tmp_path}/b").count() == 39 and len(made) == 6


def test_bins_and_targets_by_command(spark, tmp_path):
    rng = np.random.default_rng(1)
    known = [r for r in candidates.LABELLED if r[3] in ("13_13.5", "13.5_14")][:4]
    rows = []
    for k, (_, name, _, mag_bin, _, _) in enumerate(known):
        folder = tmp_path / mag_bin / "lc1_cal"
        folder.mkdir(parents=True, exist_ok=True)
        dip = 4.0 if k % 2 else 0.0
        lines = [f"{2458000 + i} {13 + rng.normal(0, 0.01) + (dip if 60 <= i < 66 else 0):.4f} 0.02 1 3 0 0 ba/F1" for i in range(120)]
        (folder / f"{name}.dat2").write_text("\n".join(lines) + "\n")
        rows.append((name, mag_bin, str(folder), f"{folder}/{name}.dat2", True))
    spark.createDataFrame(rows, "source_id string, mag_bin string, lc_dir string, dat_path string, dat_exists boolean").coalesce(1).write.parquet(f"{tmp_path}/manifest")
    for _ in range(2):
        main(["find-bins", "--manifest", f"{tmp_path}/manifest", "--root", f"{tmp_path}/run", "--output", f"{tmp_path}/found"])
    found = {r["source_id"]: r["g_is_dip_dominated"] for r in spark.read.parquet(f"{tmp_path}/found").collect()}
    assert found[known[1][1]] and found[known[3][1]] and spark.read.parquet(f"{tmp_path}/run/commits").count() == len({r[3] for r in known})
    for method in ("naive", "biweight", "bayes"):
        more = ["--baseline", "global_median"] if method == "bayes" else []
        main(["reproduce", "--method", method, *more, "--manifest", f"{tmp_path}/manifest", "--output", f"{tmp_path}/{method}"])
        report = {r["source_id"]: r for r in spark.read.parquet(f"{tmp_path}/{method}").collect()}
        assert len(report) == 29 and not report[candidates.LABELLED[-1][1]]["detected"]
    assert report[known[1][1]]["detected"] and "dip significant" in report[known[1][1]]["detection_details"] and not report[known[0][1]]["detected"]


def test_newest_file_of_each_bin(spark, tmp_path):
    for name in ("peaks_13_13_5_20250101_000000-0500.csv", "peaks_13_13_5_20250301_000000-0500.csv", "peaks_13_5_14_20250201_000000-0500.csv", "other.csv"):
        (tmp_path / name).write_text("source_id,g_n_peaks,v_n_peaks,n_cameras\n1,2,0,3\n")
    main(["filter", f"{tmp_path}/*.csv", "--latest", "--dry-run", "--output", f"{tmp_path}/list"])
    assert sorted(r["file"].rpartition("/")[2] for r in spark.read.parquet(f"{tmp_path}/list").collect()) == ["peaks_13_13_5_20250301_000000-0500.csv", "peaks_13_5_14_20250201_000000-0500.csv"]
    main(["filter", f"{tmp_path}/*.csv", "--latest", "--min-cameras", "3", "--output", f"{tmp_path}/kept"])
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 2


def test_labelled_candidates(spark):
    rows = candidates.labelled(spark)
    assert rows.count() == 29 and rows.where("expected_detected").count() == 21


def test_tables_and_stamped_catalogs_by_command(spark, tmp_path):
    (tmp_path / "5.dat2").write_text("".join(f"{2458000 + i} {13 + i / 100:.2f} 0.02 1 3 {i % 2} 0 ba/F1\n" for i in range(30)))
    main(["stats", f"{tmp_path}/*.dat2", "--tables", f"{tmp_path}/tables", "--output", f"{tmp_path}/stats"])
    assert spark.read.parquet(f"{tmp_path}/tables/nights").count() == 30 and spark.read.parquet(f"{tmp_path}/tables/seasons").count() == 1
    line = [" "] * 206
    for at, value in ((0, "42"), (42, "10.5"), (52, "-3.25"), (62, "VAR")):
        line[at : at + len(value)] = value
    (tmp_path / "vsx.dat").write_text("".join(line) + "\n")
    main(["clean-vsx", "--catalog", f"{tmp_path}/vsx.dat", "--stamp", "20250101_0000", "--output", f"{tmp_path}/catalogs"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/catalogs/clean_vsx_20250101_0000").first()["class"] == "VAR"
