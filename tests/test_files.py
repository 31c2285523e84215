"""Readers, writers and lookups on small files."""

import pytest

from dimwatch.operators import clean, lookups
from dimwatch.sources import files, sinks


def test_dat2_and_csv_make_points(spark, tmp_path):
    (tmp_path / "11.dat2").write_text("2458000.5 13.1 0.02 1 7 0 0 ba/F12\n  2458001.5  13.2 0.03 0 8 1 1 bb/F13\n# note\n")
    (tmp_path / "12-light-curves.csv").write_text("# made by hand\nJD,Flux,Flux Error,Mag,Mag Error,Limit,FWHM,Filter,Quality,Camera\n2458000.5,1,1,13.5,0.02,17,1,V,G,ba\n2458001.5,1,1,13.6,x,17,1,g,B,bb\n2458002.5,1,1,13.7,0.02,17,1,R,G,bb\n")
    dat = files.read_dat2(spark, str(tmp_path / "*.dat2")).orderBy("jd").collect()
    assert [(r["source_id"], r["band"], r["camera"], r["camera_name"], r["field"], r["saturated"]) for r in dat] == [("11", 0, "7", "ba", "F12", 0), ("11", 1, "8", "bb", "F13", 1)]
    csv = files.read_skypatrol(spark, str(tmp_path / "*.csv")).orderBy("jd").collect()
    assert [(r["source_id"], r["band"], r["error"], r["good_bad"]) for r in csv] == [("12", 1, 0.02, 1), ("12", 0, None, 0), ("12", 0, 0.02, 1)]
    assert files.read_skypatrol(spark, str(tmp_path / "*.csv"), "drop").count() == 2
    assert files.read_light_curves(spark, [str(tmp_path / "*.csv"), str(tmp_path / "*.dat2")]).count() == 5


def test_fixed_width_catalog(spark, tmp_path):
    line = [" "] * 206
    for name, value in {"id_vsx": "42", "name": "AB Cas", "ra": "10.5", "dec": "-3.25", "class": "EA", "mag_max": "9.1", "period": "abc"}.items():
        start = next(a for n, a, _, _ in files.VSX if n == name)
        line[start : start + len(value)] = value
    (tmp_path / "vsx.dat").write_text("".join(line) + "\n")
    r = files.read_vsx(spark, str(tmp_path / "vsx.dat")).first()
    assert (r["id_vsx"], r["name"], r["ra"], r["dec"], r["class"], r["mag_max"], r["period"]) == (42, "AB Cas", 10.5, -3.25, "EA", 9.1, None)


def test_catalog_without_motion_is_an_error(spark, tmp_path):
    (tmp_path / "c.csv").write_text("asas_sn_id,ra_deg,dec_deg,pm_ra,pm_dec\n1,2,3,4,5\n2,2,3,,5\n")
    with pytest.raises(ValueError, match="proper motion"):
        files.read_catalog(spark, str(tmp_path / "c.csv"))


def test_manifest_takes_the_first_bin(spark, tmp_path):
    for mag_bin, ids in (("12_12.5", "1\n2"), ("13_13.5", "2\n3")):
        (tmp_path / mag_bin).mkdir()
        (tmp_path / mag_bin / "index4_masked.csv").write_text(f"asas_sn_id\n{ids}\n")
    (tmp_path / "lc/12_12.5/lc4_cal").mkdir(parents=True)
    (tmp_path / "lc/12_12.5/lc4_cal/2.dat2").write_text("1 2 3\n")
    indexes = files.read_indexes(spark, str(tmp_path), ("12_12.5", "13_13.5"))
    got = files.manifest(indexes, str(tmp_path / "lc"), files.files(spark, str(tmp_path / "lc/*/lc*_cal/*.dat2"))).collect()
    assert [(r["source_id"], r["mag_bin"], r["index_num"], r["dat_exists"]) for r in got] == [("1", "12_12.5", 4, False), ("2", "12_12.5", 4, True), ("3", "13_13.5", 4, False)]


def test_writers_append_and_keep(spark, tmp_path):
    df = spark.createDataFrame([("a", "12_12.5"), ("b", "13_13.5")], "source_id string, mag_bin string")
    for _ in range(2):
        sinks.append_rows(df, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4
    path = sinks.write_peaks(df, str(tmp_path), "12_12.5", "20250101_000000")
    assert path == sinks.write_peaks(df.limit(0), str(tmp_path), "12_12.5", "20250101_000000") and files.read_csv(spark, path).count() == 2
    assert len(files.expanded(spark, [str(tmp_path / "*"), str(tmp_path / "rows")], exclude="peaks*")) == 1
    assert files.read_many(spark, [path, str(tmp_path / "absent")]).count() == 2


def test_fuzzy_ids_rank_their_matches(spark):
    wanted = spark.createDataFrame([("500",), ("123400.0",), ("1234567891",), ("77",), (None,)], "id string")
    there = spark.createDataFrame([("500",), ("123400",), ("1234567895",), ("90000",)], "id string")
    got = {r["id"]: (r["match"], r["rank"]) for r in lookups.fuzzy_ids(wanted, there).collect()}
    assert got == {"500": ("500", 0), "123400.0": ("123400", 1), "1234567891": ("1234567895", 2), "77": (None, None)}


def test_metadata_by_id_then_path_then_name(spark):
    wanted = spark.createDataFrame([("1", "/x/9.dat2", "N"), ("8", "/x/2.dat2", "n"), ("8-light-curves", "", "Star C"), ("5", "", "")], "source_id string, dat_path string, source string")
    rows = spark.createDataFrame([("1", "/x/1.dat2", "A", "dip", "EA"), ("2", "/x/2.dat2", "B", "jump", ""), ("3", "/x/3.dat2", "star c", "dip", "M")], "Match_ID string, DAT_Path string, Source string, Category string, VSX_Class string")
    got = {r["source_id"]: r["category"] for r in lookups.source_metadata(wanted, rows).collect()}
    assert got == {"1": "dip", "8": "jump", "8-light-curves": "dip", "5": None}


def test_candidates_default_to_unknown(spark):
    wanted = spark.createDataFrame([("/a/1.dat2",), ("1",), ("2-light-curves.csv",)], "id string")
    known = spark.createDataFrame([("1", "dipper")], "source_id string, category string")
    assert {(r["source_id"], r["category"]) for r in lookups.as_candidates(wanted, known).collect()} == {("1", "dipper"), ("2", "unknown")}


def test_points_are_numbered_by_line_over_many_splits(spark, tmp_path):
    (tmp_path / "big.dat2").write_text("# note\n" + "".join(f"{2458000 + i // 2} {13 + i / 1e4:.4f} 0.02 1 7 0 0 ba/F12\n" for i in range(2000)))
    (tmp_path / "small.dat2").write_text("1 2 0.1 1 7 0 0 ba/F12\n\n3 4 0.1 1 7 0 0 ba/F12\n")
    head = "JD,Mag,Mag Error,Filter,Quality,Camera\n"
    (tmp_path / "curve.csv").write_text(head + "".join(f"{i},{13 + i / 1e4},0.02,g,G,ba\n" for i in range(2000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, ("4096", "64")):
            spark.conf.set(k, v)
        points = files.read_dat2(spark, str(tmp_path / "*.dat2"))
        assert points.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path / "big.dat2")).rdd.getNumPartitions() > 10
        rows = points.collect()
        curve = files.read_skypatrol(spark, str(tmp_path / "curve.csv")).collect()
        first = clean.stats_quality(points).where("source_id = 'big'").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["seq"], r["mag"]) for r in rows if r["source_id"] == "big") == [(i + 1, pytest.approx(13 + i / 1e4)) for i in range(2000)]
    assert sorted((r["seq"], r["mag"]) for r in rows if r["source_id"] == "small") == [(0, 2.0), (2, 4.0)]
    assert sorted((r["seq"], r["jd"]) for r in curve) == [(i, float(i)) for i in range(2000)]
    assert len(first) == 1000 and all(r["seq"] % 2 == 1 for r in first)  # of equal times the first line


def test_many_small_files_make_a_short_plan(spark, tmp_path):
    for i in range(600):
        head, row = ("a,b", f"{i},x") if i % 2 else ("b,c", f"y,{i}")
        (tmp_path / f"{i}.csv").write_text(f"{head}\n{row}\n")
    (tmp_path / "empty.csv").write_text("")
    spark.createDataFrame([(7, 1.5)], "a int, d double").write.parquet(str(tmp_path / "table"))
    out = files.read_many(spark, [str(tmp_path)])
    rows = out.collect()
    assert len(rows) == 601 and sorted(out.columns) == ["a", "b", "c", "d"] and {r["d"] for r in rows} == {None, "1.5"}
    assert sorted(int(r["a"]) for r in rows if r["b"] == "x") == list(range(1, 600, 2))
    scans = out._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert scans == 3 and files.read_many(spark, [str(tmp_path / "none*")]) is None
