"""Light curves, catalogs and manifests from files; every reader takes many paths or globs and reads them distributed.

Files are matched by name on the cluster's file system; a light curve's source_id is its file's stem. Numbers that don't
parse are null. seq is a point's line (from 0, comments counted), or in CSV files its row, in its file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .adapters import POINT_COLUMNS

Paths = str | Sequence[str]

# Magnitude bins; columns of a .dat2 file and of a .raw file.
MAG_BINS = ("12_12.5", "12.5_13", "13_13.5", "13.5_14", "14_14.5", "14.5_15")
DAT2 = ("jd double", "mag double", "error double", "good_bad int", "camera string", "band int", "saturated int", "cam_field string")
RAW = ("camera string", "median double", "sig1_low double", "sig1_high double", "p90_low double", "p90_high double")
# The variable-star index's columns, each with its first character from 0, the one after its last, and type.
VSX = (
    ("id_vsx", 0, 8, "bigint"), ("name", 9, 39, "string"), ("var_flag", 40, 41, "bigint"), ("ra", 42, 51, "double"), ("dec", 52, 61, "double"), ("class", 62, 92, "string"),
    ("l_max", 93, 94, "bigint"), ("mag_max", 95, 102, "double"), ("u_max", 103, 104, "bigint"), ("mag_band_max", 105, 112, "string"), ("f_min", 113, 114, "bigint"), ("l_min", 115, 116, "bigint"),
    ("mag_min", 117, 124, "double"), ("u_min", 125, 126, "bigint"), ("mag_band_min", 127, 135, "string"), ("epoch", 136, 150, "double"), ("u_epoch", 151, 152, "bigint"), ("l_period", 153, 154, "bigint"),
    ("period", 155, 174, "double"), ("u_period", 175, 176, "bigint"), ("spectral_type", 177, 206, "string"),
)


def _list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _placed(rows: DataFrame) -> DataFrame:
    """rows read from files, with their path, the split's first byte, and a number that grows by 1 within a split."""
    return rows.withColumns({"_path": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"), "_n": F.monotonically_increasing_id()})


def numbered(rows: DataFrame, to: str = "seq") -> DataFrame:
    """rows of _placed with their number in the file, from 0, whatever the splits. The rows of each split are counted first;
    prefix sums of the counts within a file, a row per split, say what a split's first number is."""
    splits = rows.groupBy("_path", "_at").agg(F.count("*").alias("_rows"), F.min("_n").alias("_first"))
    before = F.sum("_rows").over(W.partitionBy("_path").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.select("_path", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, ["_path", "_at"]).withColumn(to, F.col("_n") + F.col("_shift")).drop("_at", "_n", "_shift")


def _fields(spark: SparkSession, paths: Paths, columns: Sequence[str], has_header: bool = False) -> DataFrame:
    """Lines of white-space separated fields as columns, with `path` and `seq`; comments and empty lines are passed over."""
    lines = numbered(_placed(spark.read.text(_list(paths)))).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v"), F.col("_path").alias("path"), "seq")
    lines = lines.where((F.col("v") != "") & ~F.col("v").startswith("#"))
    if has_header:  # a header's first field is no number
        lines = lines.where(F.expr("try_cast(split_part(v, ' ', 1) as double)").isNotNull())
    fields = F.split("v", " ")
    typed = [F.get(fields, F.lit(i)).try_cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(columns)]
    return lines.select("path", *typed, "seq")


def read_dat2(spark: SparkSession, paths: Paths) -> DataFrame:
    """Points of .dat2 light curves, with camera_name and field; band 0 is g, 1 is V."""
    name = F.split("cam_field", "/")
    rows = _fields(spark, paths, DAT2).withColumns({"source_id": stem(F.col("path")), "camera_name": F.get(name, F.lit(0)), "field": F.get(name, F.lit(1))})
    return rows.select(*POINT_COLUMNS, "camera_name", "field")


def read_dat(spark: SparkSession, paths: Paths, columns: Sequence[str] = DAT2, has_header: bool = False) -> DataFrame:
    """White-space separated files under given `name type` columns; fields that a line lacks are null."""
    return _fields(spark, paths, columns, has_header).withColumn("source_id", stem(F.col("path"))).drop("path")


def read_skypatrol(spark: SparkSession, paths: Paths, unknown_band: str = "g") -> DataFrame:
    """Points of `<id>-light-curves.csv` or `<id>.csv`. Filters other than g and V count as g, or are dropped together
    with points without time or magnitude (unknown_band="drop")."""
    raw = numbered(_placed(spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(_list(paths))), "_seq")
    first = F.lower(F.trim(F.col("Filter")))
    number = lambda c: F.col(c).try_cast("double")
    rows = raw.select(
        F.regexp_replace(stem(F.col("_path")), "-light-curves$", "").alias("source_id"), F.when(first.startswith("v"), 1).otherwise(0).alias("band"), F.col("Camera").alias("camera"), number("JD").alias("jd"),
        number("Mag").alias("mag"), number("Mag Error").alias("error"), F.lit(0).alias("saturated"), (F.col("Quality") == "G").cast("int").alias("good_bad"), F.col("_seq").alias("seq"), first.alias("_f"),
    )
    if unknown_band == "drop":
        rows = rows.where(F.col("_f").isin("g", "v") & F.col("jd").isNotNull() & F.col("mag").isNotNull())
    elif unknown_band != "g":
        raise ValueError(f"unknown_band must be g or drop, not {unknown_band}")
    return rows.drop("_f")


def read_light_curves(spark: SparkSession, paths: Paths, unknown_band: str = "g") -> DataFrame:
    """Points of files of both kinds, told apart by their suffix."""
    csv, other = ([p for p in _list(paths) if p.lower().endswith(".csv") == is_csv] for is_csv in (True, False))
    found = ([read_skypatrol(spark, csv, unknown_band)] if csv else []) + ([read_dat2(spark, other)] if other else [])
    return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)


def read_raw(spark: SparkSession, paths: Paths) -> DataFrame:
    """Per-camera summaries of .raw files."""
    return _fields(spark, paths, RAW).withColumn("source_id", stem(F.col("path"))).drop("path", "seq")


def read_vsx(spark: SparkSession, path: Paths) -> DataFrame:
    """The fixed-width catalog of variable stars."""
    cell = lambda a, b: F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit(""))
    return spark.read.text(_list(path)).where(F.length("value") > 0).select(*(cell(a, b).try_cast(kind).alias(name) for name, a, b, kind in VSX))


def read_csv(spark: SparkSession, paths: Paths, numbers: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header, all strings but for the named numbers."""
    df = spark.read.option("header", True).csv(_list(paths))
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in df.columns})


def read_catalog(spark: SparkSession, paths: Paths, key: str = "asas_sn_id") -> DataFrame:
    """The survey catalog. Rows without a finite proper motion are an error, which shows ten of them."""
    df = read_csv(spark, paths, ("ra_deg", "dec_deg", "pm_ra", "pm_dec"))
    bad = df.where(~(F.abs(F.coalesce("pm_ra", F.lit(float("nan")))) < float("inf")) | ~(F.abs(F.coalesce("pm_dec", F.lit(float("nan")))) < float("inf")))
    if sample := bad.select(key, "pm_ra", "pm_dec").limit(10).collect():
        raise ValueError(f"rows without a proper motion, such as {[tuple(r) for r in sample]}")
    return df


def read_indexes(spark: SparkSession, root: str, bins: Sequence[str] = MAG_BINS) -> DataFrame:
    """All index files of the bins with mag_bin, index_num and index_csv; rows without a position are dropped."""
    df = read_csv(spark, f"{root}/{{{','.join(bins)}}}/index*_masked.csv", ("ra_deg", "dec_deg")).withColumn("index_csv", F.col("_metadata.file_path"))
    df = df.withColumns({"mag_bin": F.regexp_extract("index_csv", r"([^/]+)/[^/]+$", 1), "index_num": F.regexp_extract("index_csv", r"index(\d+)_masked", 1).cast("int")})
    positions = [F.col(c).isNotNull() for c in ("ra_deg", "dec_deg") if c in df.columns]
    for there in positions:
        df = df.where(there)
    return df


def files(spark: SparkSession, paths: Paths, below: bool = False) -> DataFrame:
    """path and source_id of matching files (with below, of all files in folders below too); their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", below).load(_list(paths)).select("path", stem(F.col("path")).alias("source_id"))


def manifest(indexes: DataFrame, lc_root: str, lc_files: DataFrame, key: str = "asas_sn_id", suffix: str = ".dat2") -> DataFrame:
    """A row per source of the indexes, the first by bin and index: where its light curve should be and whether it is."""
    own = indexes.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("source_id"), "mag_bin", "index_num", "index_csv").distinct()
    first = W.partitionBy("source_id").orderBy("mag_bin", "index_num", "index_csv")
    own = own.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    own = own.withColumn("lc_dir", F.concat(F.lit(lc_root.rstrip("/") + "/"), "mag_bin", F.lit("/lc"), "index_num", F.lit("_cal")))
    own = own.withColumn("dat_path", F.concat("lc_dir", F.lit("/"), "source_id", F.lit(suffix)))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    there = lc_files.select(bare("path").alias("_path")).distinct()
    out = own.join(there, bare("dat_path") == F.col("_path"), "left").withColumn("dat_exists", F.col("_path").isNotNull()).drop("_path")
    return out.orderBy("mag_bin", "source_id")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest in CSV or parquet, with source_id as a string."""
    df = read_csv(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)
    df = df.withColumnRenamed("asas_sn_id", "source_id") if "source_id" not in df.columns else df
    return df.withColumn("source_id", F.col("source_id").cast("string"))


def read_detections(spark: SparkSession, paths: Paths) -> DataFrame:
    """Detection results: trimmed strings, empty ones kept, with Match_ID, the stem of DAT_Path."""
    df = spark.read.option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(_list(paths))
    df = df.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in df.columns))
    return df.withColumn("Match_ID", stem(F.col("DAT_Path")))


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """All rows of the CSV and Parquet files of the paths and below, by name of column; paths that aren't there are passed
    over. None if there are no files. Headers are read in one distributed pass; files with one header are one scan, so the
    plan grows with the kinds of headers and not with the files. Next to CSV, values of Parquet files are texts."""
    there = expanded(spark, paths)
    names = [r["path"] for r in files(spark, there, below=True).select("path").collect()] if there else []
    parquet, csv = [n for n in names if n.endswith(".parquet")], [n for n in names if n.endswith(".csv")]
    found = []
    if csv:
        lines = _placed(spark.read.text(csv)).where("_at = 0")
        heads = lines.groupBy("_path").agg(F.min_by("value", "_n").alias("head"))
        for r in heads.groupBy("head").agg(F.collect_list("_path").alias("paths")).orderBy("head").collect():
            found.append(read_csv(spark, sorted(r["paths"])))
    if parquet:
        rows = spark.read.option("mergeSchema", True).parquet(*parquet)
        found.append(rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)) if csv else rows)
    out = found[0] if found else None
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def expanded(spark: SparkSession, paths: Sequence[str], include: str = "*", exclude: str | None = None) -> list[str]:
    """Files and folders that the globs match, once each, in order, by patterns of their names."""
    from fnmatch import fnmatch

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen: dict[str, None] = {}
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        for status in at.getFileSystem(conf).globStatus(at) or ():
            name = status.getPath().getName()
            if fnmatch(name, include) and not (exclude and fnmatch(name, exclude)):
                seen.setdefault(status.getPath().toString())
    return list(seen)
