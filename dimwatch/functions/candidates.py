"""The labelled candidates that searches are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "source string, source_id string, category string, mag_bin string, search_method string, expected_detected boolean"

# Name, id, class, magnitude bin, how it was found, and whether a search should find it.
LABELLED = (
    ("J042214+152530", "377957522430", "Dippers", "13_13.5", "Pipeline", True),
    ("J202402+383938", "42950993887", "Dippers", "13_13.5", "Pipeline", True),
    ("J174328+343315", "223339338105", "Dippers", "13_13.5", "Pipeline", True),
    ("J080327-261620", "601296043597", "Dippers", "13_13.5", "Pipeline", False),
    ("J184916-473251", "472447294641", "Dippers", "13_13.5", "Known", True),
    ("J183153-284827", "455267102087", "Dippers", "13.5_14", "Known", False),
    ("J070519+061219", "266288137752", "Dippers", "13.5_14", "Known", False),
    ("J081523-385923", "532576686103", "Dippers", "13.5_14", "Known", False),
    ("J085816-430955", "352187470767", "Dippers", "12_12.5", "Known", False),
    ("J114712-621037", "609886184506", "Dippers", "13_13.5", "Known", False),
    ("J005437+644347", "68720274411", "Multiple Eclipse Binaries", "13_13.5", "Known", True),
    ("J062510-075341", "377958261591", "Multiple Eclipse Binaries", "13.5_14", "Pipeline", True),
    ("J124745-622756", "515397118400", "Multiple Eclipse Binaries", "13.5_14", "Pipeline", True),
    ("J175912-120956", "326417831663", "Multiple Eclipse Binaries", "13_13.5", "Pipeline", True),
    ("J181752-580749", "644245387906", "Multiple Eclipse Binaries", "12_12.5", "Known", True),
    ("J160757-574540", "661425129485", "Multiple Eclipse Binaries", "13.5_14", "Pipeline", False),
    ("J073924-272916", "438086977939", "Single Eclipse Binaries", "13.5_14", "Pipeline", True),
    ("J074007-161608", "360777377116", "Single Eclipse Binaries", "13_13.5", "Pipeline", True),
    ("J094848-545959", "635655234580", "Single Eclipse Binaries", "13_13.5", "Pipeline", True),
    ("J162209-444247", "412317159120", "Single Eclipse Binaries", "13.5_14", "Pipeline", True),
    ("J183606-314826", "438086901547", "Single Eclipse Binaries", "13.5_14", "Pipeline", True),
    ("J205245-713514", "463856535113", "Single Eclipse Binaries", "13_13.5", "Pipeline", True),
    ("J212132+480140", "120259184943", "Single Eclipse Binaries", "13_13.5", "Pipeline", True),
    ("J225702+562312", "25770019815", "Single Eclipse Binaries", "13.5_14", "Pipeline", True),
    ("J190316-195739", "515396514761", "Single Eclipse Binaries", "13.5_14", "Pipeline", True),
    ("J175602+013135", "231929175915", "Single Eclipse Binaries", "14_14.5", "Known", True),
    ("J073234-200049", "335007754417", "Single Eclipse Binaries", "14.5_15", "Known", True),
    ("J223332+565552", "60130040391", "Single Eclipse Binaries", "12.5_13", "Known", True),
    ("J183210-173432", "317827964025", "Single Eclipse Binaries", "12.5_13", "Pipeline", False),
)


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), SCHEMA)
