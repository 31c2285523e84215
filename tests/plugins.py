"""A baseline from outside the library, which fails for some sources."""

from pyspark.sql import functions as F


def broken(points, keys=("source_id",)):
    name, nan = F.col("source_id"), F.lit(float("nan"))
    odd = F.col("seq") % 2 == 0
    baseline = F.when((name == "baseline nan") | (name == "split") & odd, nan).when(name == "far", -1e200).otherwise(13.0)
    sigma = F.when((name == "sigma nan") | (name == "split") & ~odd, nan).when(name == "sigma negative", -0.1).otherwise(F.col("error"))
    out = points.withColumns({"baseline": baseline, "sigma_eff": sigma})
    return out.withColumn("resid", F.col("mag") - F.col("baseline")).withColumn("sigma_resid", F.col("resid") / F.col("error")).withColumn("baseline_source", F.lit("broken"))
