"""Downstream recipes: quality control, activity labels, standardised model features, batch summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_report(features: DataFrame, blur: float = 0.5, bright: float = 240.0, dark: float = 20.0) -> DataFrame:
    """Add ``qc``: PASS, or FAIL with the reasons in a fixed order."""
    reasons = F.concat_ws(
        ", ",
        F.when(F.col("blur_score") < blur, "blurry"),
        F.when(F.col("average_brightness") > bright, "overexposed").when(F.col("average_brightness") < dark, "underexposed"),
    )
    return features.withColumn("qc", F.when(reasons == "", "PASS").otherwise(F.concat(F.lit("FAIL: "), reasons)))


def motion_activity(features: DataFrame, threshold: float = 0.7) -> DataFrame:
    return features.withColumn("activity", F.when(F.col("motion_score") > threshold, "HIGH").otherwise("LOW"))


def standardised(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation per column; a constant column is divided by one.

    The moments come from one partial aggregate, joined back as a single broadcast row.
    """
    stats = [f(F.col(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    moments = features.agg(*stats)
    out = features.join(F.broadcast(moments))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return out.withColumns({f"{c}_scaled": v for c, v in scaled.items()}).drop(*moments.columns)


def label_from_directory(features: DataFrame) -> DataFrame:
    """The parent directory's name as the class label."""
    return features.withColumn("label", F.regexp_extract("filename", r"([^/]+)/[^/]*\z", 1))


def batch_summary(features: DataFrame) -> DataFrame:
    return features.select(F.regexp_extract("filename", r"([^/]*)\z", 1).alias("filename"), "average_brightness", "blur_score")
