"""Streaming forms: windows over retention times and pairing of arriving spectra with a fixed side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.operators import recall


def tumbling(rows: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and key; rows later than ``late`` are dropped by the watermark."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def paired(arriving: DataFrame, fixed: DataFrame, tolerance: float = recall.PPM) -> DataFrame:
    """Mirror candidates of streaming first-digest spectra (id, mh, rt) against a static mirror side."""
    return recall.mirror_candidates(arriving, fixed, tolerance)
