"""Daily station means as a stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(stream: DataFrame, min_coverage: float, late: str = "2 hours", by: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """(by, day, value, coverage) of a streaming (or static) DataFrame.

    State is one bitmap of hours and two sums for each station and open day.
    """
    x = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    hours = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.hour("__ts"))))
    d = x.groupBy(by, F.window("__ts", "1 day").alias("w")).agg(F.avg(value).alias("mean"), (hours / 24.0).alias("coverage"))
    return d.select(by, F.to_date("w.start").alias("day"), F.when(F.col("coverage") >= min_coverage, F.col("mean")).alias("value"), "coverage")


def qc_stream(stream: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    """Rows whose value is present and in range."""
    return stream.where(F.col(value).between(low, high) & ~F.isnan(value))
