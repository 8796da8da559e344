"""Readers of the driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = ("view", "click", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missing_as_null(c: Column) -> Column:
    """NaN is a value to Spark's aggregates; missing data must be NULL."""
    return F.when(~F.isnan(c), c)


def observations(spark: SparkSession, sf_dir: str, members=MEMBERS) -> DataFrame:
    """(sensor, day, px, value): one row per member, day and pixel; repeats are averaged."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*members))
    return (
        e.select(F.col("event_type").alias("sensor"), F.to_date("ts").alias("day"), F.col("user_id").alias("px"), missing_as_null(F.col("value")).alias("value"))
        .groupBy("sensor", "day", "px")
        .agg(F.avg("value").alias("value"))
    )
