"""The driver's tables in the operators' roles, for Spark and (BASE) for SQL.

member: event type; pixel: user; a pixel's row and column: user div 15, user % 15; water: user
not divisible by 10; quality flag: the event's k over 80.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brineloom.sources.tables import table

MEMBERS = ("click", "purchase", "view")


def events(spark, sf):
    e = table(spark, sf, "events")
    hour = F.hour("ts") + F.minute("ts") / 60.0
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.col("user_id").alias("px"), F.col("event_type").alias("sensor"), F.col("value"), hour.alias("hour"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def obs(spark, sf):
    """(sensor, day, px, row, col, value, hour, k, water): one row a member, day and pixel."""
    x = events(spark, sf).where(F.col("sensor").isin(*MEMBERS)).groupBy("sensor", "day", "px").agg(F.avg("value").alias("value"), F.avg("hour").alias("hour"), F.max("k").alias("k"))
    return x.select("sensor", "day", "px", F.expr("px div 15").alias("row"), F.expr("px % 15").alias("col"), "value", "hour", "k", (F.col("px") % 10 != 0).alias("water"))


def grid_rows(spark, sf) -> int:
    """Height of the grid: a one-row aggregate."""
    return (obs(spark, sf).agg(F.max("row")).first()[0] or 0) + 1


def water_cells(spark, sf):
    """One row (n_water): the water pixels of the record."""
    return obs(spark, sf).where("water").agg(F.count_distinct("px").cast("double").alias("n_water"))


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def day_text(c="day"):
    return F.col(c).cast("string")


BASE = """
ev as (select event_id, ts, cast(ts as date) as day, user_id as px, event_type as sensor, value, hour(ts) + minute(ts) / 60.0 as hr,
              cast(json_extract_string(props, '$.k') as int) as k from events),
obs as (select sensor, day, px, px // 15 as row, px % 15 as col, avg(value) as value, avg(hr) as hour, max(k) as k, px % 10 <> 0 as water
        from ev where sensor in ('click', 'purchase', 'view') group by sensor, day, px)"""
