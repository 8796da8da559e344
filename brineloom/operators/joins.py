"""Matchups: by pixel, by footprint, nearest in time, within an interval, nearest in space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tolerances of a span of time that is one task's work in nearest_in_time.
CELLS = 16


def _whole_seconds(a: Column, b: Column) -> Column:
    """Distance in time, cut to whole seconds."""
    us = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return F.floor(F.abs(us) / 1_000_000).cast("long")


def pixel_matchups(member: DataFrame, reference: DataFrame, min_pixels: int = 1, on: Sequence[str] = ("day", "px"), scene: Sequence[str] = ("sensor", "day")) -> DataFrame:
    """member (value) with the reference's value as ``ref``, for scenes with enough pairs."""
    ref = reference.where(F.col("value").isNotNull()).select(*on, F.col("value").alias("ref"))
    x = member.where(F.col("value").isNotNull()).join(ref, list(on))
    n = F.count(F.lit(1)).over(Window.partitionBy(*scene))
    return x.withColumn("__n", n).where(F.col("__n") >= min_pixels).drop("__n")


def footprint_matchups(member: DataFrame, cells: DataFrame, min_cells: int, min_cover: float, min_footprints: int = 1) -> DataFrame:
    """(sensor, day, fp, ref, n_cells, n_sensor, value): a footprint's value against the median of
    the member's cells in it; cells: (day, px, fp, ref), each footprint of one reference value."""
    n_cells = cells.groupBy("day", "fp").agg(F.count("*").alias("n_cells"), F.first("ref").alias("ref"))
    m = member.where(F.col("value").isNotNull()).join(cells.select("day", "px", "fp"), ["day", "px"]).groupBy("sensor", "day", "fp").agg(F.count("value").alias("n_sensor"), F.median("value").alias("value"))
    x = m.join(n_cells, ["day", "fp"]).where((F.col("n_cells") >= min_cells) & (F.col("n_sensor") >= min_cover * F.col("n_cells")))
    n = F.count(F.lit(1)).over(Window.partitionBy("sensor", "day"))
    return x.withColumn("__n", n).where(F.col("__n") >= min_footprints).drop("__n")


def nearest_in_time(targets: DataFrame, obs: DataFrame, by: Sequence[str], max_seconds: int, target_ts: str = "target", obs_ts: str = "ts", value: str = "value") -> DataFrame:
    """Each target with the nearest observation of its group, if it is within max_seconds.

    Both sides are united and sorted by time; the observation before (or at the same instant)
    is the last one seen in that order, and the one after the last one seen in the opposite order: a
    frame that ends with the record would be summed up anew for each row.  The later one wins only
    if it is strictly nearer.  Distances are cut to whole seconds.  Tasks are spans of CELLS
    tolerances of a group; an observation near a span's border is in both spans.
    """
    by = list(by)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    reach = (max_seconds + 1) * 1_000_000
    span = lambda c: F.floor(c / (CELLS * reach)).cast("long")
    at = us(F.col(obs_ts))
    o = obs.where(F.col(value).isNotNull() & F.col(obs_ts).isNotNull())
    o = o.select(*by, F.col(obs_ts).alias("__t"), F.struct(F.col(obs_ts).alias("ts"), F.col(value).alias("value")).alias("__o"), F.lit(0).alias("__side"), F.explode(F.sequence(span(at - reach), span(at + reach))).alias("__c"))
    q = targets.where(F.col(target_ts).isNotNull())
    q = q.select(*by, F.col(target_ts).alias("__t"), F.lit(None).cast(o.schema["__o"].dataType).alias("__o"), F.lit(1).alias("__side"), span(us(F.col(target_ts))).alias("__c"))
    w = Window.partitionBy(*by, "__c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last("__o", ignorenulls=True)
    u = o.unionByName(q)
    u = u.withColumn("__b", seen.over(w.orderBy("__t", "__side"))).withColumn("__a", seen.over(w.orderBy(F.desc("__t"), F.desc("__side")))).where("__side = 1")
    gap = lambda s: _whole_seconds(F.col(f"{s}.ts"), F.col("__t"))
    later = F.col("__a").isNotNull() & (F.col("__b").isNull() | (gap("__a") < gap("__b")))
    u = u.withColumn("__m", F.when(later, F.col("__a")).otherwise(F.col("__b"))).withColumn("dt", gap("__m"))
    u = u.where(F.col("dt") <= max_seconds)
    return u.select(*by, F.col("__t").alias(target_ts), F.col("__m.ts").alias("ts"), F.col("__m.value").alias("value"), "dt")


def nearest_by_cells(targets: DataFrame, obs: DataFrame, by: Sequence[str], max_seconds: int, target_ts: str = "target", obs_ts: str = "ts", value: str = "value") -> DataFrame:
    """As nearest_in_time, for groups too large for one task: time is cut into cells of the
    tolerance, a target meets the observations of its own and the two neighbouring cells, and the
    best is an aggregate that combines before the shuffle.  Targets must differ in (by, time)."""
    by = list(by)
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (max_seconds + 1))
    t = targets.select(*by, target_ts).withColumn("__c", cell(target_ts)).withColumn("__c", F.explode(F.array(F.col("__c") - 1, F.col("__c"), F.col("__c") + 1)))
    o = obs.where(F.col(value).isNotNull()).select(*by, F.col(obs_ts).alias("ts"), F.col(value).alias("value")).withColumn("__c", cell("ts"))
    dt = _whole_seconds(F.col("ts"), F.col(target_ts))
    x = t.join(o, [*by, "__c"]).withColumn("dt", dt).where(F.col("dt") <= max_seconds)
    # Of equally near ones before the target the last, then the first after it.
    late = F.col("ts") > F.col(target_ts)
    order = F.struct("dt", late.cast("int"), F.when(late, 1).otherwise(-1) * F.unix_micros(F.col("ts").cast("timestamp")))
    best = x.groupBy(*by, target_ts).agg(F.min_by(F.struct("ts", "value", "dt"), order).alias("m"))
    return best.select(*by, target_ts, "m.ts", "m.value", "m.dt")


def overpass_instants(days: DataFrame, default_hour: float | None) -> DataFrame:
    """days (sensor, day, hour) with ``target``; a missing hour is the record's median, then the default."""
    med = days.groupBy("sensor").agg(F.median("hour").alias("__m"))
    x = days.join(med, "sensor")
    hour = F.coalesce("hour", "__m", *([F.lit(default_hour)] if default_hour is not None else [F.raise_error(F.lit("no overpass hour")).cast("double")]))
    return x.withColumn("target", F.timestamp_micros((F.unix_date("day") * 86_400_000_000 + F.round(hour * 3600) * 1_000_000).cast("long"))).drop("__m")


def daily_means(obs: DataFrame, min_coverage: float, by: Sequence[str] = ("station",), ts: str = "ts", value: str = "value") -> DataFrame:
    """(by..., day, value, coverage): means of UTC days with enough distinct hours; else NULL."""
    x = obs.groupBy(*by, F.to_date(ts).alias("day")).agg(F.avg(value).alias("mean"), (F.count_distinct(F.hour(ts)) / 24.0).alias("coverage"))
    return x.select(*by, "day", F.when(F.col("coverage") >= min_coverage, F.col("mean")).alias("value"), "coverage")


def nearest_cell(points: DataFrame, cells: DataFrame, radius: float, key: str = "station") -> DataFrame:
    """points (key, x, y) with their nearest cell (px, x, y) within the radius.

    Both are filed in squares of the radius' size, so a point meets its nine squares' cells only.
    """
    sq = lambda c: F.floor(F.col(c) / radius)
    nine = F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as a, b as b))))")
    p = points.select(key, F.col("x").alias("__x"), F.col("y").alias("__y")).withColumn("__n", F.explode(nine))
    p = p.select(key, "__x", "__y", (F.floor(F.col("__x") / radius) + F.col("__n.a")).alias("__sx"), (F.floor(F.col("__y") / radius) + F.col("__n.b")).alias("__sy"))
    c = cells.select("px", "x", "y").withColumn("__sx", sq("x")).withColumn("__sy", sq("y"))
    d = F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y"))
    j = p.join(c, ["__sx", "__sy"]).withColumn("distance", d).where(F.col("distance") <= radius)
    return j.groupBy(key).agg(F.min_by(F.struct("px", "distance"), F.struct("distance", "px")).alias("m")).select(key, "m.px", "m.distance")


def interval_composite(targets: DataFrame, ref: DataFrame, days: int, q: float, min_obs: int) -> DataFrame:
    """(day, px, value, n): quantile of the reference within +-days of each target day.

    Each reference row is addressed to the 2 * days + 1 days that it serves: an equi-join.
    """
    r = ref.where(F.col("value").isNotNull()).select("px", "value", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("day"))
    x = r.join(targets.select("day").distinct(), "day").groupBy("day", "px").agg(F.percentile("value", F.lit(q)).alias("value"), F.count("value").alias("n"))
    return x.where(F.col("n") >= min_obs)


def seasonal_field(days: DataFrame, coef: DataFrame, period: float) -> DataFrame:
    """(day, px, seasonal) from coef (px, mean, cos1, sin1): every day with every pixel."""
    import math

    w = 2 * math.pi / period
    d = F.dayofyear("day") - 1
    return days.select("day").distinct().crossJoin(coef).select("day", "px", (F.col("mean") + F.col("cos1") * F.cos(d * w) + F.col("sin1") * F.sin(d * w)).alias("seasonal"))


def donor_points(cover: DataFrame, low: float, high: float) -> DataFrame:
    """(day, donor): donors whose coverage is within [low, high] of the day's; cover: (day, n)."""
    c = cover.select(F.col("day").alias("donor"), F.col("n").alias("dn"))
    return cover.join(F.broadcast(c), (F.col("dn") >= low * F.col("n")) & (F.col("dn") <= high * F.col("n")) & (F.col("day") != F.col("donor"))).select("day", "donor")  # one row a day of the record


def hash_order(c: Column, seed: int) -> Column:
    """A draw without replacement is the head of this order."""
    return F.xxhash64(F.lit(seed), c)


def offset_table(members: DataFrame, days: DataFrame, constants: DataFrame, own: DataFrame, by: str = "sensor") -> DataFrame:
    """(by, day, off) of every member and day: the day's own offset, else the member's constant."""
    grid = days.select("day").distinct().crossJoin(F.broadcast(members.select(by).distinct()))  # members are few
    c = constants.select(by, F.col("off").alias("__c"))
    return grid.join(c, by, "left").join(own.select(by, "day", "off"), [by, "day"], "left").select(by, "day", F.coalesce("off", "__c").alias("off"))


def with_prior_masks(obs: DataFrame, masks: DataFrame, keys: Sequence[str] = ("sensor", "day", "px")) -> DataFrame:
    """obs with ``kept`` of an earlier run's masks (keys); what they lack was not kept."""
    kept = masks.select(*keys).distinct().withColumn("kept", F.lit(True))
    return obs.join(kept, list(keys), "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def nearest_day(obs: DataFrame, day, among: DataFrame | None = None) -> DataFrame:
    """The rows of the acquisition day nearest to the given one (ties: the earlier); among: days to choose from."""
    days = (obs if among is None else among).select("day").distinct()
    best = days.orderBy(F.abs(F.date_diff(F.lit(day).cast("date"), "day")), "day").limit(1)
    return obs.join(F.broadcast(best), "day", "left_semi")  # one row


def residuals(obs: DataFrame, base: DataFrame, offset: Column, by: str = "sensor") -> DataFrame:
    """(by, n, resid, sd) of values less a baseline (px, base) and an offset; sd is without the offset."""
    x = obs.join(base, "px")
    e = F.col("value") - F.col("base")
    return x.groupBy(by).agg(F.count("*").alias("n"), F.avg(e - offset).alias("resid"), F.stddev_pop(e).alias("sd"))


def verdict_tables(scenes: DataFrame, kept: dict[str, DataFrame], keys: Sequence[str] = ("sensor", "day")) -> DataFrame:
    """scenes with a column KEPT or DROPPED for each named table of kept scenes."""
    for name, table in kept.items():
        scenes = scenes.join(table.select(*keys).distinct().withColumn(name, F.lit("KEPT")), list(keys), "left")
    return scenes.na.fill("DROPPED", list(kept))


def sensor_overlap(obs: DataFrame, first: str, second: str, min_overlap: int) -> DataFrame:
    """(day, n, diff): pixels that both sensors have on a day, and their mean difference."""
    b = obs.where(F.col("sensor") == second).select("day", "px", F.col("value").alias("__b"))
    x = obs.where(F.col("sensor") == first).join(b, ["day", "px"])
    return x.groupBy("day").agg(F.count("*").alias("n"), F.avg(F.col("value") - F.col("__b")).alias("diff")).where(F.col("n") >= min_overlap)


def common_points(a: DataFrame, b: DataFrame, tolerance: float, keys: Sequence[str] = ("day", "px"), value: str = "value") -> DataFrame:
    """Rows of ``a`` whose point ``b`` has too, with a value within the tolerance."""
    other = b.select(*keys, F.col(value).alias("__v"))
    return a.join(other, list(keys)).where(F.abs(F.col(value) - F.col("__v")) < tolerance).drop("__v")


def align_days(days: DataFrame, series: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """(i, day, value): the record's days numbered in order from 0, each with the series' value or ``fill``."""
    q = days.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")).cast("long") - 1)  # the record's days
    return q.join(series.select("day", value), "day", "left").select("i", "day", F.coalesce(value, F.lit(fill)).alias(value))


def site_series(field: DataFrame, sites: DataFrame) -> DataFrame:
    """The field's rows at the pixels of sites (px, site...); sites are few."""
    return field.join(F.broadcast(sites), "px")
