"""Readers of station observations, points, hand-off files and gridded channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATION = "station_id string, station_name string, lat double, lon double, time timestamp_ntz, value_c double"


def read_csv_stations(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, units: str = "C", timezone: str = "UTC", max_depth_m: float | None = None) -> DataFrame:
    """Long CSV to (station_id, station_name, lat, lon, time, value_c).

    columns: our name -> the file's.  Times that can't be read, and rows without time, value or
    place, go; zoned times become UTC; rows deeper than max_depth_m go (no depth: kept).
    """
    names = {"station_id": "station_id", "time": "time", "lat": "latitude", "lon": "longitude", "value": "value", "station_name": "station_name", "z": "z"} | dict(columns or {})
    raw = spark.read.option("header", True).csv(path)
    if missing := [n for k, n in names.items() if k in ("station_id", "time", "lat", "lon", "value") and n not in raw.columns]:
        raise ValueError(f"{path} has no column {missing}; it has {raw.columns}")
    c = lambda k: F.col(f"`{names[k]}`")
    zoned = F.try_to_timestamp(c("time"))
    utc = zoned if timezone == "UTC" else F.to_utc_timestamp(zoned, timezone)
    name = c("station_name") if names["station_name"] in raw.columns else c("station_id")
    value = c("value").try_cast("double") - (273.15 if units.upper() == "K" else 0.0)
    x = raw
    if max_depth_m is not None and names["z"] in raw.columns:
        z = c("z").try_cast("double")
        x = x.where(z.isNull() | (F.abs(z) <= max_depth_m))
    x = x.select(c("station_id").alias("station_id"), name.alias("station_name"), c("lat").try_cast("double").alias("lat"), c("lon").try_cast("double").alias("lon"), utc.cast("timestamp_ntz").alias("time"), F.nanvl(value, F.lit(None)).alias("value_c"))
    return x.na.drop(subset=["time", "value_c", "lat", "lon"])


def stations_from_grid(table: DataFrame, flags: Sequence[int] = (1, 2), units: str = "K") -> DataFrame:
    """(station_id, lat, lon, times array, values array, qc array) to long rows with a passing flag."""
    x = table.select("station_id", "lat", "lon", F.explode(F.arrays_zip("times", "values", "qc")).alias("o"))
    v = F.col("o.values") - (273.15 if units == "K" else 0.0)
    ok = F.col("o.qc").isin(*flags) & F.col("o.values").isNotNull() & ~F.isnan("o.values")
    return x.where(ok).select("station_id", F.col("station_id").alias("station_name"), "lat", "lon", F.col("o.times").alias("time"), v.alias("value_c"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, lat, lon, grp) of a CSV; without a group: ``default``."""
    x = spark.read.option("header", True).csv(path)
    group = F.coalesce("group", F.lit("default")) if "group" in x.columns else F.lit("default")
    return x.select("site_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), group.alias("grp"))


def stations_of_json(meta: DataFrame, column: str = "value") -> DataFrame:
    parsed = F.from_json(column, "array<struct<station_id: string, lat: double, lon: double>>")
    return meta.select(F.inline(parsed))


OFFSETS = "sensors map<string, struct<label: string, recommended: string, chosen: string, models: map<string, struct<a: double, b: double, x0: double, off: double, slope: double>>>>"


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(sensor, model, off, slope) of a hand-off file: each sensor's chosen model."""
    x = spark.read.schema(OFFSETS).option("multiLine", True).json(path).select(F.explode("sensors").alias("sensor", "s"))
    m = F.col("s.models")[F.coalesce("s.chosen", "s.recommended")]
    return x.select("sensor", F.coalesce("s.chosen", "s.recommended").alias("model"), m["off"].alias("off"), F.coalesce(m["slope"], F.lit(1.0)).alias("slope"))


def with_channel(df: DataFrame, name: str, kind: str = "double") -> DataFrame:
    """df with the channel; one that is absent gives no verdict (NULL)."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def carried(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The named channels that exist, and every in-situ channel."""
    return df.select(*keys, *(c for c in df.columns if c not in keys and (c in names or c.startswith("insitu") or "_insitu_" in c)))


def assert_dates(obs: DataFrame, days: DataFrame) -> None:
    """An error that names requested days which the record does not have."""
    missing = [str(r[0]) for r in days.select("day").distinct().join(obs.select("day").distinct(), "day", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"days without data: {missing}")


def utm(lat: Column, lon: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the transverse Mercator series to the third order in n."""
    # WGS 84 and UTM constants.
    a, f, k0, e0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, aj in enumerate(al, 1):
        x = x + aj * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + aj * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return e0 + k0 * big * x, k0 * big * y + (10_000_000.0 if south else 0.0)
