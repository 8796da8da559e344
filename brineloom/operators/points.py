"""Point series of a filled record: smoothing at sites, and their evaluation against stations.

Stations take no part in the smoothing; a bias between them and the smoothed series is fitted
afterwards, and scored at sites that did not see it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.functions.scalars import harmonics
from brineloom.operators import calibrate, statespace


def insitu_daily(stations: DataFrame | None, carried: DataFrame | None) -> DataFrame:
    """(site, day, insitu): a station file's daily means, or what the record carries along; neither is an error."""
    if stations is not None and carried is not None:
        both = carried.select("site", "day", F.col("insitu").alias("__c")).join(stations.select("site", "day", "insitu"), ["site", "day"], "full")
        return both.select("site", "day", F.coalesce("insitu", "__c").alias("insitu"))
    found = stations if stations is not None else carried
    if found is None:
        raise ValueError("no station file, and the record carries no in-situ channel")
    return found.where(F.col("insitu").isNotNull()).select("site", "day", "insitu")


def evaluate(smoothed: DataFrame, insitu: DataFrame, selection: str = "aic", n_harmonics: int = 1, period: float = 365.25, min_gain: float = 0.0) -> tuple[dict, DataFrame]:
    """(the bias's form and coefficients, metrics) of smoothed (site, day, smooth) against insitu (site, day, insitu).

    metrics: (site or ``all``, n, bias_before, rmse_before, bias_after, rmse_after).
    """
    m = smoothed.select("site", "day", "smooth").join(insitu.where(F.col("insitu").isNotNull()), ["site", "day"])
    m = m.withColumn("error", F.col("insitu") - F.col("smooth"))
    if not m.limit(1).count():
        raise ValueError("no day on which a site has both a smoothed and an in-situ value")
    fit = calibrate.fit_offset(m, selection, n_harmonics, period, min_gain)
    terms = list(harmonics(F.dayofyear("day") - 1, (len(fit["coef"]) - 1) // 2, period).values())
    after = -F.col("error") + sum((float(c) * x for c, x in zip(fit["coef"], terms, strict=True)), F.lit(0.0))
    x = m.withColumn("b", -F.col("error")).withColumn("a", after)
    square = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    out = x.rollup("site").agg(F.count("*").alias("n"), F.avg("b").alias("bias_before"), square("b").alias("rmse_before"), F.avg("a").alias("bias_after"), square("a").alias("rmse_after"))
    return fit, out.withColumn("site", F.coalesce("site", F.lit("all")))


def smooth_points(series: DataFrame, model: str, sources: Sequence[str], **kw) -> DataFrame:
    """Smoothed series of sites (grp, site, day, type, value) from the given sources, a group together."""
    return statespace.smooth_groups(series.where(F.col("type").isin(*sources)), model, sources, **kw)
