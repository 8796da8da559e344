"""Scalar Column functions: seasonal designs, filter settings, labels, links."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The season of each month.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def year_fraction_day(ts: Column) -> Column:
    """Days since the year began, with the time of day."""
    t = ts.cast("timestamp")
    return F.dayofyear(t) - 1 + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400.0


def harmonics(x: Column, n: int, period: float, prefix: str = "") -> dict[str, Column]:
    """Constant, then cosine and sine of each of n harmonics of x."""
    out = {f"{prefix}mean": F.lit(1.0)}
    for k in range(1, n + 1):
        w = 2 * math.pi * k / period
        out |= {f"{prefix}cos{k}": F.cos(x * w), f"{prefix}sin{k}": F.sin(x * w)}
    return out


def diurnal(hour: Column, n: int) -> dict[str, Column]:
    """Harmonics of the day; a missing hour leaves the constant alone."""
    return {k: c if k == "mean" else F.coalesce(c, F.lit(0.0)) for k, c in harmonics(hour, n, 24.0).items()}


def amplitude(cos_k: Column, sin_k: Column) -> Column:
    return F.hypot(cos_k, sin_k)


def peak_day(cos_k: Column, sin_k: Column, k: int, period: float) -> Column:
    return F.pmod(F.atan2(sin_k, cos_k) * period / (2 * math.pi * k), F.lit(period / k))


def half_away(c: Column, digits: int) -> Column:
    """Rounded as SQL engines do with doubles: scaled, then half away from zero; a small negative is -0.0."""
    y = F.abs(c * 10.0**digits)
    whole = F.floor(y).cast("double")
    out = F.signum(c) * F.when(y - whole >= 0.5, whole + 1).otherwise(whole) / 10.0**digits
    return F.when(y < 2.0**52, out).otherwise(c)  # larger ones, infinity and NaN have no such digits


def terms(coefs: dict[str, Column]) -> Column:
    """The coefficients as text; null if one of them is."""
    return F.concat(*(F.concat(F.lit(";" if i else ""), F.when(c.isNotNull(), F.format_string(f"{name}=%.4f", c))) for i, (name, c) in enumerate(coefs.items())))


def sigmoid(x: Column) -> Column:
    return (F.tanh(x / 2) + 1) * 0.5


def season(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), name).otherwise(out)
    return out


def fit_label(code: Column) -> Column:
    # Codes of the seasonal fit.
    return F.when(code == 0, "full").when(code == 1, "mean_only").when(code == 2, "reference").otherwise("none")


def cutoff_settings(t_c: Column, alpha_max: float) -> dict[str, Column]:
    """(alpha, p) of a diffusion filter with cutoff t_c; (0, 0) is off."""
    reach = F.pow(t_c / (2 * math.pi), 2)
    p = F.greatest(F.ceil(reach / alpha_max), F.lit(1)).cast("long")
    on = t_c > 0
    return {"alpha": F.when(on, reach / p).otherwise(F.lit(0.0)), "p": F.when(on, p).otherwise(F.lit(0).cast("long"))}


def stable(alpha: Column, min_step: Column, factor: float = 0.25) -> Column:
    return alpha <= factor * min_step * min_step


def exponential_log_odds(w: Column, rate: float, sigma: float, prior: Column) -> Column:
    """Log odds of an exponential cold (or warm) tail of rate ``rate`` against a clear Gaussian,
    without noise on the tail: off its support there is none (-inf)."""
    clear = -w * w / (2 * sigma * sigma) - math.log(sigma) - 0.5 * math.log(2 * math.pi)
    tail = F.when(w > 0, math.log(rate) - w * rate - clear).otherwise(F.lit(float("-inf")))
    return tail + F.log(prior / (1 - prior))


def linear_sensor(x: Column, x0: Column, a: Column, b: Column) -> Column:
    """What a sensor should read for a reference value x."""
    return x0 + a + b * (x - x0)


def apply_offset(value: Column, off: Column, slope: Column) -> Column:
    return (value - off) / slope


def aic(rss: Column, n: Column, k: int) -> Column:
    return n * F.log(rss / n) + 2 * k
