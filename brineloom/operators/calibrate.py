"""Station calibration: constant or seasonal offsets, chosen by information or by held-out sites."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.functions.scalars import harmonics
from brineloom.operators.stats import normal_equations


def loso_cv_constant(rows: DataFrame, site: str, error: str) -> DataFrame:
    """(constant, loso_mse): the mean error, and the pooled square of each site's errors from the
    mean of all other sites; from one sum a site."""
    e = F.col(error)
    s = rows.groupBy(site).agg(F.count(e).alias("n"), F.sum(e).alias("t"), F.sum(e * e).alias("tt"))
    a = s.agg(F.sum("n").alias("an"), F.sum("t").alias("at"))
    other = (F.col("at") - F.col("t")) / (F.col("an") - F.col("n"))
    sse = F.col("tt") - 2 * F.col("t") * other + F.col("n") * other * other
    x = s.crossJoin(F.broadcast(a))  # one row
    return x.agg((F.max("at") / F.max("an")).alias("constant"), (F.sum(sse) / F.max("an")).alias("loso_mse"))


def _sums(rows: DataFrame, n_harmonics: int, period: float, site: str, day: str, error: str):
    """Normal equations of every site, gathered: a few numbers a site."""
    d = harmonics(F.dayofyear(day) - 1, n_harmonics, period)
    names = list(d)
    eq = normal_equations(rows, [site], d, F.col(error))
    sq = rows.groupBy(site).agg(F.sum(F.col(error) * F.col(error)).alias("yy"))
    got = eq.join(sq, site).toPandas()
    k = len(names)
    a, b = np.zeros((len(got), k, k)), np.zeros((len(got), k))
    for i, p in enumerate(names):
        b[:, i] = got[f"b_{p}"]
        for j, q in enumerate(names[i:], i):
            a[:, i, j] = a[:, j, i] = got[f"a_{p}_{q}"]
    return a, b, got["n"].to_numpy(float), got["yy"].to_numpy(float)


def fit_offset(rows: DataFrame, selection: str = "aic", n_harmonics: int = 2, period: float = 365.25, min_gain: float = 0.0, site: str = "site", day: str = "day", error: str = "error") -> dict:
    """form, coef, aic, loso_mse from errors (observation less product).

    selection: constant or seasonal (forced), aic (seasonal if it gains more than min_gain), or
    loso_cv (the smaller held-out square; a tie is constant; under two sites: aic).
    """
    a, b, n, yy = _sums(rows, n_harmonics, period, site, day, error)

    def form(k):
        at, bt, nt, yt = a[:, :k, :k].sum(0), b[:, :k].sum(0), n.sum(), yy.sum()
        c = np.linalg.lstsq(at, bt, rcond=None)[0]
        rss = max(float(yt - 2 * c @ bt + c @ at @ c), 1e-300)
        held = None
        if len(n) > 1:
            sse = 0.0
            for i in range(len(n)):
                ci = np.linalg.lstsq(at - a[i, :k, :k], bt - b[i, :k], rcond=None)[0]
                sse += yy[i] - 2 * ci @ b[i, :k] + ci @ a[i, :k, :k] @ ci
            held = float(sse / nt)
        return {"coef": c, "aic": nt * math.log(rss / nt) + 2 * k, "loso_mse": held}

    forms = {"constant": form(1), "seasonal": form(2 * n_harmonics + 1)}
    if selection in forms:
        name = selection
    elif selection == "loso_cv" and len(n) > 1:
        name = "seasonal" if forms["seasonal"]["loso_mse"] < forms["constant"]["loso_mse"] else "constant"
    elif selection in ("aic", "loso_cv"):
        name = "seasonal" if forms["seasonal"]["aic"] <= forms["constant"]["aic"] - min_gain and forms["seasonal"]["aic"] < forms["constant"]["aic"] else "constant"
    else:
        raise ValueError(f"selection {selection!r}")
    return {"form": name, "forms": forms} | forms[name]


def calibrated(field: DataFrame, coef, period: float, value: str = "value", day: str = "day") -> DataFrame:
    """field with offset and <value>_cal."""
    d = list(harmonics(F.dayofyear(day) - 1, (len(coef) - 1) // 2, period).values())
    off = sum(float(c) * x for c, x in zip(coef, d, strict=True))
    return field.withColumn("offset", off).withColumn(f"{value}_cal", F.col(value) + F.col("offset"))
