"""Seasonal cycles a pixel: gappy harmonics with a reference cycle, their smoothing in space, or a
grand mean, each with a robust scale.

A pixel with enough well-spread days has its own least-squares cycle (FULL); one with a few values
has its own level on the reference cycle, the mean of all full ones (MEAN_ONLY); one without any
has the reference (REFERENCE).  With method ``gmrf`` the coefficients are smoothed as Matern fields
whose deviations come from the data by moments: harmonics first, from full pixels, then the level,
from every pixel's own values less the smoothed cycle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.functions.scalars import harmonics
from brineloom.operators import gmrf
from brineloom.operators.stats import normal_equations, robust_scale
from brineloom.sources.scratch import written

FULL, MEAN_ONLY, REFERENCE = 0, 1, 2  # as functions.scalars.fit_label names them
METHODS = ("harmonic", "gmrf", "none")


def solve_pixels(eq: DataFrame, names: Sequence[str], min_n: int, max_cond: float) -> DataFrame:
    """(px, n, a, b, full, coef) from normal equations of any number of terms; a: the matrix, row by row."""
    k = len(names)
    cell = lambda i, j: F.col(f"a_{names[min(i, j)]}_{names[max(i, j)]}")
    rows = eq.select("px", "n", F.array(*(cell(i, j).cast("double") for i in range(k) for j in range(k))).alias("a"), F.array(*(F.col(f"b_{p}").cast("double") for p in names)).alias("b"))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = np.stack(pdf["a"]).reshape(-1, k, k), np.stack(pdf["b"])
            full = (pdf["n"].to_numpy() >= max(min_n, k)) & (np.linalg.cond(a) <= max_cond)
            coef = np.zeros((len(pdf), k))
            if full.any():
                coef[full] = np.linalg.solve(a[full], b[full][..., None])[..., 0]
            yield pdf.assign(full=full, coef=list(coef))

    return rows.mapInPandas(run, f"px {rows.schema['px'].dataType.simpleString()}, n long, a array<double>, b array<double>, full boolean, coef array<double>")


def _prior_sd(values: np.ndarray, variances: np.ndarray, floor: float) -> float:
    """Spread of the values beyond that of their errors."""
    return floor if len(values) < 2 else float(np.sqrt(max(values.var() - np.nanmean(variances), floor**2)))


def smooth_channel(pdf: pd.DataFrame, range_px: float, alpha: int, floor: float) -> pd.DataFrame:
    """One coefficient's field on its grid from (row, col, value, variance, full); NaN: no value."""
    i, j = (pdf[c].to_numpy(int) - pdf[c].min() for c in ("row", "col"))
    shape = (int(i.max()) + 1, int(j.max()) + 1)
    mask, obs, var = np.zeros(shape, bool), np.full(shape, np.nan), np.full(shape, np.nan)
    value, variance, full = pdf["value"].to_numpy(float), np.maximum(pdf["variance"].to_numpy(float), 1e-12), pdf["full"].to_numpy(bool)
    mask[i, j], obs[i, j], var[i, j] = True, value, variance
    prior = float(value[full].mean()) if full.any() else 0.0
    field = gmrf.solve(obs, mask, np.full(shape, prior), range_px, _prior_sd(value[full], variance[full], floor), np.where(np.isfinite(var), var, 1.0), alpha)
    return pdf.assign(smooth=field[i, j])


def _smoothed(cells: DataFrame, by: str, range_px: float, alpha: int, floor: float) -> DataFrame:
    """(by, px, smooth): the fields of one region's grid, a channel a task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = smooth_channel(pdf, range_px, alpha, floor)
        return pd.DataFrame({by: key[0], "px": out["px"], "smooth": out["smooth"]})

    return cells.select(by, "px", "row", "col", "value", "variance", "full").groupBy(by).applyInPandas(run, f"{by} int, px {cells.schema['px'].dataType.simpleString()}, smooth double")


def fit_seasonal(values: DataFrame, cells: DataFrame, method: str = "harmonic", n_harmonics: int = 1, period: float = 365.25, min_dates: int = 10, max_cond: float = 100.0, floor: float = 0.5, dof: bool = True, scaled: bool = True, range_px: float = 50.0, alpha: int = 2, min_sd: float = 1e-3, save=written) -> DataFrame:
    """(px, row, col, n, fit, coef, scale) of every cell (px, row, col) from values (px, day, value).

    scaled: a robust scale of the residuals, else 1.  coef: level, then cosine and sine of each
    harmonic (method ``none``: the grand mean alone).
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    seen = values.where(F.col("value").isNotNull()).select("px", "day", F.col("value").cast("double").alias("value"))
    if method == "none":
        mean = seen.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"))
        n = seen.groupBy("px").agg(F.count("*").alias("n"))
        out = cells.select("px", "row", "col").join(n, "px", "left").crossJoin(F.broadcast(mean))  # one row
        out = out.select("px", "row", "col", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(FULL).alias("fit"), F.array("mean").alias("coef"))
        return _with_scale(out, seen, 0, period, floor, dof, scaled)
    design = harmonics(F.dayofyear("day") - 1, n_harmonics, period)
    names = list(design)
    solved = save(solve_pixels(normal_equations(seen, ["px"], design, F.col("value")), names, min_dates, max_cond))
    ref = solved.where("full").agg(*(F.avg(F.col("coef")[i]) for i in range(len(names)))).first()
    if ref[0] is None:
        raise ValueError(f"no pixel has {min_dates} well-spread days: fewer harmonics or min_dates")
    cycle = [float(x) for x in ref]
    level = (F.col("b")[0] - sum((F.col("a")[i] * cycle[i] for i in range(1, len(cycle))), F.lit(0.0))) / F.col("n")
    own = F.when(F.col("full"), F.col("coef")).when(F.col("n") > 0, F.array(level, *map(F.lit, cycle[1:]))).otherwise(F.array(*map(F.lit, cycle)))
    fit = F.when(F.coalesce("full", F.lit(False)), FULL).when(F.col("n") > 0, MEAN_ONLY).otherwise(REFERENCE)
    out = cells.select("px", "row", "col").join(solved, "px", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    out = save(out.select("px", "row", "col", "n", fit.alias("fit"), own.alias("coef"), "a", "b"))
    if method == "harmonic":
        return _with_scale(out.select("px", "row", "col", "n", "fit", "coef"), seen, n_harmonics, period, floor, dof, scaled)
    k = len(names)
    first = _with_scale(out.select("px", "row", "col", "n", "fit", "coef"), seen, n_harmonics, period, floor, dof, scaled).select("px", "scale")
    x = save(out.join(first, "px"))

    def variances(batches):
        for pdf in batches:
            full = (pdf["fit"] == FULL).to_numpy()
            var = np.full((len(pdf), k), np.nan)
            if full.any():
                var[full] = pdf["scale"].to_numpy()[full, None] ** 2 * np.einsum("ipp->ip", np.linalg.inv(np.stack(pdf["a"][full]).reshape(-1, k, k)))
            yield pdf[["px", "row", "col"]].assign(full=full, value=[c if f else [np.nan] * k for c, f in zip(pdf["coef"], full, strict=True)], variance=list(var))

    kinds = f"px {x.schema['px'].dataType.simpleString()}, row {x.schema['row'].dataType.simpleString()}, col {x.schema['col'].dataType.simpleString()}"
    channels = x.select("px", "row", "col", "fit", "coef", "a", "scale").mapInPandas(variances, f"{kinds}, full boolean, value array<double>, variance array<double>")
    channels = channels.select("px", "row", "col", "full", F.posexplode(F.arrays_zip("value", "variance")).alias("p", "v")).where("p > 0")
    fields = _smoothed(channels.select("p", "px", "row", "col", "full", "v.value", "v.variance"), "p", range_px, alpha, min_sd)
    shape = save(fields.groupBy("px").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "smooth"))), lambda c: c["smooth"]).alias("shape")))
    x = x.join(shape, "px")
    cross = sum((F.col("a")[i] * F.col("shape")[i - 1] for i in range(1, k)), F.lit(0.0))
    mean = x.select(F.lit(0).alias("p"), "px", "row", "col", (F.col("fit") == FULL).alias("full"), F.when(F.col("n") > 0, (F.col("b")[0] - cross) / F.col("n")).alias("value"), F.when(F.col("n") > 0, F.col("scale") * F.col("scale") / F.col("n")).alias("variance"))
    levels = _smoothed(mean, "p", range_px, alpha, min_sd).select("px", F.col("smooth").alias("level"))
    out = save(x.join(levels, "px").select("px", "row", "col", "n", "fit", F.concat(F.array("level"), F.col("shape")).alias("coef")))
    return _with_scale(out, seen, n_harmonics, period, floor, dof, scaled)


def seasonal_values(days: DataFrame, fits: DataFrame, n_harmonics: int, period: float) -> DataFrame:
    """rows of days (px, day, ...) with ``seasonal`` from the pixels' coefficients."""
    terms = list(harmonics(F.dayofyear("day") - 1, n_harmonics, period).values())
    x = days.join(fits.select("px", F.col("coef").alias("__c")), "px")
    return x.withColumn("seasonal", sum((t * F.col("__c")[i] for i, t in enumerate(terms)), F.lit(0.0))).drop("__c")


def _with_scale(fits: DataFrame, seen: DataFrame, n_harmonics: int, period: float, floor: float, dof: bool, scaled: bool) -> DataFrame:
    if not scaled:
        return fits.withColumn("scale", F.lit(1.0))
    r = seasonal_values(seen, fits, n_harmonics, period).withColumn("r", F.col("value") - F.col("seasonal"))
    s = robust_scale(r, 2 * n_harmonics + 1, floor, dof, "px", "r").select("px", "scale")
    typical = s.agg(F.coalesce(F.median("scale"), F.lit(floor)).alias("__typical"))
    out = fits.join(s, "px", "left").crossJoin(F.broadcast(typical))  # one row
    return out.withColumn("scale", F.coalesce("scale", "__typical")).drop("__typical")
