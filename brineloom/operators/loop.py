"""The cloud loop: fit a low-rank baseline, classify every scene against it, until verdicts settle."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.operators.detect import Mixture, classify_scenes
from brineloom.operators.filters import present
from brineloom.operators.fill import settings
from brineloom.operators.lowrank import Fit, em_fill_rows, matrix_rows, reconstruct_rows, reference_loadings
from brineloom.operators.stats import normal_equations
from brineloom.sources.scratch import written


def _long(rows: DataFrame, days: Sequence[datetime.date], column: str, out: str) -> DataFrame:
    at = F.array(*(F.lit(d) for d in days))
    return rows.select("px", F.posexplode(column).alias("__i", out)).select("px", at[F.col("__i")].alias("day"), out)


def loadings_baseline(state: DataFrame, fit: Fit, reference: DataFrame, days: Sequence[datetime.date], t: np.ndarray, alpha: float, sweeps: int, ridge: float = 1e-3, min_px: int = 5) -> tuple[DataFrame, np.ndarray]:
    """(baseline (px, day, z), status a day) from the modes of a fit and the reference's values alone.

    reference: (px, day, z).  Each day's normal equations on the modes are sums over its pixels;
    they are pooled in time on the driver (days x rank numbers).
    """
    k = len(fit.sigma)
    sigma = np.where(fit.sigma > 0, fit.sigma, 1.0)
    modes = state.select("px", F.transform(F.arrays_zip("w", F.array(*(F.lit(float(s)) for s in sigma)).alias("s")), lambda c: c["w"] / c["s"]).alias("u"))
    design = {f"u{i}": F.col("u")[i] for i in range(k)}
    eq = normal_equations(reference.where(F.col("z").isNotNull()).join(modes, "px"), ["day"], design, F.col("z") - fit.mean)
    a, b, n = np.zeros((len(days), k, k)), np.zeros((len(days), k)), np.zeros(len(days), np.int64)
    at = {d: i for i, d in enumerate(days)}
    for r in eq.collect():  # a row a day
        if r["day"] in at:
            j = at[r["day"]]
            n[j] = r["n"]
            for p in range(k):
                b[j, p] = r[f"b_u{p}"]
                for q in range(p, k):
                    a[j, p, q] = a[j, q, p] = r[f"a_u{p}_u{q}"]
    load, status = reference_loadings(a, b, n, t, alpha, sweeps, ridge, min_px)
    of_days = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in load))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(fit.mean), lambda s, x: s + x)
    base = modes.select("px", F.transform(of_days, lambda v: dot(F.col("u"), v)).alias("low"))
    return _long(base, days, "low", "z"), status


def cloud_loop(pixels: DataFrame, days: Sequence[datetime.date], rows: int, cols: int, k: int = 2, cfg: Mixture = Mixture(), p_min: float = 0.5, max_iter: int = 8, tol: float = 1e-3, patience: int = 1, t_c: float = 0.0, alpha_max: float = 0.25, warm: bool = True, source: str = "all", reference: str | None = None, loading_t_c: float | None = None, ridge: float = 1e-3, min_px: int = 5, method: str = "mixture", center_range: tuple[float, float] | None = None, min_kept_frac: float | None = None, require_qc: bool = True, save: Callable[[DataFrame], DataFrame] = written) -> tuple[DataFrame, list[dict]]:  # noqa: B008
    """(pixels with bits and keep, history) from water pixels (sensor, day, px, row, col, value,
    seasonal, scale, flagged).

    bits: bit 0 is the start (unflagged values), bit i + 1 the verdict of round i.  A round takes
    the kept values, standardizes them, fills the pixels-by-days matrix at rank k, and classifies
    all scenes anew against the baseline.  It ends when the largest share of flips of any
    sensor stays under tol for ``patience`` rounds.

    t_c: cutoff of the modes' filter in time, in days.  warm: each fit starts from the last one's
    modes and loadings, not from its observations, so that what a round flags does not linger.
    source: the baseline is the low-rank field (``all``), or the modes with loadings from the
    ``reference`` sensor alone (``reference``), pooled with cutoff loading_t_c (default t_c).  A scene
    goes as a whole if its centre is outside of center_range, or under min_kept_frac of the water
    would stay.  No pixels: none come back, with an empty history.
    """
    if source not in ("all", "reference") or source == "reference" and reference is None:
        raise ValueError("source is all, or reference with the sensor's name")
    if max_iter > 30:
        raise ValueError("a history of at most 30 rounds fits the bits")
    has = present(F.col("value"))
    x = save(pixels.withColumn("keep", has & ~F.coalesce(F.col("flagged"), F.lit(False))).withColumn("bits", F.col("keep").cast("int")))
    t = np.array([(d - days[0]).days for d in days], float)
    history, calm, seed = [], 0, None
    if not x.limit(1).count():
        return x, history
    alpha, sweeps = settings(t_c, alpha_max)
    pool = settings(t_c if loading_t_c is None else loading_t_c, alpha_max)
    n_water = x.select("px").distinct().count()
    standard = (F.col("value") - F.col("seasonal")) / F.col("scale")
    for n in range(max_iter):
        z = x.where("keep").groupBy("px", "day").agg(F.avg(standard).alias("z"))
        fit, state = em_fill_rows(matrix_rows(z, days), len(days), k, t, alpha, sweeps, seed=seed, save=save)
        seed = (fit.v, state.select("px", "w")) if warm else None
        status = None
        if source == "all":
            base = _long(reconstruct_rows(state, fit), days, "lowrank", "z")
        else:
            own = x.where(F.col("keep") & (F.col("sensor") == reference)).groupBy("px", "day").agg(F.avg(standard).alias("z"))
            base, status = loadings_baseline(state, fit, own, days, t, *pool, ridge, min_px)
        y = x.join(base, ["px", "day"], "left").withColumn("base", F.coalesce("z", F.lit(0.0)) * F.col("scale") + F.col("seasonal"))
        p = save(classify_scenes(y, rows, cols, cfg, method).select("sensor", "day", "row", "col", "p_valid", "center"))
        bad = ~F.coalesce(F.col("flagged"), F.lit(False)) if require_qc else F.lit(True)
        now = F.coalesce(has & (F.col("p_valid") >= p_min) & bad, F.lit(False))
        x = x.drop("p_valid").join(p, ["sensor", "day", "row", "col"], "left").withColumn("__was", F.col("keep")).withColumn("keep", now)
        if center_range is not None or min_kept_frac is not None:
            scene = x.groupBy("sensor", "day").agg(F.first("center", ignorenulls=True).alias("__c"), (F.count_if("keep") / n_water).alias("__f"))
            out = F.lit(True)
            if center_range is not None:
                out &= F.coalesce(F.col("__c").between(*center_range), F.lit(True))
            if min_kept_frac is not None:
                out &= F.col("__f") >= min_kept_frac
            x = x.join(scene.select("sensor", "day", out.alias("__ok")), ["sensor", "day"]).withColumn("keep", F.col("keep") & F.col("__ok")).drop("__ok")
        x = x.drop("center")
        x = save(x.withColumn("bits", F.col("bits").bitwiseOR(F.shiftleft(F.col("keep").cast("int"), n + 1))))
        flips = x.where(has).groupBy("sensor").agg(F.avg((F.col("keep") != F.col("__was")).cast("double")).alias("f"), F.count_if("keep").alias("kept")).collect()
        history.append({"round": n, "flips": {r["sensor"]: r["f"] for r in flips}, "kept": {r["sensor"]: r["kept"] for r in flips}, "em": fit.deltas, "status": None if status is None else status.tolist()})
        x = x.drop("__was")
        calm = calm + 1 if max((r["f"] for r in flips), default=0.0) < tol else 0
        if calm >= patience:
            break
    return x, history


def windows(days: Sequence[datetime.date], span: int, overlap: int) -> list[tuple[list, list]]:
    """(days of a window, its central days); the central parts cut the record without gaps."""
    out = []
    for lo in range(0, len(days), span):
        central = list(days[lo : lo + span])
        out.append((list(days[max(0, lo - overlap) : lo + span + overlap]), central))
    return out


def segmented_loop(pixels: DataFrame, days, rows, cols, span: int, overlap: int, **kw) -> DataFrame:
    """The loop on overlapping windows, each giving its central days."""
    parts = []
    for own, central in windows(days, span, overlap):
        x, _ = cloud_loop(pixels.where(F.col("day").isin(own)), own, rows, cols, **kw)
        parts.append(x.where(F.col("day").isin(central)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
