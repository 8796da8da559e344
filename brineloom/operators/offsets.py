"""Inter-calibration: clipping of pairs, fixed and major-axis models, held-out scenes, bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brineloom.operators.stats import MAD_SCALE
from brineloom.sources.scratch import written


def clip_pairs(pairs: DataFrame, k: float, slope: float = 1.0, max_rounds: int = 20, by: str = "sensor", scene: str = "day", save: Callable[[DataFrame], DataFrame] = written) -> tuple[DataFrame, int, bool]:
    """(pairs with ``kept``, rounds, converged) from pairs (sensor, day, px, x, y).

    Each round judges every pair anew: a scene's offset is the median over its kept pairs (over
    all, if none is kept), residuals are centred for the sensor, and those within k scaled MADs
    over all its pairs are kept.  It ends when nothing changes, when a state returns (a cycle, not
    converged), or after max_rounds.
    """
    x = save(pairs.withColumn("kept", F.lit(True)))
    seen: list[int] = []
    for n in range(1, max_rounds + 1):
        d = F.col("y") - slope * F.col("x")
        off = x.groupBy(by, scene).agg(F.coalesce(F.median(F.when(F.col("kept"), d)), F.median(d)).alias("__off"))
        r = x.join(off, [by, scene]).withColumn("__r", d - F.col("__off"))
        med = r.groupBy(by).agg(F.median("__r").alias("__med"))
        r = r.join(med, by).withColumn("__r", F.col("__r") - F.col("__med"))
        s = r.groupBy(by).agg((MAD_SCALE * F.median(F.abs("__r"))).alias("__s"))
        now = F.when(F.col("__s") > 0, F.abs("__r") <= k * F.col("__s")).otherwise(F.col("kept"))
        x = save(r.join(s, by).withColumn("__was", F.col("kept")).withColumn("kept", now).select(*pairs.columns, "kept", "__was"))
        changed, state = x.agg(F.count_if(F.col("kept") != F.col("__was")), F.bit_xor(F.when(F.col("kept"), F.xxhash64(by, scene, "px")).otherwise(0))).first()
        x = x.drop("__was")
        if not changed:
            return x, n, True
        if state in seen:
            return x, n, False
        seen.append(state)
    return x, max_rounds, False


def loso_constant(scenes: DataFrame, by: str, scene: str, delta: str) -> DataFrame:
    """(by, n, rmse, bias): each scene against the mean of all others, from sums and not from pairs."""
    t = scenes.groupBy(by).agg(F.sum(delta).alias("__t"), F.count(delta).alias("__n"))
    e = F.col(delta) - (F.col("__t") - F.col(delta)) / (F.col("__n") - 1)
    x = scenes.join(t, by).where("__n > 1").withColumn("__e", e)
    return x.groupBy(by).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg("__e").alias("bias"))


def fit_fixed(scenes: DataFrame, by: str = "sensor") -> DataFrame:
    """(by, a, n) from scenes (delta, w): the weighted mean offset."""
    return scenes.groupBy(by).agg((F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("a"), F.count("*").alias("n"))


def fit_rma(scenes: DataFrame, by: str = "sensor", clip: tuple[float, float] = (0.2, 5.0)) -> DataFrame:
    """(by, slope, x0, a, off, valid) from scene medians (x, y): off is subtracted before the
    division by slope."""
    p = scenes.groupBy(by).agg(F.median("x").alias("x0"))
    s = scenes.join(p, by).groupBy(by, "x0").agg(
        (F.signum(F.corr("x", "y")) * F.stddev_pop("y") / F.stddev_pop("x")).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")
    )
    a = F.col("my") - F.col("x0") - F.col("slope") * (F.col("mx") - F.col("x0"))
    s = s.withColumn("a", a).withColumn("off", F.col("a") + F.col("x0") * (1 - F.col("slope")))
    return s.select(by, "slope", "x0", "a", "off", "n", F.coalesce(F.col("slope").between(*clip), F.lit(False)).alias("valid"))


def loso_rma(scenes: DataFrame, by: str = "sensor", clip: tuple[float, float] = (0.2, 5.0)) -> DataFrame:
    """(by, rmse_rma): each scene's y predicted by the major-axis model of all other scenes (x, y).

    A member's scenes, a row each, are one task; those left with an invalid model are not scored.
    """

    def run(key, table):
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        e = []
        for i in range(len(x)):
            p, q = np.delete(x, i), np.delete(y, i)
            if len(p) < 3 or not p.std() or not q.std():
                continue
            slope = np.sign(np.corrcoef(p, q)[0, 1]) * q.std() / p.std()
            if clip[0] <= slope <= clip[1]:
                e.append(y[i] - (q.mean() + slope * (x[i] - p.mean())))
        return pa.table({by: [str(key[0].as_py())], "rmse_rma": pa.array([float(np.sqrt(np.mean(np.square(e)))) if e else None], pa.float64())})

    rows = scenes.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(by).cast("string").alias(by), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.groupBy(by).applyInArrow(run, f"{by} string, rmse_rma double")


def recommend(rmse_fixed: Column, rmse_rma: Column, valid: Column, gain: float = 0.02) -> Column:
    return F.when(valid & (rmse_rma <= (1 - gain) * rmse_fixed), "rma").otherwise("fixed")


def scene_bootstrap(scenes: DataFrame, stat: Callable[[], Column], by: str = "sensor", n_boot: int = 200, seed: int = 0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(by, low, high): percentiles of an aggregate over whole scenes drawn with replacement.

    A scene's number of copies in a draw is Poisson(1), from a hash of scene and draw: each row
    draws for itself, so there is no index join; ``stat`` is over rows repeated so often.
    """
    # The Poisson(1) distribution function.
    steps = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)
    u = F.pmod(F.xxhash64(F.lit(seed), "day", "draw"), F.lit(1_000_000)) / 1_000_000.0
    times = sum(F.when(u >= s, 1).otherwise(0) for s in steps)
    x = scenes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("copies", times).where("copies > 0")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    s = x.groupBy(by, "draw").agg(stat().alias("s"))
    return s.groupBy(by).agg(F.percentile("s", F.lit(low)).alias("low"), F.percentile("s", F.lit(high)).alias("high"))


def fit_offset_model(hours: Sequence[float], delta: Sequence[float], w: Sequence[float], harmonics: int = 1, min_scenes: int = 8, max_cond: float = 100.0, clip: tuple[float, float] = (-5.0, 5.0), name: str = "member") -> dict:
    """harmonics, coef, loo, fitted and its range, of a member's offset over its matchup scenes.

    Under min_scenes it is a constant; no scene at all, or a fitted offset outside of ``clip``, is
    an error that says so.
    """
    delta = np.asarray(delta, float)
    if not len(delta):
        raise ValueError(f"{name} has no matchup scene: it can't be put on the reference's scale")
    k, coef, loo = harmonic_ladder(hours, delta, w, harmonics if len(delta) >= min_scenes else 0, max_cond)
    fitted = offset_at(hours, coef)
    low, high = float(fitted.min()), float(fitted.max())
    if not (clip[0] <= low and high <= clip[1]):
        raise ValueError(f"{name}: the fitted offset spans [{low:+.2f}, {high:+.2f}], outside of [{clip[0]:+.2f}, {clip[1]:+.2f}]")
    return {"harmonics": k, "coef": coef, "loo": loo, "fitted": fitted, "mean": float(fitted.mean()), "low": low, "high": high, "few": len(delta) < min_scenes}


def offset_at(hours: Sequence[float], coef: Sequence[float]) -> np.ndarray:
    """The offset at those hours; a missing hour has the constant alone."""
    h, coef = np.asarray(hours, float), np.asarray(coef, float)
    out = np.full(len(h), coef[0])
    for j in range(1, (len(coef) - 1) // 2 + 1):
        w = 2 * np.pi * j * h / 24
        out += np.nan_to_num(coef[2 * j - 1] * np.cos(w)) + np.nan_to_num(coef[2 * j] * np.sin(w))
    return out


def fit_offsets(scenes: DataFrame, by: str = "sensor", harmonics: int = 1, min_scenes: int = 8, max_cond: float = 100.0, clip: tuple[float, float] = (-5.0, 5.0)) -> DataFrame:
    """(by, harmonics, coef, loo, mean, low, high) of each member from scenes (by, hour, delta, w): one row a scene."""
    schema = f"{by} string, harmonics int, coef array<double>, loo double, mean double, low double, high double"

    def run(key, table):
        r = fit_offset_model(table.column("hour").to_numpy(zero_copy_only=False), table.column("delta").to_numpy(), table.column("w").to_numpy(), harmonics, min_scenes, max_cond, clip, str(key[0].as_py()))
        return pa.table({by: [str(key[0].as_py())], "harmonics": pa.array([r["harmonics"]], pa.int32()), "coef": [r["coef"].tolist()], "loo": [r["loo"]], "mean": [r["mean"]], "low": [r["low"]], "high": [r["high"]]})

    x = scenes.where(F.col("delta").isNotNull()).select(F.col(by).cast("string").alias(by), F.coalesce(F.col("hour").cast("double"), F.lit(float("nan"))).alias("hour"), F.col("delta").cast("double").alias("delta"), F.col("w").cast("double").alias("w"))
    return x.groupBy(by).applyInArrow(run, schema)


def harmonic_ladder(hours: Sequence[float], y: Sequence[float], w: Sequence[float], most: int, max_cond: float = 100.0) -> tuple[int, np.ndarray, float]:
    """(K, coefficients, LOO error) of a diurnal offset from a table of scenes (a row each).

    K steps down while the design is ill-conditioned or has too few rows, then while the
    leave-one-out error of K harmonics does not beat that of K - 1.
    """
    h, y, w = (np.asarray(a, float) for a in (hours, y, w))

    def design(k):
        cols = [np.ones_like(h)]
        for j in range(1, k + 1):
            cols += [np.nan_to_num(np.cos(2 * np.pi * j * h / 24)), np.nan_to_num(np.sin(2 * np.pi * j * h / 24))]
        return np.column_stack(cols)

    def fit(k):
        x = design(k)
        inv = np.linalg.pinv(x.T @ (x * w[:, None]))
        b = inv @ (x.T @ (w * y))
        lever = w * np.einsum("ij,jk,ik->i", x, inv, x)
        e = (y - x @ b) / np.maximum(1 - lever, 1e-8)
        return b, float(np.sqrt(np.mean(e * e)))

    k = most
    while k > 0 and (len(y) <= 2 * k + 1 or np.linalg.cond(np.sqrt(w)[:, None] * design(k)) > max_cond):
        k -= 1
    best = fit(k)
    while k > 0:
        less = fit(k - 1)
        if best[1] < less[1]:
            break
        k, best = k - 1, less
    return k, best[0], best[1]
