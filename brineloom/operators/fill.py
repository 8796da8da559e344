"""The final fill of a standardized record: settings by cross-validation on a coarse grid, modes
there, and a fit at the native grid started from them; held-out scores; smoothing of maps."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.operators import stencil as G
from brineloom.operators.lowrank import Fit, cv_grid, em_fill, em_fill_rows, matrix_rows, pick_k, reconstruct_rows
from brineloom.sources.scratch import written


def settings(cutoff: float, alpha_max: float = 0.25) -> tuple[float, int]:
    """(alpha, sweeps) of a diffusion with that cutoff, in days or pixels; 0 is off."""
    if cutoff <= 0:
        return 0.0, 0
    reach = (cutoff / (2 * math.pi)) ** 2
    sweeps = max(1, math.ceil(reach / alpha_max))
    return reach / sweeps, sweeps


def map_smoother(mask: np.ndarray, cutoff: float, alpha_max: float = 0.25) -> Callable[[np.ndarray], np.ndarray] | None:
    """For a matrix whose rows are the mask's cells in order: diffuses each column's map over the
    mask, with no flux over its border.  None when the cutoff is 0."""
    alpha, sweeps = settings(cutoff, alpha_max)
    if not sweeps:
        return None
    if alpha > 0.25:
        raise ValueError(f"alpha {alpha:g} is over 0.25: the diffusion would not be stable")
    at = np.full(mask.shape, -1)
    at[mask] = np.arange(int(mask.sum()))
    sides = [(at[:-1], at[1:]), (at[:, :-1], at[:, 1:])]
    pairs = np.concatenate([np.column_stack([a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]]) for a, b in sides])

    def smooth(x: np.ndarray) -> np.ndarray:
        for _ in range(sweeps):
            flow = alpha * (x[pairs[:, 1]] - x[pairs[:, 0]])
            x = x.copy()
            np.add.at(x, pairs[:, 0], flow)
            np.subtract.at(x, pairs[:, 1], flow)
        return x

    return smooth


def smooth_maps(cells: DataFrame, cutoff: float, alpha_max: float = 0.25, by: Sequence[str] = ("day",), value: str = "value") -> DataFrame:
    """The same over cells (by..., row, col, value) dealt over the cluster; as they are when the cutoff is 0."""
    alpha, sweeps = settings(cutoff, alpha_max)
    return G.diffuse_space(cells, by, alpha, sweeps, value) if sweeps else cells


@dataclass
class Choice:
    """Rank and cutoff by each criterion."""

    k_point: int
    t_c_point: float
    k_day: int
    t_c_day: float


def choose(scores: Sequence[tuple[float, int, float | None, float | None]], rel_tol: float = 0.01) -> Choice:
    """From (t_c, k, rmse_points, rmse_days): for each criterion the cutoff of the least error, and
    at it the least rank within rel_tol of the best.  A criterion without scores follows the other."""
    found = []
    for at in (2, 3):
        rows = [(r[at], r[0], r[1]) for r in scores if r[at] is not None and np.isfinite(r[at])]
        if rows:
            t_c = min(rows)[1]
            own = [(k, e) for e, c, k in rows if c == t_c]
            found.append((pick_k([k for k, _ in own], [e for _, e in own], rel_tol), t_c))
        else:
            found.append(None)
    point, day = found[0] or found[1], found[1] or found[0]
    if point is None:
        raise ValueError("nothing could be held out: no score to choose by")
    return Choice(point[0], point[1], day[0], day[1])


def _coarse(values: DataFrame, days: Sequence[datetime.date], f: int, height: int, width: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The block means as a matrix in memory (one region's coarse grid), and its rows' blocks."""
    b = G.block_mean(values.withColumnRenamed("z", "value"), ["day"], f, math.ceil(height / f) * f, math.ceil(width / f) * f).where(F.col("value").isNotNull()).collect()
    cells = sorted({(r["row"], r["col"]) for r in b})
    at, when = {c: i for i, c in enumerate(cells)}, {d: j for j, d in enumerate(days)}
    x = np.full((len(cells), len(days)), np.nan)
    for r in b:
        if r["day"] in when:
            x[at[r["row"], r["col"]], when[r["day"]]] = r["value"]
    return x, cells


def final_fill(values: DataFrame, days: Sequence[datetime.date], coarsen: int, cutoffs: Sequence[float] = (0, 2, 4), ks: Sequence[int] = (1, 2, 3, 4), alpha_max: float = 0.25, rel_tol: float = 0.01, l_c: float = 0.0, tol: float = 1e-3, max_iter: int = 100, seed: int = 0, choice: Choice | None = None, save=written) -> tuple[DataFrame, Choice, dict[str, Fit]]:
    """(px, day, point, filled_day, filled, observed, constrained) from standardized values (px, row, col, day, z).

    The coarse grid (coarsen x coarsen blocks, in memory) is searched for rank and cutoff by points
    and by days held out; each choice is fitted there, and then at the native grid, where each
    pixel starts from its block's loadings.  filled: by the point choice on days with any value
    (constrained), by the day choice on others.  Pixels that were never observed have no rows.
    l_c: cutoff of the maps' smoothing on the coarse grid, in its blocks; 0 is off.
    """
    spark = values.sparkSession
    t = np.array([(d - days[0]).days for d in days], float)
    top = values.agg(F.max("row"), F.max("col")).first()
    if top[0] is None:
        raise ValueError("no values to fill from")
    x, cells = _coarse(values, days, coarsen, top[0] + 1, top[1] + 1)
    if choice is None:
        got = cv_grid(spark, x, t, cutoffs, ks, alpha_max, tol=tol, max_iter=max_iter, seed=seed).collect()
        choice = choose([tuple(r) for r in got], rel_tol)
    mask = np.zeros((max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1), bool)
    mask[tuple(np.array(cells).T)] = True
    smoother = map_smoother(mask, l_c, alpha_max)
    matrix = save(matrix_rows(values.select("px", "day", "z"), days))
    place = values.select("px", F.expr(f"row div {coarsen}").cast("long").alias("r"), F.expr(f"col div {coarsen}").cast("long").alias("c")).distinct()
    out, fits = None, {}
    for name, k, t_c in (("point", choice.k_point, choice.t_c_point), ("day", choice.k_day, choice.t_c_day)):
        alpha, sweeps = settings(t_c, alpha_max)
        k = min(k, *x.shape)
        coarse = em_fill(x, k, t, alpha, sweeps, tol, max_iter, smoother=smoother)
        blocks = spark.createDataFrame([(int(r), int(c), w.tolist()) for (r, c), w in zip(cells, coarse["W"], strict=True)], "r long, c long, w array<double>")
        start = place.join(F.broadcast(blocks), ["r", "c"]).select("px", "w")  # one region's coarse grid
        fit, state = em_fill_rows(matrix, len(days), k, t, alpha, sweeps, tol, max_iter, (coarse["V"], start), save)
        fits[name] = fit
        own = reconstruct_rows(state, fit).select("px", F.posexplode("filled").alias("__i", name))
        out = own if out is None else out.join(own, ["px", "__i"])
    at = F.array(*(F.lit(d) for d in days))
    seen = matrix.select("px", F.posexplode("z").alias("__i", "__z")).select("px", "__i", F.col("__z").isNotNull().alias("observed"))
    some = seen.groupBy("__i").agg(F.max("observed").alias("constrained"))
    out = out.join(seen, ["px", "__i"]).join(F.broadcast(some), "__i")  # a row a day
    return out.select("px", at[F.col("__i")].alias("day"), "point", F.col("day").alias("filled_day"), F.when(F.col("constrained"), F.col("point")).otherwise(F.col("day")).alias("filled"), "observed", "constrained"), choice, fits


def holdout_table(observed: DataFrame, predicted: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """(by..., n, rmse, bias) of predictions (px, day, pred) at held-out values (px, day, value)."""
    e = F.col("pred") - F.col("value")
    x = observed.where(F.col("value").isNotNull()).join(predicted.where(F.col("pred").isNotNull()), ["px", "day"])
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def holdout_predictions(values: DataFrame, held: DataFrame, days: Sequence[datetime.date], k: int, t_c: float, alpha_max: float = 0.25, tol: float = 1e-3, max_iter: int = 100, save=written) -> tuple[DataFrame, DataFrame]:
    """(predictions (px, day, value, pred), table a day) of values (px, day, z) held out at (px, day), by one fit without them."""
    alpha, sweeps = settings(t_c, alpha_max)
    t = np.array([(d - days[0]).days for d in days], float)
    rest = values.join(held.select("px", "day"), ["px", "day"], "left_anti")
    fit, state = em_fill_rows(matrix_rows(rest.select("px", "day", "z"), days), len(days), k, t, alpha, sweeps, tol, max_iter, save=save)
    at = F.array(*(F.lit(d) for d in days))
    pred = reconstruct_rows(state, fit).select("px", F.posexplode("lowrank").alias("__i", "pred")).select("px", at[F.col("__i")].alias("day"), "pred")
    own = values.join(held.select("px", "day"), ["px", "day"], "left_semi").select("px", "day", F.col("z").alias("value"))
    out = save(own.join(pred, ["px", "day"]))
    return out, holdout_table(out.select("px", "day", "value"), out.select("px", "day", "pred"))
