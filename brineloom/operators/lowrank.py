"""Low-rank gap filling of a pixels-by-days matrix: Gram matrix, filtered modes, EM, cross-validation.

Rows of the matrix are rows of a DataFrame (px, z: array<double> of n days, NULL in gaps), dealt
over the cluster.  Only n x n and n x k arrays meet on the driver; n is the length of the record
in days.  Each EM round is one pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.sources.scratch import written

#: Values of a matrix (160 MB) that one task fits.
ONE_TASK = 20_000_000


def _rows(column: pa.Array, n: int) -> np.ndarray:
    """An array column as a float matrix, NaN where NULL."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), n)


def gram(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(i, j, g), from 1: sums of products of the columns, gaps as 0; a part sums its own first."""

    def part(batches):
        g = np.zeros((n, n))
        for batch in batches:
            x = np.nan_to_num(_rows(batch.column(0), n))
            g += x.T @ x
        i, j = np.indices((n, n))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + 1, pa.int32()), pa.array(j.ravel() + 1, pa.int32()), pa.array(g.ravel())], ["i", "j", "g"])

    return rows.select(column).mapInArrow(part, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def cell_widths(t: np.ndarray) -> np.ndarray:
    d = np.diff(t)
    return (np.append(d[:1], d) + np.append(d, d[-1:])) / 2


def diffusion_step(t: np.ndarray, alpha: float) -> np.ndarray:
    """The matrix of one sweep along t, with no flux over the ends."""
    t = np.asarray(t, float)
    n = len(t)
    step = np.eye(n)
    if n < 2 or alpha == 0:
        return step
    c, w = alpha / np.diff(t), cell_widths(t)
    for i in range(n - 1):
        step[i, i] -= c[i] / w[i]
        step[i, i + 1] += c[i] / w[i]
        step[i + 1, i + 1] -= c[i] / w[i + 1]
        step[i + 1, i] += c[i] / w[i + 1]
    return step


def diffuse(t: np.ndarray, m: np.ndarray, alpha: float, sweeps: int) -> np.ndarray:
    """Sweeps along the first axis."""
    return np.linalg.matrix_power(diffusion_step(t, alpha), sweeps) @ m if sweeps else np.array(m, float)


def check_stability(t: np.ndarray, alpha: float, factor: float = 0.25) -> None:
    limit = factor * float(np.min(np.diff(t))) ** 2
    if alpha > limit:
        raise ValueError(f"alpha {alpha:g} is over {limit:g}: the diffusion would not be stable")


def filtered_gram(t: np.ndarray, b: np.ndarray, alpha: float, sweeps: int) -> np.ndarray:
    f = np.linalg.matrix_power(diffusion_step(t, alpha), sweeps) if sweeps else np.eye(len(b))
    out = f @ b @ f.T
    return (out + out.T) / 2


def top_modes(b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, eigenvalues) of the k largest, each V with its largest entry positive."""
    values, vectors = np.linalg.eigh(b)
    v, lam = vectors[:, ::-1][:, :k], values[::-1][:k]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign), np.maximum(lam, 0)


def em_fill(x: np.ndarray, k: int, t: np.ndarray, alpha: float = 0.0, sweeps: int = 0, tol: float = 1e-3, max_iter: int = 100, seed: np.ndarray | None = None, smoother: Callable[[np.ndarray], np.ndarray] | None = None) -> dict:
    """One matrix in memory (a coarse grid): NaN are gaps.  Returns filled, V, sigma, deltas, mean.

    seed: a field to start the gaps from; without a filter in time, days without any value start
    from the mean all the same, as nothing else would hold them.  smoother: applied to the columns'
    maps before the modes are taken.
    """
    seen = np.isfinite(x)
    mean = x[seen].mean() if seen.any() else 0.0
    start = np.zeros_like(x) if seed is None else np.nan_to_num(seed - mean)
    if not sweeps:
        start[:, ~seen.any(0)] = 0.0
    z = np.where(seen, x - mean, start)
    sd = (x[seen] - mean).std() or 1.0
    deltas: list[float] = []
    v = sigma = w = None
    for _ in range(max_iter):
        s = smoother(z) if smoother else z
        v, _lam = top_modes(filtered_gram(t, s.T @ s, alpha, sweeps), k)
        w = s @ v
        sigma = np.linalg.norm(w, axis=0)
        new = (w @ v.T)[~seen]
        deltas.append(float(np.sqrt(np.mean((new - z[~seen]) ** 2)) / sd) if new.size else 0.0)
        z[~seen] = new
        if deltas[-1] < tol:
            break
    last = w
    w = (smoother(z) if smoother else z) @ v
    return {"filled": z + mean, "lowrank": w @ v.T + mean, "W": w, "last": last, "V": v, "sigma": sigma, "deltas": deltas, "mean": mean, "sd": sd}


@dataclass
class Fit:
    v: np.ndarray
    sigma: np.ndarray
    mean: float
    deltas: list[float] = field(default_factory=list)


def em_fill_rows(matrix: DataFrame, n: int, k: int, t: np.ndarray, alpha: float = 0.0, sweeps: int = 0, tol: float = 1e-3, max_iter: int = 100, seed: tuple[np.ndarray, DataFrame] | None = None, save: Callable[[DataFrame], DataFrame] = written, one_task: int = ONE_TASK) -> tuple[Fit, DataFrame]:
    """EM over dealt rows (px, z).  Returns the fit, and (px, z, w): w are a row's loadings on V.

    seed: V of an earlier fit of rank k and rows' loadings (px, w) on it, which fill the gaps at
    first (rows without: the mean; days without any value too, if there is no filter in time).

    A matrix of at most ``one_task`` values (counted first) is fitted by one task, with the same
    result: rounds of it would spend their time on starting jobs.  Of a larger one, a row's state
    between rounds is its k loadings, written by ``save``; a round fills the gaps from them, sums
    the Gram matrix of its part, and sends n x n numbers, which are added in two steps.
    """
    if matrix.count() * n <= one_task:
        return _fit_in_task(matrix, n, k, t, alpha, sweeps, tol, max_iter, seed, save)
    e = matrix.select(F.explode("z").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    mean, sd = float(e["m"] or 0.0), float(e["s"] or 0.0) or 1.0
    none = F.array_repeat(F.lit(0.0), k)
    fit = Fit(np.zeros((n, k)), np.zeros(k), mean)
    if seed is None:
        state = save(matrix.select("px", "z", none.alias("w")))
    else:
        state = save(matrix.select("px", "z").join(seed[1].select("px", F.col("w").cast("array<double>").alias("w")), "px", "left").select("px", "z", F.coalesce("w", none).alias("w")))
        fit.v = np.array(seed[0], float)
        if not sweeps:
            counts = matrix.select(F.posexplode("z").alias("i", "v")).where(F.col("v").isNotNull() & ~F.isnan("v")).select("i").distinct().collect()
            fit.v[np.setdiff1d(np.arange(n), [r["i"] for r in counts])] = 0.0

    def filled(batch, v):
        x = _rows(batch.column(1), n) - mean
        gap = ~np.isfinite(x)
        return np.where(gap, _rows(batch.column(2), k) @ v.T, x), gap

    for _ in range(max_iter):
        v_old = fit.v

        def part(batches, v_old=v_old):
            from pyspark import TaskContext

            g = np.zeros((n, n))
            for batch in batches:
                x, _ = filled(batch, v_old)
                g += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([g.tobytes()], pa.binary())], ["part", "g"])

        def add(table):
            return pa.table({"part": table.column("part").slice(0, 1), "g": pa.array([sum(np.frombuffer(g.as_py()) for g in table.column("g")).tobytes()], pa.binary())})

        groups = max(1, math.isqrt(state.rdd.getNumPartitions()))
        sums = state.mapInArrow(part, "part int, g binary").groupBy("part").applyInArrow(add, "part int, g binary").collect()
        b = sum((np.frombuffer(r["g"]) for r in sums), np.zeros(n * n)).reshape(n, n)
        v_new, _lam = top_modes(filtered_gram(t, b, alpha, sweeps), k)

        def move(batches, v_old=v_old, v_new=v_new):
            for batch in batches:
                x, gap = filled(batch, v_old)
                w = x @ v_new
                d = np.where(gap, w @ v_new.T - x, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel())), pa.array((d * d).sum(1)), pa.array(gap.sum(1), pa.int64())], ["px", "z", "w", "ss", "gaps"])

        moved = save(state.mapInArrow(move, f"px {state.schema['px'].dataType.simpleString()}, z array<double>, w array<double>, ss double, gaps long"))
        r = moved.agg(F.sum("ss"), F.sum("gaps"), *(F.sum(F.col("w")[i] * F.col("w")[i]) for i in range(k))).first()
        fit.v, fit.sigma = v_new, np.sqrt(np.array([float(x or 0) for x in r[2:]]))
        fit.deltas.append(float(np.sqrt((r[0] or 0.0) / max(1, r[1] or 0)) / sd))
        state = moved.select("px", "z", "w")
        if fit.deltas[-1] < tol:
            break
    return fit, state


def _fit_in_task(matrix, n, k, t, alpha, sweeps, tol, max_iter, seed, save) -> tuple[Fit, DataFrame]:
    none = F.array_repeat(F.lit(0.0), k)
    v0 = None if seed is None else np.array(seed[0], float)
    rows = matrix.select("px", "z", none.alias("w"))
    if seed is not None:
        rows = matrix.select("px", "z").join(seed[1].select("px", F.col("w").cast("array<double>").alias("w")), "px", "left").select("px", "z", F.coalesce("w", none).alias("w"))

    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        x = _rows(table.column("z").chunk(0), n)
        seen = np.isfinite(x)
        start = None if v0 is None else _rows(table.column("w").chunk(0), k) @ v0.T + (x[seen].mean() if seen.any() else 0.0)
        r = em_fill(x, k, t, alpha, sweeps, tol, max_iter, start)
        told = np.concatenate([[r["mean"], len(r["deltas"])], r["deltas"], r["sigma"], r["V"].ravel()])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(r["last"]).ravel()))
        fits = pa.array([told.tobytes()] + [None] * (len(x) - 1), pa.binary())
        yield from pa.table([table.column("px"), table.column("z").cast(pa.list_(pa.float64())), lists, fits], names=["px", "z", "w", "fit"]).to_batches(max_chunksize=2_000)

    px = rows.schema["px"].dataType.simpleString()
    out = save(rows.repartition(1).mapInArrow(run, f"px {px}, z array<double>, w array<double>, fit binary"))
    found = out.where(F.col("fit").isNotNull()).select("fit").first()
    if found is None:
        return Fit(np.zeros((n, k)), np.zeros(k), 0.0), out.select("px", "z", "w")
    told = np.frombuffer(found["fit"])
    m = int(told[1])
    return Fit(told[2 + m + k :].reshape(n, k).copy(), told[2 + m : 2 + m + k].copy(), float(told[0]), told[2 : 2 + m].tolist()), out.select("px", "z", "w")


def reconstruct_rows(state: DataFrame, fit: Fit) -> DataFrame:
    """(px, filled, lowrank) arrays from rows with loadings."""
    n, k = fit.v.shape

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(1), n)
            low = _rows(batch.column(2), k) @ fit.v.T + fit.mean
            full = np.where(np.isfinite(x), x, low)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(a.ravel())) for a in (full, low)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["px", "filled", "lowrank"])

    return state.select("px", "z", "w").mapInArrow(run, f"px {state.schema['px'].dataType.simpleString()}, filled array<double>, lowrank array<double>")


def matrix_rows(values: DataFrame, days: Sequence, min_obs: int = 1) -> DataFrame:
    """(px, z) from long (px, day, z): the days in order, NULL in gaps; days of under min_obs
    values are gaps as a whole, pixels without any value go."""
    ok = values.where(F.col("z").isNotNull()).groupBy("day").agg(F.count("*").alias("n")).where(F.col("n") >= min_obs).select("day")
    held = values.where(F.col("z").isNotNull()).join(ok, "day", "left_semi")
    m = held.groupBy("px").agg(F.map_from_entries(F.collect_list(F.struct("day", F.col("z").cast("double")))).alias("m"))
    return m.select("px", F.array(*(F.col("m")[F.lit(d)] for d in days)).alias("z"))


def hold_out(x: np.ndarray, day_frac: float, frac: float, low: float, high: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(points, days) held: whole days, and points seen on a day where a donor day of similar
    coverage has a gap."""
    rng = np.random.default_rng(seed)
    seen = np.isfinite(x)
    cover = seen.sum(0)
    data = np.flatnonzero(cover)
    days = rng.permutation(data)[: round(day_frac * len(data))]
    points = np.zeros_like(seen)
    for j in np.setdiff1d(data, days):
        donors = np.flatnonzero((cover >= low * cover[j]) & (cover <= high * cover[j]))
        cap = int(min(0.4 * cover[j], cover[j] - 50, frac * cover[j]))
        if not len(donors) or cap < 1:
            continue
        at = np.flatnonzero(seen[:, j] & ~seen[:, rng.choice(donors)])
        points[rng.permutation(at)[:cap], j] = True
    return points, days


def pick_k(ks: Sequence[int], rmse: Sequence[float], rel_tol: float) -> int:
    best = min(rmse)
    return min(k for k, r in zip(ks, rmse, strict=True) if r <= best * (1 + rel_tol))


def cv_grid(spark, x: np.ndarray, t: np.ndarray, cutoffs: Sequence[float], ks: Sequence[int], alpha_max: float = 0.25, day_frac: float = 0.1, frac: float = 0.1, patience: int = 3, tol: float = 1e-3, max_iter: int = 100, seed: int = 0) -> DataFrame:
    """(t_c, k, rmse_points, rmse_days): one task a cutoff; ranks in order, each started from the
    last, until the error has risen ``patience`` times.  x: a coarse matrix that fits a task."""
    points, days = hold_out(x, day_frac, frac, 0.5, 0.95, seed)
    held = x.copy()
    held[points] = np.nan
    held[:, days] = np.nan
    own = np.zeros_like(points)
    own[:, days] = np.isfinite(x[:, days])
    shared = spark.sparkContext.broadcast((x, held, points, own))

    def run(key, table):
        x, held, points, own = shared.value
        t_c = key[0].as_py()
        reach = (t_c / (2 * np.pi)) ** 2
        sweeps = max(1, int(np.ceil(reach / alpha_max))) if t_c > 0 else 0
        alpha = reach / sweeps if sweeps else 0.0
        out, filled, worse, last = [], None, 0, np.inf
        for k in ks:
            r = em_fill(held, k, t, alpha, sweeps, tol, max_iter, filled)
            filled = r["filled"]
            rms = lambda m, r=r: float(np.sqrt(np.mean((r["lowrank"][m] - x[m]) ** 2))) if m.any() else None
            p, d = rms(points), rms(own)
            out.append((t_c, k, p, d))
            score = np.mean([s for s in (p, d) if s is not None])
            worse = worse + 1 if score > last else 0
            last = score
            if worse >= patience:
                break
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.float64(), pa.float64()))], names=["t_c", "k", "rmse_points", "rmse_days"])

    settings = spark.createDataFrame([(float(c),) for c in cutoffs], "t_c double").repartition(max(1, len(cutoffs)), "t_c")
    return settings.groupBy("t_c").applyInArrow(run, "t_c double, k int, rmse_points double, rmse_days double")


def reference_loadings(a: np.ndarray, b: np.ndarray, n_px: np.ndarray, t: np.ndarray, alpha: float, sweeps: int, ridge: float = 1e-3, min_px: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, status) a day from normal equations a (n, k, k), b (n, k): pooled in time by
    diffusion, with a ridge.  status 0: climatology, 1: from neighbours, 2: own data."""
    n, k = b.shape
    own = n_px >= min_px
    a, b = np.where(own[:, None, None], a, 0.0), np.where(own[:, None], b, 0.0)
    a2, b2 = diffuse(t, a.reshape(n, -1), alpha, sweeps).reshape(n, k, k), diffuse(t, b, alpha, sweeps)
    trace = np.trace(a2, axis1=1, axis2=2)
    ref = np.median(trace[trace > 0]) if (trace > 0).any() else 0.0
    lam = ridge * ref / k
    out, status = np.zeros((n, k)), np.zeros(n, np.int8)
    for j in np.flatnonzero(trace > 1e-9 * ref) if ref else []:
        out[j] = np.linalg.solve(a2[j] + lam * np.eye(k), b2[j])
        status[j] = 2 if own[j] else 1
    return out, status
