"""Scene classification: quartile fences as a plan, and a mixture with a neighbourhood prior as a
grouped map, one scene a group (a scene is one grid)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tukey(pixels: DataFrame, by: Sequence[str], residual: str, k_low: float = 3.0, k_high: float = 3.0, min_pixels: int = 64) -> DataFrame:
    """pixels with cold, warm, p_valid and the scene's sd; a scene of few pixels keeps all."""
    q = pixels.where(F.col(residual).isNotNull()).groupBy(*by).agg(F.percentile(residual, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(residual).alias("__n"))
    iqr = F.col("q")[1] - F.col("q")[0]
    x = pixels.join(q, list(by)).withColumn("__i", iqr)
    few = F.col("__n") < min_pixels
    cold = ~few & (F.col(residual) < F.col("q")[0] - k_low * F.col("__i"))
    warm = ~few & (F.col(residual) > F.col("q")[1] + k_high * F.col("__i"))
    x = x.withColumn("cold", F.coalesce(cold, F.lit(False))).withColumn("warm", F.coalesce(warm, F.lit(False)))
    return x.withColumn("p_valid", F.when(F.col("cold") | F.col("warm"), 0.0).otherwise(1.0)).withColumn("sd", F.col("__i") / 1.349).drop("q", "__n", "__i")


_erfc = np.vectorize(math.erfc, otypes=[float])


def log_ndtr(x: np.ndarray) -> np.ndarray:
    """Log of the standard normal's distribution function, also far in the lower tail."""
    x = np.asarray(x, float)
    out = np.empty_like(x)
    low = x < -20
    with np.errstate(divide="ignore"):
        out[~low] = np.log(0.5 * _erfc(-x[~low] / math.sqrt(2)))
    z = x[low]
    out[low] = -z * z / 2 - np.log(-z) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / z**2 + 3 / z**4 - 15 / z**6)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(x, float) / 2))


def shorth(x: np.ndarray) -> tuple[float, float]:
    """(midpoint, width) of the shortest half."""
    s = np.sort(x)
    h = len(s) // 2
    w = s[h:] - s[: len(s) - h]
    i = int(w.argmin())
    return float(s[i] + s[i + h]) / 2, float(w[i])


def center_and_scale(r: np.ndarray, least: int = 64) -> tuple[float, float]:
    """Too few values tell nothing: (0, 1)."""
    if len(r) < least:
        return 0.0, 1.0
    c, w = shorth(r)
    side = r[r > c] - c
    return c, max(float(np.median(side)) / 0.6745 if len(side) >= least else w / 1.349, 1e-3)


def tail_log_odds(w: np.ndarray, sigma: float, rate: float, prior: np.ndarray, noise: bool = True) -> np.ndarray:
    """Log odds that a deviation w comes from an exponential tail (with Gaussian noise on it)
    rather than from a clear Gaussian."""
    clear = -w * w / (2 * sigma**2) - math.log(sigma) - 0.5 * math.log(2 * math.pi)
    if noise:
        tail = math.log(rate) + (rate * sigma) ** 2 / 2 - rate * w + log_ndtr((w - rate * sigma**2) / sigma)
    else:
        tail = np.where(w > 0, math.log(rate) - rate * w, -np.inf)
    return tail - clear + np.log(prior / (1 - prior))


def ising(u: np.ndarray, valid: np.ndarray, beta: float = 1.5, sweeps: int = 8, damp: float = 0.5) -> np.ndarray:
    """Mean-field probabilities on a grid: a fixed number of damped sweeps."""
    u = np.clip(np.nan_to_num(u, nan=0.0, posinf=50, neginf=-50), -50, 50)
    v = valid.astype(float)

    def around(a):
        out = np.zeros_like(a)
        out[1:] += a[:-1]
        out[:-1] += a[1:]
        out[:, 1:] += a[:, :-1]
        out[:, :-1] += a[:, 1:]
        return out

    n = around(v)
    q = sigmoid(u) * v
    for _ in range(sweeps):
        near = np.where(n > 0, around(q) / np.maximum(n, 1), 0.5)
        q = ((1 - damp) * q + damp * sigmoid(u + beta * (2 * near - 1))) * v
    return q


def ising_scenes(cells: DataFrame, by: Sequence[str], u: str, beta: float = 1.5, sweeps: int = 8, damp: float = 0.5) -> DataFrame:
    """(by..., row, col, q) of every cell (by..., row, col, u): each scene's grid is a group."""
    by = list(by)
    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by) + ", row int, col int, q double"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["row"].to_numpy(int), pdf["col"].to_numpy(int)
        grid, valid = np.zeros((i.max() + 1, j.max() + 1)), np.zeros((i.max() + 1, j.max() + 1), bool)
        grid[i, j], valid[i, j] = pdf["u"], True
        q = ising(grid, valid, beta, sweeps, damp)
        return pd.DataFrame({**dict(zip(by, key, strict=True)), "row": i, "col": j, "q": q[i, j]})

    return cells.select(*by, "row", "col", F.col(u).cast("double").alias("u")).groupBy(*by).applyInPandas(run, schema)


@dataclass(frozen=True)
class Mixture:
    prior_cloud: float = 0.1  # of an unflagged value; config.DEFAULTS sets what stages use
    prior_flagged: float = 0.7
    prior_warm: float = 0.02
    cold_rate: float = 0.25
    warm_rate: float = 0.5
    min_dev_cold: float = 0.0
    min_dev_warm: float = 0.0
    beta: float = 1.75
    beta_warm: float = 0.5
    sweeps: int = 20
    damp: float = 0.5
    floor: float = 0.01
    sd: float | None = None


def classify(y: np.ndarray, water: np.ndarray, base: np.ndarray, flagged: np.ndarray, cfg: Mixture) -> dict:
    """One scene: residual from the baseline and its centre, cloud (cold) and warm fields, p_valid.

    A gap has only its prior; the two fields never add to more than one.
    """
    seen = water & np.isfinite(y)
    r = y - base
    center, scale = center_and_scale(r[seen & np.isfinite(r)])
    scale = cfg.sd or scale
    d = r - center
    q, qh = _fields(d, seen, water, _priors(seen, water, flagged, cfg), scale, cfg)
    return {"residual": np.where(seen, d, np.nan), "q_cloud": q, "q_warm": qh, "p_valid": np.clip(1 - q - qh, cfg.floor, 1), "center": center, "sd": scale}


def _priors(seen: np.ndarray, water: np.ndarray, flagged: np.ndarray, cfg: Mixture) -> np.ndarray:
    return np.clip(np.where(flagged | (water & ~seen), cfg.prior_flagged, cfg.prior_cloud), 1e-6, 1 - 1e-6)


def _fields(d: np.ndarray, seen: np.ndarray, water: np.ndarray, prior: np.ndarray, scale: float, cfg: Mixture, noise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(cloud, warm) probabilities from centred residuals; a gap has only its prior; at most one together."""
    d0 = np.where(seen & np.isfinite(d), d, 0.0)
    cold = np.where(seen, tail_log_odds(-cfg.min_dev_cold - d0, scale, cfg.cold_rate, prior, noise), np.log(prior / (1 - prior)))
    warm = np.where(seen, tail_log_odds(d0 - cfg.min_dev_warm, scale, cfg.warm_rate, np.full(d.shape, cfg.prior_warm), noise), np.log(cfg.prior_warm / (1 - cfg.prior_warm)))
    q, qh = ising(cold, water, cfg.beta, cfg.sweeps, cfg.damp), ising(warm, water, cfg.beta_warm, cfg.sweeps, cfg.damp)
    total = np.maximum(q + qh, 1.0)
    return q / total, qh / total


@dataclass(frozen=True)
class Analysis:
    """The alternating detector's field and when it ends."""

    range_px: float = 20.0
    field_sd: float = 1.0
    obs_error: float = 0.04
    alpha: int = 2
    damp: float = 0.5
    max_iter: int = 30
    min_iter: int = 3
    patience: int = 2
    cloud_tol: float = 1e-3
    valid_tol: float = 1e-3


def alternate(y: np.ndarray, water: np.ndarray, prior: np.ndarray, flagged: np.ndarray, cfg: Mixture, ana: Analysis = Analysis()) -> dict:  # noqa: B008
    """One scene: labels from residuals and a field from what the labels leave, in turn.

    The field starts as ``prior`` and stays anchored on it; an observation's error grows as its
    p_valid falls.  The scale never sinks under the observations' error, or the field would flag
    what it has not fitted yet.  Rounds end when the share of cloud and the mean change of p_valid
    over observed cells are small for ``patience`` rounds.
    """
    from brineloom.operators import gmrf

    seen = water & np.isfinite(y)
    if not seen.any():
        raise ValueError("no observed water cell")
    offset = center_and_scale((y - prior)[seen & np.isfinite(prior)])[0]
    field, p = np.where(water, prior, np.nan), np.ones(y.shape)
    priors = _priors(seen, water, flagged, cfg)
    share, quiet, history = None, 0, []
    q = qh = np.zeros(y.shape)
    center, scale = offset, 1.0
    for n in range(ana.max_iter):
        r = y - field
        trusted = seen & np.isfinite(r) & (p >= 0.5)
        center, scale = center_and_scale(r[trusted if n and trusted.sum() >= 64 else seen & np.isfinite(r)])
        scale = cfg.sd or max(scale, math.sqrt(ana.obs_error))
        q, qh = _fields(r - center, seen, water, priors, scale, cfg)
        new = np.clip(1 - q - qh, cfg.floor, 1)
        was, p = p, new if n == 0 else (1 - ana.damp) * p + ana.damp * new
        field = gmrf.solve(np.where(seen, y - offset, np.nan), water, prior, ana.range_px, ana.field_sd, ana.obs_error / p, ana.alpha)
        now = float(q[seen].mean())
        moved = float(np.abs(p - was)[seen].mean())
        history.append({"cloud": now, "moved": moved, "center": center, "sd": scale})
        quiet = quiet + 1 if share is not None and abs(now - share) < ana.cloud_tol and moved < ana.valid_tol else 0
        share = now
        if n + 1 >= ana.min_iter and quiet >= ana.patience:
            break
    residual = np.where(seen, y - offset - field, np.nan)
    return {"analysis": field, "combined": field + p * np.nan_to_num(residual), "p_valid": p, "q_cloud": q, "q_warm": qh, "residual": residual, "center": offset, "sd": scale, "converged": quiet >= ana.patience, "history": history}


def mixture_em(y: np.ndarray, water: np.ndarray, base: np.ndarray, flagged: np.ndarray, cfg: Mixture, steps: int = 20, damp: float = 0.75) -> dict:
    """One scene: the mixture's centre, scale and tails re-estimated from its own labels.

    Each of ``steps`` rounds labels with the parameters so far and moves them to the labels' weighted
    moments, keeping ``damp`` of the old.  Tails are exponential: their rate is one over the mean
    deviation, which is at least 1.
    """
    seen = water & np.isfinite(y) & np.isfinite(base)
    if not seen.any():
        raise ValueError("no observed water cell")
    first = classify(y, water, base, flagged, cfg)
    r = np.where(seen, y - base, 0.0)
    priors = _priors(seen, water, flagged, cfg)
    least = cfg.sd or 1e-3

    def moments(q, qh, center):
        w = np.where(seen, np.maximum(1 - q - qh, 0), 0.0)
        c = float((w * r).sum() / max(w.sum(), 1e-9))
        var = (w * (r - c) ** 2).sum() / max(w.sum() - (w * w).sum() / max(w.sum(), 1e-9), 1e-9)
        mean = lambda q, d: max(1.0, float((q * d)[seen].sum() / max(q[seen].sum(), 1e-9)))
        return np.array([c, math.sqrt(max(var, 1e-12)), mean(q, center - cfg.min_dev_cold - r), mean(qh, r - center - cfg.min_dev_warm)])

    at = moments(first["q_cloud"], first["q_warm"], first["center"])
    q, qh, history = first["q_cloud"], first["q_warm"], []
    for _ in range(steps):
        now = replace(cfg, cold_rate=1 / at[2], warm_rate=1 / at[3])
        q, qh = _fields(r - at[0], seen, water, priors, max(at[1], least), now)
        at = damp * at + (1 - damp) * moments(q, qh, at[0])
        history.append({"cloud": float(q[seen].mean()), "warm": float(qh[seen].mean()), "center": float(at[0]), "sd": float(at[1])})
    return {"residual": np.where(seen, r - at[0], np.nan), "q_cloud": q, "q_warm": qh, "p_valid": np.clip(1 - q - qh, cfg.floor, 1), "center": float(at[0]), "sd": float(max(at[1], least)), "cold_rate": 1 / at[2], "warm_rate": 1 / at[3], "history": history}


METHODS = {"mixture": classify, "alternate": alternate, "em": mixture_em}


def classify_scenes(pixels: DataFrame, rows: int, cols: int, cfg: Mixture = Mixture(), method: str = "mixture") -> DataFrame:  # noqa: B008
    """(sensor, day, row, col, p_valid, q_cloud, center) of every water cell of every scene from
    pixels (sensor, day, row, col, value, base, flagged); a scene without values is all prior."""
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {sorted(METHODS)}")
    schema = "sensor string, day date, row int, col int, p_valid double, q_cloud double, center double"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["row"].to_numpy(int), pdf["col"].to_numpy(int)
        y, base = np.full((rows, cols), np.nan), np.full((rows, cols), np.nan)
        water, flagged = np.zeros((rows, cols), bool), np.zeros((rows, cols), bool)
        y[i, j], base[i, j], water[i, j], flagged[i, j] = pdf["value"], pdf["base"], True, pdf["flagged"].fillna(False)
        r = (METHODS[method] if np.isfinite(y).any() else classify)(y, water, base, flagged, cfg)
        return pd.DataFrame({"sensor": key[0], "day": key[1], "row": i, "col": j, "p_valid": r["p_valid"][i, j], "q_cloud": r["q_cloud"][i, j], "center": r["center"]})

    cells = pixels.select("sensor", "day", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value", "base", "flagged")
    return cells.groupBy("sensor", "day").applyInPandas(run, schema)
