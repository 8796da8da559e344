"""Matern fields on a grid: a sparse precision from the SPDE, solved by conjugate gradients."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def dct2_eigenvalues(shape: tuple[int, int]) -> np.ndarray:
    """Of the Neumann Laplacian on a grid."""
    a, b = (2 - 2 * np.cos(np.pi * np.arange(n) / n) for n in shape)
    return a[:, None] + b[None, :]


def _dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def spde_params(shape: tuple[int, int], range_px: float, sd: float, alpha: int = 2) -> tuple[float, float]:
    """(kappa2, lam) of a field with that range and marginal deviation."""
    kappa2 = 8 * (alpha - 1) / range_px**2 if alpha > 1 else 1 / range_px**2
    lam = (np.mean((kappa2 + dct2_eigenvalues(shape)) ** -alpha) / sd**2) ** (1 / alpha)
    return float(kappa2), float(lam)


def laplacian(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sum of differences to present neighbours (positive semi-definite)."""
    out = np.zeros_like(x)
    for axis in (0, 1):
        lo = [slice(None)] * 2
        hi = [slice(None)] * 2
        lo[axis], hi[axis] = slice(None, -1), slice(1, None)
        d = np.where(mask[tuple(lo)] & mask[tuple(hi)], x[tuple(lo)] - x[tuple(hi)], 0.0)
        out[tuple(lo)] += d
        out[tuple(hi)] -= d
    return out


def pcg(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, precondition=None, tol: float = 1e-8, max_iter: int = 2000, x0=None) -> tuple[np.ndarray, int]:
    """Conjugate gradients until |r| / |b| < tol."""
    m = precondition or (lambda r: r)
    x = np.zeros_like(b) if x0 is None else x0.copy()
    r = b - apply(x)
    z = m(r)
    p, rz, size = z.copy(), float((r * z).sum()), float(np.linalg.norm(b)) or 1.0
    for n in range(max_iter):
        if np.linalg.norm(r) / size < tol:
            return x, n
        q = apply(p)
        step = rz / float((p * q).sum())
        x += step * p
        r -= step * q
        z = m(r)
        new = float((r * z).sum())
        p = z + new / rz * p
        rz = new
    return x, max_iter


def solve(obs: np.ndarray, mask: np.ndarray, prior: np.ndarray, range_px: float, sd: float, obs_var, alpha: int = 2, tol: float = 1e-6, max_iter: int = 2000) -> np.ndarray:
    """Posterior mean over the mask, anchored on the prior; without data it is the prior."""
    seen = mask & np.isfinite(obs)
    if not seen.any():
        return np.where(mask, prior, np.nan)
    kappa2, lam = spde_params(mask.shape, range_px, sd, alpha)
    w = np.where(seen, 1.0 / np.broadcast_to(obs_var, mask.shape), 0.0)

    def smooth(x):
        for _ in range(alpha):
            x = np.where(mask, lam * (kappa2 * x + laplacian(x, mask)), 0.0)
        return x

    ev = (lam * (kappa2 + dct2_eigenvalues(mask.shape))) ** alpha + w[mask].mean()
    cy, cx = _dct_matrix(mask.shape[0]), _dct_matrix(mask.shape[1])

    def precondition(r):
        return np.where(mask, cy.T @ ((cy @ r @ cx.T) / ev) @ cx, 0.0)

    b = np.where(seen, w * (np.where(seen, obs, 0.0) - prior), 0.0)
    x, _ = pcg(lambda v: w * v + smooth(v), b, precondition, tol, max_iter)
    return np.where(mask, prior + x, np.nan)


def smooth_scenes(cells: DataFrame, rows: int, cols: int, range_px: float, sd: float, obs_var: float, alpha: int = 2) -> DataFrame:
    """(layer, row, col, smooth) from cells (layer, row, col, value, prior): one grid a group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["row"].to_numpy(int), pdf["col"].to_numpy(int)
        mask, obs, prior = np.zeros((rows, cols), bool), np.full((rows, cols), np.nan), np.zeros((rows, cols))
        mask[i, j], obs[i, j], prior[i, j] = True, pdf["value"], pdf["prior"]
        out = solve(obs, mask, prior, range_px, sd, obs_var, alpha)
        return pd.DataFrame({"layer": key[0], "row": i, "col": j, "smooth": out[i, j]})

    return cells.select("layer", "row", "col", "value", "prior").groupBy("layer").applyInPandas(run, "layer string, row long, col long, smooth double")
