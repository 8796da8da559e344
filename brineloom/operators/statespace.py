"""Linear Gaussian state space models of station series: likelihood, smoothing, fitting, by site."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("random_walk", "ar1", "ar1_harmonic", "harmonic_trend")
DIFFUSE = 1e6


@dataclass
class System:
    """y_t = h_t x_t + bias + e, x_t = phi x_{t-1} + c + w; h: (T, p, m), one row an observed series."""

    f: np.ndarray
    c: np.ndarray
    q: np.ndarray
    h: np.ndarray
    a0: np.ndarray
    p0: np.ndarray


def harmonic_rows(doy: np.ndarray, n: int, period: float) -> np.ndarray:
    w = 2 * np.pi * np.outer(doy, np.arange(1, n + 1)) / period
    return np.stack([np.cos(w), np.sin(w)], axis=2).reshape(len(doy), 2 * n)


def build(model: str, theta: dict, doy: np.ndarray, p: int, n_harmonics: int = 1, period: float = 365.25) -> System:
    """The system of a model with p observed series of one state."""
    t = len(doy)
    one = np.ones((t, p, 1))
    if model == "random_walk":
        return System(np.eye(1), np.zeros(1), np.array([[theta["var_state"]]]), one, np.zeros(1), np.eye(1) * DIFFUSE)
    phi, v, mu = theta.get("phi", 0.0), theta["var_state"], theta.get("mu", 0.0)
    if model in ("ar1", "ar1_harmonic"):
        f, c, q = np.array([[phi]]), np.array([(1 - phi) * mu]), np.array([[v]])
        a0, p0 = np.array([mu]), np.array([[v / max(1 - phi * phi, 1e-9)]])
        if model == "ar1":
            return System(f, c, q, one, a0, p0)
        k = 2 * n_harmonics
        h = np.concatenate([one, np.repeat(harmonic_rows(doy, n_harmonics, period)[:, None, :], p, axis=1)], axis=2)
        z = np.zeros
        return System(_diag(f, np.eye(k)), np.append(c, z(k)), _diag(q, z((k, k))), h, np.append(a0, z(k)), _diag(p0, np.eye(k) * DIFFUSE))
    if model == "harmonic_trend":
        k = 2 * n_harmonics
        f = _diag(np.array([[1.0, 1.0], [0.0, 1.0]]), np.eye(k))
        q = _diag(np.diag([v, theta.get("var_slope", 0.0)]), np.zeros((k, k)))
        h = np.concatenate([one, np.zeros((t, p, 1)), np.repeat(harmonic_rows(doy, n_harmonics, period)[:, None, :], p, axis=1)], axis=2)
        return System(f, np.zeros(2 + k), q, h, np.zeros(2 + k), np.eye(2 + k) * DIFFUSE)
    raise ValueError(f"model {model!r} is none of {MODELS}")


def _diag(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a) + len(b),) * 2)
    out[: len(a), : len(a)], out[len(a) :, len(a) :] = a, b
    return out


def kalman(s: System, y: np.ndarray, r: np.ndarray):
    """(log likelihood, filtered, predicted): y and r (variances): (T, p); NaN in y is a gap.

    Series are independent given the state, so they are taken one by one.
    """
    a, p, ll = s.a0, s.p0, 0.0
    at, pt, ap, pp = [], [], [], []
    for t in range(len(y)):
        if t:
            a, p = s.f @ a + s.c, s.f @ p @ s.f.T + s.q
        ap.append(a), pp.append(p)
        for i in np.flatnonzero(np.isfinite(y[t])):
            h = s.h[t, i]
            ph = p @ h
            v, var = y[t, i] - h @ a, max(h @ ph + r[t, i], 1e-12)
            gain = ph / var
            a, p = a + gain * v, p - np.outer(gain, ph)
            if var < DIFFUSE / 10:
                ll -= 0.5 * (np.log(2 * np.pi * var) + v * v / var)
        at.append(a), pt.append((p + p.T) / 2)
    return ll, (np.array(at), np.array(pt)), (np.array(ap), np.array(pp))


def smooth(s: System, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed signal h x and its deviation, of the first series' loading."""
    _, (a, p), (ap, pp) = kalman(s, y, r)
    a, p = a.copy(), p.copy()
    for t in range(len(y) - 2, -1, -1):
        j = p[t] @ s.f.T @ np.linalg.pinv(pp[t + 1])
        a[t] += j @ (a[t + 1] - ap[t + 1])
        p[t] += j @ (p[t + 1] - pp[t + 1]) @ j.T
    h = s.h[:, 0]
    return np.einsum("tm,tm->t", h, a), np.sqrt(np.maximum(np.einsum("tm,tmn,tn->t", h, p, h), 0))


def minimize(fn, gradient, x0: np.ndarray, max_iter: int = 200, tol: float = 1e-5) -> np.ndarray:
    """Quasi-Newton descent with backtracking; steps are at most 2 long, as variances are logarithms."""
    x, f, h = np.array(x0, float), fn(x0), np.eye(len(x0))
    g = gradient(x)
    for _ in range(max_iter):
        if np.abs(g).max(initial=0) < tol * (1 + abs(f)):
            break
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        d *= min(1.0, 2.0 / max(np.linalg.norm(d), 1e-12))
        step = 1.0
        while step > 1e-8:
            new = fn(x + step * d)
            if np.isfinite(new) and new <= f + 1e-4 * step * (d @ g):
                break
            step /= 2
        else:
            break
        after = gradient(x + step * d)
        s, y = step * d, after - g
        done = f - new < 1e-10 * (1 + abs(f))
        x, f, g = x + s, new, after
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            left = np.eye(len(x)) - rho * np.outer(s, y)
            h = left @ h @ left.T + rho * np.outer(s, s)
        if done:
            break
    return x


@dataclass
class Series:
    """A site's values: y (T, p) with NaN gaps, kinds (T, p) the type of each, day of year."""

    y: np.ndarray
    kinds: np.ndarray
    doy: np.ndarray


def fit_group(model: str, sites: Sequence[Series], n_kinds: int, n_harmonics: int = 1, period: float = 365.25, share: Sequence[str] = (), biased: Sequence[int] = (), bias_harmonics: int = 0) -> list[dict]:
    """Maximum likelihood of a group of sites together: for each theta, var_obs, bias, smooth, sd, log_likelihood.

    Parameters var_state, phi, mu, var_obs (a variance a type) and bias are each site's own unless
    ``share`` names them; sites that share none are fitted one by one, which is the same.  biased:
    types that have a bias against the others, constant or with harmonics of the year.
    """
    ar = model in ("ar1", "ar1_harmonic")
    if unknown := set(share) - {"var_state", "phi", "mu", "var_obs", "bias"}:
        raise ValueError(f"no parameters {sorted(unknown)} to share")
    if not share and len(sites) > 1:
        return [fit_group(model, [s], n_kinds, n_harmonics, period, (), biased, bias_harmonics)[0] for s in sites]
    n_bias = 1 + 2 * bias_harmonics if biased else 0
    blocks = [("var_state", 1), *([("phi", 1), ("mu", 1)] if ar else []), ("var_obs", n_kinds), *([("bias", n_bias)] if n_bias else [])]
    seen = np.concatenate([s.y[np.isfinite(s.y)] for s in sites]) if sites else np.zeros(0)
    level, spread = (float(seen.mean()), max(float(seen.var()), 1e-4)) if len(seen) else (0.0, 1.0)
    begin = {"var_state": np.log(0.3 * spread), "phi": np.arctanh(0.5 / 0.999), "mu": level, "var_obs": np.log(0.3 * spread), "bias": 0.0}
    at, start = [{} for _ in sites], []
    for name, size in blocks:
        for i in range(len(sites)):
            if name not in share or not i:
                own = slice(len(start), len(start) + size)
                start += [float(begin[name])] * size
            at[i][name] = own
    users = np.zeros((len(sites), len(start)), bool)
    for i, names in enumerate(at):
        for own in names.values():
            users[i, own] = True
    is_biased = np.isin(np.arange(n_kinds), list(biased))
    year = [np.column_stack([np.ones(len(s.doy)), harmonic_rows(s.doy, bias_harmonics, period)]) if n_bias else None for s in sites]

    def unpack(x, i):
        get = lambda name: x[at[i][name]]
        theta = {"var_state": float(np.exp(np.clip(get("var_state")[0], -25, 25)))}
        if ar:
            theta |= {"phi": 0.999 * float(np.tanh(get("phi")[0])), "mu": float(get("mu")[0])}
        return theta, np.exp(np.clip(get("var_obs"), -25, 25)), get("bias") if n_bias else np.zeros(0)

    def system(x, i):
        theta, var, bias = unpack(x, i)
        s = sites[i]
        y = s.y - np.where(is_biased[s.kinds], (year[i] @ bias)[:, None], 0.0) if n_bias else s.y
        return build(model, theta, s.doy, s.y.shape[1], n_harmonics, period), y, var[s.kinds]

    def cost(x, which=None):
        return -sum(kalman(*system(x, i))[0] for i in (range(len(sites)) if which is None else which))

    def gradient(x):
        out = np.zeros(len(x))
        for j in range(len(x)):
            which = np.flatnonzero(users[:, j])  # a site's own parameter moves its likelihood alone
            e = np.zeros(len(x))
            e[j] = 1e-4 * max(1.0, abs(x[j]))
            out[j] = (cost(x + e, which) - cost(x - e, which)) / (2 * e[j])
        return out

    best = minimize(cost, gradient, np.array(start))
    out = []
    for i in range(len(sites)):
        theta, var, bias = unpack(best, i)
        level, sd = smooth(*system(best, i))
        out.append({"theta": theta, "var_obs": var, "bias": year[i] @ bias if n_bias else np.zeros(len(sites[i].doy)), "log_likelihood": -cost(best, [i]), "smooth": level, "sd": sd})
    return out


def fit(model: str, y: np.ndarray, kinds: np.ndarray, doy: np.ndarray, n_kinds: int, n_harmonics: int = 1, period: float = 365.25) -> dict:
    """One site alone, as ``fit_group``.  kinds: (T, p) index of each value's observation type, which sets its variance."""
    return fit_group(model, [Series(y, kinds, doy)], n_kinds, n_harmonics, period)[0]


def first_type(y: np.ndarray) -> np.ndarray:
    """Of each day only the first present value, in the order of types."""
    out = np.full(y.shape, np.nan)
    some = np.flatnonzero(np.isfinite(y).any(1))
    j = np.isfinite(y[some]).argmax(1)
    out[some, j] = y[some, j]
    return out


def smooth_groups(series: DataFrame, model: str, types: Sequence[str], n_harmonics: int = 1, period: float = 365.25, mode: str = "all", share: Sequence[str] = (), biased: Sequence[str] = (), bias_harmonics: int = 0) -> DataFrame:
    """(grp, site, day, smooth, low, high, bias, log_likelihood) from series (grp, site, day, type, value).

    One group's sites are fitted in one task; days without any value are filled.  mode: ``all``
    values of a day, or ``hierarchy``: its first by the order of types.  The band is 1.96
    deviations.  A site without values has no rows.
    """
    if mode not in ("all", "hierarchy"):
        raise ValueError("mode is all or hierarchy")
    index = {k: i for i, k in enumerate(types)}

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(day=pd.to_datetime(pdf["day"]))
        days = pd.date_range(pdf["day"].min(), pdf["day"].max())
        names, sites = sorted(pdf["site"].unique()), []
        for name in names:
            wide = pdf[pdf["site"] == name].pivot_table(index="day", columns="type", values="value", aggfunc="mean", dropna=False).reindex(index=days, columns=list(types))
            y = wide.to_numpy(float)
            sites.append(Series(first_type(y) if mode == "hierarchy" else y, np.tile(np.arange(len(types)), (len(days), 1)), days.dayofyear.to_numpy(float) - 1))
        got = fit_group(model, sites, len(types), n_harmonics, period, share, [index[b] for b in biased], bias_harmonics)
        return pd.concat([pd.DataFrame({"grp": key[0], "site": n, "day": days.date, "smooth": r["smooth"], "low": r["smooth"] - 1.96 * r["sd"], "high": r["smooth"] + 1.96 * r["sd"], "bias": r["bias"], "log_likelihood": r["log_likelihood"]}) for n, r in zip(names, got, strict=True)])

    x = series.where(F.col("type").isin(*index) & F.col("value").isNotNull()).select(F.col("grp").cast("string").alias("grp"), F.col("site").cast("string").alias("site"), "day", "type", "value")
    return x.groupBy("grp").applyInPandas(run, "grp string, site string, day date, smooth double, low double, high double, bias double, log_likelihood double")


def smooth_sites(series: DataFrame, model: str, types: Sequence[str], n_harmonics: int = 1, period: float = 365.25) -> DataFrame:
    """(site, day, smooth, low, high, log_likelihood) from series (site, day, type, value): each site by itself."""
    alone = smooth_groups(series.withColumn("grp", F.col("site").cast("string")), model, types, n_harmonics, period)
    return alone.select("site", "day", "smooth", "low", "high", "log_likelihood")
