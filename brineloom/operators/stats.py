"""Robust and weighted statistics, agreement scores and seasonal normal equations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAD_SCALE = 1.4826


def mad(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by..., n, median, mad): 1.4826 times the median distance from the median."""
    by = list(by)
    med = rows.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    away = rows.join(med, by) if by else rows.crossJoin(F.broadcast(med))  # without groups: one row
    return away.groupBy(*by, "median", "n").agg((MAD_SCALE * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad"))


def robust_scale(rows: DataFrame, n_params: int, floor: float, dof: bool = True, by: str = "px", value: str = "value") -> DataFrame:
    """(by, n, scale): MAD with a degrees-of-freedom factor; where there are too few values or no
    spread, the median of the good ones (or the floor); never under the floor."""
    m = mad(rows, [by], value)
    factor = F.sqrt(F.col("n") / (F.col("n") - n_params)) if dof else F.lit(1.0)
    m = m.withColumn("raw", F.when((F.col("n") > n_params) & (F.col("mad") > 0), F.col("mad") * factor))
    typical = m.agg(F.coalesce(F.median("raw"), F.lit(floor)).alias("typical"))
    return m.crossJoin(F.broadcast(typical)).select(by, "n", F.greatest(F.coalesce("raw", "typical"), F.lit(floor)).alias("scale"))  # one row


def means_in_order(rows: DataFrame, by: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(by, name...): means of doubles that are added row by row in the given order.

    A mean that lies halfway between two roundings falls to one side or the other by the order of
    its sum; here the order is the rows' own and not that in which parts arrive.  A running sum needs
    no group in memory.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.select(by, *order, *(c.alias(name) for name, c in values.items()))
    run = [F.struct(F.sum(name).over(w).alias("s"), F.count(name).over(w).alias("n")).alias(f"__{name}") for name in values]
    x = x.select(by, F.row_number().over(w).alias("__i"), *run)
    x = x.groupBy(by).agg(F.max_by(F.struct(*(f"__{name}" for name in values)), "__i").alias("m"))
    return x.select(by, *((F.col(f"m.__{name}.s") / F.when(F.col(f"m.__{name}.n") > 0, F.col(f"m.__{name}.n"))).alias(name) for name in values))


def shorth(rows: DataFrame, by: Sequence[str], value: str = "value", least: int = 64) -> DataFrame:
    """(by..., center, width, scale): midpoint of the shortest half, and the warm side's scale.

    Groups of under ``least`` values have (0, 1).
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    x = rows.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(order).alias("i"), n.alias("n"))
    # lead() takes a fixed distance; the half is the group's own, so rows meet by rank.
    far = x.select(*by, (F.col("i") - F.floor(F.col("n") / 2)).alias("i"), F.col(value).alias("top"))
    w = x.join(far, [*by, "i"]).withColumn("width", F.col("top") - F.col(value))
    c = w.groupBy(*by).agg(F.min_by(F.struct(F.col(value).alias("low"), "top", "width"), F.struct("width", "i")).alias("h"))
    c = c.select(*by, ((F.col("h.low") + F.col("h.top")) / 2).alias("center"), F.col("h.width").alias("width"))
    r = x.join(c, by).groupBy(*by, "center", "width", "n").agg(
        F.count_if(F.col(value) > F.col("center")).alias("above"), F.median(F.when(F.col(value) > F.col("center"), F.col(value) - F.col("center"))).alias("side")
    )
    scale = F.greatest(F.when(F.col("above") >= 64, F.col("side") / 0.6745).otherwise(F.col("width") / 1.349), F.lit(1e-3))
    few = F.col("n") < least
    return r.select(*by, F.when(few, 0.0).otherwise(F.col("center")).alias("center"), "width", F.when(few, 1.0).otherwise(scale).alias("scale"))


def scores(pred: Column, obs: Column, clim: Column | None = None) -> dict[str, Column]:
    """Aggregates n, bias, mse, rmse, mae, medae, robust_sd (from med), r, skill of pred against obs."""
    e = pred - obs
    out = {
        "n": F.count(e), "bias": F.avg(e), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "medae": F.median(F.abs(e)),
        "r": F.when((F.count(e) > 2) & (F.stddev_pop(pred) > 0) & (F.stddev_pop(obs) > 0), F.corr(pred, obs)),
    }
    if clim is not None:
        ec = clim - obs
        out["skill"] = 1 - F.try_divide(F.avg(e * e), F.avg(ec * ec))
    return out


def slopes(x: Column, y: Column) -> dict[str, Column]:
    """Least-squares and reduced-major-axis slopes and the correlation, as aggregates."""
    r = F.corr(x, y)
    return {"ols": F.regr_slope(y, x), "rma": F.signum(r) * F.stddev_pop(y) / F.stddev_pop(x), "r": r}


def theil_sen(rows: DataFrame, by: Sequence[str], x: str, y: str, most: int = 3000, key: str = "px") -> DataFrame:
    """(by..., slope): median of all pairs' slopes, over at most ``most`` points a group.

    The points are those of the smallest hashes of their key: the sample is bounded, so is the
    number of pairs.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(F.xxhash64(key), key)
    p = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"), F.row_number().over(w).alias("i")).where(F.col("i") <= most)
    q = p.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("i").alias("i2"))
    return p.join(q, by).where("i < i2 and x <> x2").groupBy(*by).agg(F.median((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("slope"))


def auc(rows: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """(by..., auc) by rank sums with average ranks of ties.

    Ranks come from counts of distinct scores, so one window row stands for all ties.
    """
    by = list(by)
    t = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("rank", below + (F.col("n") + 1) / 2)
    a = t.groupBy(*by).agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    return a.select(*by, F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn")).alias("auc"))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two boolean verdicts, as an aggregate; 1 where chance agreement is whole."""
    pa, pb = F.avg(a.cast("double")), F.avg(b.cast("double"))
    agree, chance = F.avg((a == b).cast("double")), pa * pb + (1 - pa) * (1 - pb)
    return F.when(chance >= 1, 1.0).otherwise((agree - chance) / (1 - chance))


def variance_components(scenes: DataFrame, by: Sequence[str], delta: str = "delta", sd: str = "sd", n: str = "n") -> DataFrame:
    """scenes with w = 1 / (tau2 + sd^2 / n); tau2 = max(var(delta) - mean(sd^2 / n), 0)."""
    w = Window.partitionBy(*by)
    v = F.col(sd) * F.col(sd) / F.col(n)
    tau2 = F.greatest(F.var_samp(delta).over(w) - F.avg(v).over(w), F.lit(0.0))
    return scenes.withColumn("tau2", tau2).withColumn("w", 1 / (F.col("tau2") + v))


def loo_rmse_constant(y: Column, w: Column, over) -> Column:
    """Residual of a weighted mean when the row itself is left out: r / (1 - h)."""
    sw = F.sum(w).over(over)
    r = y - F.sum(w * y).over(over) / sw
    return r / F.greatest(1 - w / sw, F.lit(1e-8))


def normal_equations(rows: DataFrame, by: Sequence[str], design: dict[str, Column], value: Column) -> DataFrame:
    """(by..., n, a_i_j for i <= j, b_i): sums of products, combined before the shuffle."""
    names = list(design)
    x = rows.select(*by, value.alias("__y"), *(c.alias(f"__{k}") for k, c in design.items())).where(F.col("__y").isNotNull())
    sums = [F.sum(F.col(f"__{p}") * F.col(f"__{q}")).alias(f"a_{p}_{q}") for i, p in enumerate(names) for q in names[i:]]
    return x.groupBy(*by).agg(F.count("__y").alias("n"), *sums, *(F.sum(F.col(f"__{p}") * F.col("__y")).alias(f"b_{p}") for p in names))


def solve3(eq: DataFrame, by: Sequence[str], names: Sequence[str], min_n: int) -> DataFrame:
    """Coefficients of three terms by Cramer's rule where n >= min_n and the system is regular."""
    p, q, r = names
    g = lambda i, j: F.col(f"a_{i}_{j}")
    a, b, c, d, e, f = g(p, p), g(p, q), g(p, r), g(q, q), g(q, r), g(r, r)
    u, v, w = (F.col(f"b_{k}") for k in names)
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    ok = (F.col("n") >= min_n) & (F.abs(det) > 1e-9)
    x0 = (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det
    x1 = (a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det
    x2 = (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det
    return eq.select(*by, "n", *(F.when(ok, x).alias(k) for k, x in zip(names, (x0, x1, x2), strict=True)), ok.alias("full"))


def histogram(c: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin from 0; what lies outside counts in the end bins."""
    return F.least(F.greatest(F.floor((c - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("long")
