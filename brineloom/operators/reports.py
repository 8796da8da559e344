"""Tables about verdicts, scenes, days and runs, on any frames: agreement, flips, coverage, picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brineloom.operators.stats import kappa


def agreement(rows: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """(by..., n, agree, kappa, only_a, only_b) of two boolean verdicts."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("agree"), kappa(a, b).alias("kappa"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


def flip_fraction(rows: DataFrame, by: Sequence[str], was: Column, now: Column) -> DataFrame:
    """(by..., flips): the share of rows whose verdict changed."""
    return rows.groupBy(*by).agg((F.count_if(was != now) / F.count("*").cast("double")).alias("flips"))


def flag_changes(rows: DataFrame, by: Sequence[str], bits: str, rounds: int) -> DataFrame:
    """(by..., i, flagged, restored) of each round from 1, from a history with bit i the verdict after round i."""
    x = rows.select(*by, F.col(bits).alias("__b"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long"))).alias("i"))
    now, was = F.expr("shiftright(__b, int(i)) & 1 = 1"), F.expr("shiftright(__b, int(i) - 1) & 1 = 1")
    return x.groupBy(*by, "i").agg(F.count_if(was & ~now).alias("flagged"), F.count_if(~was & now).alias("restored"))


def verdict_flips(rows: DataFrame, by: Sequence[str], bits: str, rounds: int) -> DataFrame:
    """(by..., flips): how often verdicts turned over that many rounds."""
    mask = (1 << rounds) - 1
    return rows.select(*by, F.col(bits).alias("__b")).groupBy(*by).agg(F.sum(F.expr(f"bit_count((__b ^ shiftright(__b, 1)) & {mask})")).alias("flips"))


def removal_shares(rows: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """(by..., a, b, diff): the share that each of two filters removes, and the difference."""
    x, y = F.avg(a.cast("double")), F.avg(b.cast("double"))
    return rows.groupBy(*by).agg(x.alias("a"), y.alias("b"), (x - y).alias("diff"))


def verdict_crosstab(rows: DataFrame, by: Sequence[str], first: Column, kept: Column) -> DataFrame:
    """(by..., first, kept, removed): counts of the second verdict under each value of the first."""
    x = rows.select(*by, first.alias("first"), F.when(kept, "kept").otherwise("removed").alias("__s"))
    return x.groupBy(*by, "first").pivot("__s", ["kept", "removed"]).count().na.fill(0)


def busiest(rows: DataFrame, by: str, scene: str, most: int, aggregates: Sequence[Column] = ()) -> DataFrame:
    """(by, scene, n, aggregates...) of the scenes with most rows of each ``by``; ties: the earlier."""
    x = rows.groupBy(by, scene).agg(F.count("*").alias("n"), *aggregates)
    return x.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), scene))).where(F.col("__r") <= most).drop("__r")


def busiest_outliers(rows: DataFrame, by: str, scene: str, value: str, kept: Column, most: int) -> DataFrame:
    """The busiest scenes with the medians of what was kept and of what was removed."""
    v = F.col(value)
    return busiest(rows, by, scene, most, [F.median(F.when(kept, v)).alias("kept"), F.median(F.when(~kept, v)).alias("removed")])


def round_robin(rows: DataFrame, by: str, scene: str, total: int) -> DataFrame:
    """(by, scene, n): so many busiest scenes in all, dealt evenly over ``by``."""
    x = rows.groupBy(by, scene).agg(F.count("*").alias("n"))
    x = x.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), scene)))
    return x.orderBy("__r", by).limit(total).drop("__r")


def sheet_order(scenes: DataFrame, by: str, scene: str, score: str) -> DataFrame:
    """scenes (one row each, a report's few) with their place from 1, the highest score first."""
    return scenes.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), by, scene)).cast("long"))


def strip_scenes(rows: DataFrame, by: str, scene: str, disagree: Column, most: int) -> DataFrame:
    """(by, scene) of the busiest and of the most disagreeing scenes of each ``by``, each once."""
    q = rows.groupBy(by, scene).agg(F.count("*").alias("n"), F.count_if(disagree).alias("d"))
    w = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), scene))
    return q.withColumn("a", w("n")).withColumn("b", w("d")).where((F.col("a") <= most) | (F.col("b") <= most)).select(by, scene)


def field_days(rows: DataFrame, day: str, most: int) -> DataFrame:
    """(kind, day): the busiest, the emptiest and the most typical days."""
    q = rows.groupBy(day).agg(F.count("*").alias("n"))
    m = q.crossJoin(F.broadcast(q.agg(F.median("n").alias("med"))))  # one row
    pick = lambda df, kind, key: df.orderBy(key, day).limit(most).select(F.lit(kind).alias("kind"), day)
    return pick(q, "busiest", F.desc("n")).union(pick(m, "typical", F.abs(F.col("n") - F.col("med")))).union(pick(q, "emptiest", F.col("n")))


def worst(scenes: DataFrame, value: str, most: int, ties: Sequence[str]) -> DataFrame:
    """The rows farthest from zero."""
    return scenes.orderBy(F.desc(F.abs(value)), *ties).limit(most)


def first_available(rows: DataFrame, keys: Sequence[str], kind: str, order: Sequence[str], value: str) -> DataFrame:
    """(keys..., source, value): of each key the value of the first kind in the order; others come last."""
    rank = F.coalesce(*(F.when(F.col(kind) == k, i) for i, k in enumerate(order)), F.lit(len(order)))
    first = F.min_by(F.struct(F.col(kind).alias("k"), F.col(value).alias("v")), F.struct(rank, F.col(kind)))
    return rows.groupBy(*keys).agg(first.alias("__f")).select(*keys, F.col("__f.k").alias("source"), F.col("__f.v").alias("value"))


def contraction(series: DataFrame, by: str, at: str, delta: str, smooth: int) -> DataFrame:
    """(by, at, ratio, smooth): each step's change over the last one's, and a mean over the last ``smooth`` steps."""
    w = Window.partitionBy(by).orderBy(at)
    return series.select(by, at, (F.col(delta) / F.lag(delta).over(w)).alias("ratio"), F.avg(delta).over(w.rowsBetween(1 - smooth, 0)).alias("smooth"))


def parsimonious(scores: DataFrame, k: str, error: str, rel_tol: float) -> DataFrame:
    """One row (k, best): the least k within rel_tol of the least error, and the k of that error."""
    m = scores.agg(F.min(error).alias("__m"), F.min_by(k, error).alias("best"))
    near = scores.crossJoin(F.broadcast(m)).where(F.col(error) <= F.col("__m") * (1 + rel_tol))  # one row
    return near.agg(F.min(k).alias("k"), F.max("best").alias("best"))


def cv_gain(scores: DataFrame, cutoff: str, error: str) -> DataFrame:
    """(cutoff, gain): percent less error than without a filter (cutoff 0)."""
    zero = scores.where(F.col(cutoff) == 0).select(F.col(error).alias("__0"))
    return scores.crossJoin(F.broadcast(zero)).select(cutoff, (100 * (1 - F.col(error) / F.col("__0"))).alias("gain"))  # one row


def held_days(pairs: DataFrame, by: str, day: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, n, bias, pooled) of reconstructions y against held-out days x, pooled over days by their counts."""
    e = F.col(y) - F.col(x)
    d = pairs.groupBy(by, day).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(e * e).alias("mse"))
    n = F.col("n")
    return d.groupBy(by).agg(F.sum("n").alias("n"), (F.sum(n * F.col("bias")) / F.sum("n")).alias("bias"), F.sqrt(F.sum(n * F.col("mse")) / F.sum("n")).alias("pooled"))


def eligible_days(obs: DataFrame, n_water: Column, share: float, by: Sequence[str] = ("sensor", "day")) -> DataFrame:
    """Distinct days on which some sensor covers more than a share of the water."""
    x = obs.groupBy(*by).agg(F.count("*").alias("n"))
    return x.where(F.col("n") / n_water > share).select("day").distinct()


def coverage(obs: DataFrame, n_water: Column, reference: str) -> DataFrame:
    """(day, reference_px, share, reference_only): pixels of the reference, share of water by any sensor."""
    ref = F.col("sensor") == reference
    out = obs.groupBy("day").agg(F.count_distinct(F.when(ref, F.col("px"))).alias("reference_px"), F.count_distinct("px").alias("n"), F.bool_and(ref).alias("reference_only"))
    return out.select("day", "reference_px", (F.col("n") / n_water).alias("share"), "reference_only")


def pooled_bias(pairs: DataFrame, by: str, scene: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, before, after): the mean difference, before and after each scene's median is taken off."""
    e = F.col(y) - F.col(x)
    s = pairs.groupBy(by, scene).agg(F.median(e).alias("__o"))
    return pairs.join(s, [by, scene]).groupBy(by).agg(F.avg(e).alias("before"), F.avg(e - F.col("__o")).alias("after"))


def within_scene(pairs: DataFrame, by: str, scene: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, r, ols, rma, sd) of anomalies about the scenes' means, and the median of scenes' deviations."""
    w = Window.partitionBy(by, scene)
    a = pairs.select(by, (F.col(x) - F.avg(x).over(w)).alias("xa"), (F.col(y) - F.avg(y).over(w)).alias("ya"))
    r = F.corr("xa", "ya")
    a = a.groupBy(by).agg(r.alias("r"), F.regr_slope("ya", "xa").alias("ols"), (F.signum(r) * F.stddev_pop("ya") / F.stddev_pop("xa")).alias("rma"))
    s = pairs.groupBy(by, scene).agg(F.stddev_samp(y).alias("sd")).groupBy(by).agg(F.median("sd").alias("sd"))
    return a.join(s, by)
