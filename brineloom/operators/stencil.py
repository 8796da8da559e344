"""Neighbourhoods on a grid of (row, col) cells, one layer a group (a day, say)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brineloom.sources.scratch import written

_FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


def offsets(cells: DataFrame, by: Sequence[str], shifts, value: str) -> DataFrame:
    """Each cell's value, addressed to the cells that have it at one of the shifts."""
    at = F.explode(F.array(*(F.struct((F.col("row") - a).alias("row"), (F.col("col") - b).alias("col")) for a, b in shifts))).alias("at")
    return cells.select(*by, F.col(value).alias("near"), at).select(*by, F.col("at.row").alias("row"), F.col("at.col").alias("col"), "near")


def neighbour_mean(cells: DataFrame, by: Sequence[str], value: str = "value", fill: float | None = 0.5) -> DataFrame:
    """cells with near_n and near_mean over the present four neighbours; none: ``fill``."""
    by = list(by)
    sums = offsets(cells.where(F.col(value).isNotNull()), by, _FOUR, value).groupBy(*by, "row", "col").agg(F.count("near").alias("near_n"), F.sum("near").alias("near_sum"))
    out = cells.join(sums, [*by, "row", "col"], "left")
    mean = F.col("near_sum") / F.col("near_n")
    return out.withColumn("near_n", F.coalesce("near_n", F.lit(0))).withColumn("near_mean", F.coalesce(mean, F.lit(fill).cast("double"))).drop("near_sum")


def box_mean(cells: DataFrame, by: Sequence[str], k: int, value: str = "value") -> DataFrame:
    """cells with box_n and box_mean over the k x k box's present cells."""
    if k < 1 or k % 2 == 0:
        raise ValueError("an odd box")
    h, by = k // 2, list(by)
    shifts = [(a, b) for a in range(-h, h + 1) for b in range(-h, h + 1)]
    sums = offsets(cells.where(F.col(value).isNotNull()), by, shifts, value).groupBy(*by, "row", "col").agg(F.count("near").alias("box_n"), F.avg("near").alias("box_mean"))
    return cells.join(sums, [*by, "row", "col"], "left")


def block_mean(cells: DataFrame, by: Sequence[str], f: int, rows: int, cols: int, value: str = "value") -> DataFrame:
    """(by..., row, col, value, n) of f x f blocks; a ragged edge is trimmed."""
    inside = (F.col("row") < rows // f * f) & (F.col("col") < cols // f * f)
    return cells.where(inside).groupBy(*by, F.expr(f"row div {f}").alias("row"), F.expr(f"col div {f}").alias("col")).agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def upsample(blocks: DataFrame, cells: DataFrame, by: Sequence[str], f: int, rows: int, cols: int, value: str = "value") -> DataFrame:
    """cells with their block's value; edges beyond the last block take it."""
    at = cells.withColumn("__r", F.least(F.expr(f"row div {f}"), F.lit(rows // f - 1))).withColumn("__c", F.least(F.expr(f"col div {f}"), F.lit(cols // f - 1)))
    b = blocks.select(*by, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("up"))
    return at.join(b, [*by, "__r", "__c"], "left").drop("__r", "__c")


def diffuse_space(cells: DataFrame, by: Sequence[str], alpha: float, sweeps: int = 1, value: str = "value") -> DataFrame:
    """Mass-conserving diffusion over present cells: v += alpha * sum(neighbour - v)."""
    for _ in range(sweeps):
        near = neighbour_mean(cells, by, value, 0.0)
        cells = near.withColumn(value, F.col(value) + alpha * F.col("near_n") * (F.col("near_mean") - F.col(value))).drop("near_n", "near_mean")
    return cells


def diffuse_time(series: DataFrame, by: Sequence[str], alpha: float, sweeps: int = 1, t: str = "t", value: str = "value") -> DataFrame:
    """Diffusion along irregular times with no flux over the ends.

    flux alpha * dv/dt between neighbours, divided by the width of a sample's cell; the end cells
    are as wide as if the series went on with its first (last) step.
    """
    w = Window.partitionBy(*by).orderBy(t)
    for _ in range(sweeps):
        before, after = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
        flux_in = F.coalesce(alpha * (F.col(value) - F.lag(value).over(w)) / before, F.lit(0.0))
        flux_out = F.coalesce(alpha * (F.lead(value).over(w) - F.col(value)) / after, F.lit(0.0))
        width = (F.coalesce(before, after) + F.coalesce(after, before)) / 2
        series = series.withColumn("__d", F.coalesce((flux_out - flux_in) / width, F.lit(0.0))).withColumn(value, F.col(value) + F.col("__d")).drop("__d")
    return series


def components(cells: DataFrame, by: Sequence[str], value: str = "value", save=written) -> DataFrame:
    """cells with label: the least cell number of its four-connected patch of equal values.

    Labels spread to neighbours, then jump to their label's label, until none changes; ``save``
    cuts the lineage of each round (a written table, on a cluster).
    """
    by = list(by)
    x = save(cells.where(F.col(value).isNotNull()).select(*by, "row", "col", F.col(value).alias("value"), (F.col("row").cast("long") * 1_000_003 + F.col("col")).alias("cell")))
    at = F.explode(F.array(*(F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in ((0, 1), (1, 0))))).alias("at")
    far = x.select(*by, "value", F.col("cell").alias("other"), at).select(*by, F.col("at.row").alias("row"), F.col("at.col").alias("col"), "value", "other")
    half = x.join(far, [*by, "row", "col", "value"]).select(*by, "cell", "other")
    edges = save(half.union(half.select(*by, F.col("other").alias("cell"), F.col("cell").alias("other"))))
    labels = x.select(*by, "cell", F.col("cell").alias("label"))
    while True:
        near = edges.join(labels.withColumnRenamed("cell", "other"), [*by, "other"]).groupBy(*by, "cell").agg(F.min("label").alias("near"))
        nxt = labels.join(near, [*by, "cell"], "left").select(*by, "cell", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = nxt.select(*by, F.col("cell").alias("label"), F.col("label").alias("to"))
        nxt = save(nxt.join(jump, [*by, "label"]).select(*by, "cell", "was", F.col("to").alias("label")))
        done = not nxt.where("label <> was").limit(1).count()
        labels = nxt.select(*by, "cell", "label")
        if done:
            return x.join(labels, [*by, "cell"])
