"""Weighted multi-member composites with a source bitmask."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lookup(key: Column, table: Mapping[str, object]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))[key]


def weighted_composite(obs: DataFrame, order: Sequence[str], weights: Mapping[str, float] | None = None, min_members: int = 1) -> DataFrame:
    """(day, px, mean, n, src, sd) of members with a value.

    mean = sum(w v)/sum(w); bit i of src is the i-th member of ``order``; sd uses the
    reliability denominator sum(w) - sum(w^2)/sum(w) and needs two members.  Cells below
    ``min_members`` have a NULL mean and src 0.  The centred sum of squares is taken in one
    pass over an array of at most len(order) pairs, so a cell is shuffled once.
    """
    if not 1 <= len(order) <= 31:
        raise ValueError("between 1 and 31 members")
    weights = {m: float((weights or {}).get(m, 1.0)) for m in order}
    x = obs.where(F.col("sensor").isin(*order) & F.col("value").isNotNull()).select(
        "day", "px", "value", _lookup(F.col("sensor"), weights).alias("w"), _lookup(F.col("sensor"), {m: 1 << i for i, m in enumerate(order)}).alias("bit")
    )
    a = x.groupBy("day", "px").agg(
        F.sum(F.col("w") * F.col("value")).alias("swv"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"),
        F.count("value").alias("n"), F.bit_or("bit").alias("src"), F.collect_list(F.struct("w", "value")).alias("pairs"),
    )
    mean = F.col("swv") / F.col("sw")
    ss = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + p["w"] * (p["value"] - mean) * (p["value"] - mean))
    enough = F.col("n") >= min_members
    den = F.col("sw") - F.col("sw2") / F.col("sw")
    return a.select(
        "day", "px", F.when(enough, mean).alias("mean"), "n", F.when(enough, F.col("src")).otherwise(0).cast("int").alias("src"),
        F.when(enough & (F.col("n") >= 2) & (den > 0), F.sqrt(ss / den)).alias("sd"),
    )
