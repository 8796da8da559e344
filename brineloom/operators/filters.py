"""Predicates, scene criteria, quality masks and verdicts, all as Column expressions."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comparison signs, NaN policies and the names a criterion may go by.
_SIGNS: dict[str, Callable] = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POLICIES = ("invalid", "ignore", "valid")
ALIASES = {
    "channel": ("channel", "chanel", "name", "var", "variable", "band"),
    "value": ("value", "values", "condition"),
    "prop": ("prop", "proportion", "min_prop", "threshold", "frac"),
    "nan_policy": ("nan_policy", "nan"),
    "label": ("label",),
}


def present(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _comparison(value: Any) -> Callable[[Column], Column] | None:
    if isinstance(value, str) and (m := re.fullmatch(rf"\s*([<>=!]=?)\s*({_NUMBER})\s*", value)) and m[1] in _SIGNS:
        return lambda c: _SIGNS[m[1]](c, float(m[2]))
    return None


def compile_predicate(value: Any) -> Callable[[Column], Column]:
    """A scalar (equality), a list of scalars (membership), a comparison such as "<0.5", a list
    with a comparison or a callable in it (all of them), or a callable from Column to Column."""
    if callable(value):
        return value
    if found := _comparison(value):
        return found
    if isinstance(value, (list, tuple, set, frozenset)):
        parts = list(value)
        if not parts:
            raise ValueError("an empty list is no condition")
        if any(callable(p) or _comparison(p) for p in parts):
            every = [compile_predicate(p) for p in parts]
            return lambda c: reduce(operator.and_, (p(c) for p in every))
        return lambda c: c.isin(*parts)
    return lambda c: c == value


@dataclass
class Criterion:
    """At least ``prop`` of a scene's pixels must satisfy ``value`` in ``channel``."""

    channel: str
    value: Any
    prop: float
    nan_policy: str = "invalid"
    label: str = field(default="")

    def __post_init__(self):
        if not 0 <= float(self.prop) <= 1:
            raise ValueError(f"prop {self.prop} is outside [0, 1]")
        if self.nan_policy not in POLICIES:
            raise ValueError(f"nan_policy {self.nan_policy!r} is none of {POLICIES}")
        self.holds = compile_predicate(self.value)
        self.label = self.label or f"{self.channel} {self.value}"

    @classmethod
    def of(cls, spec: Any) -> Criterion:
        if isinstance(spec, Criterion):
            return spec
        if not isinstance(spec, Mapping):
            return cls(*spec)
        known = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
        if unknown := set(spec) - set(known):
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(**{known[k]: v for k, v in spec.items()})

    def fraction(self) -> Column:
        """An aggregate.  invalid: missing pixels fail; ignore: they are left out, and a scene
        without any other has no fraction; valid: they pass."""
        c = F.col(self.channel)
        hit = F.coalesce(present(c) & self.holds(c), F.lit(False))
        if self.nan_policy == "ignore":
            return F.try_divide(F.count_if(hit).cast("double"), F.count_if(present(c)))
        if self.nan_policy == "valid":
            hit = hit | ~present(c)
        return F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1)))


def unique_labels(criteria: Sequence[Criterion]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for c in criteria:
        seen[c.label] = seen.get(c.label, 0) + 1
        out.append(c.label if seen[c.label] == 1 else f"{c.label} #{seen[c.label]}")
    return out


def evaluate(pixels: DataFrame, criteria: Sequence[Any], by: Sequence[str] = ("day",), how: str = "all") -> DataFrame:
    """One row a scene: each criterion's fraction, ``pass: <label>``, and valid (all or any)."""
    criteria = [Criterion.of(c) for c in criteria]
    if how not in ("all", "any") or not criteria:
        raise ValueError("how is all or any, of one criterion at least")
    labels = unique_labels(criteria)
    if clash := {"valid", *by} & set(labels):
        raise ValueError(f"labels {sorted(clash)} are names of the result's own columns")
    scored = pixels.groupBy(*by).agg(*(c.fraction().alias(label) for c, label in zip(criteria, labels, strict=True)))
    passed = {f"pass: {label}": F.coalesce(F.col(f"`{label}`") >= c.prop, F.lit(False)) for c, label in zip(criteria, labels, strict=True)}
    return scored.withColumns(passed).withColumn("valid", reduce(operator.and_ if how == "all" else operator.or_, passed.values()))


def passing(pixels: DataFrame, criteria: Sequence[Any], by: Sequence[str] = ("day",), how: str = "all") -> DataFrame:
    """The pixels of scenes that pass."""
    return pixels.join(evaluate(pixels, criteria, by, how).where("valid").select(*by), list(by), "left_semi")


def acquisitions(obs: DataFrame, min_pixels: int, by: Sequence[str] = ("sensor", "day"), value: str = "value") -> DataFrame:
    """Scenes with enough present values."""
    return obs.groupBy(*by).agg(F.count_if(present(F.col(value))).alias("n_obs")).where(F.col("n_obs") >= min_pixels)


def celsius(c: Column, median: Column) -> Column:
    """Kelvin to Celsius if the record's median says that it is in kelvin."""
    return F.when(median > 150, c - 273.15).otherwise(c)


def usable(value: Column, water: Column, valid: Column) -> Column:
    """The value of a member where it counts, else NULL."""
    return F.when(present(value) & water & (valid > 0.5), value)


def qc_flags(value: Column, water: Column, cloud: Column | None, valid: Column | None, enabled: bool = True) -> dict[str, Column]:
    """flagged: has data that the sensor's own control distrusts; gap: water without data; nodata:
    a gap that is not called cloud.  A missing verdict is none."""
    has = water & present(value)
    gap = water & ~present(value)
    no = F.lit(False)
    if not enabled:
        return {"flagged": no, "gap": gap, "nodata": no}
    is_cloud = F.coalesce(cloud == 1, no) if cloud is not None else no
    is_bad = F.coalesce(valid == 0, no) if valid is not None else no
    return {"flagged": has & (is_cloud | is_bad), "gap": gap, "nodata": gap & ~is_cloud if cloud is not None else no}


def cloud_prior(flagged: Column, gap: Column, nodata: Column, base: float, raised: float, nodata_prior: float | None = None) -> Column:
    p = F.when(flagged | gap, raised).otherwise(base)
    if nodata_prior is not None:
        p = F.when(nodata, nodata_prior).otherwise(p)
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def scene_verdict(center: Column, lower: float | None, upper: float | None, no_reference: Column | None = None) -> Column:
    """Why a scene is dropped, or ``kept``."""
    out = F.when(no_reference, "no reference").otherwise("kept") if no_reference is not None else F.lit("kept")
    if upper is not None:
        out = F.when(center > upper, F.format_string(f"offset %+.2f above {upper:+.2f}", center)).otherwise(out)
    if lower is not None:
        out = F.when(center < lower, F.format_string(f"offset %+.2f below {lower:+.2f}", center)).otherwise(out)
    return out


def keep_scenes(pixels: DataFrame, scenes: DataFrame, p_min: float, n_water: int, min_kept: float | None, by=("sensor", "day")) -> DataFrame:
    """One row a scene (n_pass, pixel_frac, n_kept, verdict, reason) from pixels (value, p_valid)
    and scenes' ``reason``: the pixel cut, then the scene's verdict, then the least share kept."""
    cut = pixels.groupBy(*by).agg(F.count_if(present(F.col("value")) & (F.col("p_valid") >= p_min)).alias("n_pass"))
    x = cut.join(scenes.select(*by, "reason"), list(by)).withColumn("pixel_frac", F.col("n_pass") / float(n_water))
    if min_kept is not None:
        few = (F.col("reason") == "kept") & (F.col("pixel_frac") < min_kept)
        x = x.withColumn("reason", F.when(few, "too few pixels").otherwise(F.col("reason")))
    kept = F.col("reason") == "kept"
    return x.withColumn("n_kept", F.when(kept, F.col("n_pass")).otherwise(F.lit(0).cast("long"))).withColumn("verdict", F.when(kept, "KEPT").otherwise("DROPPED"))


def day_context(observed: Column, constrained: Column) -> Column:
    return F.when(observed, "observed").when(constrained, "point_fill").otherwise("day_fill")


def kept_at(bits: Column, i: int) -> Column:
    """Whether bit i of a keep history is set; bit 0 is the start."""
    return F.shiftright(bits, i).bitwiseAND(1) == 1


def standardized(value: Column, seasonal: Column, scale: Column) -> Column:
    return (value - seasonal) / scale


def unstandardized(z: Column, seasonal: Column, scale: Column) -> Column:
    """Climatology where z is missing."""
    return F.coalesce(z, F.lit(0.0)) * scale + seasonal
