"""Settings: defaults, overrides from YAML, and errors for what is unknown."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from pathlib import Path
from typing import Any

# Defaults that define behaviour.
DEFAULTS: dict[str, dict[str, Any]] = {
    "region": {"aoi": "region", "out_dir": "out"},
    "data": {"observations": None, "insitu": None, "points": None, "reference": "view", "days": None},
    "pairs": {"min_footprints": 10, "min_footprint_cells": 20, "cover": 0.5, "outlier_k": 1.5, "outlier_max_iter": 20, "min_pixels": 200, "max_abs_delta": 8.0},
    "offset": {"max_harmonics": 1, "max_cond": 100.0, "min_scenes": 8, "slope": False, "clip": [-5.0, 5.0]},
    "holdout": {"frac": 0.2, "coverage": 0.5, "seed": 0},
    "seasonal": {"method": "harmonic", "range_px": 50.0, "harmonics": 1, "period_days": 365.25, "min_dates": 10, "max_cond": 100.0, "scale_floor": 0.5, "dof": True},
    "detector": {"method": "mixture", "prior_cloud": 0.5, "beta": 1.75, "sweeps": 20, "damp": 0.5, "p_floor": 0.01, "k_low": 3.0, "k_high": 3.0, "min_pixels": 64},
    "filter": {"p_valid_min": 0.5, "offset_lower": -2.0, "offset_upper": 4.0, "valid_range": [271.0, 310.0], "require_qc": True, "min_kept_frac": None},
    "loop": {"source": "all", "k": 2, "t_c": 7.0, "max_iter": 8, "tol": 1e-3, "patience": 1, "ridge": 1e-3, "min_px": 5},
    "fill": {"coarsen": 4, "l_c": 0.0, "t_c_grid": [0, 2, 4, 6, 8, 11], "alpha_max": 0.25, "k_max": 40, "rel_tol": 0.01, "patience": 3, "tol": 1e-3, "max_iter": 100},
    "validation": {"max_dt_min": 60, "min_coverage": 0.75, "max_snap_m": 300.0, "boxes": [1], "qc_pass": [1, 2], "max_depth_m": 5.0},
    "points": {"model": "random_walk", "sources": ["observed", "point_fill", "day_fill"], "mode": "all", "harmonics": 1, "share": [], "evaluate": True},
    "calibration": {"match": "daily_mean", "selection": "aic", "harmonics": 2, "min_gain": 0.0},
}


def merged(overrides: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, dict[str, Any]]:
    out = copy.deepcopy(DEFAULTS)
    for section, values in (overrides or {}).items():
        if section not in out:
            raise ValueError(f"unknown section {section!r}; there are {sorted(out)}")
        if unknown := set(values) - set(out[section]):
            raise ValueError(f"unknown keys {sorted(unknown)} in {section}; there are {sorted(out[section])}")
        out[section].update(values)
    check(out)
    return out


def check(cfg: Mapping[str, Mapping[str, Any]]) -> None:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    need(0 < cfg["pairs"]["cover"] <= 1, "pairs.cover is in (0, 1]")
    need(0 <= cfg["filter"]["p_valid_min"] <= 1, "filter.p_valid_min is in [0, 1]")
    lo, hi = cfg["filter"]["offset_lower"], cfg["filter"]["offset_upper"]
    need(lo is None or hi is None or lo < hi, "filter.offset_lower is below offset_upper")
    need(1 <= cfg["loop"]["max_iter"] <= 15, "loop.max_iter is in 1..15")
    need(cfg["detector"]["method"] in ("mixture", "alternate", "em"), "detector.method is mixture, alternate or em")
    need(cfg["seasonal"]["method"] in ("harmonic", "gmrf", "none"), "seasonal.method is harmonic, gmrf or none")
    need(cfg["loop"]["source"] in ("all", "reference"), "loop.source is all or reference")
    need(cfg["points"]["mode"] in ("all", "hierarchy"), "points.mode is all or hierarchy")
    need(cfg["fill"]["coarsen"] >= 1 and cfg["fill"]["k_max"] >= 1, "fill.coarsen and fill.k_max are 1 or more")
    need(cfg["calibration"]["selection"] in ("aic", "loso_cv", "constant", "seasonal"), "calibration.selection")
    need(all(n > 0 and round(n**0.5) ** 2 == n and n % 2 for n in cfg["validation"]["boxes"]), "validation.boxes are odd squares")


def load(path: str | Path) -> dict[str, dict[str, Any]]:
    import yaml

    return merged(yaml.safe_load(Path(path).read_text()) or {})
