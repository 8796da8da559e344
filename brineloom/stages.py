"""Stage jobs of a region: offsets, fill, validate, points, calibrate.

Each reads the record and what earlier stages wrote, takes its settings from the configuration, and
writes its tables (Parquet, swapped in whole) and reports (CSV, JSON) under

    <region.out_dir>/<region.aoi>[_<tag>]/stage1_offsets ... stage5_calibration

The record is a table (sensor, day, px, row, col, value) with, if there are any, hour and flagged.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineloom.operators import calibrate, fill, filters, joins, loop, offsets, points, seasonal, stats
from brineloom.operators.composite import weighted_composite
from brineloom.operators.detect import Mixture
from brineloom.sources.readers import with_channel
from brineloom.sources.scratch import written
from brineloom.sources.sinks import config_key, provenance, replace_table, write_text

DIRS = {"offsets": "stage1_offsets", "fill": "stage2_fill", "validate": "stage3_validation", "points": "stage4_points", "calibrate": "stage5_calibration"}


def stage_dirs(cfg: Mapping[str, Mapping[str, Any]], tag: str | None = None) -> dict[str, str]:
    base = f"{str(cfg['region']['out_dir']).rstrip('/')}/{cfg['region']['aoi']}" + (f"_{tag}" if tag else "")
    return {"base": base} | {name: f"{base}/{d}" for name, d in DIRS.items()}


def open_table(spark: SparkSession, path: str, what: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """A table, or an error that names what is missing and what makes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no {what} at {path}")
    out = spark.read.parquet(path)
    if missing := [c for c in needs if c not in out.columns]:
        raise ValueError(f"{what} at {path} has no column {missing}; it has {out.columns}")
    return out


def earlier(spark: SparkSession, cfg, tag: str | None, stage: str, *tables: str) -> dict[str, DataFrame]:
    """Tables of an earlier stage; an error says which stage to run."""
    d = stage_dirs(cfg, tag)[stage]
    return {t: open_table(spark, f"{d}/{t}", f"table {t} (run the stage {stage} first)") for t in tables}


def record(spark: SparkSession, cfg) -> DataFrame:
    """(sensor, day, px, row, col, value, hour, flagged) of the configured record and days."""
    if not cfg["data"]["observations"]:
        raise ValueError("data.observations names no table")
    x = open_table(spark, cfg["data"]["observations"], "record", ("sensor", "day", "px", "row", "col", "value"))
    x = with_channel(with_channel(x, "hour"), "flagged", "boolean")
    first, last = cfg["data"]["days"] or (None, None)
    if first:
        x = x.where(F.col("day") >= F.lit(str(first)).cast("date"))
    if last:
        x = x.where(F.col("day") <= F.lit(str(last)).cast("date"))
    value = F.when(filters.present(F.col("value")), F.col("value").cast("double"))
    return x.select("sensor", "day", "px", "row", "col", value.alias("value"), "hour", F.coalesce("flagged", F.lit(False)).alias("flagged"))


def sensor_block(obs: DataFrame, sensor: str, min_pixels: int) -> DataFrame:
    """One sensor's acquisitions, as a table of their own."""
    own = obs.where(F.col("sensor") == sensor)
    return written(own.join(filters.acquisitions(own, min_pixels).select("sensor", "day"), ["sensor", "day"], "left_semi"))


def _save(df: DataFrame, path: str) -> DataFrame:
    replace_table(df, path)
    return df.sparkSession.read.parquet(path)


def _report(df: DataFrame, path: str) -> None:
    """A small table as one CSV folder; arrays as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    replace_table(df.select(*flat), path, kind="csv")


def _finish(spark: SparkSession, cfg, path: str, stage: str) -> None:
    replace_table(provenance(spark, {"stage": stage} | dict(cfg)), f"{path}/run_meta")


def run_offsets(spark: SparkSession, cfg, tag: str | None = None) -> dict[str, DataFrame]:
    """Stage 1: pairs with the reference, clipped; scenes; each member's models and the recommended one."""
    d, p, ref = stage_dirs(cfg, tag)["offsets"], cfg["pairs"], cfg["data"]["reference"]
    o = record(spark, cfg).where(~F.col("flagged"))
    m = joins.pixel_matchups(o.where(F.col("sensor") != ref), o.where(F.col("sensor") == ref), p["min_pixels"])
    pairs, rounds, done = offsets.clip_pairs(m.select("sensor", "day", "px", "hour", F.col("ref").alias("x"), F.col("value").alias("y")), p["outlier_k"], max_rounds=p["outlier_max_iter"])
    pairs = _save(pairs, f"{d}/pairs")
    kept = pairs.where("kept").withColumn("d", F.col("y") - F.col("x"))
    mad = stats.mad(kept, ["sensor", "day"], "d").select("sensor", "day", F.col("median").alias("delta"), F.col("mad").alias("sd"), "n")
    medians = kept.groupBy("sensor", "day").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.min("hour").alias("hour"))
    scenes = mad.where(F.abs("delta") <= p["max_abs_delta"]).join(medians, ["sensor", "day"])
    scenes = _save(stats.variance_components(scenes, ["sensor"]).fillna(1.0, ["w"]), f"{d}/scenes")
    ladder = offsets.fit_offsets(scenes, "sensor", cfg["offset"]["max_harmonics"], cfg["offset"]["min_scenes"], cfg["offset"]["max_cond"], tuple(cfg["offset"]["clip"]))
    fixed = offsets.fit_fixed(scenes).join(offsets.loso_constant(scenes, "sensor", "day", "delta").select("sensor", F.col("rmse").alias("rmse_fixed")), "sensor", "left")
    rma = offsets.fit_rma(scenes).join(offsets.loso_rma(scenes), "sensor", "left").select("sensor", F.col("a").alias("a_rma"), "x0", "slope", F.col("off").alias("off_rma"), "valid", "rmse_rma")
    models = fixed.join(rma, "sensor").join(ladder.withColumnRenamed("mean", "offset_mean"), "sensor")
    chosen = offsets.recommend(F.col("rmse_fixed"), F.col("rmse_rma"), F.col("valid")) if cfg["offset"]["slope"] else F.lit("fixed")
    models = _save(models.withColumn("recommended", F.coalesce(chosen, F.lit("fixed"))), f"{d}/models")
    _report(models, f"{d}/models_csv")
    hand = {}
    for r in models.collect():  # a row a sensor
        fixed_model = {"a": r["a"], "x0": 0.0, "b": 1.0, "off": r["a"], "slope": 1.0}
        hand[r["sensor"]] = {"label": r["sensor"], "recommended": r["recommended"], "chosen": r["recommended"], "models": {"fixed": fixed_model, "rma": {"a": r["a_rma"], "x0": r["x0"], "b": r["slope"], "off": r["off_rma"], "slope": r["slope"]}}}
    write_text(spark, f"{d}/offsets.json", json.dumps({"aoi": cfg["region"]["aoi"], "config_key": config_key(dict(cfg)), "rounds": rounds, "converged": done, "sensors": hand}, indent=1))
    _finish(spark, cfg, d, "offsets")
    return {"pairs": pairs, "scenes": scenes, "models": models}


def run_fill(spark: SparkSession, cfg, tag: str | None = None) -> dict[str, DataFrame]:
    """Stage 2: one scale, composite, seasonal cycle, cloud loop, final fill, held-out scores."""
    d, ref = stage_dirs(cfg, tag)["fill"], cfg["data"]["reference"]
    s, lp, fl, f = cfg["seasonal"], cfg["loop"], cfg["fill"], cfg["filter"]
    models = earlier(spark, cfg, tag, "offsets", "models")["models"]
    rma = F.col("recommended") == "rma"
    one = models.select("sensor", F.when(rma, F.col("off_rma")).otherwise(F.col("a")).alias("off"), F.when(rma, F.col("slope")).otherwise(F.lit(1.0)).alias("slope"))
    x = record(spark, cfg).join(F.broadcast(one), "sensor", "left")  # a row a sensor
    x = written(x.withColumn("raw", F.col("value")).withColumn("value", (F.col("value") - F.coalesce("off", F.lit(0.0))) / F.coalesce("slope", F.lit(1.0))))
    cells = written(x.select("px", "row", "col").distinct())
    good = x.where(~F.col("flagged") & F.col("value").isNotNull())
    names = [r[0] for r in good.select("sensor").distinct().orderBy("sensor").collect()]
    composite = _save(weighted_composite(good, [ref, *[n for n in names if n != ref]]), f"{d}/composite")
    fits = seasonal.fit_seasonal(composite.select("day", "px", F.col("mean").alias("value")), cells, s["method"], s["harmonics"], s["period_days"], s["min_dates"], s["max_cond"], s["scale_floor"], s["dof"], range_px=s["range_px"])
    fits = _save(fits, f"{d}/seasonal")
    harmonics = 0 if s["method"] == "none" else s["harmonics"]
    with_cycle = lambda df: seasonal.seasonal_values(df, fits, harmonics, s["period_days"]).join(fits.select("px", "scale"), "px")
    y = written(with_cycle(x))
    days = [r[0] for r in y.where(F.col("value").isNotNull()).select("day").distinct().orderBy("day").collect()]  # the record's days
    top = cells.agg(F.max("row"), F.max("col")).first()
    det = cfg["detector"]
    mixture = Mixture(prior_cloud=det["prior_cloud"], beta=det["beta"], sweeps=det["sweeps"], damp=det["damp"], floor=det["p_floor"])
    method = {"mixture": "mixture", "alternate": "alternate", "em": "em"}[det["method"]]
    kept, history = loop.cloud_loop(
        y, days, top[0] + 1, top[1] + 1, lp["k"], mixture, f["p_valid_min"], lp["max_iter"], lp["tol"], lp["patience"], lp["t_c"], fl["alpha_max"], source=lp["source"], reference=ref, ridge=lp["ridge"], min_px=lp["min_px"],
        method=method, center_range=(f["offset_lower"], f["offset_upper"]), min_kept_frac=f["min_kept_frac"], require_qc=f["require_qc"],
    )
    mask = _save(kept.select("sensor", "day", "px", "row", "col", "raw", "hour", "keep", "bits", "p_valid"), f"{d}/mask")
    filtered = _save(mask.select("sensor", "day", "px", "row", "col", "hour", "raw", F.when(F.col("keep"), F.col("raw")).alias("filtered")), f"{d}/filtered")
    z = kept.where("keep").groupBy("px", "row", "col", "day").agg(F.avg((F.col("value") - F.col("seasonal")) / F.col("scale")).alias("z"))
    z = _save(z, f"{d}/standardized")
    out, choice, modes = fill.final_fill(z, days, fl["coarsen"], fl["t_c_grid"], range(1, fl["k_max"] + 1), fl["alpha_max"], fl["rel_tol"], fl["l_c"], fl["tol"], fl["max_iter"])
    field = with_cycle(out)
    kelvin = lambda c: (F.col(c) * F.col("scale") + F.col("seasonal")).alias(c)
    field = _save(field.select("day", "px", kelvin("point"), kelvin("filled_day"), kelvin("filled"), "observed", "constrained", "seasonal"), f"{d}/field")
    v = [(name, j, day, float(fit.v[i, j]), float(fit.sigma[j])) for name, fit in modes.items() for j in range(fit.v.shape[1]) for i, day in enumerate(days)]
    mode = _save(spark.createDataFrame(v, "fit string, mode int, day date, v double, sigma double"), f"{d}/modes")
    chosen = [(choice.k_point, float(choice.t_c_point), choice.k_day, float(choice.t_c_day), fl["coarsen"])]
    _save(spark.createDataFrame(chosen, "k_point int, t_c_point double, k_day int, t_c_day double, coarsen int"), f"{d}/choice")
    held = z.where(F.pmod(F.xxhash64(F.lit(cfg["holdout"]["seed"]), "day"), F.lit(1000)) < int(1000 * cfg["holdout"]["frac"]))
    _, table = fill.holdout_predictions(z, held, days, choice.k_point, choice.t_c_point, fl["alpha_max"], fl["tol"], fl["max_iter"])
    holdout = _save(table, f"{d}/holdout")
    _report(holdout, f"{d}/holdout_csv")
    rounds = [(h["round"], k, float(h["flips"][k]), int(h["kept"][k]), len(h["em"])) for h in history for k in h["flips"]]
    loop_table = _save(spark.createDataFrame(rounds, "round int, sensor string, flips double, kept long, em_rounds int"), f"{d}/loop")
    _report(loop_table, f"{d}/loop_csv")
    _finish(spark, cfg, d, "fill")
    return {"field": field, "mask": mask, "composite": composite, "seasonal": fits, "filtered": filtered, "modes": mode, "holdout": holdout, "loop": loop_table}


def load_choice(spark: SparkSession, cfg, tag: str | None = None) -> fill.Choice:
    """The settings of an earlier (coarse) run, to start another from without a search."""
    r = earlier(spark, cfg, tag, "fill", "choice")["choice"].first()
    return fill.Choice(r["k_point"], r["t_c_point"], r["k_day"], r["t_c_day"])


def _insitu(spark: SparkSession, cfg, needed: bool = True) -> DataFrame | None:
    """(site, px, day, insitu) of the configured station table, or else what the record carries."""
    if cfg["data"]["insitu"]:
        return open_table(spark, cfg["data"]["insitu"], "in-situ table", ("site", "px", "day", "insitu"))
    x = spark.read.parquet(cfg["data"]["observations"])
    if "insitu" in x.columns:
        return x.where(F.col("insitu").isNotNull()).groupBy(F.col("px").cast("string").alias("site"), "px", "day").agg(F.avg("insitu").alias("insitu"))
    if needed:
        raise ValueError("data.insitu names no table, and the record carries no column insitu")
    return None


def run_validate(spark: SparkSession, cfg, tag: str | None = None) -> dict[str, DataFrame]:
    """Stage 3: the filled field against stations, by product, site and season."""
    d = stage_dirs(cfg, tag)["validate"]
    field = earlier(spark, cfg, tag, "fill", "field")["field"]
    m = field.join(_insitu(spark, cfg), ["px", "day"])
    m = m.select("site", "px", "day", "insitu", "observed", F.month("day").alias("month"), F.explode(F.create_map(*(v for c in ("point", "filled_day", "filled") for v in (F.lit(c), F.col(c))))).alias("product", "value"))
    m = _save(m, f"{d}/matchups")
    sets = m.groupingSets([[F.col("product")], [F.col("product"), F.col("site")], [F.col("product"), F.col("month")], [F.col("product"), F.col("observed")]], "product", "site", "month", "observed")
    metrics = _save(sets.agg(*(c.alias(n) for n, c in stats.scores(F.col("value"), F.col("insitu")).items())), f"{d}/metrics")
    _report(metrics, f"{d}/metrics_csv")
    _finish(spark, cfg, d, "validate")
    return {"matchups": m, "metrics": metrics}


def run_points(spark: SparkSession, cfg, tag: str | None = None) -> dict[str, DataFrame]:
    """Stage 4: smoothed series at points, a group together, and their evaluation where stations are."""
    d, p = stage_dirs(cfg, tag)["points"], cfg["points"]
    field = earlier(spark, cfg, tag, "fill", "field")["field"]
    if not cfg["data"]["points"]:
        raise ValueError("data.points names no table (grp, site, px)")
    sites = open_table(spark, cfg["data"]["points"], "points", ("grp", "site", "px"))
    kind = F.when(F.col("observed"), "observed").when(F.col("constrained"), "point_fill").otherwise("day_fill")
    series = field.join(F.broadcast(sites), "px").select("grp", "site", "day", kind.alias("type"), F.col("filled").alias("value"))  # the given points
    out = points.smooth_points(series, p["model"], p["sources"], n_harmonics=p["harmonics"], period=cfg["seasonal"]["period_days"], mode=p["mode"], share=p["share"])
    out = {"points": _save(out, f"{d}/points")}
    insitu = _insitu(spark, cfg, needed=False)
    if insitu is not None and p["evaluate"]:
        fit, metrics = points.evaluate(out["points"], insitu.select("site", "day", "insitu"), cfg["calibration"]["selection"], cfg["calibration"]["harmonics"], cfg["seasonal"]["period_days"], cfg["calibration"]["min_gain"])
        out["metrics"] = _save(metrics, f"{d}/metrics")
        _report(out["metrics"], f"{d}/metrics_csv")
        write_text(spark, f"{d}/bias.json", json.dumps({"form": fit["form"], "coef": [float(c) for c in fit["coef"]], "aic": float(fit["aic"]), "loso_mse": fit["loso_mse"]}))
    _finish(spark, cfg, d, "points")
    return out


def run_calibrate(spark: SparkSession, cfg, tag: str | None = None) -> dict[str, DataFrame]:
    """Stage 5: an offset from stations, chosen by the configured rule, and the calibrated field."""
    d, c = stage_dirs(cfg, tag)["calibrate"], cfg["calibration"]
    field = earlier(spark, cfg, tag, "fill", "field")["field"]
    m = _insitu(spark, cfg).join(field.select("px", "day", "filled"), ["px", "day"]).withColumn("error", F.col("insitu") - F.col("filled"))
    if not m.limit(1).count():
        raise ValueError("no station has a value on a filled pixel and day")
    fit = calibrate.fit_offset(m, c["selection"], c["harmonics"], cfg["seasonal"]["period_days"], c["min_gain"])
    out = calibrate.calibrated(field, fit["coef"], cfg["seasonal"]["period_days"], "filled")
    out = _save(out.select("day", "px", "filled", "offset", "filled_cal"), f"{d}/calibrated")
    write_text(spark, f"{d}/offset.json", json.dumps({"form": fit["form"], "coef": [float(x) for x in fit["coef"]], "aic": float(fit["aic"]), "loso_mse": fit["loso_mse"]}))
    _finish(spark, cfg, d, "calibrate")
    return {"calibrated": out}


STAGES = {"offsets": run_offsets, "fill": run_fill, "validate": run_validate, "points": run_points, "calibrate": run_calibrate}


def run_all(spark: SparkSession, cfg, tag: str | None = None) -> dict[str, dict[str, DataFrame]]:
    """Every stage that the configuration has inputs for, in order."""
    insitu = cfg["data"]["insitu"] or "insitu" in spark.read.parquet(cfg["data"]["observations"]).columns
    skip = set() if insitu else {"validate", "calibrate"}
    skip |= set() if cfg["data"]["points"] else {"points"}
    return {name: fn(spark, cfg, tag) for name, fn in STAGES.items() if name not in skip}
