"""Commands: check a configuration and a record, list queries, run one, show a stage's tables.

    python -m brineloom.cli check CONFIG SF_DIR
    python -m brineloom.cli queries
    python -m brineloom.cli run NAME SF_DIR OUT_DIR
    python -m brineloom.cli status OUT_DIR
    python -m brineloom.cli init CONFIG [--force]
    python -m brineloom.cli stage NAME CONFIG [--tag TAG]     (offsets, fill, validate, points, calibrate, all)
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from brineloom import config
from brineloom.session import local_session

MIN_ACQUISITIONS = 8


def init(args) -> int:
    import yaml

    path = Path(args.config)
    if path.exists() and not args.force:
        print(f"{path} exists; --force replaces it", file=sys.stderr)
        return 1
    path.write_text(yaml.safe_dump(config.DEFAULTS, sort_keys=False))
    return 0


def sensor_report(obs, least: int = 8):
    """(sensor, days, enough, first, last): the acquisitions of each sensor, and whether they are enough."""
    from pyspark.sql import functions as F

    x = obs.groupBy("sensor").agg(F.count_distinct("day").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"))
    return x.withColumn("enough", F.col("days") >= least)


def check(args) -> int:
    """Errors: a bad configuration, a sensor without acquisitions; few of them: a warning."""
    from brineloom.operators.filters import acquisitions
    from brineloom.sources.tables import MEMBERS, observations

    try:
        cfg = config.load(args.config)
    except ValueError as e:
        print(f"ERROR {e}")
        return 1
    spark, bad = local_session(), 0
    o = observations(spark, args.sf_dir)
    found = {r["sensor"]: r["n"] for r in acquisitions(o, cfg["pairs"]["min_pixels"] // 10).groupBy("sensor").agg(F.count("*").alias("n")).collect()}
    for sensor in MEMBERS:
        n = found.get(sensor, 0)
        level = "ERROR" if not n else "WARN" if n < MIN_ACQUISITIONS else "ok"
        bad += level == "ERROR"
        print(f"{level} {sensor}: {n} acquisitions")
    return int(bad > 0)


def queries(args) -> int:
    from brineloom.plans import registry

    print("\n".join(sorted(registry.queries())))
    return 0


def run(args) -> int:
    from brineloom.plans import registry
    from brineloom.sources.sinks import provenance, replace_table

    spark = local_session()
    replace_table(registry.queries()[args.name](spark, args.sf_dir), f"{args.out_dir}/{args.name}")
    replace_table(provenance(spark, {"query": args.name, "input": args.sf_dir}), f"{args.out_dir}/{args.name}.run_meta")
    return 0


def status(args) -> int:
    spark = local_session()
    for p in [*sorted(Path(args.out_dir).glob("*.run_meta")), *sorted(Path(args.out_dir).glob("**/run_meta"))]:
        r = spark.read.parquet(str(p)).first()
        name = p.name.removesuffix(".run_meta") if p.name != "run_meta" else p.parent.name
        print(name, r["written"], r["commit"][:12], r["config_key"])
    return 0


def stage(args) -> int:
    """One stage of a region, or all that the configuration has inputs for."""
    from brineloom import stages

    try:
        cfg = config.load(args.config)
        fn = stages.run_all if args.name == "all" else stages.STAGES[args.name]
        fn(local_session(), cfg, args.tag)
    except (KeyError, ValueError, FileNotFoundError) as e:
        print(f"ERROR {e}", file=sys.stderr)
        return 1
    print(stages.stage_dirs(cfg, args.tag)["base"])
    return 0


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="brineloom")
    s = p.add_subparsers(required=True)
    for fn, names in ((init, ["config"]), (check, ["config", "sf_dir"]), (queries, []), (run, ["name", "sf_dir", "out_dir"]), (status, ["out_dir"]), (stage, ["name", "config"])):
        c = s.add_parser(fn.__name__)
        for n in names:
            c.add_argument(n)
        if fn is init:
            c.add_argument("--force", action="store_true")
        if fn is stage:
            c.add_argument("--tag")
        c.set_defaults(fn=fn)
    args = p.parse_args(argv)
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
