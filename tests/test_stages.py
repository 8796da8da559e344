"""The stages of a region end to end, their layout, hand-offs and errors."""

import datetime
import json
import os

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from brineloom import cli, config, stages
from brineloom.sources import readers, sinks

DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=2 * i) for i in range(30)]


@pytest.fixture(scope="module")
def region(spark, tmp_path_factory):
    """A reference and a warmer member with cold patches; stations read 0.4 more than the truth."""
    path = tmp_path_factory.mktemp("region")
    rng = np.random.default_rng(3)
    data, insitu, bad = [], [], set()
    for d, day in enumerate(DAYS):
        for i in range(8):
            for j in range(8):
                px = 8 * i + j
                truth = 10 + np.cos(d / 5) + 0.3 * np.sin(d / 3) * i / 8
                if px in (9, 30, 50):
                    insitu.append((f"s{px}", px, day, float(truth + 0.4 + rng.normal(0, 0.02))))
                if d % 3 and rng.random() < 0.9:
                    data.append(("view", day, px, i, j, float(truth + rng.normal(0, 0.05)), 10.0, False))
                if d % 2 == 0 and rng.random() < 0.95:
                    cold = d % 6 == 0 and i < 3 and j < 3
                    data.append(("eco", day, px, i, j, float(truth + 1.2 - 4 * cold + rng.normal(0, 0.05)), 14.0, False))
                    if cold:
                        bad.add((day, px))
    spark.createDataFrame(data, "sensor string, day date, px long, row int, col int, value double, hour double, flagged boolean").write.parquet(f"{path}/obs")
    spark.createDataFrame(insitu, "site string, px long, day date, insitu double").write.parquet(f"{path}/insitu")
    spark.createDataFrame([("g", "s9", 9), ("g", "s30", 30)], "grp string, site string, px long").write.parquet(f"{path}/points")
    cfg = {
        "region": {"aoi": "bay", "out_dir": f"{path}/out"}, "data": {"observations": f"{path}/obs", "insitu": f"{path}/insitu", "points": f"{path}/points", "reference": "view"},
        "pairs": {"min_pixels": 10}, "seasonal": {"method": "none"}, "loop": {"k": 1, "t_c": 4.0, "max_iter": 2}, "detector": {"prior_cloud": 0.1},
        "fill": {"coarsen": 2, "t_c_grid": [0, 6], "k_max": 2, "max_iter": 60}, "calibration": {"selection": "constant"},
    }
    (path / "c.yaml").write_text(yaml.safe_dump(cfg))
    return path, cfg, bad


def test_all_stages(spark, region):
    path, cfg, bad = region
    assert cli.main(["stage", "all", str(path / "c.yaml"), "--tag", "t"]) == 0
    full = config.load(path / "c.yaml")
    dirs = stages.stage_dirs(full, "t")
    assert dirs["base"] == f"{path}/out/bay_t" and sorted(os.listdir(dirs["base"])) == sorted(stages.DIRS.values())
    read = lambda stage, table: spark.read.parquet(f"{dirs[stage]}/{table}")
    hand = {r["sensor"]: r for r in readers.read_offsets(spark, f"{dirs['offsets']}/offsets.json").collect()}
    assert hand["eco"]["model"] == "fixed" and hand["eco"]["off"] == pytest.approx(1.2, abs=0.1)
    mask = {(r["day"], r["px"]): r["keep"] for r in read("fill", "mask").where("sensor = 'eco'").collect()}
    removed = {k for k, v in mask.items() if not v}
    assert len(removed & bad) > 0.9 * len(bad) and len(removed - bad) < 0.05 * len(mask)
    assert read("fill", "filtered").where("sensor = 'eco' and filtered is not null").count() == len(mask) - len(removed)
    field = read("fill", "field")
    assert field.count() == 64 * 25 and field.where("filled is null").count() == 0
    metrics = {r["product"]: r for r in read("validate", "metrics").where("site is null and month is null and observed is null").collect()}
    assert metrics["filled"]["n"] == 75 and metrics["filled"]["bias"] == pytest.approx(-0.4, abs=0.1) and metrics["filled"]["rmse"] < 0.6
    pts = read("points", "points")
    assert {r["site"] for r in pts.select("site").distinct().collect()} == {"s9", "s30"} and pts.count() == 2 * ((DAYS[-1] - DAYS[0]).days + 1)
    after = {r["site"]: r for r in read("points", "metrics").collect()}["all"]
    assert after["rmse_after"] < after["rmse_before"]
    cal = read("calibrate", "calibrated").agg(F.avg("offset"), F.avg(F.col("filled_cal") - F.col("filled"))).first()
    assert cal[0] == pytest.approx(0.4, abs=0.1) and cal[1] == pytest.approx(cal[0])
    for stage, table in (("fill", "composite"), ("fill", "seasonal"), ("fill", "standardized"), ("fill", "modes"), ("fill", "holdout"), ("fill", "loop"), ("offsets", "pairs"), ("offsets", "scenes")):
        assert read(stage, table).count() > 0
    assert all(read(s, "run_meta").first()["config_key"] for s in stages.STAGES)
    assert stages.load_choice(spark, full, "t").k_point in (1, 2)
    assert json.loads(open(f"{dirs['calibrate']}/offset.json").read())["form"] == "constant"
    assert cli.main(["status", dirs["base"]]) == 0
    block = stages.sensor_block(stages.record(spark, full), "eco", 60)
    assert 0 < block.select("day").distinct().count() <= 15 and {r[0] for r in block.select("sensor").distinct().collect()} == {"eco"}


def test_errors_name_what_is_missing(spark, region, capsys):
    path, cfg, _ = region
    full = config.merged(cfg)
    with pytest.raises(FileNotFoundError, match="stage offsets first"):
        stages.run_fill(spark, full, "none")
    with pytest.raises(FileNotFoundError, match="record"):
        stages.record(spark, config.merged(cfg | {"data": {"observations": f"{path}/nothing"}}))
    with pytest.raises(ValueError, match="no column"):
        stages.open_table(spark, f"{path}/points", "points", ("lat",))
    with pytest.raises(ValueError, match="no table"):
        stages.record(spark, config.merged())
    with pytest.raises(ValueError, match="in-situ|insitu"):
        stages._insitu(spark, config.merged(cfg | {"data": {"observations": f"{path}/obs"}}))
    with pytest.raises(ValueError, match="seasonal.method"):
        config.merged({"seasonal": {"method": "x"}})
    assert cli.main(["stage", "validate", str(path / "c.yaml"), "--tag", "none"]) == 1 and "first" in capsys.readouterr().err
    some = config.merged(cfg | {"data": cfg["data"] | {"days": [str(DAYS[4]), str(DAYS[6])]}})
    assert stages.record(spark, some).select("day").distinct().count() == 3


def test_sweep_asks_for_processes_of_this_host(spark, tmp_path):
    dest = f"file://{tmp_path}/t"
    own = sinks.scratch_name(f"{tmp_path}/t")
    os.mkdir(own)
    host = own.rsplit(".part-", 1)[1].split("-")[0]
    os.mkdir(f"{tmp_path}/t.part-{host}-999999999-abc")
    os.mkdir(f"{tmp_path}/t.part-otherhost-1-abc")
    assert sinks.sweep(spark, dest) == 1 and os.path.exists(own) and os.path.exists(f"{tmp_path}/t.part-otherhost-1-abc")
    sinks.write_text(spark, f"file://{tmp_path}/x.json", "é")
    sinks.write_text(spark, f"file://{tmp_path}/x.json", "{}")
    assert (tmp_path / "x.json").read_text() == "{}"
