"""Operators on small inline tables: gaps, ties, single rows, tolerances, cycles."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineloom.operators import composite, detect, filters, joins, loop, lowrank, offsets, stats, stencil
from brineloom.operators.calibrate import fit_offset
from brineloom.sources import readers, sinks
from brineloom.streaming.daily import daily_means, qc_stream

DAY = datetime.date(2024, 1, 1)
NAN = float("nan")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_predicates_and_specs():
    with pytest.raises(ValueError):
        filters.compile_predicate([])
    with pytest.raises(ValueError):
        filters.Criterion.of({"channel": "a", "value": 1, "prop": 2})
    with pytest.raises(ValueError):
        filters.Criterion.of({"channel": "a", "value": 1, "prop": 0.5, "colour": 1})
    two = [filters.Criterion("a", 1, 0.5), filters.Criterion("a", 1, 0.7)]
    assert filters.unique_labels(two) == ["a 1", "a 1 #2"]


def test_nan_policies(spark):
    x = spark.createDataFrame([(DAY, 1.0), (DAY, NAN), (DAY, None), (DAY, 0.0)], "day date, v double")
    got = filters.evaluate(x, [filters.Criterion("v", ">0.5", 0.4, p, f"of {p}") for p in filters.POLICIES], ("day",)).first()
    assert tuple(got[f"of {p}"] for p in filters.POLICIES) == (0.25, 0.5, 0.75) and got["valid"] is False
    with pytest.raises(ValueError):
        filters.evaluate(x, [filters.Criterion("v", 1, 0.4, label="valid")])
    gone = x.where("isnan(v)")
    assert filters.evaluate(gone, [filters.Criterion("v", 1, 0.0, "ignore", "i")]).first()["pass: i"] is False


def test_composite_sd_and_bits(spark):
    x = spark.createDataFrame([("a", DAY, 1, 1.0), ("b", DAY, 1, 3.0), ("a", DAY, 2, 5.0), ("b", DAY, 2, None)], "sensor string, day date, px int, value double")
    got = {r["px"]: r for r in composite.weighted_composite(x, ["a", "b"], {"a": 1, "b": 1}).collect()}
    assert got[1]["mean"] == 2 and got[1]["src"] == 3 and got[1]["sd"] == pytest.approx(2**0.5) and got[2]["sd"] is None and got[2]["src"] == 1
    assert composite.weighted_composite(x, ["a", "b"], min_members=2).where("px = 2").first()["src"] == 0


def test_nearest_in_time_ties_and_tolerance(spark):
    ts = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    t = spark.createDataFrame([(1, ts(20)), (1, ts(50)), (2, ts(0))], "station int, target timestamp_ntz")
    o = spark.createDataFrame([(1, ts(10), 1.0), (1, ts(30), 2.0), (1, ts(40), None), (2, ts(11), 9.0)], "station int, ts timestamp_ntz, value double")
    for fn in (joins.nearest_in_time, joins.nearest_by_cells):
        assert rows(fn(t, o, ["station"], 20).select("station", F.second("target"), "value", "dt")) == [(1, 20, 1.0, 10), (1, 50, 2.0, 20), (2, 0, 9.0, 11)]
        assert rows(fn(t, o, ["station"], 10).select("station", "value")) == [(1, 1.0)]


def test_nearest_in_time_is_linear_and_split_in_time(spark):
    """No frame up to the end of a group, many tasks for one group, the same pairs across their borders."""
    hour = "timestampadd(SECOND, cast(id * {} as int), timestamp_ntz'2024-01-01 00:00:00')"
    t = spark.range(3000).select(F.lit(1).alias("station"), F.expr(hour.format(37)).alias("target"))
    o = spark.range(4000).where("id % 11 < 7").select(F.lit(1).alias("station"), F.expr(hour.format(29)).alias("ts"), F.col("id").cast("double").alias("value"))
    out = joins.nearest_in_time(t, o, ["station"], 60)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "__c" in plan
    assert rows(out.select("target", "ts", "value", "dt")) == rows(joins.nearest_by_cells(t, o, ["station"], 60).select("target", "ts", "value", "dt"))


def test_nearest_cell_is_within_the_radius(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "station int, x double, y double")
    c = spark.createDataFrame([(1, 1.0, 0.0), (2, -0.9, 0.0), (3, 0.0, 5.0)], "px int, x double, y double")
    assert rows(joins.nearest_cell(p, c, 2.0).select("station", "px")) == [(1, 2)]


def test_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(0)
    g = rng.integers(0, 2, (12, 12))
    cells = spark.createDataFrame([(0, int(i), int(j), int(g[i, j])) for i in range(12) for j in range(12)], "day int, row int, col int, value int")
    got = {(r["row"], r["col"]): r["label"] for r in stencil.components(cells, ["day"]).collect()}
    want, todo = {}, [(i, j) for i in range(12) for j in range(12)]
    for at in todo:
        if at in want:
            continue
        stack, own = [at], []
        want[at] = None
        while stack:
            i, j = stack.pop()
            own.append((i, j))
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < 12 and 0 <= b < 12 and (a, b) not in want and g[a, b] == g[i, j]:
                    want[a, b] = None
                    stack.append((a, b))
        for c in own:
            want[c] = min(i * 1_000_003 + j for i, j in own)
    assert got == want


def test_shorth_of_few_and_of_ties(spark):
    x = spark.createDataFrame([("a", float(i % 3)) for i in range(90)] + [("b", 1.0)], "g string, value double")
    got = {r["g"]: r for r in stats.shorth(x, ["g"]).collect()}
    assert got["b"]["center"] == 0.0 and got["b"]["scale"] == 1.0 and got["a"]["width"] == 1.0


def test_auc_with_ties_and_one_class(spark):
    x = spark.createDataFrame([(1, 1.0, True), (1, 1.0, False), (1, 2.0, True), (1, 0.0, False), (2, 1.0, True)], "g int, s double, p boolean")
    assert rows(stats.auc(x, ["g"], "s", "p")) == [(1, 0.875), (2, None)]


def test_clipping_ends(spark):
    rng = np.random.default_rng(1)
    d = [("s", DAY + datetime.timedelta(int(i % 5)), int(i), 10.0, 11.0 + float(rng.normal(0, 0.1)) + (8 if i % 17 == 0 else 0)) for i in range(120)]
    x = spark.createDataFrame(d, "sensor string, day date, px long, x double, y double")
    out, n, settled = offsets.clip_pairs(x, 3.0)
    assert settled and n < 20 and out.where("not kept").count() >= 8 and out.where("kept and y > 15").count() == 0


def test_rma_and_recommendation(spark):
    x = spark.createDataFrame([("s", float(i), 1.5 * i + 2) for i in range(10)], "sensor string, x double, y double")
    r = offsets.fit_rma(x).first()
    assert r["slope"] == pytest.approx(1.5) and r["off"] == pytest.approx(2.0) and r["valid"]
    got = spark.range(1).select(offsets.recommend(F.lit(1.0), F.lit(0.97), F.lit(True)).alias("a"), offsets.recommend(F.lit(1.0), F.lit(0.99), F.lit(True)).alias("b")).first()
    assert tuple(got) == ("rma", "fixed")


def test_bootstrap_covers_the_mean(spark):
    x = spark.createDataFrame([("s", DAY + datetime.timedelta(i), float(i)) for i in range(30)], "sensor string, day date, v double")
    r = offsets.scene_bootstrap(x, lambda: F.avg("v"), n_boot=100).first()
    assert r["low"] < 14.5 < r["high"] and r["high"] - r["low"] < 12


def test_calibration_selects_the_right_form(spark):
    days = [DAY + datetime.timedelta(i) for i in range(300)]
    rng = np.random.default_rng(2)
    make = lambda f: spark.createDataFrame([(s, d, float(f(d.timetuple().tm_yday - 1) + rng.normal(0, 0.1))) for s in ("a", "b", "c") for d in days], "site string, day date, error double")
    for selection in ("aic", "loso_cv"):
        assert fit_offset(make(lambda t: 1.0 + np.cos(2 * np.pi * t / 365.25)), selection)["form"] == "seasonal"
        got = fit_offset(make(lambda t: 0.7), selection, min_gain=20.0 if selection == "aic" else 0.0)
        assert got["coef"][0] == pytest.approx(0.7, abs=0.05)
    with pytest.raises(ValueError):
        fit_offset(make(lambda t: 0.0), "guess")


def test_distributed_em_equals_the_one_in_memory(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 12)) + 5
    gap = rng.random(x.shape) < 0.3
    data = [(i, [None if gap[i, j] else float(x[i, j]) for j in range(12)]) for i in range(60)]
    m = spark.createDataFrame(data, "px long, z array<double>").repartition(3)
    t = np.arange(12.0)
    fit, state = lowrank.em_fill_rows(m, 12, 2, t, 0.05, 2, 1e-4, 12, one_task=0)
    one = lowrank.em_fill(np.where(gap, np.nan, x), 2, t, 0.05, 2, 1e-4, 12)
    assert np.allclose(fit.deltas, one["deltas"], rtol=1e-6)
    got = {r["px"]: r["filled"] for r in lowrank.reconstruct_rows(state, fit).collect()}
    assert np.allclose([got[i] for i in range(60)], np.where(gap, one["filled"], x), atol=1e-6)


def test_cross_validation_runs_a_task_a_cutoff(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 2)) @ rng.normal(size=(2, 20))
    x[rng.random(x.shape) < 0.3] = np.nan
    got = lowrank.cv_grid(spark, x, np.arange(20.0), [0.0, 4.0], [1, 2, 3], max_iter=20).toPandas()
    assert set(got["t_c"]) == {0.0, 4.0} and len(got) <= 6
    off = got[got["t_c"] == 0.0].set_index("k")["rmse_points"].dropna()
    assert off.empty or off[2] < off[1]


def test_loop_finds_patches_and_keeps_history(spark):
    rng = np.random.default_rng(5)
    days = [DAY + datetime.timedelta(i) for i in range(12)]
    data, bad = [], set()
    for d, day in enumerate(days):
        cold, r0, c0 = d % 3 == 0, int(rng.integers(0, 8)), int(rng.integers(0, 8))
        for i in range(12):
            for j in range(12):
                v = 285 + np.sin(d / 3) * i / 12 + rng.normal(0, 0.1)
                if cold and r0 <= i < r0 + 4 and c0 <= j < c0 + 4:
                    v -= 4
                    bad.add((day, i * 12 + j))
                data.append(("eco", day, i * 12 + j, i, j, float(v), 285.0, 1.0, False))
    x = spark.createDataFrame(data, "sensor string, day date, px int, row int, col int, value double, seasonal double, scale double, flagged boolean")
    out, history = loop.cloud_loop(x, days, 12, 12, k=1, max_iter=2)
    got = {(r["day"], r["px"]): (r["keep"], r["bits"]) for r in out.collect()}
    removed = {k for k, v in got.items() if not v[0]}
    assert len(removed & bad) > 0.9 * len(bad) and len(removed - bad) < 0.03 * len(got)
    assert all(b & 1 for _, b in got.values()) and len(history) <= 2
    own = [d for _, c in loop.windows(days, 5, 2) for d in c]
    assert own == days


def test_classify_scenes_keeps_every_cell(spark):
    x = spark.createDataFrame([("a", DAY, i, j, 285.0 + i * 0.01, 285.0, False) for i in range(9) for j in range(9)], "sensor string, day date, row int, col int, value double, base double, flagged boolean")
    assert detect.classify_scenes(x, 9, 9).where("p_valid > 0.5").count() == 81


def test_replace_upsert_and_sweep(spark, tmp_path):
    dest = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.replace_table(a, dest)
    b = sinks.upsert(a, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    sinks.replace_table(b, dest)
    assert rows(spark.read.parquet(dest)) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception):
        sinks.replace_table(a.select(F.raise_error(F.lit("no"))), dest)
    assert rows(spark.read.parquet(dest)) == [(1, "a"), (2, "c")] and [p.name for p in tmp_path.iterdir() if "part" in p.name] == []
    (tmp_path / "t.part-x").mkdir()
    assert sinks.sweep(spark, dest) == 0 and sinks.sweep(spark, dest, -1) == 1
    assert sinks.provenance(spark, {"a": 1}).first()["config_key"] == sinks.config_key({"a": 1})


def test_station_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("station_id,time,latitude,longitude,value,z\na,2024-01-01 00:00:00,48.1,-122.6,10.5,1\na,nonsense,48.1,-122.6,10.5,1\na,2024-01-01 01:00:00,48.1,-122.6,,1\na,2024-01-01 02:00:00,48.1,-122.6,9,50\nb,2024-01-01 03:00:00,48.1,-122.6,8,\n")
    got = readers.read_csv_stations(spark, str(p), max_depth_m=5, timezone="America/Los_Angeles")
    assert [(r["station_id"], r["value_c"], r["time"].hour) for r in got.orderBy("station_id").collect()] == [("a", 10.5, 8), ("b", 8.0, 11)]
    with pytest.raises(ValueError):
        readers.read_csv_stations(spark, str(p), {"value": "sst"})


def test_handoff_points_and_projection(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"sensors": {"eco": {"label": "E", "recommended": "fixed", "chosen": "rma", "models": {"fixed": {"off": 1.0, "slope": 1.0}, "rma": {"off": 2.0, "slope": 1.1}}}}}')
    assert tuple(readers.read_offsets(spark, str(tmp_path / "o.json")).first()) == ("eco", "rma", 2.0, 1.1)
    (tmp_path / "p.csv").write_text("site_id,lat,lon\nx,48.0,-123.0\n")
    p = readers.read_points(spark, str(tmp_path / "p.csv"))
    assert p.first()["grp"] == "default"
    e, n = readers.utm(F.col("lat"), F.col("lon"), 10)
    got = p.select(e, n).first()
    assert got[0] == pytest.approx(500000, abs=0.01) and got[1] == pytest.approx(5316300, abs=600)


def test_stream_equals_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    data = [(i % 2, base + datetime.timedelta(hours=i), float(i)) for i in range(60)]
    x = spark.createDataFrame(data, "station int, ts timestamp, value double")
    x.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    q = daily_means(qc_stream(s, 0, 100), 0.4).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = rows(spark.table("daily").select("station", F.col("day").cast("string"), F.coalesce("value", F.lit(-1.0))))
    want = rows(joins.daily_means(x, 0.4).select("station", F.col("day").cast("string"), F.coalesce("value", F.lit(-1.0))))
    assert got == want


def test_sample_products_hold_all_stations(spark, monkeypatch):
    from brineloom.plans import joins

    cells = spark.range(275_000).selectExpr("id as px", "date '2024-01-01' as day", "cast(id as double) as value")
    monkeypatch.setattr(joins, "obs", lambda spark, sf: cells)
    assert joins.join09(spark, "").count() == 275_000
