"""Detectors, the loop's options, offset models and state-space groups."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineloom.operators import detect, loop, offsets, points, statespace

DAY = datetime.date(2024, 1, 1)


def scene(seed=0, n=24, patch=6):
    rng = np.random.default_rng(seed)
    i, j = np.indices((n, n))
    truth = 285 + np.sin(i / 6) + 0.5 * np.cos(j / 5)
    y = truth + 1.5 + rng.normal(0, 0.15, truth.shape)
    cloud = (i >= 4) & (i < 4 + patch) & (j >= 8) & (j < 8 + patch)
    y[cloud] -= 5 + rng.random(int(cloud.sum()))
    water = rng.random(truth.shape) > 0.05
    y[rng.random(truth.shape) < 0.05] = np.nan
    return truth, y, water, cloud


@pytest.mark.parametrize("method", sorted(detect.METHODS))
def test_detectors_find_a_cold_patch(method):
    truth, y, water, cloud = scene()
    r = detect.METHODS[method](y, water, truth, np.zeros(y.shape, bool), detect.Mixture())
    seen = water & np.isfinite(y)
    bad = r["p_valid"] < 0.5
    assert bad[seen & cloud].mean() > 0.95 and bad[seen & ~cloud].mean() < 0.03
    assert abs(r["center"] - 1.5) < 0.2 and ((r["q_cloud"] + r["q_warm"])[water] <= 1 + 1e-9).all()


def test_alternating_field_learns_what_the_prior_lacks():
    truth, y, water, cloud = scene()
    flat = np.full(truth.shape, truth.mean())
    r = detect.alternate(y, water, flat, np.zeros(y.shape, bool), detect.Mixture(), detect.Analysis(range_px=10.0, field_sd=1.0))
    ok = water & ~cloud
    e = (r["analysis"] + r["center"] - 1.5 - truth)[ok]
    assert np.sqrt(np.mean((e - e.mean()) ** 2)) < 0.5 * truth[ok].std() and r["converged"]
    assert len(r["history"]) >= 3 and r["sd"] >= 0.2 - 1e-9
    with pytest.raises(ValueError, match="observed"):
        detect.alternate(np.full(truth.shape, np.nan), water, flat, np.zeros(y.shape, bool), detect.Mixture())


def test_em_moves_towards_the_scene():
    truth, y, water, cloud = scene()
    r = detect.mixture_em(y, water, truth, np.zeros(y.shape, bool), detect.Mixture())
    assert len(r["history"]) == 20 and 0.1 < r["sd"] < 0.3
    steps = [h["sd"] for h in r["history"]]
    assert abs(steps[-1] - steps[-2]) < abs(steps[1] - steps[0]) + 1e-9
    assert 1 / r["cold_rate"] == pytest.approx(5.5, abs=1.0)  # the patch's mean deviation


def test_scene_methods_by_name(spark):
    x = spark.createDataFrame([("a", DAY, i, j, 285.0 + i * 0.01, 285.0, False) for i in range(9) for j in range(9)] + [("a", DAY + datetime.timedelta(1), i, j, None, 285.0, False) for i in range(9) for j in range(9)], "sensor string, day date, row int, col int, value double, base double, flagged boolean")
    for method in detect.METHODS:
        assert detect.classify_scenes(x, 9, 9, method=method).count() == 162
    with pytest.raises(ValueError, match="method"):
        detect.classify_scenes(x, 9, 9, method="none")


def loop_pixels(spark, reference=False):
    rng = np.random.default_rng(5)
    days = [DAY + datetime.timedelta(i) for i in range(12)]
    data, bad = [], set()
    for d, day in enumerate(days):
        cold, r0, c0 = d % 3 == 0, int(rng.integers(0, 8)), int(rng.integers(0, 8))
        for i in range(12):
            for j in range(12):
                v = 285 + np.sin(d / 3) * i / 12 + rng.normal(0, 0.1)
                if reference and d % 2 == 0:
                    data.append(("ref", day, i * 12 + j, i, j, float(v), 285.0, 1.0, False))
                if cold and r0 <= i < r0 + 4 and c0 <= j < c0 + 4:
                    v -= 4
                    bad.add((day, i * 12 + j))
                data.append(("eco", day, i * 12 + j, i, j, float(v), 285.0, 1.0, False))
    return spark.createDataFrame(data, "sensor string, day date, px int, row int, col int, value double, seasonal double, scale double, flagged boolean"), days, bad


@pytest.mark.parametrize("kw", [{"t_c": 4.0}, {"source": "reference", "reference": "ref", "loading_t_c": 6.0}])
def test_loop_with_filter_seed_and_reference(spark, kw):
    x, days, bad = loop_pixels(spark, reference="reference" in kw)
    out, history = loop.cloud_loop(x, days, 12, 12, k=1, max_iter=3, **kw)
    got = {(r["day"], r["px"]): r["keep"] for r in out.where("sensor = 'eco'").collect()}
    removed = {k for k, v in got.items() if not v}
    assert len(removed & bad) > 0.9 * len(bad) and len(removed - bad) < 0.05 * len(got)
    if "reference" in kw:
        assert set(history[0]["status"]) == {1, 2}  # days of their own, and pooled ones
    if len(history) > 2:
        assert history[2]["em"][0] < history[1]["em"][0]  # started from the last round


def test_loop_gates_whole_scenes_and_takes_nothing(spark):
    x, days, _ = loop_pixels(spark, reference=True)  # the reference has no second day
    off = x.withColumn("value", F.col("value") + F.when(F.col("day") == days[1], 9.0).otherwise(0.0))
    out, _ = loop.cloud_loop(off, days, 12, 12, k=1, max_iter=1, source="reference", reference="ref", loading_t_c=6.0, center_range=(-3.0, 3.0), min_kept_frac=0.2)
    assert out.where((F.col("day") == days[1]) & F.col("keep")).count() == 0 and out.where("keep").count() > 1000
    none, history = loop.cloud_loop(x.where("false"), days, 12, 12)
    assert none.count() == 0 and history == []
    with pytest.raises(ValueError, match="source"):
        loop.cloud_loop(x, days, 12, 12, source="reference")


def test_offset_models(spark):
    rng = np.random.default_rng(0)
    h = rng.uniform(0, 24, 60)
    y = 0.5 + 0.8 * np.cos(2 * np.pi * h / 24) + rng.normal(0, 0.05, 60)
    r = offsets.fit_offset_model(h, y, np.ones(60))
    assert r["harmonics"] == 1 and r["coef"] == pytest.approx([0.5, 0.8, 0.0], abs=0.05)
    assert offsets.offset_at([float("nan"), 0.0], r["coef"])[0] == pytest.approx(r["coef"][0])
    few = offsets.fit_offset_model(h[:5], y[:5], np.ones(5))
    assert few["few"] and few["harmonics"] == 0 and few["coef"] == pytest.approx([y[:5].mean()])
    with pytest.raises(ValueError, match="outside"):
        offsets.fit_offset_model(h, y + 9, np.ones(60))
    with pytest.raises(ValueError, match="no matchup"):
        offsets.fit_offset_model([], [], [])
    rows = [("a", float(p), float(q), 1.0) for p, q in zip(h, y, strict=True)] + [("b", None, 1.0, 1.0), ("b", 3.0, 2.0, 3.0)]
    got = {r["sensor"]: r for r in offsets.fit_offsets(spark.createDataFrame(rows, "sensor string, hour double, delta double, w double")).collect()}
    assert got["a"]["harmonics"] == 1 and got["b"]["coef"] == pytest.approx([1.75])


def simulate(model, rng, t, phi=0.8, mu=15.0, q=0.2, var=(0.05, 0.4), gaps=0.3, bias=0.0):
    x, out = mu, np.empty(t)
    for i in range(t):
        x = mu + phi * (x - mu) + rng.normal(0, q**0.5) if model.startswith("ar1") else x + rng.normal(0, q**0.5)
        out[i] = x
    doy = np.arange(t) % 365.0
    if "harmonic" in model:
        out = out + 3 * np.cos(2 * np.pi * doy / 365.25)
    y = out[:, None] + rng.normal(size=(t, 2)) * np.sqrt(var) + np.array([0.0, bias])
    y[rng.random(y.shape) < gaps] = np.nan
    return out, statespace.Series(y, np.tile(np.arange(2), (t, 1)), doy)


@pytest.mark.parametrize("model", statespace.MODELS)
@pytest.mark.filterwarnings("error::RuntimeWarning")
def test_parameters_are_recovered(model):
    truth, s = simulate(model, np.random.default_rng(4), 500)
    r = statespace.fit(model, s.y, s.kinds, s.doy, 2)
    assert 0.5 < r["theta"]["var_state"] / 0.2 < 2 and 0.5 < r["var_obs"][1] / 0.4 < 2 and r["var_obs"][0] < 0.15
    if model.startswith("ar1"):
        assert abs(r["theta"]["phi"] - 0.8) < 0.12 and abs(r["theta"]["mu"] - 15) < (0.6 if model == "ar1" else 1.5)
    assert np.sqrt(np.mean((r["smooth"] - truth) ** 2)) < 0.35
    assert 0.85 < np.mean(np.abs(r["smooth"] - truth) < 1.96 * r["sd"]) <= 1


def test_groups_share_and_take_out_a_bias():
    rng = np.random.default_rng(7)
    sites = [simulate("ar1", rng, 160, bias=1.0) for _ in range(3)]
    shared = statespace.fit_group("ar1", [s for _, s in sites], 2, share=["var_state", "phi", "var_obs", "bias"], biased=[1])
    assert len({r["theta"]["var_state"] for r in shared}) == 1 and len({r["theta"]["mu"] for r in shared}) == 3
    assert all(r["bias"][0] == pytest.approx(1.0, abs=0.25) for r in shared)
    alone = statespace.fit_group("ar1", [s for _, s in sites], 2, biased=[1])
    one = statespace.fit_group("ar1", [sites[1][1]], 2, biased=[1])[0]
    assert alone[1]["smooth"] == pytest.approx(one["smooth"])
    assert sum(r["log_likelihood"] for r in alone) >= sum(r["log_likelihood"] for r in shared) - 1e-3
    with pytest.raises(ValueError, match="share"):
        statespace.fit_group("ar1", [sites[0][1]], 2, share=["other"])


def test_first_type_of_a_day():
    n = float("nan")
    got = statespace.first_type(np.array([[n, 2.0], [1.0, 2.0], [n, n]]))
    assert np.array_equal(got, np.array([[n, 2.0], [1.0, n], [n, n]]), equal_nan=True)


def test_points_are_smoothed_and_evaluated(spark):
    rng = np.random.default_rng(2)
    rows, insitu = [], []
    for site in ("p", "q", "r"):
        truth, s = simulate("random_walk", rng, 60, q=0.05)
        rows += [("g", site, DAY + datetime.timedelta(i), "filled", float(s.y[i, 0])) for i in range(60) if np.isfinite(s.y[i, 0])]
        insitu += [(site, DAY + datetime.timedelta(i), float(truth[i] + 0.7)) for i in range(0, 60, 2)]
    series = spark.createDataFrame(rows, "grp string, site string, day date, type string, value double")
    out = points.smooth_points(series, "random_walk", ["filled"], share=["var_state", "var_obs"])
    assert out.count() == 180
    carried = spark.createDataFrame(insitu, "site string, day date, insitu double")
    fit, metrics = points.evaluate(out, points.insitu_daily(None, carried))
    m = {r["site"]: r for r in metrics.collect()}
    assert set(m) == {"p", "q", "r", "all"} and m["all"]["n"] == 90 and fit["form"] == "constant"
    assert m["all"]["bias_before"] == pytest.approx(-0.7, abs=0.15) and abs(m["all"]["bias_after"]) < 1e-6 and m["all"]["rmse_after"] < m["all"]["rmse_before"]
    both = points.insitu_daily(carried.where("site = 'p'").withColumn("insitu", F.lit(1.0)), carried)
    assert both.count() == 90 and {r["insitu"] for r in both.where("site = 'p'").collect()} == {1.0}
    with pytest.raises(ValueError):
        points.insitu_daily(None, None)
    with pytest.raises(ValueError, match="no day"):
        points.evaluate(out, carried.where("false"))
