"""Seasonal cycles, the final fill and held-out scores against plain versions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineloom.operators import fill, seasonal
from brineloom.operators.lowrank import em_fill, em_fill_rows, matrix_rows

DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=3 * i) for i in range(40)]


def record(seed=0, rows=6, cols=8, gaps=0.4):
    rng = np.random.default_rng(seed)
    i, j = np.indices((rows, cols))
    t = np.arange(len(DAYS))
    field = np.sin(i / 3)[..., None] * np.cos(t / 6) + (j / cols)[..., None] * np.sin(t / 9)
    seen = rng.random(field.shape) > gaps
    seen[:, :, 7] = False  # a day without any value
    seen[2, 3] = False  # a pixel without any
    return field, seen


def frame(spark, field, seen, extra=0.0):
    rows = [(int(r * field.shape[1] + c), int(r), int(c), DAYS[d], float(field[r, c, d] + extra)) for r, c, d in np.argwhere(seen)]
    return spark.createDataFrame(rows, "px long, row long, col long, day date, z double")


def test_seeded_rows_equal_the_seeded_matrix(spark):
    field, seen = record()
    values = frame(spark, field, seen)
    x = np.where(seen, field, np.nan).reshape(-1, len(DAYS))
    x = x[np.isfinite(x).any(1)]
    t = np.array([(d - DAYS[0]).days for d in DAYS], float)
    first = em_fill(x, 2, t, max_iter=3)
    ids = sorted(r["px"] for r in values.select("px").distinct().collect())
    start = spark.createDataFrame([(p, w.tolist()) for p, w in zip(ids, first["W"], strict=True)], "px long, w array<double>")
    fit, state = em_fill_rows(matrix_rows(values, DAYS), len(DAYS), 2, t, seed=(first["V"], start), max_iter=2, tol=0, one_task=0)
    one, held = em_fill_rows(matrix_rows(values, DAYS), len(DAYS), 2, t, seed=(first["V"], start), max_iter=2, tol=0)
    assert one.v == pytest.approx(fit.v, abs=1e-6) and one.sigma == pytest.approx(fit.sigma) and one.deltas == pytest.approx(fit.deltas, rel=1e-6) and one.mean == pytest.approx(fit.mean)
    assert {r["px"]: r["w"] for r in held.collect()} == {r["px"]: pytest.approx(r["w"], abs=1e-6) for r in state.collect()}
    none, rows = em_fill_rows(matrix_rows(values.where("false"), DAYS), len(DAYS), 2, t)
    assert rows.count() == 0 and none.deltas == []
    want = em_fill(x, 2, t, seed=first["W"] @ first["V"].T + first["mean"], max_iter=2, tol=0)
    assert np.abs(np.abs(fit.v) - np.abs(want["V"])).max() < 1e-6 and fit.deltas == pytest.approx(want["deltas"], rel=1e-6)
    assert np.abs(want["lowrank"][:, 7] - want["mean"]).max() < 0.2  # without a filter nothing holds the empty day


def test_final_fill_recovers_gaps_and_merges(spark):
    field, seen = record()
    out, choice, fits = fill.final_fill(frame(spark, field, seen), DAYS, 2, cutoffs=(0, 6), ks=(1, 2, 3), tol=1e-5, max_iter=200)
    got = out.toPandas()
    assert len(got) == (field.shape[0] * field.shape[1] - 1) * len(DAYS) and set(fits) == {"point", "day"}
    at = {d: i for i, d in enumerate(DAYS)}
    truth = np.array([field[p // 8, p % 8, at[d]] for p, d in zip(got["px"], got["day"], strict=True)])
    assert np.abs(got["filled"] - truth)[got["observed"]].max() < 1e-9
    hidden = got["constrained"] & ~got["observed"]
    assert np.sqrt(np.mean((got["filled"] - truth)[hidden] ** 2)) < 0.1
    empty = got[~got["constrained"]]
    assert set(empty["day"]) == {DAYS[7]} and (empty["filled"] == empty["filled_day"]).all()
    assert choice.k_point <= 3


def test_choice_takes_the_least_rank_near_the_best():
    rows = [(0.0, 1, 0.5, 0.9), (0.0, 2, 0.5, 0.8), (4.0, 1, 0.4, None), (4.0, 2, 0.301, None), (4.0, 3, 0.3, None)]
    assert fill.choose(rows) == fill.Choice(2, 4.0, 2, 0.0)
    assert fill.choose([(2.0, 3, None, 0.1)]) == fill.Choice(3, 2.0, 3, 2.0)
    with pytest.raises(ValueError):
        fill.choose([(0.0, 1, None, None)])


def test_map_smoothers_agree_and_conserve(spark):
    rng = np.random.default_rng(1)
    mask = rng.random((5, 6)) > 0.2
    x = rng.normal(size=(int(mask.sum()), 3))
    smooth = fill.map_smoother(mask, 5.0)
    assert fill.map_smoother(mask, 0.0) is None and fill.settings(0) == (0.0, 0)
    got = smooth(x)
    assert got.sum(0) == pytest.approx(x.sum(0)) and got.std() < x.std()
    rows = [(int(r), int(c), d, float(x[n, d])) for n, (r, c) in enumerate(np.argwhere(mask)) for d in range(3)]
    out = fill.smooth_maps(spark.createDataFrame(rows, "row long, col long, day int, value double"), 5.0).collect()
    number = {(r, c): n for n, (r, c) in enumerate(map(tuple, np.argwhere(mask)))}
    assert all(r["value"] == pytest.approx(got[number[r["row"], r["col"]], r["day"]]) for r in out)


def test_holdout_scores(spark):
    field, seen = record(gaps=0.2)
    values = frame(spark, field, seen)
    held = values.where(F.col("day").isin(DAYS[10], DAYS[20]) & (F.col("px") % 3 == 0))
    pred, table = fill.holdout_predictions(values, held, DAYS, 2, 0.0, tol=1e-5)
    p, rows = pred.toPandas(), {r["day"]: r for r in table.collect()}
    assert len(p) == held.count() and set(rows) == {DAYS[10], DAYS[20]}
    for d, own in p.groupby("day"):
        e = own["pred"] - own["value"]
        assert (rows[d]["n"], rows[d]["rmse"], rows[d]["bias"]) == (len(own), pytest.approx(np.sqrt((e**2).mean())), pytest.approx(e.mean()))
        assert rows[d]["rmse"] < 0.15


def seasonal_record(spark, rng):
    """A field whose level and cycle change smoothly; thin, empty and one-season pixels."""
    rows, truth = [], {}
    days = [datetime.date(2023, 1, 1) + datetime.timedelta(days=7 * i) for i in range(104)]
    for px in range(48):
        r, c = divmod(px, 8)
        coef = (10 + 0.3 * r, 2 + 0.1 * c, -1 + 0.05 * r)
        truth[px] = coef
        for n, d in enumerate(days):
            w = 2 * np.pi * (d.timetuple().tm_yday - 1) / 365.25
            keep = {20: False, 21: n in (3, 50), 22: d.month in (1, 2)}.get(px, rng.random() < 0.7)
            if keep:
                rows.append((px, d, coef[0] + coef[1] * np.cos(w) + coef[2] * np.sin(w) + rng.normal(0, 0.1)))
    cells = spark.createDataFrame([(px, *divmod(px, 8)) for px in range(48)], "px long, row int, col int")
    return spark.createDataFrame([(p, d, float(v)) for p, d, v in rows], "px long, day date, value double"), cells, truth, rows


def test_seasonal_methods(spark):
    rng = np.random.default_rng(3)
    values, cells, truth, rows = seasonal_record(spark, rng)
    plain = {r["px"]: r for r in seasonal.fit_seasonal(values, cells, floor=0.01).collect()}
    assert len(plain) == 48
    assert {px: plain[px]["fit"] for px in (0, 20, 21, 22)} == {0: seasonal.FULL, 20: seasonal.REFERENCE, 21: seasonal.MEAN_ONLY, 22: seasonal.MEAN_ONLY}
    own = [(d, v) for p, d, v in rows if p == 5]
    w = np.array([2 * np.pi * (d.timetuple().tm_yday - 1) / 365.25 for d, _ in own])
    design = np.column_stack([np.ones_like(w), np.cos(w), np.sin(w)])
    assert plain[5]["coef"] == pytest.approx(np.linalg.lstsq(design, np.array([v for _, v in own]), rcond=None)[0])
    ref = np.mean([plain[p]["coef"] for p in plain if plain[p]["fit"] == seasonal.FULL], axis=0)
    assert plain[20]["coef"] == pytest.approx(ref) and plain[21]["coef"][1:] == pytest.approx(ref[1:])
    assert 0.05 < plain[0]["scale"] < 0.2
    smooth = {r["px"]: r for r in seasonal.fit_seasonal(values, cells, "gmrf", floor=0.01, range_px=6.0).collect()}
    err = lambda got, p: np.abs(np.array(got[p]["coef"]) - truth[p]).max()
    assert err(smooth, 20) < err(plain, 20) and err(smooth, 22) < err(plain, 22) + 0.05 and err(smooth, 0) < 0.2
    assert smooth[20]["fit"] == seasonal.REFERENCE
    mean = seasonal.fit_seasonal(values, cells, "none").collect()
    assert all(r["coef"] == pytest.approx([np.mean([v for _, _, v in rows])]) for r in mean) and len(mean) == 48
    with pytest.raises(ValueError, match="method"):
        seasonal.fit_seasonal(values, cells, "other")
    with pytest.raises(ValueError, match="well-spread"):
        seasonal.fit_seasonal(values.where("px = 21"), cells)
