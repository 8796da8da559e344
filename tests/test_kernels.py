"""Algebra and parameter recovery of the numeric kernels."""

import math

import numpy as np
import pytest

from brineloom import config
from brineloom.operators import detect as D
from brineloom.operators import gmrf as G
from brineloom.operators import lowrank as L
from brineloom.operators import offsets as O
from brineloom.operators import statespace as S


def test_diffusion_keeps_constants_and_mass():
    t = np.cumsum(np.random.default_rng(0).uniform(0.5, 4, 30))
    step = L.diffusion_step(t, 0.05)
    assert np.allclose(step @ np.ones(30), 1)
    m = np.random.default_rng(1).normal(size=(30, 3))
    assert np.allclose(L.cell_widths(t) @ L.diffuse(t, m, 0.05, 5), L.cell_widths(t) @ m)
    with pytest.raises(ValueError):
        L.check_stability(t, 10.0)


def test_filtered_gram_is_symmetric_and_modes_are_orthonormal():
    x = np.random.default_rng(2).normal(size=(80, 12))
    b = L.filtered_gram(np.arange(12.0), x.T @ x, 0.1, 3)
    assert np.array_equal(b, b.T)
    v, lam = L.top_modes(b, 4)
    assert np.allclose(v.T @ v, np.eye(4)) and (np.diff(lam) <= 1e-9).all()
    assert (v[np.abs(v).argmax(0), range(4)] > 0).all()
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    v, _ = L.top_modes(x.T @ x, 3)
    assert np.allclose((x @ v) @ v.T, (u[:, :3] * s[:3]) @ vt[:3])


def rank5(gaps=0.4, seed=3):
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.normal(size=(400, 5)))[0], np.linalg.qr(rng.normal(size=(60, 5)))[0]
    truth = (u * [50, 30, 18, 11, 6]) @ v.T
    x = truth + rng.normal(0, 0.01, truth.shape)
    return truth, np.where(rng.random(x.shape) < gaps, np.nan, x)


def test_em_recovers_rank_five():
    truth, x = rank5()
    r = L.em_fill(x, 5, np.arange(60.0), tol=1e-5, max_iter=300)
    gap = np.isnan(x)
    assert np.sqrt(np.mean((r["filled"] - truth)[gap] ** 2)) < 0.1 * truth[gap].std()
    assert np.array_equal(r["filled"][~gap], x[~gap] - r["mean"] + r["mean"])


def test_pick_k_is_parsimonious():
    assert L.pick_k([1, 2, 3, 4], [2.0, 1.009, 1.0, 1.2], 0.01) == 2


def test_loadings_are_exact_with_own_data_and_climatology_out_of_reach():
    rng = np.random.default_rng(4)
    u, true = rng.normal(size=(50, 2)), rng.normal(size=(6, 2))
    a = np.repeat((u.T @ u)[None], 6, axis=0)
    b = true @ (u.T @ u)
    n = np.array([50, 50, 50, 50, 50, 0])
    out, status = L.reference_loadings(a, b, n, np.arange(6.0), 0.0, 0, ridge=1e-12)
    assert np.allclose(out[:5], true[:5], atol=1e-6) and status.tolist() == [2] * 5 + [0] and not out[5].any()


def test_log_ndtr_matches_erfc_and_its_tail():
    x = np.linspace(-19, 8, 200)
    assert np.allclose(D.log_ndtr(x), [math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in x], rtol=1e-9)
    assert abs(D.log_ndtr(np.array([-25.0]))[0] - math.log(0.5 * math.erfc(25 / math.sqrt(2)))) < 1e-6


def test_ising_fills_a_hole_and_respects_the_mask():
    u = np.full((9, 9), -3.0)
    u[2:7, 2:7] = 3.0
    u[4, 4] = -1.0
    valid = np.ones((9, 9), bool)
    valid[0] = False
    q = D.ising(u, valid, 2.0, 20)
    assert q[4, 4] > 0.5 and (q[0] == 0).all() and q[8, 8] < 0.1


def test_shorth_and_few_values():
    assert D.shorth(np.array([0, 1.0, 1.1, 1.2, 9]))[0] == pytest.approx(1.1)
    assert D.center_and_scale(np.arange(10.0)) == (0.0, 1.0)


def test_mixture_finds_cold_patches():
    rng = np.random.default_rng(5)
    y = 285 + rng.normal(0, 0.2, (24, 24))
    patch = np.zeros((24, 24), bool)
    patch[5:12, 5:12] = True
    y[patch] -= 4
    r = D.classify(y, np.ones((24, 24), bool), np.full((24, 24), 284.0), np.zeros((24, 24), bool), D.Mixture())
    bad = r["p_valid"] < 0.5
    assert bad[patch].mean() > 0.9 and bad[~patch].mean() < 0.02 and r["center"] == pytest.approx(1.0, abs=0.2)


def test_gmrf_without_data_is_the_prior_and_interpolates():
    mask = np.ones((20, 20), bool)
    prior = np.full((20, 20), 3.0)
    assert np.allclose(G.solve(np.full((20, 20), np.nan), mask, prior, 6, 1.0, 0.01), 3.0)
    obs = np.full((20, 20), np.nan)
    obs[10, 10] = 5.0
    out = G.solve(obs, mask, prior, 6, 1.0, 1e-4)
    assert out[10, 10] == pytest.approx(5.0, abs=0.05) and 3 < out[0, 0] < out[10, 12] < 5
    kappa2, lam = G.spde_params((40, 40), 8, 1.5)
    q = (lam * (kappa2 + G.dct2_eigenvalues((40, 40)))) ** 2
    assert np.mean(1 / q) == pytest.approx(1.5**2)


def test_ar1_is_recovered():
    rng = np.random.default_rng(6)
    x = np.zeros(500)
    for t in range(1, 500):
        x[t] = 0.8 * x[t - 1] + rng.normal(0, 0.5)
    y = (12 + x + rng.normal(0, 0.3, 500))[:, None]
    y[100:110] = np.nan
    r = S.fit("ar1", y, np.zeros((500, 1), int), np.arange(500.0) % 365, 1)
    assert r["theta"]["phi"] == pytest.approx(0.8, abs=0.12) and r["theta"]["mu"] == pytest.approx(12, abs=0.5)
    assert np.sqrt(np.mean((r["smooth"] - 12 - x) ** 2)) < 0.4


@pytest.mark.parametrize("model", S.MODELS)
def test_models_smooth_without_failing(model):
    t = np.arange(120.0)
    y = (5 + np.sin(2 * np.pi * t / 365.25))[:, None]
    r = S.fit(model, y, np.zeros((120, 1), int), t, 1)
    assert np.isfinite(r["smooth"]).all() and np.abs(r["smooth"] - y[:, 0]).max() < 1


def test_unknown_model_is_an_error():
    with pytest.raises(ValueError):
        S.build("loess", {"var_state": 1.0}, np.arange(3.0), 1)


def test_harmonic_ladder_drops_a_useless_term_and_keeps_a_real_one():
    rng = np.random.default_rng(7)
    h, w = rng.uniform(0, 24, 60), np.ones(60)
    assert O.harmonic_ladder(h, 2 * np.cos(2 * np.pi * h / 24) + rng.normal(0, 0.1, 60), w, 1)[0] == 1
    assert O.harmonic_ladder([10.0] * 20, rng.normal(size=20), np.ones(20), 1)[0] == 0


def test_config_rejects_what_is_unknown():
    assert config.merged({"loop": {"k": 3}})["loop"]["k"] == 3
    for bad in ({"lop": {}}, {"loop": {"kk": 1}}, {"loop": {"max_iter": 99}}, {"validation": {"boxes": [4]}}, {"filter": {"offset_lower": 5, "offset_upper": 1}}):
        with pytest.raises(ValueError):
            config.merged(bad)
