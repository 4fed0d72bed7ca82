import numpy as np
import pytest

from pixelloom.operators import stencil as N

FLAT = np.full((1, 9, 9), 7.0)
SPOT = np.zeros((1, 9, 9))
SPOT[0, 4, 4] = 1


def test_constant_tile():
    assert np.allclose(N.box_mean(3)(FLAT), 7) and np.allclose(N.box_std(3)(FLAT), 0, atol=1e-6)
    for f in (N.sobel_h, N.sobel_v, N.laplace_of_gaussian(2), N.difference_of_gaussians(1, 2)):
        assert np.allclose(f(FLAT), 0, atol=1e-2)
    assert np.allclose(N.local_entropy(5)(FLAT), 0)


def test_box_mean_mirrors_the_border():
    x = np.arange(5.0).reshape(1, 1, 5).repeat(5, 1)
    padded = np.pad(x, ((0, 0), (2, 2), (2, 2)), mode="symmetric")
    want = np.lib.stride_tricks.sliding_window_view(padded, (5, 5), (1, 2)).mean((-2, -1))
    assert np.allclose(N.box_mean(2)(x), want)
    assert np.allclose(N.box_mean(15)(x).shape, x.shape)  # a window larger than the tile


def test_impulse_gives_the_kernel():
    assert N.gaussian(1.0)(SPOT).sum() == pytest.approx(1)
    assert N.sobel_h(SPOT)[0, 3, 4] == pytest.approx(0.5) and N.sobel_h(SPOT)[0, 5, 4] == pytest.approx(-0.5)


def test_ramp_is_anisotropic():
    x = np.arange(16.0).reshape(1, 16, 1).repeat(16, 2)
    assert N.tensor_part("anisotropy")(x)[0, 8, 8] > 0.95


def test_distance_transform_is_exact():
    m = np.random.default_rng(1).random((3, 12, 10)) < 0.1
    m[2] = False
    got = N.distance_to(m)
    for k in range(2):
        at = np.argwhere(m[k])
        want = np.sqrt(((np.argwhere(np.ones((12, 10)))[:, None] - at[None]) ** 2).sum(-1).min(1)).reshape(12, 10)
        assert np.allclose(got[k], want)
    assert np.isinf(got[2]).all()


def test_lbp_of_a_flat_tile_is_all_ones_inside():
    assert N.uniform_lbp(1)(FLAT)[0, 4, 4] == pytest.approx(0.8)


def test_glcm_of_flat_and_tiny_patches():
    p = dict(zip(N.GLCM_PROPS, N.glcm(np.full((5, 5), 64.0))))
    assert p == {"contrast": 0, "dissimilarity": 0, "homogeneity": 1, "energy": 1, "correlation": 1, "asm": 1}
    assert not N.glcm(np.ones((2, 4))).any()


def test_superpixels_cover_the_tile():
    s = N.superpixels(np.random.default_rng(2).random((32, 32)) * 255, 16)
    assert s.shape == (32, 32) and set(np.unique(s)) == set(range(s.max() + 1)) and s.max() >= 8


def test_gabor_answers_its_own_frequency():
    x = np.cos(2 * np.pi * 0.2 * np.arange(64))[None, None].repeat(64, 1)
    along, across = N.gabor(0.2, 0.0)(x)[0, 32], N.gabor(0.2, np.pi / 2)(x)[0, 32]
    assert np.abs(along).max() > 10 * np.abs(across).max()
