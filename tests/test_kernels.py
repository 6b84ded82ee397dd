import numpy as np
import pytest

from sigweave.functions import kernels as k

RNG = np.random.default_rng(0)


def test_welch_finds_a_sine():
    t = np.arange(1024) / 128
    f, p = k.welch(np.sin(2 * np.pi * 10 * t)[None], 128)
    assert f[p[0].argmax()] == 10
    assert np.trapezoid(p[0], f) == pytest.approx(0.5, rel=0.02)


def test_band_of_one_bin_is_zero():
    f = np.arange(5.0)
    assert k.band_integral(f, np.ones((1, 5)), [(2, 3), (0, 4)])[0].tolist() == [0, 3]


def test_simpson_is_exact_for_parabolas():
    for n in (5, 6, 9):
        x = np.linspace(0, 1, n)
        assert k.simpson((x**2)[None], x[1])[0] == pytest.approx(1 / 3)


def test_envelope_of_a_cosine_is_one():
    x = np.cos(2 * np.pi * 8 * np.arange(64) / 64)
    assert np.allclose(k.analytic_envelope(x[None]), 1)


def test_fourier_resample_keeps_a_sine():
    x = np.sin(2 * np.pi * 3 * np.arange(60) / 60)
    for n in (30, 45, 120):
        assert np.allclose(k.fourier_resample(x[None], n)[0], np.sin(2 * np.pi * 3 * np.arange(n) / n), atol=1e-9)


def test_fir_band_pass_gain():
    taps = k.fir_taps(300, 8, 50)
    assert len(taps) % 2 == 1
    gain = lambda f: abs((taps * np.exp(-2j * np.pi * f / 300 * np.arange(len(taps)))).sum())
    assert gain(25) == pytest.approx(1, abs=0.01) and gain(2) < 0.01 and gain(90) < 0.01
    notch = k.notch_taps(300, 50, 2)
    gain = lambda f: abs((notch * np.exp(-2j * np.pi * f / 300 * np.arange(len(notch)))).sum())
    assert gain(50) < 0.01 and gain(40) == pytest.approx(1, abs=0.01)


def test_convolution_is_plain():
    x, h = RNG.standard_normal((2, 50)), np.array([0.25, 0.5, 0.25])
    assert np.allclose(k.fft_convolve(x, h), [np.convolve(r, h, "same") for r in x])


def test_refractory():
    assert k.refractory(np.array([0, 1.0, 1.6, 3.0, 3.2]), 1.5).tolist() == [True, False, True, False, True]


def test_fft_features_of_even_length():
    x = RNG.standard_normal((3, 8))
    f = k.fft_features(x, 1000)
    assert np.allclose(f["total_power"], 8 * (x**2).sum(axis=1))
    alone = (x * (-1.0) ** np.arange(8)).sum(axis=1) ** 2
    assert np.allclose(f["mean_freq"], -500 * alone / f["total_power"])


def test_ledoit_wolf_between_sample_and_identity():
    x = RNG.standard_normal((40, 5)) * [1, 2, 3, 4, 5]
    x -= x.mean(axis=0)
    out = k.ledoit_wolf(40, x.T @ x, float(((x**2).sum(axis=1) ** 2).sum()))
    cov = x.T @ x / 40
    assert np.trace(out) == pytest.approx(np.trace(cov))
    assert abs(out[0, 1]) <= abs(cov[0, 1])


def test_csp_whitens():
    a, b = RNG.standard_normal((4, 100)), RNG.standard_normal((4, 100)) * [[5], [1], [1], [1]]
    w = k.csp_filters(a @ a.T, b @ b.T, 4)
    assert np.allclose(w @ (a @ a.T + b @ b.T) @ w.T, np.eye(4), atol=1e-8)


def sequential(sections, x, state):
    """Sample by sample, section by section."""
    state = [list(state[2 * k : 2 * k + 2]) for k in range(len(sections))]
    out = []
    for v in x:
        for s, (g, a1, a2) in zip(state, sections):
            y = g * v + s[0]
            s[0], s[1] = s[1] - a1 * y, -g * v - a2 * y
            v = y
        out.append(v)
    return np.array(out), np.ravel(state)


@pytest.mark.parametrize("order, n", [(1, 5), (2, 64), (3, 200), (4, 1000), (8, 777)])
def test_sections_in_blocks_equal_the_sequential_filter(order, n):
    sections = k.butterworth_sections(300, 1, 45, order)
    made, x = k.SectionFilter(sections), RNG.standard_normal(n)
    state = RNG.standard_normal(2 * order)
    y, end = sequential(sections, x, state)
    assert np.allclose(made.run(x, state), y, atol=1e-9) and np.allclose(made.states(x, state)[-1], end, atol=1e-9)
    # At rest, a constant passes as nothing.
    assert np.allclose(made.run(np.ones(n), made.rest), 0, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 4, 5])
def test_sections_have_the_butterworth_response(order):
    f = np.linspace(0.5, 140, 300)
    z = np.exp(-2j * np.pi * f / 300)
    got = np.abs(np.prod([g * (1 - z**2) / (1 + a1 * z + a2 * z**2) for g, a1, a2 in k.butterworth_sections(300, 4, 40, order)], axis=0)) ** 2
    w, lo, hi = np.tan(np.pi * f / 300), np.tan(np.pi * 4 / 300), np.tan(np.pi * 40 / 300)
    assert np.allclose(got, 1 / (1 + ((w**2 - lo * hi) / (w * (hi - lo))) ** (2 * order)), atol=1e-9)
