import numpy as np
import pytest

from tracewell.functions import kernels as K

RNG = np.random.default_rng(0)


def gain(sos, f, fs):
    z = np.exp(2j * np.pi * f / fs)
    return np.prod([abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)) for b0, b1, b2, _, a1, a2 in sos])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_butterworth_gains(order):
    fs = 200.0
    for btype, band, passed, stopped in (("lowpass", 20, 0.001, 99.9), ("highpass", 20, 99.9, 0.01), ("bandpass", (10, 30), 17.5, 0.01), ("bandstop", (10, 30), 0.001, 17.6)):
        sos = K.butter_sos(order, band, btype, fs)
        assert gain(sos, passed, fs) == pytest.approx(1, abs=1e-2)
        assert gain(sos, stopped, fs) < 0.2
        for edge in np.atleast_1d(band):
            assert gain(sos, edge, fs) == pytest.approx(np.sqrt(0.5), rel=1e-6)


def test_butterworth_arguments():
    for args in ((3, 5, "comb", 100), (3, (5,), "bandpass", 100), (3, (9, 5), "bandpass", 100), (3, 60, "lowpass", 100)):
        with pytest.raises(ValueError):
            K.butter_sos(*args)


def test_filter_has_zero_phase():
    t = np.arange(400) / 100
    x = np.sin(2 * np.pi * 10 * t)
    y = K.filtfilt(x + 0.5 * np.sin(2 * np.pi * 30 * t) + 0.1 * np.sin(2 * np.pi * 2 * t), (8, 12), 100.0)[0]
    assert np.abs(y - x)[100:-100].max() < 0.03
    assert np.allclose(K.filtfilt(x[::-1], (8, 12), 100.0)[0][150:-150], K.filtfilt(x, (8, 12), 100.0)[0][::-1][150:-150], atol=1e-3)
    assert np.allclose(K.filtfilt(np.ones((2, 100)), 10, 100.0, btype="lowpass"), 1)
    with pytest.raises(ValueError):
        K.filtfilt(np.ones(5), (8, 12), 100.0)


def test_gaussian_keeps_mass_and_constants():
    x = RNG.random((3, 50))
    assert np.allclose(K.gaussian_smooth(x, 2.0).sum(1), x.sum(1))
    assert np.allclose(K.gaussian_smooth(np.ones(9), 3.0), 1)
    assert np.allclose(K.gaussian_smooth(x, 0.1), x)


def test_welch_finds_a_sine_and_its_power():
    fs = 100.0
    t = np.arange(2000) / fs
    x = np.sin(2 * np.pi * 10 * t)
    freq, p = K.welch(x, fs, 200, 100, "mean")
    assert freq[p.argmax()] == 10
    assert p.sum() * (freq[1] - freq[0]) == pytest.approx(0.5, rel=1e-6)
    _, m = K.welch(x, fs, 200, 100, "median")
    assert m.argmax() == p.argmax()
    with pytest.raises(ValueError):
        K.welch(x, fs, 200, 100, "mode")


def test_median_bias():
    assert K.median_bias(1) == 1
    assert K.median_bias(3) == pytest.approx(1 + 1 / 3 - 1 / 2)


def test_cross_spectrum_sign_and_auto():
    fs = 100.0
    t = np.arange(1000) / fs
    x, lead = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 10 * t + 0.5)
    freq, w = K.cpsd(x, lead, fs, 100, 50)
    assert np.angle(w[freq == 10][0]) == pytest.approx(0.5, abs=1e-6)
    _, a = K.cpsd(x, x, fs, 100, 50)
    assert np.allclose(a.imag, 0)
    assert np.allclose(a.real, K.welch(x, fs, 100, 50, "mean")[1])


def test_stft_places_segments():
    freq, at, z = K.stft(np.sin(2 * np.pi * 10 * np.arange(400) / 100), 100.0, 50, 25)
    assert at[0] == 25
    assert (np.diff(at) == 25).all()
    assert (freq[np.abs(z).argmax(-1)] == 10).all()


@pytest.mark.parametrize(
    ("x", "y", "window", "lags"),
    [([0, 1, 2, 1, 0], [1, 0, 1, 0, 1], None, range(-4, 5)), ([0, 1, 2, 1, 0, -1], [1, 1, 0, -1, -1, 0], (-0.15, 0.25), range(-1, 3)), ([1, 2, 3, 4], [4, 3, 2, 1], (-10, 0.15), range(-3, 2))],
)
def test_crosscorr_by_definition(x, y, window, lags):
    found = K.lag_range(window, 10.0, len(x))
    assert list(found) == list(lags)
    n = len(x)
    expected = [sum(x[t + k] * y[t] for t in range(n) if 0 <= t + k < n) / n for k in lags]
    assert np.allclose(K.crosscorr(x, y, found), expected)


def test_crosscorr_normalised_long_and_degenerate():
    x = np.array([1.0, 2, 3, 4])
    assert K.crosscorr(x, x, np.array([0]), normalise=True)[0] == pytest.approx(1)
    assert np.isnan(K.crosscorr(np.ones(4), x, np.array([0]), demean=True, normalise=True)).all()
    a, b = RNG.random(600), RNG.random(600)
    lags = np.arange(-5, 6)
    assert np.allclose(K.crosscorr(a, b, lags), [a[max(0, k) : 600 + min(0, k)] @ b[max(0, -k) : 600 - max(0, k)] / 600 for k in lags])
    with pytest.raises(ValueError):
        K.lag_range((0.2, -0.2), 10.0, 5)


def test_differences_keep_size():
    x = RNG.random((6, 3))
    d1, d2 = K.diff_keep(x, 1), K.diff_keep(x, 2)
    assert d1.shape == d2.shape == x.shape
    assert np.allclose(d1[:-1], np.diff(x, axis=0)) and np.allclose(d1[-1], 0)
    assert np.allclose(d2[1:-1], np.diff(x, 2, axis=0))
    assert K.diff_keep(x, 3).shape == x.shape


def test_control_intervals():
    units = {"a": ([(1, 2.5), (4, 4.5)], [(10, 14), (20, 23)])}
    found, seed = K.sample_controls(units, 0)
    again, _ = K.sample_controls(units, 0)
    assert found == again and seed >= 0
    spans = sorted(found["a"])
    assert all(any(lo <= a and b <= hi for lo, hi in ((10, 14), (20, 23))) for a, b in spans)
    assert spans[0][1] < spans[1][0]
    assert [b - a for a, b in found["a"]] == pytest.approx([1.5, 0.5])
    with pytest.raises(RuntimeError):
        K.sample_controls({"a": ([(0, 5), (6, 10)], [(10, 16)])}, 0, 5)


def test_bursts_find_an_alpha_burst():
    fs, n = 500.0, 3000
    t = np.arange(n) / fs
    x = 0.05 * RNG.standard_normal(n) + np.where((t > 2) & (t < 3), np.sin(2 * np.pi * 10 * t), 0)
    freqs = np.arange(4.0, 31.0)
    found = K.events(K.normalise_power(K.morlet_power(x, fs, freqs), "mednorm"), freqs, fs, 4.0)
    best = max(found, key=lambda b: b["peak_power"] * b["duration"])
    assert best["band"] == "alpha" and abs(best["peak_t"] - 2.5) < 0.5 and best["ncycle"] > 5
    assert np.isnan(K.interval_stats(np.array([1.0, 2.0]))[0])
    assert K.interval_stats(np.arange(9.0)) == (0.0, 0.0)
