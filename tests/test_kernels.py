import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seisframe.functions import kernels

RNG = np.random.default_rng(3)


def test_sta_lta_equals_window_means():
    x = RNG.normal(size=(3, 50))
    y = kernels.sta_lta(x, 3, 10)
    assert (y[:, :9] == 0).all()
    for i in range(9, 50):
        want = (x[:, i - 2 : i + 1] ** 2).mean(1) / (x[:, i - 9 : i + 1] ** 2).mean(1)
        np.testing.assert_allclose(y[:, i], want)


def test_sta_lta_of_silence_is_zero():
    assert (kernels.sta_lta(np.zeros((1, 20)), 2, 5) == 0).all()


def test_agc_looks_forward():
    x = RNG.normal(size=(2, 31))
    y = kernels.agc(x, 6)
    for i in range(31):
        np.testing.assert_allclose(y[:, i], x[:, i] / np.abs(x[:, i : i + 6]).max(1))
    with pytest.raises(ValueError):
        kernels.agc(x, 5)


def test_bandpass_has_the_closed_form_gain():
    fs, low, high, n = 100.0, 5.0, 15.0, 4000
    impulse = np.zeros((1, n))
    impulse[0, 0] = 1
    one = np.abs(np.fft.rfft(kernels.bandpass(impulse, fs, low, high, zerophase=False)[0]))
    f = np.fft.rfftfreq(n, 1 / fs)[1:-1]
    w, a, b = (2 * fs * np.tan(np.pi * v / fs) for v in (f, low, high))
    want = 1 / np.sqrt(1 + ((w * w - a * b) / (w * (b - a))) ** 8)
    np.testing.assert_allclose(one[1:-1], want, atol=1e-6)


def test_zero_phase_keeps_a_pulse_in_place():
    x = np.zeros((1, 401))
    x[0, 200] = 1
    y = kernels.bandpass(x, 100.0, 3.0, 20.0)[0]
    assert y.argmax() == 200
    np.testing.assert_allclose(y[150:251], y[150:251][::-1], atol=1e-6)


def test_envelope_of_a_tone_is_flat():
    t = np.arange(200) / 100
    np.testing.assert_allclose(kernels.envelope(np.sin(2 * np.pi * 10 * t)[None])[0], 1, atol=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.integers(-30, 30))
def test_shift_pad_round_trip(lag):
    b = np.arange(1.0, 21.0)
    y = kernels.shift_pad(b, lag)
    kept = kernels.shift_pad(y, -lag)
    assert set(kept) <= set(b) | {0.0}
    assert np.count_nonzero(y) == max(0, 20 - abs(lag))


def test_corrected_lag_undoes_a_delay():
    a = RNG.normal(size=200)
    b = kernels.shift_pad(a, -7)  # delayed by 7
    lag = kernels.best_lag(a, b, 700.0, 5000.0, 20000.0, 100.0, "corrected")
    assert lag == 7
    np.testing.assert_allclose(kernels.shift_pad(b, lag)[:180], a[:180])
    assert kernels.best_lag(a, b, 0.0, 5000.0, 7000.0, 100.0) == 0


def test_reference_lag_has_the_other_sign():
    a = RNG.normal(size=200)
    b = kernels.shift_pad(a, 7)
    assert kernels.best_lag(a, b, 700.0, 5000.0, 20000.0, 100.0, "reference") == 7


def test_savgol_keeps_parabolas():
    x = np.arange(60.0)
    z = 0.3 * x * x - 2 * x + 5
    np.testing.assert_allclose(kernels.savgol(z, 20), z, atol=1e-8)


def test_lag_scores_equal_sums():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 30))
    for lags in (np.arange(-4, 9), np.arange(20, 50), np.arange(-70, -20), np.arange(40, 60), np.array([3])):
        for sign in (-1, 1):
            expected = [sum(a[i] * b[i + sign * lag] for i in range(30) if 0 <= i + sign * lag < 30) for lag in lags]
            np.testing.assert_allclose(kernels.lag_scores(a, b, lags, sign), expected, atol=1e-12)


def test_first_of_equal_lags():
    a = np.zeros(40)
    a[[10, 13, 20, 23]] = 1.0
    assert kernels.best_lag(a, a, 1000.0, 100.0, 1000.0, 1.0, "corrected") == 3  # of lags 1 to 10, 3 and 10 match two peaks
    assert kernels.best_lag(np.zeros(40), a, 1000.0, 100.0, 1000.0, 1.0) == 1


def test_filter_blocks_equal_single_steps():
    rng = np.random.default_rng(4)
    sections = kernels.butter_bandpass(4, 16.0, 1.0, 5.0)
    for n in (1, 2, kernels.BLOCK, kernels.BLOCK + 1, 5 * kernels.BLOCK - 3):
        x = rng.normal(size=(3, n))
        y = x.copy()
        for b0, b1, b2, a1, a2 in sections:
            s1, s2 = np.zeros(3), np.zeros(3)
            for t in range(n):
                v = y[:, t].copy()
                y[:, t] = b0 * v + s1
                s1, s2 = b1 * v - a1 * y[:, t] + s2, b2 * v - a2 * y[:, t]
        np.testing.assert_allclose(kernels.sos_filter(sections, x), y, atol=1e-10)


def test_ratio_after_a_strong_burst():
    x = np.full((1, 4000), 1e-6)
    x[0, 100:110] = 1e8
    ratio = kernels.sta_lta(x, 5, 50)[0]
    np.testing.assert_allclose(ratio[200:], 1.0, rtol=1e-12)
    plain = [np.mean(x[0, i - 4 : i + 1] ** 2) / np.mean(x[0, i - 49 : i + 1] ** 2) for i in range(49, 4000)]
    np.testing.assert_allclose(ratio[49:], plain, rtol=1e-12)
    assert (ratio[:49] == 0).all() and kernels.sta_lta(x[:, :49], 5, 50).max() == 0
