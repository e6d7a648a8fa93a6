"""Array kernels: numpy over a matrix of traces (rows) by samples (columns).

``per_trace`` turns a kernel into a column function; Arrow carries whole batches, and rows of
equal length are stacked so that a kernel loops over time, never over traces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def per_trace(kernel: Callable[[np.ndarray], np.ndarray], samples: Column) -> Column:
    """Apply a kernel to a column of sample arrays; a null trace stays null."""

    @F.pandas_udf("array<double>")
    def run(arrays: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(arrays)
        sizes: dict[int, list[int]] = {}
        for i, a in enumerate(arrays):
            if a is not None:
                sizes.setdefault(len(a), []).append(i)
        for n, rows in sizes.items():
            done = kernel(np.stack([np.asarray(arrays.iloc[i], np.float64) for i in rows])) if n else np.zeros((len(rows), 0))
            for i, row in zip(rows, done, strict=True):
                out[i] = row
        return pd.Series(out)

    return run(samples)


def moving_sum(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of each ``width`` neighbouring columns.

    Sums run inside blocks of ``width`` only, from both ends, and a window is the end of one block and the
    beginning of the next; nothing is taken off, so a burst leaves no error behind it.
    """
    rows, n = x.shape
    blocks = np.zeros((rows, -(-n // width), width))
    blocks.reshape(rows, -1)[:, :n] = x
    upto = np.cumsum(blocks, 2).reshape(rows, -1)
    rest = np.cumsum(blocks[:, :, ::-1], 2)[:, :, ::-1].reshape(rows, -1)
    first = np.arange(n - width + 1)
    return upto[:, first + width - 1] + np.where(first % width == 0, 0.0, rest[:, first])


def sta_lta(x: np.ndarray, nsta: int, nlta: int) -> np.ndarray:
    """Mean of squares of the last ``nsta`` samples over that of the last ``nlta``; 0 until the long
    window is full, and where the long mean is 0."""
    out = np.zeros_like(x, dtype=np.float64)
    n = x.shape[1]
    if n >= max(nlta, nsta):
        squares = x.astype(np.float64) ** 2
        short = moving_sum(squares, nsta)[:, max(0, nlta - nsta) :] / nsta
        long = moving_sum(squares, nlta) / nlta
        np.divide(short, long, out=out[:, nlta - 1 :], where=long > 0)
    return out


def forward_max(a: np.ndarray, length: int) -> np.ndarray:
    """Maximum of each sample and the ``length - 1`` after it, cut at the end."""
    out, width = a.copy(), 1
    while width < length:
        step = min(width, length - width)
        out[:, :-step] = np.maximum(out[:, :-step], out[:, step:])
        width += step
    return out


def agc(x: np.ndarray, length: int) -> np.ndarray:
    """Each sample over the largest absolute value of the window it begins; 0 where that is 0."""
    if length % 2:
        raise ValueError("the window must be even")
    top = forward_max(np.abs(x), length)
    return np.divide(x, top, out=np.zeros_like(x, dtype=np.float64), where=top > 0)


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1))


def butter_bandpass(corners: int, fs: float, low: float, high: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a digital Butterworth band-pass.

    The analogue low-pass poles move to the band, two poles each, and the bilinear transform with
    warped edges takes them to the unit disc; each section gets unit gain at the band's centre.
    """
    if not 0 < low < high < fs / 2:
        raise ValueError("the band must lie between 0 and half the sampling rate")
    w0, w1 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    width, centre = w1 - w0, np.sqrt(w0 * w1)
    lowpass = np.exp(1j * np.pi * (2 * np.arange(corners) + corners + 1) / (2 * corners))
    half = lowpass * width / 2
    root = np.sqrt(half * half - centre**2)
    poles = np.concatenate([half + root, half - root])
    z = (1 + poles / (2 * fs)) / (1 - poles / (2 * fs))
    z = z[np.imag(z) > 0]
    at = np.exp(1j * 2 * np.arctan(centre / (2 * fs)))
    sections = []
    for p in z:
        a1, a2 = -2 * p.real, abs(p) ** 2
        gain = abs((1 - at**-2) / (1 + a1 / at + a2 / at**2))
        sections.append([1 / gain, 0.0, -1 / gain, a1, a2])
    return np.array(sections)


#: samples of a block of the recursion
BLOCK = 128


def section_blocks(section: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A second-order section over ``n`` samples at once: what samples and state give for the output, and for
    the state after it (two numbers)."""
    b0, b1, b2, a1, a2 = section
    step, feed = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(n):
        powers.append(step @ powers[-1])
    impulse = np.array([b0, *[(powers[k] @ feed)[0] for k in range(n - 1)]])
    back = np.arange(n)[:, None] - np.arange(n)[None, :]
    by_sample = np.where(back >= 0, impulse[np.maximum(back, 0)], 0.0)
    return by_sample, np.array([powers[k][0] for k in range(n)]), np.stack([powers[n - 1 - k] @ feed for k in range(n)], 1), powers[n]


def sos_filter(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sections in turn, each by blocks of ``BLOCK`` samples of all traces: a block is a product of matrices, and
    only the state of two numbers is carried from one to the next."""
    y = x.astype(np.float64).T.copy()  # time first: one product handles all traces
    for section in sections:
        state = np.zeros((2, y.shape[1]))
        for lo in range(0, len(y), BLOCK):
            part = y[lo : lo + BLOCK]
            if lo == 0 or len(part) != len(by_sample):
                by_sample, by_state, gather, carry = section_blocks(section, len(part))
            out = by_sample @ part + by_state @ state
            state = gather @ part + carry @ state
            y[lo : lo + BLOCK] = out
    return y.T


def bandpass(x: np.ndarray, fs: float, low: float, high: float, zerophase: bool = True, corners: int = 4) -> np.ndarray:
    sections = butter_bandpass(corners, fs, low, high)
    y = sos_filter(sections, x)
    return sos_filter(sections, y[:, ::-1])[:, ::-1] if zerophase else y


def normalize_peak(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True) if x.shape[1] else np.ones((len(x), 1))
    return np.divide(x, top, out=np.full(x.shape, np.nan), where=top > 0)


def lag_window(diff_m: float, vmin: float, vmax: float, fs: float) -> np.ndarray:
    """Whole lags between the two travel-time differences; their middle if there is none."""
    ends = sorted((diff_m / vmax * fs, diff_m / vmin * fs))
    lags = np.arange(np.ceil(ends[0]), np.floor(ends[1]) + 1).astype(int)
    return lags if len(lags) else np.array([int(np.rint(sum(ends) / 2))])


def shift_pad(b: np.ndarray, lag: int) -> np.ndarray:
    """Shift left for a positive lag, right for a negative one, zeros moving in."""
    out = np.zeros_like(b)
    n = len(b)
    if abs(lag) < n:
        if lag >= 0:
            out[: n - lag] = b[lag:]
        else:
            out[-lag:] = b[: n + lag]
    return out


#: decimals of a correlation that decide between lags; with more, the order of a sum would
SCORE_DIGITS = 9


def lag_scores(a: np.ndarray, b: np.ndarray, lags: np.ndarray, sign: int) -> np.ndarray:
    """``sum a[l] b[l + sign * lag]`` of consecutive lags, samples outside of ``b`` being 0.

    Only the band of ``b`` that the lags reach is laid out, and all of them are one correlation of it
    with ``a``; lags that share no sample with it are 0.
    """
    n, shift = len(a), sign * lags
    near = np.abs(shift) < n
    scores = np.zeros(len(lags))
    if near.any():
        first, last = int(shift[near].min()), int(shift[near].max())
        band = np.zeros(n + last - first)
        lo, hi = max(first, 0), min(last + n, n)
        band[lo - first : hi - first] = b[lo:hi]
        scores[near] = np.correlate(band, a, "valid")[shift[near] - first]
    return scores


def best_lag(a: np.ndarray, b: np.ndarray, diff_m: float, vmin: float, vmax: float, fs: float, align: str = "reference") -> int:
    """Allowed lag with the largest correlation, the first of equals.

    ``reference`` scores ``sum a[l] b[l - lag]``, ``corrected`` scores ``sum a[l] b[l + lag]``, which
    is the sign that ``shift_pad`` undoes.
    """
    lags = lag_window(diff_m, vmin, vmax, fs)
    scores = lag_scores(a, b, lags, {"reference": -1, "corrected": 1}[align])
    return int(lags[int(np.argmax(np.round(scores, SCORE_DIGITS)))])


def savgol(z: np.ndarray, width: int, order: int = 2) -> np.ndarray:
    """Local polynomial smoothing of one array; at the ends the outer windows' fits are used."""
    n, half = len(z), width // 2
    width = 2 * half + 1
    if n < width:
        raise ValueError("the window is longer than the array")
    at = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(at, order + 1, increasing=True).astype(float))
    out = np.convolve(z, fit[0][::-1], "same")
    for ends, window in ((range(half), z[:width]), (range(n - half, n), z[-width:])):
        coef = fit @ window
        for i in ends:
            out[i] = sum(c * (i - (half if i < half else n - 1 - half)) ** p for p, c in enumerate(coef))
    return out
