"""Array kernels in numpy for what SQL can't express: recursive filters, spectra, wavelets, sequential sampling.

All take arrays whose last axis is time and work on many traces at once.
"""

from __future__ import annotations

import hashlib

import numpy as np

BTYPES = ("bandpass", "lowpass", "highpass", "bandstop")


# --- filters -----------------------------------------------------------------


def butter_sos(order: int, band, btype: str, fs: float) -> np.ndarray:
    """Second-order sections of a digital Butterworth filter (bilinear transform with pre-warping)."""
    if btype not in BTYPES:
        raise ValueError(f"btype must be one of {BTYPES}")
    edges = np.atleast_1d(np.asarray(band, float))
    if len(edges) != (2 if btype in ("bandpass", "bandstop") else 1):
        raise ValueError(f"{btype} needs {2 if btype in ('bandpass', 'bandstop') else 1} edge(s)")
    if (edges <= 0).any() or (edges >= fs / 2).any() or (np.diff(edges) <= 0).any():
        raise ValueError("edges must increase between 0 and half the sampling rate")
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    zeros = np.empty(0, complex)
    if btype == "lowpass":
        poles, gain = poles * warped[0], warped[0] ** order
    elif btype == "highpass":
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    else:
        centre, width = np.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
        if btype == "bandpass":
            half = poles * width / 2
            root = np.sqrt(half**2 - centre**2)
            poles, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(order, complex), width**order
        else:
            gain = np.real(1 / np.prod(-poles))
            half = width / 2 / poles
            root = np.sqrt(half**2 - centre**2)
            poles, zeros = np.concatenate((half + root, half - root)), np.concatenate((np.full(order, 1j * centre), np.full(order, -1j * centre)))
    double = 2 * fs
    gain = gain * np.real(np.prod(double - zeros) / np.prod(double - poles))
    zd = np.concatenate(((double + zeros) / (double - zeros), -np.ones(len(poles) - len(zeros))))
    return _sections(zd, (double + poles) / (double - poles), gain)


def _pairs(roots: np.ndarray) -> list[tuple]:
    """Roots in conjugate or real pairs, those nearest the unit circle last; a lone real root goes with 0."""
    upper = sorted(roots[np.imag(roots) > 1e-10 * np.abs(roots)], key=lambda r: abs(abs(r) - 1), reverse=True)
    real = sorted(np.real(roots[np.abs(np.imag(roots)) <= 1e-10 * np.abs(roots)]), key=abs)
    out = []
    if len(real) % 2:
        out.append((real.pop(0), 0.0))
    while real:
        out.append((real.pop(0), real.pop()))
    return out + [(r, np.conj(r)) for r in upper]


def _sections(z: np.ndarray, p: np.ndarray, gain: float) -> np.ndarray:
    zp, pp = _pairs(z), _pairs(p)
    if len(p) % 2:  # the first-order section takes a real zero
        lone = next((i for i, pair in enumerate(zp) if pair[1] == 0.0), None)
        if lone is None:
            zp.insert(0, (0.0, 0.0))
        else:
            zp.insert(0, zp.pop(lone))
    sos = []
    for (z1, z2), (p1, p2) in zip(zp, pp, strict=True):
        sos.append([1.0, -np.real(z1 + z2), np.real(z1 * z2), 1.0, -np.real(p1 + p2), np.real(p1 * p2)])
    sos = np.array(sos)
    sos[0, :3] *= gain
    return sos


def sosfilt(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filter rows of x (rows, time) from a state (sections, rows, 2), transposed direct form II."""
    return sosfilt_on(sos, x, state)[0]


def sosfilt_on(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`sosfilt`, with the state after the last sample, from which a next piece goes on."""
    y, left = np.array(x, float, order="F"), np.empty((len(sos), len(x), 2))
    for k, ((b0, b1, b2, _, a1, a2), s) in enumerate(zip(sos, state, strict=True)):
        s1, s2 = s[:, 0].copy(), s[:, 1].copy()
        for i in range(y.shape[1]):
            v = y[:, i].copy()
            out = b0 * v + s1
            s1 = b1 * v - a1 * out + s2
            s2 = b2 * v - a2 * out
            y[:, i] = out
        left[k, :, 0], left[k, :, 1] = s1, s2
    return y, left


def pad_length(sos: np.ndarray) -> int:
    """Samples by which a trace is extended at each end before zero-phase filtering."""
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def steady_state(sos: np.ndarray) -> np.ndarray:
    """State (sections, 2) of each section after a long unit step into the cascade."""
    out, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 - a2 * gain
        out.append([scale * (b1 - a1 * gain + s2), scale * s2])
        scale *= gain
    return np.array(out)


def filtfilt(x: np.ndarray, band, fs: float, order: int = 3, btype: str = "bandpass") -> np.ndarray:
    """Zero-phase Butterworth filtering, forward and backward, with odd extension at both ends."""
    x = np.atleast_2d(np.asarray(x, float))
    sos = butter_sos(order, band, btype, fs)
    pad = pad_length(sos)
    if x.shape[1] <= pad:
        raise ValueError(f"a trace must be longer than {pad} samples")
    left, right = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = np.concatenate((left, x, right), axis=1)
    zi = steady_state(sos)[:, None, :]
    for _ in range(2):
        y = sosfilt(sos, y, zi * y[None, :, :1])[:, ::-1]
    return y[:, pad : y.shape[1] - pad]


def gaussian_smooth(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing along time; edges reflect with the border sample repeated."""
    x = np.atleast_2d(np.asarray(x, float))
    radius = int(truncate * sigma + 0.5)
    if radius == 0 or x.shape[1] == 0:
        return x.copy()
    k = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    w /= w.sum()
    padded = np.pad(x, ((0, 0), (radius, radius)), mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * radius + 1, axis=1) @ w


# --- spectra -----------------------------------------------------------------


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(n)


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """The periodic Tukey window."""
    if n <= 1:
        return np.ones(n)
    at = np.arange(n) / n
    w = np.ones(n)
    rise, fall = at < alpha / 2, at >= 1 - alpha / 2
    w[rise] = 0.5 * (1 + np.cos(np.pi * (2 * at[rise] / alpha - 1)))
    w[fall] = 0.5 * (1 + np.cos(np.pi * (2 * at[fall] / alpha - 2 / alpha + 1)))
    return w


def segments(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """(..., segments, size) windows; a trace shorter than size is one segment."""
    n = x.shape[-1]
    size = min(size, n)
    step = max(1, size - min(overlap, size - 1))
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::step, :]


def segment_ffts(x: np.ndarray, fs: float, size: int, overlap: int, window=hann, detrend: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, scaled segment FFTs (density) and one-sided weights."""
    s = segments(np.asarray(x, float), size, overlap)
    n = s.shape[-1]
    w = window(n)
    if detrend:
        s = s - s.mean(-1, keepdims=True)
    f = np.fft.rfft(s * w, axis=-1) / np.sqrt(fs * (w**2).sum())
    double = np.full(f.shape[-1], 2.0)
    double[0] = 1.0
    if n % 2 == 0:
        double[-1] = 1.0
    return np.arange(n // 2 + 1) * fs / n, f, double


def median_bias(n: int) -> float:
    k = 2 * np.arange(1, (n - 1) // 2 + 1)
    return float(1 + (1 / (k + 1) - 1 / k).sum())


def welch(x: np.ndarray, fs: float, size: int, overlap: int, average: str = "median") -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density by Welch's method; mean or bias-corrected median over segments."""
    freq, f, double = segment_ffts(x, fs, size, overlap)
    power = np.abs(f) ** 2 * double
    if average == "mean":
        return freq, power.mean(-2)
    if average == "median":
        return freq, np.median(power, axis=-2) / median_bias(power.shape[-2])
    raise ValueError("average must be mean or median")


def cpsd(x: np.ndarray, y: np.ndarray, fs: float, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cross spectral density conj(X) Y, mean over segments; a positive angle means that y leads."""
    freq, a, double = segment_ffts(x, fs, size, overlap)
    _, b, _ = segment_ffts(y, fs, size, overlap)
    return freq, (np.conj(a) * b).mean(-2) * double


def stft(x: np.ndarray, fs: float, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, centre sample of each segment, and complex spectra (Tukey window, constant detrend)."""
    freq, f, _ = segment_ffts(x, fs, size, overlap, tukey)
    step = max(1, size - overlap)
    centres = np.rint((size / 2 + step * np.arange(f.shape[-2])) / fs * fs).astype(int)
    return freq, np.minimum(centres, x.shape[-1] - 1), f


def crosscorr(x: np.ndarray, y: np.ndarray, lags: np.ndarray, demean: bool = False, normalise: bool = False, eps: float = 1e-12) -> np.ndarray:
    """c[lag] = sum over t of x[t + lag] y[t], over the length, or over the roots of the sums of squares."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if demean:
        x, y = x - x.mean(), y - y.mean()
    n = len(x)
    size = 1 << int(np.ceil(np.log2(max(2 * n - 1, 2))))
    full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size) if n > 256 else None
    c = full[np.asarray(lags) % size] if full is not None else np.array([x[max(0, k) : n + min(0, k)] @ y[max(0, -k) : n - max(0, k)] for k in lags])
    d = np.sqrt((x @ x) * (y @ y)) if normalise else float(n)
    return c / d if np.isfinite(d) and d > eps else np.full(len(lags), np.nan)


def lag_range(window: tuple[float, float] | None, fs: float, n: int) -> np.ndarray:
    """Sample lags in a window of seconds, clipped to +-(n - 1); may be empty."""
    if window is None:
        return np.arange(-(n - 1), n)
    lo, hi = window
    if hi < lo:
        raise ValueError("the lag window is reversed")
    return np.arange(max(int(np.ceil(lo * fs - 1e-12)), 1 - n), min(int(np.floor(hi * fs + 1e-12)), n - 1) + 1)


def diff_keep(x: np.ndarray, n: int) -> np.ndarray:
    """n-th difference along the first axis, of the same length; borders are padded from the first and last rows."""
    head, tail = x[: n // 2], x[len(x) - (n - n // 2) :]
    return np.diff(np.concatenate((head, x, tail)), n, axis=0)


# --- sequential sampling -----------------------------------------------------


def interval_stream(seed: int, name: str, k: int, attempt: int) -> np.random.Generator:
    """The random stream of an interval: a counter-based generator that these four numbers alone determine."""
    key = int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:16], "little")
    return np.random.Generator(np.random.Philox(key=key, counter=[0, 0, k, attempt]))


def place_controls(targets: list[float], free: list[tuple[float, float]], rng) -> list[tuple[float, float]] | None:
    """Random places of intervals of given durations in free ones without overlap, longest first; None if one doesn't fit.

    ``rng`` is one generator for all, or gives each interval's own by its number.
    """
    streams = rng if callable(rng) else lambda _: rng
    free, out = sorted(free), [None] * len(targets)
    for i in sorted(range(len(targets)), key=lambda i: (-targets[i], i)):
        rng = streams(i)
        fits = [j for j, (a, b) in enumerate(free) if b - a >= targets[i]]
        if not fits:
            return None
        a, b = free.pop(fits[int(rng.integers(len(fits)))])
        start = a if np.isclose(b - a, targets[i]) else float(rng.uniform(a, b - targets[i]))
        out[i] = (start, start + targets[i])
        for lo, hi in ((a, np.nextafter(start, -np.inf)), (np.nextafter(start + targets[i], np.inf), b)):
            if hi >= lo:
                free.append((float(lo), float(hi)))
        free.sort()
    return out


def sample_controls(units: dict[str, tuple[list, list]], seed: int = 0, tries: int = 100) -> tuple[dict[str, list], int]:
    """Controls of several units (targets, candidates as intervals) from one generator in order; a failure starts over with the next seed."""
    for s in range(seed, seed + tries):
        rng, out = np.random.default_rng(s), {}
        for key, (targets, candidates) in units.items():
            placed = place_controls([b - a for a, b in targets], [tuple(c) for c in candidates], rng)
            if placed is None:
                break
            out[key] = placed
        else:
            return out, s
    raise RuntimeError("no placement without overlap was found")


# --- oscillation bursts ------------------------------------------------------

#: Frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 9.0), "alpha": (9.0, 15.0), "beta": (15.0, 29.0), "gamma": (30.0, 80.0)}


def morlet_power(x: np.ndarray, fs: float, freqs: np.ndarray, cycles: float = 7.0) -> np.ndarray:
    """Power (freqs, time) of a complex Morlet transform."""
    n = len(x)
    out = np.empty((len(freqs), n))
    for i, f in enumerate(freqs):
        sigma = cycles / (2 * np.pi * f)
        t = np.arange(-int(np.ceil(4 * sigma * fs)), int(np.ceil(4 * sigma * fs)) + 1) / fs
        wave = np.exp(2j * np.pi * f * t - t**2 / (2 * sigma**2)) / np.sqrt(sigma * np.sqrt(np.pi) * fs)
        size = 1 << int(np.ceil(np.log2(n + len(t))))
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(wave, size))
        out[i] = np.abs(full[len(t) // 2 : len(t) // 2 + n]) ** 2
    return out


def normalise_power(power: np.ndarray, how: str) -> np.ndarray:
    """mednorm: each frequency over its median; unitnorm: each frequency to zero mean and unit deviation."""
    if how == "mednorm":
        return power / np.maximum(np.median(power, axis=1, keepdims=True), 1e-300)
    if how == "unitnorm":
        return (power - power.mean(1, keepdims=True)) / np.maximum(power.std(1, keepdims=True), 1e-300)
    raise ValueError("normop must be mednorm or unitnorm")


def local_maxima(power: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Places (frequency, time) that reach the threshold and none of their eight neighbours exceeds."""
    padded = np.pad(power, 1, constant_values=-np.inf)
    around = [padded[1 + a : padded.shape[0] - 1 + a, 1 + b : padded.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    peak = (power >= threshold) & np.all([power >= x for x in around], axis=0)
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(peak), strict=True)]


def grown_box(power: np.ndarray, at: tuple[int, int], floor: float) -> tuple[int, int, int, int]:
    """(f0, f1, t0, t1), inclusive: how far the row and the column of a place stay at the floor or above."""

    def reach(line: np.ndarray, i: int) -> tuple[int, int]:
        low = np.flatnonzero(~(line >= floor))
        k = np.searchsorted(low, i)
        return (int(low[k - 1]) + 1 if k else 0), (int(low[k]) - 1 if k < len(low) else len(line) - 1)

    (f0, f1), (t0, t1) = reach(power[:, at[1]], at[0]), reach(power[at[0]], at[1])
    return f0, f1, t0, t1


def merged_boxes(boxes: np.ndarray, overlap: float) -> np.ndarray:
    """A class for each box (f0, f1, t0, t1): boxes join where they share ``overlap`` of the smaller one's area, and so on."""
    n = len(boxes)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    area = (boxes[:, 1] - boxes[:, 0] + 1) * (boxes[:, 3] - boxes[:, 2] + 1)
    for i in range(n):
        high = np.minimum(boxes[i, 1], boxes[i + 1 :, 1]) - np.maximum(boxes[i, 0], boxes[i + 1 :, 0]) + 1
        wide = np.minimum(boxes[i, 3], boxes[i + 1 :, 3]) - np.maximum(boxes[i, 2], boxes[i + 1 :, 2]) + 1
        shared = np.maximum(high, 0) * np.maximum(wide, 0)
        for j in np.flatnonzero((shared > 0) & (shared >= overlap * np.minimum(area[i], area[i + 1 :]))) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], int)


def events(power: np.ndarray, freqs: np.ndarray, fs: float, threshold: float, end: float = 0.5, overlap: float = 0.5, bands: dict = BANDS) -> list[dict]:
    """Events of a window: local maxima, each in a box down to the threshold or ``end`` of its peak (the lower), boxes merged.

    A merged event spans its boxes and has the place of its strongest peak, the earliest and lowest of equal ones.
    """
    found = local_maxima(power, threshold)
    if not found:
        return []
    boxes = np.array([grown_box(power, p, min(threshold, end * power[p])) for p in found])
    classes, out = merged_boxes(boxes, overlap), []
    for c in np.unique(classes):
        own = np.flatnonzero(classes == c)
        f0, t0 = boxes[own][:, (0, 2)].min(0)
        f1, t1 = boxes[own][:, (1, 3)].max(0)
        fi, ti = min((found[i] for i in own), key=lambda p: (-power[p], p[1], p[0]))
        f, duration = float(freqs[fi]), float(t1 - t0 + 1) / fs
        out.append({
            "f0": int(f0), "f1": int(f1), "t0": int(t0), "t1": int(t1), "band": (held := [k for k, (lo, hi) in bands.items() if lo <= f < hi] or ["unknown"])[0], "bands": held, "peak_f": f, "min_f": float(freqs[f0]), "max_f": float(freqs[f1]),
            "start": float(t0) / fs, "stop": float(t1) / fs, "peak_t": float(ti) / fs, "duration": duration, "ncycle": duration * f, "octaves": float(np.log2(freqs[f1] / freqs[f0])), "peak_power": float(power[fi, ti]),
            "mean_power": float(power[f0 : f1 + 1, t0 : t1 + 1].mean()), "peaks": len(own),
        })
    return sorted(out, key=lambda b: (b["start"], b["peak_f"]))


def interval_stats(times: np.ndarray) -> tuple[float, float]:
    """CV2 and local variation LV of the intervals between sorted times; NaN with fewer than three or four times."""
    d = np.diff(np.sort(times))
    a, b = d[:-1], d[1:]
    if len(d) < 2:
        return float("nan"), float("nan")
    return float((2 * np.abs(b - a) / (a + b)).mean()), float((3 * ((a - b) / (a + b)) ** 2).mean())
