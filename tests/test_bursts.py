"""Oscillation events: peaks, boxes and merging by brute force, thresholds, waveforms across windows, band overrides."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import kernels as K
from tracewell.operators import bursts as U
from tracewell.operators import chunks as H

RNG = np.random.default_rng(11)


def test_local_maxima_by_brute_force():
    for _ in range(20):
        p = RNG.integers(0, 6, (7, 9)).astype(float)
        want = []
        for a, b in itertools.product(range(7), range(9)):
            near = p[max(0, a - 1) : a + 2, max(0, b - 1) : b + 2]
            if p[a, b] >= 3 and p[a, b] == near.max():
                want.append((a, b))
        assert K.local_maxima(p, 3.0) == want


def test_boxes_by_brute_force():
    for _ in range(30):
        p = RNG.integers(0, 9, (6, 11)).astype(float)
        a, b = np.unravel_index(p.argmax(), p.shape)
        f0 = f1 = a
        t0 = t1 = b
        while f0 and p[f0 - 1, b] >= 4:
            f0 -= 1
        while f1 < 5 and p[f1 + 1, b] >= 4:
            f1 += 1
        while t0 and p[a, t0 - 1] >= 4:
            t0 -= 1
        while t1 < 10 and p[a, t1 + 1] >= 4:
            t1 += 1
        assert K.grown_box(p, (a, b), 4.0) == (f0, f1, t0, t1)


@pytest.mark.parametrize("overlap", [0.0, 0.3, 0.5, 1.0])
def test_merging_by_brute_force(overlap):
    for n in (1, 2, 25):
        low = RNG.integers(0, 20, (n, 2))
        size = RNG.integers(0, 7, (n, 2))
        boxes = np.stack([low[:, 0], low[:, 0] + size[:, 0], low[:, 1], low[:, 1] + size[:, 1]], axis=1)
        cells = [set(itertools.product(range(f0, f1 + 1), range(t0, t1 + 1))) for f0, f1, t0, t1 in boxes]
        link = np.array([[bool(a & b) and len(a & b) >= overlap * min(len(a), len(b)) for b in cells] for a in cells])
        reach = np.linalg.matrix_power(link.astype(float) + np.eye(n), n) > 0
        assert K.merged_boxes(boxes, overlap).tolist() == [int(np.flatnonzero(r)[0]) for r in reach]


def test_events_span_their_merged_boxes():
    p = np.ones((5, 40))
    p[2, 5:15] = [5, 8, 7, 6.4, 6.2, 6, 6.1, 7, 9, 5]  # two peaks of one ridge
    p[2, 30] = 4.0  # too low at 4.5
    found = K.events(p, np.arange(8.0, 13.0), 10.0, 4.5)
    assert len(found) == 1
    e = found[0]
    assert (e["t0"], e["t1"], e["f0"], e["f1"], e["peaks"], e["peak_power"]) == (5, 14, 2, 2, 2, 9.0)
    assert (e["peak_t"], e["peak_f"], e["duration"], e["band"]) == (1.3, 10.0, 1.0, "alpha")
    assert e["mean_power"] == pytest.approx(p[2, 5:15].mean())


def recording(fs=200.0, n=4000):
    t = np.arange(n) / fs
    x = 0.05 * RNG.standard_normal(n)
    x[500:900] += 3 * np.sin(2 * np.pi * 10 * t[500:900])
    x[1500:1900] += 2 * np.sin(2 * np.pi * 8 * t[1500:1900])  # over the border of windows of 800
    return t, x


def chunked(spark, traces, size):
    rows = [(c, i, float(v)) for c, x in traces.items() for i, v in enumerate(x)]
    return H.to_chunks(spark.createDataFrame(rows, "channel string, i long, v double"), ["channel"], size)


FREQS = [float(f) for f in np.arange(4, 21, 0.5)]


def test_detection_equals_the_kernel_window_by_window(spark):
    _, x = recording()
    found = U.detect(chunked(spark, {"a": x, "b": x[::-1].copy()}, 800), 200.0, FREQS, 800, 4.0).toPandas()
    for name, y in (("a", x), ("b", x[::-1])):
        want = []
        for w in range(5):
            part = y[800 * w : 800 * w + 800]
            power = K.normalise_power(K.morlet_power(part - part.mean(), 200.0, np.array(FREQS)), "mednorm")
            want += [(w, round(e["peak_f"], 9), round(4.0 * w + e["start"], 9), round(e["peak_power"], 6), band) for e in K.events(power, np.array(FREQS), 200.0, 4.0) for band in e["bands"]]
        got = found[found["channel"] == name]
        assert sorted((r.win_idx, round(r.peakF, 9), round(r.start, 9), round(r.power, 6), r.band) for r in got.itertuples()) == sorted(want) and want


def test_dynamic_thresholds(spark):
    _, x = recording()
    chunks = chunked(spark, {"a": x, "quiet": 0.01 * RNG.standard_normal(1600), "noisy": np.r_[x[:800], 99.0 + x[800:1600]]}, 800)
    got = {r["channel"]: r["evthresh"] for r in U.thresholds(chunks, 200.0, FREQS, 3.0, 1.0, noise=50.0).collect()}

    def power(y):
        return np.concatenate([K.normalise_power(K.morlet_power(w - w.mean(), 200.0, np.array(FREQS)), "mednorm").ravel() for w in y.reshape(-1, 800)])

    for name, y in (("a", x), ("noisy", x[:800])):
        p = power(y)
        assert got[name] == pytest.approx(p.mean() + 3 * p.std(), rel=1e-9)
    found = U.detect(chunks, 200.0, FREQS, 800, 1.0, dynamic=3.0, noise=50.0)
    assert found.where("channel = 'a'").select("evthresh").distinct().first()[0] == pytest.approx(got["a"])
    assert found.where("power < evthresh").count() == 0
    assert found.where("channel = 'noisy' AND win_idx = 1").count() == 0


def test_filtered_waveforms_correlate_as_the_signal_was_made(spark):
    fs, n = 200.0, 2400
    t = np.arange(n) / fs
    a, b = 1.0, 0.75  # the event's own oscillation and one far outside of its band
    x = a * np.sin(2 * np.pi * 10 * t) + b * np.sin(2 * np.pi * 60 * t)
    own, done, r = U.event_waveform(x, 800, 1599, (8.0, 12.0), fs)
    assert r == pytest.approx(a / np.hypot(a, b), abs=0.01)
    assert np.abs(done - np.sin(2 * np.pi * 10 * t[800:1600])).max() < 0.05 and (own == x[800:1600]).all()
    assert np.isnan(U.event_waveform(np.zeros(2400), 10, 900, (8.0, 12.0), fs)[2])
    assert np.isnan(U.event_waveform(x[:5], 0, 4, (8.0, 12.0), fs)[2])
    # through the windows: an event at a window's end is filtered with the neighbour's samples
    _, y = recording()
    found = U.detect(chunked(spark, {"a": y}, 800), fs, FREQS, 800, 4.0, halo=4.0).toPandas()
    assert (found["filtsigcor"] > 0.8).any()
    for e in found.itertuples():
        i0, i1 = round(e.start * fs), round(e.start * fs) + len(e.CSDwvf) - 1
        assert np.allclose(e.CSDwvf, y[i0 : i1 + 1])
        lo, hi = max(0, 800 * e.win_idx - 800), min(len(y), 800 * e.win_idx + 1600)
        want = U.event_waveform(y[lo:hi], i0 - lo, i1 - lo, U.own_band(e.minF, e.maxF, 0.5, fs), fs)
        assert np.allclose(e.filtsig, want[1]) and e.filtsigcor == pytest.approx(want[2])


def test_band_overrides(spark):
    t, _ = recording()
    x = 0.02 * RNG.standard_normal(4000)
    x[600:1000] += 3.2 * np.sin(2 * np.pi * 8 * t[600:1000])
    chunks = chunked(spark, {"a": x}, 4000)
    plain = {r["band"] for r in U.detect(chunks, 200.0, FREQS, 4000, 8.0).where("peakF BETWEEN 7.5 AND 8.5 AND power > 100").collect()}
    other = {r["band"] for r in U.detect(chunks, 200.0, FREQS, 4000, 8.0, bands={"alpha": (7.0, 15.0)}).where("peakF BETWEEN 7.5 AND 8.5 AND power > 100").collect()}
    assert plain == {"theta"} and other == {"theta", "alpha"}
    with pytest.raises(ValueError, match="without width"):
        U.resolved_bands({"alpha": (9.0, 9.0)})


def test_halo(spark):
    chunks = chunked(spark, {"a": np.arange(10.0), "b": np.arange(3.0)}, 4)
    got = {(r["channel"], r["chunk"]): (r["before"], r["values"], r["after"]) for r in U.with_halo(chunks, ["channel"], 3).collect()}
    assert got == {
        ("a", 0): ([], [0, 1, 2, 3], [4, 5, 6]), ("a", 1): ([1, 2, 3], [4, 5, 6, 7], [8, 9]), ("a", 2): ([5, 6, 7], [8, 9], []), ("b", 0): ([], [0, 1, 2], []),
    }
    assert U.with_halo(chunks.where(F.lit(False)), ["channel"], 3).collect() == []
