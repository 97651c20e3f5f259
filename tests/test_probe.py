"""The probe job: stages, resuming, settings, and its events against the one-call form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.plans import probe as J
from tracewell.plans import workflows as P
from tracewell.sources import cache, files

FREQS = [float(f) for f in range(4, 21)]


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(6)
    rows = []
    for y in (50.0, 100.0, 150.5):
        t = np.arange(2400) / 100.0
        x = 0.05 * rng.standard_normal(2400)
        if y != 100.0:
            x[1350:1450] += np.sin(2 * np.pi * 10 * t[1350:1450]) * (2 if y == 50.0 else 3)
        rows += [(y, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))]
    return spark.createDataFrame(rows, "y double, i long, t double, v double").cache()


SETTINGS = J.Settings(100.0, FREQS, ["alpha", "theta"], t1=2.0, t2=22.0, winsz=5.0, threshold=6.0, repair=True)


def parts(spark, path):
    return {(s, c): tuple(files.stamp(spark, files.glob(spark, f"{path}/{s}/channel={c}/*.parquet"))) for s, cs in J.status(spark, path).items() for c in cs}


def test_probe_resumes_by_channel_and_stage(spark, signal, tmp_path, monkeypatch):
    path, real = str(tmp_path / "p"), J.P.event_mask

    def killed(*a, **k):
        raise OSError("killed")

    monkeypatch.setattr(J.P, "event_mask", killed)
    with pytest.raises(OSError):
        J.run(spark, path, signal, SETTINGS, ["y_50"])
    assert {s: len(c) for s, c in J.status(spark, path).items()} == {"prepared": 1, "spectrogram": 1, "events": 1, "mask": 0}
    first = parts(spark, path)
    monkeypatch.setattr(J.P, "event_mask", real)
    J.run(spark, path, signal, SETTINGS, step=2)
    second = parts(spark, path)
    assert all(second[k] == v for k, v in first.items()) and len(second) == 12  # what was there is not built again
    assert J.run(spark, path, signal, SETTINGS) and parts(spark, path) == second
    files.delete(spark, f"{path}/events/channel=y_150.5")
    tables = J.run(spark, path, signal, SETTINGS)
    third = parts(spark, path)
    assert {k for k in second if third[k] != second[k]} == {("events", "y_150.5")}
    with pytest.raises(ValueError, match="other settings"):
        J.run(spark, path, signal, J.Settings(100.0, FREQS, ["alpha"]))
    with pytest.raises(ValueError, match="no channels"):
        J.run(spark, path, signal, SETTINGS, ["y_7"])
    # the events of the one-call form, and a mask that covers them
    one = P.probe_events(signal, 100.0, FREQS, ["alpha", "theta"], 2.0, 22.0, 5.0, 6.0)
    of = lambda df: sorted((r["chan"], r["band"], round(r["peak_time_s"], 6), round(r["start_time_s"], 6), round(r["peakF"], 6), round(r["avgpow"], 6)) for r in df.collect())
    assert of(tables["events"]) == of(one) and of(one)
    strong = one.where("chan <> 100 AND peakF BETWEEN 9 AND 11").select("chan", "peak_time_s").collect()
    assert {r["chan"] for r in strong} == {50.0, 150.5} and any(13.3 <= r["peak_time_s"] <= 14.7 for r in strong)
    on = {(r["y"], round(r["t"], 2)) for r in tables["mask"].join(tables["prepared"].select("y", "i", "t"), ["y", "i"]).where("m = 1").collect()}
    spans = [(r["chan"], r["start_time_s"], r["stop_time_s"]) for r in one.where("event_passed").collect()]
    assert on == {(y, round(k / 100, 2)) for y, a, b in spans for k in range(2400) if a - 1e-9 <= k / 100 <= b + 1e-9}


def test_channels_that_a_stage_lacks_are_not_shown(spark, signal, tmp_path):
    path = str(tmp_path / "q")
    J.run(spark, path, signal, SETTINGS, ["y_50", "y_100"])
    files.delete(spark, f"{path}/mask/channel=y_100")
    assert cache.finished(spark, f"{path}/mask", "channel") == {"y_50"}
    shown = J.run(spark, path, signal, SETTINGS, ["y_50"])
    assert {n: {r["channel"] for r in df.select("channel").distinct().collect()} for n, df in shown.items() if n != "events"} == {n: {"y_50"} for n in ("prepared", "spectrogram", "mask")}
    assert shown["spectrogram"].agg(F.countDistinct("freq")).first()[0] == len(FREQS)
