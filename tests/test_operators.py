import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import batch, chunks, events, masks, pairs, parse, select, sta, traces, triggered, validate, windows
from tracewell.operators import spikes as R
from tracewell.plans import driver
from tracewell.sources import cache, files, jobs, sinks

RESULT = {
    "simConfig": {"recordLFP": [[0, 100], [0, 300]], "recordStep": 1.0, "dt": 0.1, "duration": 6.0, "sizeY": 1000},
    "net": {
        "pops": {"IT2": {"cellGids": [0, 1], "tags": {"ynormRange": [0.0, 0.2]}}, "PV2": {"cellGids": [2], "tags": {"ynormRange": [0.2, 0.3]}}, "SILENT": {"cellGids": [3], "tags": {"ynormRange": [0, 1]}}, "EMPTY": {"cellGids": [], "tags": {"ynormRange": [0, 1]}}},
        "cells": [{"tags": {"pop": p}} for p in ("IT2", "IT2", "PV2", "SILENT")],
        "params": {"popParams": {"IT2": {"cellType": "IT"}, "PV2": {"cellType": "PV"}}},
    },
    "simData": {
        "LFP": [[2 * i + 1, 2 * i + 2] for i in range(6)], "LFPPops": {"IT2": [[20 * i + 10, 20 * i + 20] for i in range(6)]}, "spkid": [0, 1, 2, 0, 2], "spkt": [1.0, 2.0, 3.0, 4.5, 5.5], "t": [0, 1, 2, 3, 4],
        "V_soma": {"cell_2": [-60, -59, -58, -57, -56], "cell_0": [-65, -64, -63, -62, -61]},
    },
}


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    for j in (0, 1):
        (folder / f"grid_{j:05d}_data.json").write_text(json.dumps(RESULT))
    return jobs.read_results(spark, str(folder))


def test_parser(result):
    one = result.where("job_id = 0")
    p = parse.pops(one)
    assert values(p, "pop", "n_cells", "y_lo", "y_hi")[:2] == [("IT2", 2, 0.0, 200.0), ("PV2", 1, 200.0, 300.0)]
    assert dict(values(parse.net_size(one), "pop", "n_cells")) == {"IT2": 2, "PV2": 1, "SILENT": 1, "EMPTY": 0}
    assert values(parse.duration(one), "duration_s") == [(0.006,)]
    assert [t for (t,) in values(parse.record_times(one).orderBy("i"), "t")] == [0, 1, 2, 3, 4, 5]
    assert values(parse.lfp(one).where("i = 2").orderBy("ch"), "y", "v") == [(100.0, 5.0), (300.0, 6.0)]
    assert values(parse.pop_lfps(one).where("i = 1").orderBy("ch"), "pop", "v") == [("IT2", 30.0), ("IT2", 40.0)]
    assert sorted(values(parse.voltages(one, limits=(1, 2)), "pop", "gid", "t", "v")) == [("IT2", 0, 1.0, -64.0), ("IT2", 0, 2.0, -63.0), ("PV2", 2, 1.0, -59.0), ("PV2", 2, 2.0, -58.0)]
    assert dict(values(parse.pop_params(one), "pop", "cellType"))["PV2"] == "PV"
    s = parse.spikes(one)
    cells = parse.cells(one)
    assert values(R.extract(s, cells, (0.002, 0.0045), True, True).orderBy("t"), "pop", "t") == [("IT2", 0.0), ("PV2", 1.0), ("IT2", 2.5)]
    trains = {(p, g): t for p, g, t in values(R.trains(s, cells), "pop", "gid", "times")}
    assert trains["SILENT", 3] == [] and trains["IT2", 0] == [0.001, 0.0045]
    assert result.select("job_id").distinct().count() == 2


def test_rates_read_documents_once(result):
    from tracewell.plans import sweeps

    out = sweeps.results_to_rates(result, 0.0, 0.006, 0.003)
    assert result.inputFiles() and not set(result.inputFiles()) & set(out.inputFiles())
    found = {(p, b): r for p, b, r in values(out.where("job_id = 1"), "pop", "bin", "rate")}
    assert {k: round(r) for k, r in found.items() if r == r} == {("IT2", 0): 333, ("IT2", 1): 167, ("PV2", 0): 0, ("PV2", 1): 667, ("SILENT", 0): 0, ("SILENT", 1): 0}
    assert {k for k, r in found.items() if r != r} == {("EMPTY", 0), ("EMPTY", 1)}
    assert out.count() == 16


def test_sweep_of_rates_reads_documents_once(spark, result):
    from tracewell.plans import sweeps

    grid = spark.createDataFrame([("a", 0), ("b", 1), ("none", None)], "name string, job_id long")
    out = sweeps.collect_rates(grid, result.select("job_id", "net", "simData"), (0.0, 0.006), 0.003)
    assert not set(result.inputFiles()) & set(out.inputFiles())
    assert sorted(r["name"] for r in out.collect()) == ["a"] * 8 + ["b"] * 8 + ["none"]


@pytest.fixture(scope="module")
def trains(spark):
    rows = [("IT2", 0, t) for t in (0.1, 0.2, 0.4, 0.9)] + [("IT2", 1, t) for t in (0.15, 0.45, 0.75)] + [("PV2", 2, t) for t in (0.05, 0.35, 0.65)]
    return spark.createDataFrame(rows, "pop string, gid long, t double")


def test_rates(spark, trains):
    units = spark.createDataFrame([("IT2", 2), ("PV2", 1), ("NONE", 0)], "pop string, n_cells long")
    assert {p: r for p, _, r in values(R.rates(trains, units, ["pop"], 0.0, 1.0, F.col("n_cells")), "pop", "n_cells", "rate")} == {"IT2": 3.5, "PV2": 3.0, "NONE": None}
    binned = {(p, b): r for p, b, r in values(R.rate_dynamics(trains, units, ["pop"], 0.0, 1.0, 0.25, cells="n_cells"), "pop", "bin", "rate")}
    assert len(binned) == 12 and binned["IT2", 0] == 3 / 0.25 / 2 and np.isnan(binned["NONE", 1])
    folded = {(p, b): r for p, b, r in values(R.rate_dynamics(trains, units, ["pop"], 0.0, 1.0, 0.25, epoch=0.5), "pop", "bin", "rate")}
    assert folded["PV2", 0] == 2 / 0.5 and folded["PV2", 1] == 1 / 0.5
    cv = {g: c for g, c in values(R.interval_cv(trains, 0.0, 1.0), "gid", "cv")}
    assert cv[2] == pytest.approx(0) and cv[0] == pytest.approx(np.std([0.1, 0.2, 0.5]) / np.mean([0.1, 0.2, 0.5]))
    with pytest.raises(ValueError):
        R.rates(trains, units, ["pop"], 1.0, 1.0)


def long(spark, v, dt=0.1, t0=0.0):
    return spark.createDataFrame([(0, i, t0 + i * dt, float(x)) for i, x in enumerate(v)], "c int, i long, t double, v double")


@pytest.mark.parametrize(("x", "y"), [([1, 1, 1, -5, 1, 1, 1], [1] * 7), ([0, 0.5, 1, 1.5, 2, 2.5, 3], None), ([1, 1, -5, -5, 1, 1, 1], None), (list(np.sin(np.arange(20))), None), ([1, 9], None)])
def test_outlier_repair(spark, x, y):
    out = [v for (v,) in values(windows.repair_outliers(long(spark, x), ["c"]).orderBy("i"), "v")]
    assert out == pytest.approx(y or x)


@pytest.mark.parametrize(
    ("spikes", "expected", "n"), [([0.2, 0.5, 0.8], [2.5, 3.5, 4.5, 5.5], 2), ([0.05, 0.2, 0.5, 0.95], [2.5, 3.5, 4.5, 5.5], 2), ([], [], 0)]
)
def test_triggered_average(spark, spikes, expected, n):
    triggers = spark.createDataFrame([(0, t) for t in spikes], "c int, t double")
    signal = long(spark, range(10)).select("c", "i", "v")
    epochs = sta.epochs_long(triggers, signal, ["c"], 0.0, 0.1, 10, (-0.1, 0.2))
    assert epochs.select("spike").distinct().count() == n
    assert [v for (v,) in values(sta.average(epochs, ["c"], 0.1).orderBy("k"), "v")] == pytest.approx(expected)
    whole = traces.to_traces(long(spark, range(10)), ["c"], 0.0, 0.1)
    sliced = sta.epochs_trace(triggers, whole, ["c"], 0.1, (-0.1, 0.2))
    assert sliced.count() == n
    if n:
        assert np.mean([e for (e,) in values(sliced, "epoch")], 0) == pytest.approx(expected)


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1000])
def test_triggered_averages_from_chunks(spark, size):
    """Equal to the average of epochs, whatever the chunks: windows over several of them, shared samples, NaN, events at the ends or without a time."""
    rng = np.random.default_rng(size)
    x = {c: rng.normal(size=100) for c in (0, 1, 2)}
    x[1][::7] = np.nan
    signal = spark.createDataFrame([(c, i, float(v)) for c, row in x.items() for i, v in enumerate(row)], "c int, i long, v double")
    at = [(c, float(t)) for c in (0, 1) for t in rng.choice(np.arange(0, 10, 0.05), 80)] + [(0, None), (1, 0.0), (1, 9.9), (9, 5.0)]
    triggers = spark.createDataFrame(at * 2, "c int, t double")
    found = triggered.averages(triggers, chunks.to_chunks(signal, ["c"], size), ["c"], 0.0, 0.1, 100, (-0.5, 0.8), size)
    expected = {(r.c, r.k): r for r in sta.average(sta.epochs_long(triggers, signal, ["c"], 0.0, 0.1, 100, (-0.5, 0.8)), ["c"], 0.1).collect()}
    rows = found.collect()
    assert len(rows) == len(expected) == 28
    for r in rows:
        e = expected[r.c, r.k]
        assert (r.v, r.n, r.t_rel) == (pytest.approx(e.v), e.n, pytest.approx(e.t_rel))
    one = triggered.averages(triggers.where("c = 0").drop("c"), chunks.to_chunks(signal.where("c = 0"), [], size), [], 0.0, 0.1, 100, (-0.5, 0.8), size)
    assert {r.k: r.v for r in one.collect()} == {k: pytest.approx(e.v) for (c, k), e in expected.items() if c == 0}
    assert triggered.averages(triggers.limit(0), chunks.to_chunks(signal, ["c"], size), ["c"], 0.0, 0.1, 100, (-0.5, 0.8), size).count() == 0


def test_a_jobs_file_is_whole(spark, tmp_path):
    """Whatever the session says of records per file; all of a job's rows are in it."""
    df = spark.range(40).selectExpr("cast(id % 3 AS int) AS job_id", "id AS v")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        sinks.save_per_job(df, str(tmp_path), "job_{job:05d}.parquet")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(p.name for p in tmp_path.glob("job_*")) == [f"job_{k:05d}.parquet" for k in range(3)]
    assert [spark.read.parquet(str(tmp_path / f"job_{k:05d}.parquet")).count() for k in range(3)] == [14, 13, 13]


def test_bounds_of_signals_follow_the_table(spark, tmp_path):
    """A folder whose events change in a session has the bounds of what it holds now."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = []
    for part in (events, events.withColumn("ts", F.expr("if(event_id % 2 = 0, ts + INTERVAL 10 DAYS, ts)"))):
        part.write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        days.append(driver.hours(spark, str(tmp_path)) // 24)
    assert days[1] == days[0] + 10


def test_trace_without_keys_is_one(spark):
    triggers = spark.createDataFrame([(0.3,), (0.5,)], "t double")
    whole = traces.to_traces(long(spark, range(10)), ["c"], 0.0, 0.1)
    assert sta.epochs_trace(triggers, whole.drop("c"), [], 0.1, (-0.1, 0.2)).count() == 2
    with pytest.raises(ValueError, match="2 traces"):
        sta.epochs_trace(triggers, whole.unionByName(whole).drop("c"), [], 0.1, (-0.1, 0.2))


def test_mask_split(spark):
    mask = spark.createDataFrame([(y, i, int(i == k)) for y, k in ((100, 2), (300, 5)) for i in range(10)], "y int, i long, m int")
    triggers = spark.createDataFrame([(100, t) for t in (0.2, 0.5, 0.8)], "y int, t double")
    split = sta.split_by_mask(triggers, mask, ["y"], 0.0, 0.1, 10)
    assert sorted(values(split, "t", "state")) == [(0.2, 1), (0.5, 0), (0.8, 0)]


def test_intervals(spark):
    rows = [("y_0", i, float(10 + i), m) for i, m in enumerate((0, 1, 1, 0))] + [("y_200", i, float(10 + i), m) for i, m in enumerate((1, 0, 0, 1))]
    mask = spark.createDataFrame(rows, "channel string, i long, t double, m int")
    runs = masks.runs(mask, ["channel"])
    assert sorted(values(runs.where("state = 1"), "channel", "t_start", "t_end")) == [("y_0", 11.0, 12.0), ("y_200", 10.0, 10.0), ("y_200", 13.0, 13.0)]
    back = masks.rasterise(runs.where("state = 1"), mask.select("channel", "i"), ["channel"], 10.0, 1.0)
    assert sorted(values(back, "channel", "i", "m")) == sorted(values(mask, "channel", "i", "m"))
    validate.intervals(runs, ["channel"])
    with pytest.raises(ValueError):
        validate.intervals(spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 4.0)], "channel string, t_start double, t_end double"), ["channel"])
    keys = spark.createDataFrame([(100.0,), (0.0,), (12.5,)], "y double").select(masks.channel_key(F.col("y")).alias("k"))
    assert [k for (k,) in values(keys, "k")] == ["y_100", "y_0", "y_12.5"]


def test_resampling(spark):
    signal = long(spark, [0, 10, 20], 1.0).select("i", "v")
    grid = spark.createDataFrame([(-0.5,), (0.25,), (1.5,), (2.0,), (2.5,)], "t double")
    assert dict(values(masks.resample_linear(signal, grid, 0.0, 1.0), "t", "v")) == {-0.5: None, 0.25: 2.5, 1.5: 15.0, 2.0: 20.0, 2.5: None}
    assert dict(values(masks.resample_nearest(signal, grid, 0.0, 1.0), "t", "v")) == {-0.5: None, 0.25: 0.0, 1.5: 10.0, 2.0: 20.0, 2.5: 20.0}


def test_lead_lag(spark):
    corr = spark.createDataFrame([("a", "b", k, c) for k, c in zip(range(-2, 3), (3.0, 1.0, 0.0, 0.5, 1.0), strict=True)], "pop_i string, pop_j string, lag long, c double")
    ((diff, bounded),) = values(pairs.lead_lag(corr, 0.01, -2, 2), "diff", "bounded")
    assert diff == pytest.approx(0.01 * (2 - 0.75)) and 0 < bounded < 1
    ((diff,),) = values(pairs.lead_lag(corr.where("lag IN (0, 1)"), 0.01, -2, 2), "diff")
    assert np.isnan(diff)


def test_coherence_table(spark):
    rows = [("IT2", "PV3", f, z.real, z.imag) for f, z in ((5, 0.1 + 0j), (10, 1 + 0j), (12, 1j), (20, 0.2 + 0j))]
    s = spark.createDataFrame(rows, "pop_i string, pop_j string, freq int, re double, im double")
    ((coh, phase),) = values(pairs.band_mean(s, 8, 14), "coh", "phase")
    assert coh == pytest.approx(abs(0.5 + 0.5j)) and phase == pytest.approx(np.pi / 4)
    m = pairs.mirrored(pairs.band_mean(s, 8, 14), ("phase",))
    assert sorted(p for (p,) in values(m, "phase")) == pytest.approx([-np.pi / 4, np.pi / 4])
    ((amp,),) = values(pairs.summarise_cpsd(s, 8, 14), "amp")
    assert amp == pytest.approx(1)


def test_events(spark):
    raw = spark.createDataFrame([("theta", 1, 3.0, 1.0, 0.5, 100.0, 50.0, 150.0, 100.0, "x"), ("alpha", 0, 2.0, 1.0, 0.5, 200.0, 150.0, 250.0, 100.0, "x"), ("alpha", 1, 4.0, 1.5, 0.2, 300.0, 250.0, 350.0, 100.0, "x\ny"), ("beta", 0, 9.0, 1.0, 0.9, 1.0, 1.0, 1.0, 1.0, "x")], "band string, chan int, ncycle double, Foct double, filtsigcor double, absPeakT double, absminT double, absmaxT double, dur double, note string")
    out = events.normalise(raw, ["theta", "alpha"], 5.0, 3, 1.5, 0.2).orderBy("peak_time_s")
    assert [p for (p,) in values(out, "event_passed")] == [True, False, True]
    assert [t for (t,) in values(out, "peak_time_s")] == [5.1, 5.2, 5.3]
    assert all(np.isnan(f) for (f,) in values(out, "peakF"))
    table = events.csv_table(out.withColumn("MUAx", F.lit(1)).withColumn("w", F.array("dur")))
    assert not {"note", "MUAx", "w"} & set(table.columns)
    clipped = events.clip_frequencies(spark.createDataFrame([(1.0, 5.0), (90.0, 95.0)], "minF double, maxF double"), 2.0, 80.0)
    assert values(clipped, "frame_lo", "frame_hi") == [(2.0, 5.0), (80.0, 80.0)]


def test_selection(spark):
    channels = spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "y double")
    targets = spark.createDataFrame([(0, 150.0), (1, 90.0), (2, 210.0), (3, 900.0)], "ord long, y_req double")
    assert sorted(values(select.nearest(channels, targets), "y", "ord")) == [(100.0, 1), (200.0, 0), (300.0, 3)]
    assert sorted(values(select.nearest(channels, targets, tie="smaller"), "y", "ord")) == [(100.0, 0), (200.0, 2), (300.0, 3)]
    assert select.stepped(300, 100, 100) == [100, 200, 300]
    pops = spark.createDataFrame([("IT2", 0), ("PV5A", 1), ("IT2_frz", 2)], "pop string, pop_ord int")
    assert values(select.populations(pops, ["PV5A", "IT2"]).orderBy("ord"), "pop") == [("PV5A",), ("IT2",)]
    for bad in (["XX"], ["IT2", "IT2"], [" "], ["IT2_frz"]):
        with pytest.raises(ValueError):
            select.populations(pops, bad)
    assert values(pops.select(select.cell_type(F.col("pop")).alias("c"), select.layer_of(F.col("pop")).alias("l")), "c", "l") == [("PYR", "L2"), ("PV", "L5A"), ("PYR", "L2")]
    with pytest.raises(KeyError):
        select.in_layers(channels, spark.createDataFrame([("L1", 0.0, 1.0)], "layer string, y0 double, y1 double"), ["L9"])


def test_batch(spark, tmp_path):
    for j in (0, 1):
        (tmp_path / f"grid_{j:05d}_cfg.json").write_text(json.dumps({"simConfig": {"rx": 10 * (j + 1), "wx": 0.1}}))
        (tmp_path / f"result_{j:05d}_x.json").write_text(json.dumps({"rates": {"IT2": 1.0 + j, "PV2": 2.0 + j}}))
    params = jobs.read_params(spark, str(tmp_path), ["rx", "wx"])
    assert sorted(values(params, "job_id", "rx", "wx")) == [(0, 10, 0.1), (1, 20, 0.1)]
    grid = batch.job_grid(params, ["rx", "wx"])
    docs = jobs.read_job_raw(spark, str(tmp_path), "result_{job:05d}_*.json").withColumn("rates", F.get_json_object("json", "$.rates"))
    rows = batch.json_to_long(docs, "rates", ["pop"], ["job_id"], {"pop": ["IT2", "XX"]})
    assert sorted(values(rows, "job_id", "pop", "value"), key=str) == [(0, "IT2", 1.0), (0, "XX", None), (1, "IT2", 2.0), (1, "XX", None)]
    assert batch.stack(grid, rows).count() == 4
    batch.require_jobs(grid, rows)
    with pytest.raises(FileNotFoundError):
        batch.require_jobs(grid, rows.where("job_id = 0"))
    with pytest.raises(ValueError):
        batch.job_grid(params.withColumn("rx", F.lit(1)), ["rx"])
    with pytest.raises(ValueError, match="t_limits"):
        batch.compatible(spark.createDataFrame([(0, 1.0), (1, 2.0)], "job_id long, t double"), ["t"])
    (tmp_path / "result_00001_y.json").write_text("{}")
    with pytest.raises(RuntimeError):
        jobs.read_job_json(spark, str(tmp_path))


def test_ragged_and_pickles(spark, tmp_path):
    np.savez(tmp_path / "spikes_00003.npz", pop_names=np.array(["A"]), A__values=np.array([0.1, 0.2, 0.3]), A__offsets=np.array([0, 2, 2, 3]), A__gids=np.array([7, 8, 9]))
    assert sorted(values(jobs.read_ragged(spark, str(tmp_path)), "job_id", "gid", "t")) == [(3, 7, 0.1), (3, 7, 0.2), (3, 9, 0.3)]


def test_cache_and_sinks(spark, tmp_path):
    path, calls = str(tmp_path / "r"), []

    def build():
        calls.append(1)
        return spark.range(3)

    src = str(tmp_path / "src")
    sinks.save(spark.range(5), src, {"k": 1})
    for expected, p in ((False, {"bands": (5, 12)}), (True, {"bands": [5, 12], "load": True}), (False, {"bands": [5, 13]})):
        _, hit = cache.load_or_run(spark, path, build, "step", p, src)
        assert hit is expected
    assert len(calls) == 2
    with pytest.raises(ValueError):
        cache.load_or_run(spark, path, build, "step", {"bands": 1}, src, on_mismatch="raise")
    assert cache.fingerprint(spark, path) == {"cache_id": sinks.load_meta(spark, path)["cache_id"]}
    made = []
    build_jobs = lambda js: made.append(js) or spark.createDataFrame([(j, 1.0) for j in js], "job_id long, v double")
    for want in ([0, 1], [1, 2]):
        out = cache.append_missing(spark, str(tmp_path / "jobs"), want, build_jobs, {"t": 1})
    assert made == [[0, 1], [2]] and out.count() == 3
    with pytest.raises(ValueError):
        cache.append_missing(spark, str(tmp_path / "jobs"), [3], build_jobs, {"t": 2})
    assert cache.tag(f=-0.5, b=(8, 14)) == "f_m0p5__b_8_14"
    assert not sinks.validate_or_write(spark, str(tmp_path / "m.json"), {"a": 1})
    assert sinks.validate_or_write(spark, str(tmp_path / "m.json"), {"a": 1})
    with pytest.raises(ValueError):
        sinks.validate_or_write(spark, str(tmp_path / "m.json"), {"a": 2})
    m = spark.createDataFrame([("a", "b", 0.5), ("b", "a", float("nan"))], "pop_i string, pop_j string, v double")
    assert sorted(values(sinks.matrix(m, "v", ["a", "b"], 2), "pop_i", "a", "b")) == [("a", "nan", "0.50"), ("b", "nan", "nan")]
    with pytest.raises(TypeError):
        sinks.save([1], path)
    assert files.exists(spark, path)


def test_validation(spark):
    good = long(spark, range(5))
    assert validate.regular_time(good, ["c"]) == pytest.approx(0.1)
    for bad in (good.where("i <> 2"), good.where("i = 0"), good.withColumn("t", F.lit(1.0))):
        with pytest.raises(ValueError):
            validate.regular_time(bad, ["c"])
    validate.consistent_rate(10.0, 0.1)
    with pytest.raises(ValueError):
        validate.consistent_rate(10.0, 0.2)
    with pytest.raises(ValueError):
        validate.binary_mask(good.withColumn("m", F.lit(2)), ["c"])
    with pytest.raises(ValueError):
        validate.same_axes(good, good.where("i < 3"), ["i"])
    with pytest.raises(ValueError):
        validate.any_finite(good.withColumn("v", F.lit(float("nan"))))


def test_streaming_equals_batch(spark, tmp_path):
    from tracewell.streaming.rates import windowed_rates

    events_ = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events_.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events_.schema).parquet(str(tmp_path / "in"))
    q = windowed_rates(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("windowed"), "pop", "t_start", "n")) == sorted(values(windowed_rates(events_), "pop", "t_start", "n"))


def test_names_and_labels_that_are_unknown_raise(spark):
    names = spark.createDataFrame([("TC",), ("HTC_frz",), ("TIM",), ("ct6",)], "pop string")
    assert values(names.select(select.cell_type(F.col("pop")).alias("c"), select.layer_of(F.col("pop")).alias("l")), "c", "l") == [("TC", "THAL"), ("TC", "THAL"), ("TI", "THAL"), ("PYR", "L6")]
    odd = spark.createDataFrame([("QQ9",)], "pop string")
    for f in (select.cell_type, select.layer_of):
        with pytest.raises(Exception, match="population QQ9"):
            odd.select(f(F.col("pop")).alias("x")).collect()
    channels = spark.createDataFrame([(300.0,), (100.0,), (100.0,)], "y double")
    assert values(select.numbered_channels(channels), "channel", "channel_y") == [(0, 100.0), (1, 300.0)]
    assert values(select.numbered_channels(channels, 300.0), "channel", "channel_y") == [(0, 300.0)]
    with pytest.raises(ValueError, match="there are"):
        select.exact(channels, "y", [100.0, 5.0])


def test_half_written_jobs_are_built_again(spark, tmp_path):
    from tracewell.sources import cache, sinks

    path, built = str(tmp_path / "jobs"), []

    def build(jobs):
        built.extend(jobs)
        return spark.createDataFrame([(j, 1.0) for j in jobs], "job_id long, v double")

    def broken(jobs):
        raise OSError("lost")

    with pytest.raises(OSError):
        cache.append_missing(spark, path, [1, 2], broken, {"t": 1})
    assert cache.append_missing(spark, path, [1, 2], build, {"t": 1}).count() == 2
    assert cache.append_missing(spark, path, [1, 2, 3], build, {"t": 1}).count() == 3 and built == [1, 2, 3]
    sinks.save(spark.range(3), str(tmp_path / "t"), {"a": 1})
    sinks.save(spark.range(4), str(tmp_path / "t"), {"a": 2})
    assert sinks.load(spark, str(tmp_path / "t")).count() == 4 and not (tmp_path / "t.old").exists()


# --- sweeps, archives, checks ------------------------------------------------------


def test_sweep_missing_jobs_raise_or_stay_empty(spark):
    from tracewell.plans import sweeps

    grid = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, None)], "p double, job_id long")
    results = spark.createDataFrame([(1, 0, 5.0), (7, 0, 9.0)], "job_id long, i long, v double")
    with pytest.raises(FileNotFoundError):
        sweeps.on_grid(grid, results)
    out = {(r.p, r.v) for r in sweeps.on_grid(grid, results, skip_missing=True).collect()}
    assert out == {(1.0, 5.0), (2.0, None), (3.0, None)}


def test_sweep_axes_must_agree(spark):
    from tracewell.plans import sweeps

    grid = spark.createDataFrame([(1.0, 1), (2.0, 2)], "p double, job_id long")
    results = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (2, 0, 9.0), (2, 2, 9.0)], "job_id long, i long, v double")
    with pytest.raises(ValueError, match="t_limits"):
        sweeps.on_grid(grid, results, axes=("i",))


def test_json_lists_need_their_length(spark):
    from tracewell.operators import batch

    df = spark.createDataFrame([(1, '{"a": [1.0, 2.0], "b": [3.0, 4.0]}')], "job_id long, j string")
    out = {(r.pop, r.t, r.value) for r in batch.json_lists_to_long(df, "j", ["pop"], ["job_id"], [10, 20], "t", {"pop": ["b", "c"]}).collect()}
    assert out == {("b", 10, 3.0), ("b", 20, 4.0), ("c", 10, None), ("c", 20, None)}
    with pytest.raises(Exception, match="must have 3 values"):
        batch.json_lists_to_long(df, "j", ["pop"], ["job_id"], [1, 2, 3], "t").collect()


def test_archive_round_trip_and_version(spark, tmp_path):
    from tracewell.sources import files, sinks

    spikes = spark.createDataFrame([(1, "a", 0.5)], "job_id long, pop string, t double")
    pops = spark.createDataFrame([(1, "a", 1), (1, "b", 0)], "job_id long, pop string, n_cells long")
    path = f"{tmp_path}/archive"
    sinks.save_spikes(spikes, pops, path, {"t0": 0.0, "tmax": 1.0, "subtract_t0": False, "ms": False})
    back, found, meta = sinks.load_spikes(spark, path)
    assert back.count() == 1 and found.count() == 2 and meta["tmax"] == 1.0
    files.write_text(spark, f"{path}/spikes.meta.json", '{"format_version": 9}')
    with pytest.raises(ValueError, match="version"):
        sinks.load_spikes(spark, path)


def test_packed_results_have_one_shape(spark):
    from tracewell.operators import events

    traces = spark.createDataFrame([("y_1", [1.0, 2.0])], "channel string, values array<double>")
    good = spark.createDataFrame([("y_1", 4.0, [1.0, 2.0])], "channel string, freq double, power array<double>")
    short = spark.createDataFrame([("y_1", 4.0, [1.0])], "channel string, freq double, power array<double>")
    table = spark.createDataFrame([(1, [1.0])], "n long, sig array<double>")
    assert events.unpack(events.pack(traces, good, table)).columns == ["n"]
    with pytest.raises(ValueError, match="differ"):
        events.pack(traces, short, table)
    with pytest.raises(ValueError, match="lacks"):
        events.unpack({"traces": traces})


def test_triggers_without_shared_population_raise(spark):
    from tracewell.operators import sta

    triggers = spark.createDataFrame([("a", 1.0)], "pop string, t double")
    with pytest.raises(ValueError, match="name that"):
        sta.shared_pops(triggers, spark.createDataFrame([(0, 1.0)], "i long, v double"))
    with pytest.raises(ValueError, match="share no"):
        sta.shared_pops(triggers, spark.createDataFrame([("b", 0)], "pop string, i long"))


def test_lead_lag_of_narrow_windows(spark):
    from tracewell.operators import pairs

    corr = spark.createDataFrame([("a", "b", k, float(k * k)) for k in range(-3, 4)], "pop_i string, pop_j string, lag long, c double")
    r = pairs.lead_lag(corr, 1.0, -1, 2).first()
    assert (r["lead"], r["lag"]) == (1.0, 2.5)
