"""Archives, plain pickles, incremental tables and gridded files: round trips, hostile and broken inputs, killed runs."""

import collections
import io
import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import kernels as K
from tracewell.operators import masks as M
from tracewell.sources import archives, cache, jobs

SPIKES = "job_id long, pop string, gid long, t double"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- archives of trains ----------------------------------------------------------


def test_ragged_round_trip(spark, tmp_path):
    rows = [(j, p, g, float(t)) for j in (0, 3, 12) for p, g in (("PV", 9), ("E", 4), ("E", 2)) for t in (0.5 * j + g, g)]
    df = spark.createDataFrame(rows, SPIKES).repartition(5)
    meta = {"t0": 1.0, "tmax": 20.0, "subtract_t0": True, "ndigits": 3}
    archives.save_ragged(df, str(tmp_path), {"E": 3, "PV": 1, "silent": 7}, meta)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["spikes_00000.npz", "spikes_00003.npz", "spikes_00012.npz"]
    with np.load(tmp_path / "spikes_00003.npz", allow_pickle=False) as z:
        assert z["pop_names"].tolist() == ["E", "PV", "silent"] and int(z["pop_2__pop_size"]) == 7 and int(z["format_version"]) == 1
        assert z["pop_0__cell_gids"].tolist() == [2, 4] and z["pop_0__cell_offsets"].tolist() == [0, 2, 4] and z["pop_0__cell_times"].tolist() == [2.0, 3.5, 4.0, 5.5]
        assert (float(z["meta__t0"]), bool(z["meta__subtract_t0"]), bool(z["meta__ms"]), int(z["meta__ndigits"])) == (1.0, True, False, 3)
        assert len(z["pop_2__cell_times"]) == 0
    assert values(jobs.read_ragged(spark, str(tmp_path)), "job_id", "pop", "gid", "t") == sorted(rows)
    archives.save_ragged(df, str(tmp_path / "c"), {"E": 3, "PV": 1}, {"combine": True})
    assert values(jobs.read_ragged(spark, str(tmp_path / "c")).where("job_id = 3"), "pop", "gid", "t") == [("E", -1, 2.0), ("E", -1, 3.5), ("E", -1, 4.0), ("E", -1, 5.5), ("PV", -1, 9.0), ("PV", -1, 10.5)]


def test_aborted_archives_leave_nothing(spark, tmp_path):
    good = spark.createDataFrame([(1, "E", 1, 0.5)], SPIKES)
    archives.save_ragged(good, str(tmp_path), {"E": 1})
    before = (tmp_path / "spikes_00001.npz").read_bytes()
    bad = spark.createDataFrame([(j, "E" if j < 9 else "other", 1, 9.5) for j in range(10)], SPIKES)
    with pytest.raises(Exception, match="no population"):
        archives.save_ragged(bad, str(tmp_path), {"E": 1})
    assert [p.name for p in tmp_path.iterdir()] == ["spikes_00001.npz"] and (tmp_path / "spikes_00001.npz").read_bytes() == before
    with pytest.raises(ValueError, match="unknown settings"):
        archives.save_ragged(good, str(tmp_path), {"E": 1}, {"t9": 1})
    archives.save_ragged(good.limit(0), str(tmp_path), {"E": 1})
    assert [p.name for p in tmp_path.iterdir()] == ["spikes_00001.npz"]


def test_unknown_archive_version(spark, tmp_path):
    np.savez(tmp_path / "spikes_00001.npz", format_version=np.array(2), pop_names=np.array(["E"]))
    with pytest.raises(Exception, match="version 2 is unknown"):
        jobs.read_ragged(spark, str(tmp_path)).collect()


# --- pickles -----------------------------------------------------------------------


class Hostile:
    def __init__(self, path):
        self.path = path

    def __reduce__(self):
        return os.system, (f"touch {self.path}",)


def test_plain_pickles_run_nothing(spark, tmp_path):
    plain = {"a": [1, 2.5, float("nan"), None], "b": np.arange(3), "c": {"d": np.array([[1.0, np.inf]]), "e": (True, {3})}, "f": np.float64(2), "o": collections.OrderedDict(x=1), "s": np.array(["p", "q"])}
    with (tmp_path / "grid_00004_data.pkl").open("wb") as f:
        pickle.dump(plain, f)
    got = jobs.read_pickles(spark, str(tmp_path), schema=None).collect()
    assert [r["job_id"] for r in got] == [4]
    assert __import__("json").loads(got[0]["json"]) == {"a": [1, 2.5, None, None], "b": [0, 1, 2], "c": {"d": [[1.0, None]], "e": [True, [3]]}, "f": 2.0, "o": {"x": 1}, "s": ["p", "q"]}
    mark = tmp_path / "mark"
    with (tmp_path / "grid_00005_data.pkl").open("wb") as f:
        pickle.dump({"x": Hostile(mark)}, f)
    with pytest.raises(Exception, match="no plain data"):
        jobs.read_pickles(spark, str(tmp_path), schema=None).collect()
    assert not mark.exists()
    for protocol in range(6):
        assert jobs.load_plain(pickle.dumps([1, {"x": np.arange(4.0)}], protocol))[1]["x"].tolist() == [0, 1, 2, 3]
    for hostile in (eval, os.system, np.load, pickle.loads, io.open, type):
        with pytest.raises(pickle.UnpicklingError):
            jobs.load_plain(pickle.dumps(hostile))


def test_first_available_raises_what_is_broken(spark, tmp_path):
    gone = lambda: spark.read.parquet(str(tmp_path / "gone"))
    assert jobs.first_available(gone, lambda: spark.range(3)).count() == 3
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        jobs.first_available(lambda: spark.read.parquet(str(tmp_path / "bad.parquet")), lambda: spark.range(3)).count()
    with pytest.raises(Exception, match="gone"):
        jobs.first_available(gone)


# --- incremental tables --------------------------------------------------------------


def test_incremental_table_resumes(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def build(part):
        if 5 in part and not (tmp_path / "well").exists():
            raise OSError("killed")
        made.extend(part)
        return spark.createDataFrame([(j, 1.5 * j) for j in part if j % 3], "job_id long, v double")

    with pytest.raises(OSError):
        cache.append_missing(spark, path, list(range(8)), build, {"t": 1}, step=2)
    assert made == [0, 1, 2, 3] and cache.finished(spark, path) == {"0", "1", "2", "3"}
    (tmp_path / "well").touch()
    out = cache.append_missing(spark, path, list(range(8)), build, {"t": 1}, step=2)
    assert made == list(range(8)) and values(out, "job_id", "v") == [(j, 1.5 * j) for j in (1, 2, 4, 5, 7)]
    cache.append_missing(spark, path, list(range(8)), build, {"t": 1})
    assert made == list(range(8))  # also jobs without rows are known
    cache.files.delete(spark, f"{path}/job_id=4")
    assert cache.append_missing(spark, path, list(range(8)), build, {"t": 1}).count() == 5 and made[8:] == [4]
    with pytest.raises(ValueError, match="other settings"):
        cache.append_missing(spark, path, [1], build, {"t": 2})


def test_incremental_table_without_rows_and_with_text_slots(spark, tmp_path):
    none = lambda part: spark.createDataFrame([], "v double, channel string")
    out = cache.append_missing(spark, str(tmp_path / "e"), ["a"], none, {}, "channel")
    assert out.count() == 0 and dict(out.dtypes) == {"v": "double", "channel": "string"}
    some = lambda part: spark.createDataFrame([(1.0, c) for c in part], "v double, channel string")
    names = ["y_1.5", "a b/c=%", "007"]
    assert values(cache.append_missing(spark, str(tmp_path / "n"), names, some, {}, "channel"), "channel") == sorted((n,) for n in names)
    assert cache.finished(spark, str(tmp_path / "n"), "channel") == set(names)


def test_a_partial_build_is_not_taken(spark, tmp_path):
    path = str(tmp_path / "t")
    build = lambda part: spark.createDataFrame([(j, 1.0) for j in part], "job_id long, v double")
    cache.append_missing(spark, path, [1], build, {})
    spark.createDataFrame([(2, 9.0), (2, 9.0)], "job_id long, v double").write.mode("append").partitionBy("job_id").parquet(path)  # never entered
    assert cache.finished(spark, path) == {"1"}
    assert values(cache.append_missing(spark, path, [1, 2], build, {}), "job_id", "v") == [(1, 1.0), (2, 1.0)]


# --- control intervals -----------------------------------------------------------------


def test_controls_are_functions_of_their_numbers(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in ("a", "b", "c"):
        t = 0.0
        for k in range(40):
            d = float(rng.uniform(0.1, 1.0) if k % 2 else rng.uniform(0.5, 4.0))
            rows.append((c, k % 2, t, t + d))
            t += d + 0.01
    schema = "channel string, state int, t_start double, t_end double"
    df = spark.createDataFrame(rows, schema)
    place = lambda d: values(M.control_intervals(d, seed=7, independent=True), "channel", "k", "t_start", "t_end", "seed")
    got = place(df)
    assert place(spark.createDataFrame(rows[::-1], schema).repartition(3)) == got
    assert place(df.where("channel <> 'a'")) == [r for r in got if r[0] != "a"]
    assert values(M.control_intervals(df, seed=8, independent=True), "channel", "k", "t_start", "t_end", "seed") != got
    for c in ("a", "b", "c"):
        on, free = ([r[2:] for r in rows if r[0] == c and r[1] == s] for s in (1, 0))
        ours = [r[2:4] for r in got if r[0] == c]
        assert [round(b - a, 9) for a, b in ours] == [round(b - a, 9) for a, b in on]
        assert all(any(lo - 1e-9 <= a and b <= hi + 1e-9 for lo, hi in free) for a, b in ours)
        apart = sorted(ours)
        assert all(x[1] <= y[0] for x, y in zip(apart, apart[1:], strict=False))
    starts = [K.interval_stream(7, "a", k, 0).uniform() for k in range(2000)]
    assert len(set(starts)) == 2000 and abs(np.mean(starts) - 0.5) < 0.03
    with pytest.raises(Exception, match="no placement"):
        M.control_intervals(spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 0, 5.0, 6.0)], schema), independent=True, tries=3).collect()
    assert M.control_intervals(df.where(F.lit(False)), independent=True).collect() == []


# --- smaller requests --------------------------------------------------------------------


def test_depth_requests(spark):
    from tracewell.operators import select as L

    channels = spark.createDataFrame([(float(y),) for y in (10, 20, 30, 40, 20)], "y double")
    ask = lambda **how: [tuple(r) for r in L.requested(channels, **how).orderBy("ord").collect()]
    assert ask() == ask(values="ALL ") == [(10.0, 0, 10.0), (20.0, 1, 20.0), (30.0, 2, 30.0), (40.0, 3, 40.0)]
    assert ask(span=(35, 15)) == [(20.0, 0, 20.0), (30.0, 1, 30.0)]
    assert ask(span=(10, 40), step=15) == [(10.0, 0, 10.0), (30.0, 1, 25.0), (40.0, 2, 40.0)]
    assert ask(values=[38, 1, 39]) == [(40.0, 0, 38.0), (10.0, 1, 1.0)]
    with pytest.raises(ValueError, match="'all'"):
        ask(values="some")
    with pytest.raises(ValueError, match="positive"):
        ask(span=(1, 2), step=0)


def test_masks_with_other_dimensions_raise(spark, tmp_path):
    from tracewell.sources import gridded

    grid = {"y": (["y"], [1.0, 2.0]), "time": (["time"], [0.0, 0.5, 1.0])}
    cells = np.array([[0, 1, 1], [1, 0, 0]])
    (tmp_path / "m.nc").write_bytes(gridded.encode({"y": 2, "time": 3}, grid | {"mask": (["y", "time"], cells)}))
    (tmp_path / "t.nc").write_bytes(gridded.encode({"y": 2, "time": 3}, grid | {"mask": (["time", "y"], cells.T)}))
    want = sorted((y, t, int(cells[i, j])) for i, y in enumerate((1.0, 2.0)) for j, t in enumerate((0.0, 0.5, 1.0)))
    assert values(jobs.read_mask(spark, str(tmp_path / "m.nc")), "y", "t", "m") == want
    with pytest.raises(ValueError, match="time', 'y"):
        jobs.read_mask(spark, str(tmp_path / "t.nc"))
    table = spark.createDataFrame(want, "y double, time double, mask int")
    table.write.parquet(str(tmp_path / "p"))
    assert values(jobs.read_mask(spark, str(tmp_path / "p")), "y", "t", "m") == want
    table.withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError, match="dimensions"):
        jobs.read_mask(spark, str(tmp_path / "q"))


def test_requests_of_archives(spark):
    from tracewell.operators import spikes as R

    meta = {"t0": 1.0, "tmax": 5.0, "ms": False}
    assert archives.matches_request(meta, ["E", "PV"], {"t0": 1, "tmax": 5}, ["E", "PV"])
    assert not archives.matches_request(meta, ["E", "PV"], {"t0": 1, "tmax": 5}, ["PV", "E"])
    assert not archives.matches_request(meta, ["E"], {"t0": 1, "tmax": 5, "ms": True}, ["E"])
    with pytest.raises(ValueError, match="unknown"):
        archives.matches_request(meta, ["E"], {"dt": 1}, ["E"])
    once = R.combine(spark.createDataFrame([("E", 2.0), ("E", 1.0)], "pop string, t double"), ["pop"])
    assert once.first()["times"] == [1.0, 2.0]
    with pytest.raises(ValueError, match="combined already"):
        R.combine(once, ["pop"])
