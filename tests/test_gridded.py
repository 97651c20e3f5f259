"""Gridded files: own writer and hand-made bytes, read by slabs, ranges and pushed filters."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.sources import gridded as G

TIME = np.arange(500) * 0.5
VALUES = np.random.default_rng(4).standard_normal((500, 3, 2))


def write(path, **more):
    data = G.encode({"time": 500, "pop": 3, "side": 2}, {"time": (["time"], TIME), "pop": (["pop"], ["E", "PV", "SOMé"]), "v": (["time", "pop", "side"], VALUES), "w": (["time", "pop", "side"], VALUES * 2), "n": (["time"], np.arange(500))}, {"title": "t"})
    path.write_bytes(data)
    return str(path)


def expected(keep=lambda t: True):
    return sorted((float(t), p, s, float(VALUES[i, j, s])) for i, t in enumerate(TIME) for j, p in enumerate(("E", "PV", "SOMé")) for s in (0, 1) if keep(t))


def rows(df):
    return sorted((r["time"], r["pop"], r["side"], r["v"]) for r in df.collect())


def test_whole_file_by_slabs(spark, tmp_path):
    path = write(tmp_path / "a.nc")
    df = G.read_gridded(spark, path, "v", slab=50 * 48)
    assert df.rdd.getNumPartitions() == 10 and dict(df.dtypes) == {"time": "double", "pop": "string", "side": "bigint", "v": "double"}
    assert rows(df) == expected()
    both = G.read_gridded(spark, path, ["v", "w"], ["time", "w"], slab=1)
    assert both.columns == ["time", "w"] and both.rdd.getNumPartitions() == 500
    assert both.agg(F.sum("w")).first()[0] == pytest.approx(2 * VALUES.sum())
    assert [r["n"] for r in G.read_gridded(spark, path, "n").orderBy("time").collect()] == list(range(500))


def test_only_the_asked_slabs_are_read(spark, tmp_path):
    path = write(tmp_path / "a.nc")
    _, variables, whole = G.read_header(path)
    assert whole == {"title": "t"}
    v = variables["v"]
    data = bytearray((tmp_path / "a.nc").read_bytes())
    broken = tmp_path / "cut.nc"
    broken.write_bytes(bytes(data[: v.begin + 200 * v.stride]))  # 200 places of v are left
    ok = G.read_gridded(spark, str(broken), "v", start=100, stop=200, slab=10 * v.stride)
    assert ok.rdd.getNumPartitions() == 10 and rows(ok) == expected(lambda t: 50 <= t < 100)
    pushed = G.read_gridded(spark, str(broken), "v", slab=64 * v.stride).where("time >= 20 AND time < 99.75")
    assert rows(pushed) == expected(lambda t: 20 <= t < 99.75)
    assert rows(G.read_gridded(spark, str(broken), "v", slab=64 * v.stride).where("time = 7.5 AND pop = 'PV'")) == [r for r in expected() if r[0] == 7.5 and r[1] == "PV"]
    with pytest.raises(Exception, match="ends early"):
        G.read_gridded(spark, str(broken), "v").collect()


def record_file(version=1):
    """Two growing variables, one of shorts, records interleaved and padded; a fill value."""
    u4 = lambda n: struct.pack(">I", n)
    text = lambda s: u4(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    at = (lambda n: u4(n)) if version == 1 else (lambda n: struct.pack(">q", n))
    dims = u4(10) + u4(2) + text("time") + u4(0) + text("y") + u4(3)
    fill = u4(12) + u4(1) + text("_FillValue") + u4(3) + u4(1) + struct.pack(">h", -9) + b"\0\0"

    def head(a, b):
        one = text("a") + u4(2) + u4(0) + u4(1) + fill + u4(3) + u4(8) + at(a)
        two = text("time") + u4(1) + u4(0) + u4(0) + u4(0) + u4(6) + u4(8) + at(b)
        return b"CDF" + bytes([version]) + u4(4) + dims + u4(0) + u4(0) + u4(11) + u4(2) + one + two

    n = len(head(0, 0))
    body = b"".join(struct.pack(">3h", 10 * r, -9 if r == 2 else 10 * r + 1, 10 * r + 2) + b"\0\0" + struct.pack(">d", r / 4) for r in range(4))
    return head(n, n + 8) + body


@pytest.mark.parametrize("version", [1, 2])
def test_records(spark, tmp_path, version):
    (tmp_path / "r.nc").write_bytes(record_file(version))
    df = G.read_gridded(spark, str(tmp_path / "r.nc"), "a", slab=12)
    got = sorted((r["time"], r["y"], r["a"]) for r in df.where("a IS NOT NULL").collect())
    assert got == sorted((r / 4, k, 10.0 * r + k) for r in range(4) for k in range(3) if (r, k) != (2, 1))
    assert df.where("a IS NULL").count() == 1 and df.rdd.getNumPartitions() == 2


def test_broken_files(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    with pytest.raises(ValueError, match="classic layout"):
        G.read_gridded(spark, str(tmp_path / "x.nc"), "v")
    write(tmp_path / "y.nc")
    (tmp_path / "z.nc").write_bytes((tmp_path / "y.nc").read_bytes()[:90])
    with pytest.raises(ValueError, match="within its header"):
        G.read_gridded(spark, str(tmp_path / "z.nc"), "v")
    with pytest.raises(ValueError, match="no variable"):
        G.read_gridded(spark, str(tmp_path / "y.nc"), "q")
    with pytest.raises(ValueError, match="on one grid"):
        G.read_gridded(spark, str(tmp_path / "y.nc"), ["v", "n"])
    with pytest.raises(FileNotFoundError):
        G.read_gridded(spark, str(tmp_path / "none*.nc"), "v")


def test_job_files_round_trip(spark, tmp_path):
    data = [(j, y, t / 2, float(100 * j + 10 * y + t)) for j in (2, 11) for y in (1.5, 4.0) for t in range(40) if (j, t) != (11, 3)]
    df = spark.createDataFrame(data, "job_id long, y double, time double, v double").repartition(4)
    done = G.save_job_gridded(df, str(tmp_path / "o"), "r_{job:05d}.nc", ["y", "time"], "v")
    assert sorted(r["job_id"] for r in done.collect()) == [2, 11] and sorted(p.name for p in (tmp_path / "o").iterdir() if p.suffix == ".nc") == ["r_00002.nc", "r_00011.nc"]
    back = G.read_job_gridded(spark, str(tmp_path / "o"), "r_{job:05d}.nc", "v")
    got = sorted((r["job_id"], r["y"], r["time"], r["v"]) for r in back.where(~F.isnan("v")).collect())
    assert got == sorted(data)
    twice = df.unionByName(df.where("job_id = 2").limit(1))
    with pytest.raises(Exception, match="two values in one cell"):
        G.save_job_gridded(twice, str(tmp_path / "p"), "r_{job:05d}.nc", ["y", "time"], "v")
    (tmp_path / "o" / "r_2.nc").write_bytes((tmp_path / "o" / "r_00002.nc").read_bytes())
    with pytest.raises(RuntimeError, match="exactly one file"):
        G.read_job_gridded(spark, str(tmp_path / "o"), "r_{job:05d}.nc", "v")
