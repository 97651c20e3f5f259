"""Forms that hold recordings and groups of any size, against whole-trace kernels and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import kernels as K
from tracewell.operators import chunks as H
from tracewell.operators import correlograms as G
from tracewell.operators.quantiles import exact_quantiles
from tracewell.sources import cache


@pytest.mark.parametrize(("size", "width"), [(7, 4), (50, 3), (64, 256), (333, 2), (2000, 8)])
def test_filter_by_chunks_equals_whole_traces(spark, size, width):
    rng = np.random.default_rng(size)
    traces = {"a": rng.standard_normal(1000).cumsum(), "b": rng.standard_normal(641) + 100, "c": np.sin(np.arange(1999) / 5)}
    rows = [(c, i, float(v)) for c, x in traces.items() for i, v in enumerate(x)]
    chunks = H.to_chunks(spark.createDataFrame(rows, "channel string, i long, v double"), ["channel"], size)
    for band, order, kind in (((2.0, 8.0), 3, "bandpass"), (0.5, 2, "highpass"), (10.0, 4, "lowpass")):
        if size in (7, 2000) or kind == "bandpass":
            done = H.filtered(chunks, ["channel"], band, 100.0, order, kind, width)
            assert done.agg(F.max(F.size("values"))).first()[0] <= size
            got = {}
            for r in H.to_long(done, ["channel"], size).orderBy("channel", "i").collect():
                got.setdefault(r["channel"], []).append(r["v"])
            for c, x in traces.items():
                want = K.filtfilt(x, band, 100.0, order, kind)[0]
                assert np.abs(np.array(got[c]) - want).max() < 1e-9 * max(1, np.abs(x).max())


def test_filter_by_chunks_of_short_traces(spark):
    short = H.to_chunks(spark.createDataFrame([("a", i, 1.0 * i) for i in range(21)], "channel string, i long, v double"), ["channel"], 4)
    with pytest.raises(Exception, match="longer than 21 samples"):
        H.filtered(short, ["channel"], (2.0, 8.0), 100.0).collect()
    assert H.filtered(short.limit(0), ["channel"], (2.0, 8.0), 100.0).collect() == []


def test_quantiles_by_selection(spark):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.standard_normal(3000), "ties": np.repeat([1.0, 2.0, 5.0], 900), "one": np.zeros(1000), "wide": 10.0 ** rng.uniform(-300, 300, 2500) * rng.choice([-1, 1], 2500),
        "few": np.array([3.0, 1.0]), "single": np.array([7.0]), "inf": np.r_[rng.standard_normal(1200), [np.inf] * 30, [-np.inf] * 30],
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("few", None)], "g string, v double")
    probs = {"least": 0.0, "low": 0.031, "med": 0.5, "p95": 0.95, "most": 1.0}
    want = {r["g"]: r for r in df.groupBy("g").agg(*(F.percentile("v", F.lit(p)).alias(c) for c, p in probs.items())).collect()}
    for limit, cuts in ((50, 4), (1000, 64)):
        got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, limit, cuts).collect()}
        assert set(got) == set(groups)
        assert all(got[g][c] == want[g][c] or np.isclose(got[g][c], want[g][c], rtol=1e-15) for g in groups for c in probs)
    whole = exact_quantiles(df, [], "v", {"med": 0.5}, 100, 8).first()["med"]
    assert whole == np.median(np.concatenate(list(groups.values())))
    assert exact_quantiles(df.limit(0), [], "v", {"med": 0.5}).collect()[0]["med"] is None
    assert exact_quantiles(df.limit(0), ["g"], "v", {"med": 0.5}).collect() == []


def test_digest_tells_tables_apart(spark):
    of = lambda rows, schema="a long, b string, t timestamp": cache.digest(spark.createDataFrame(rows, schema))
    from datetime import UTC, datetime

    t = lambda us: datetime(2024, 1, 1, 0, 0, 0, us, UTC)
    base = [(1, "x", t(1)), (2, None, None), (2, None, None)]
    assert of(base) == of(base[::-1])
    others = [base[:2], [*base, (2, None, None)], [(1, "x", t(2)), *base[1:]], [(1, None, t(1)), (2, "x", None), (2, None, None)], [(2, "x", t(1)), (1, None, None), (2, None, None)]]
    assert all(of(o) != of(base) for o in others)
    assert of(base, "a long, c string, t timestamp") != of(base)
    assert of([(1, "1", None)], "a long, b string, t timestamp") != of([("1", 1, None)], "a string, b long, t timestamp")
    nested = lambda v: cache.digest(spark.createDataFrame([(v,)], "m array<long>"))["sum"]
    assert len({nested(v) for v in ([None, 1], [1], [1, None], None, [])}) == 5


def test_tables_without_files_are_not_one_source(spark, tmp_path):
    path = str(tmp_path / "t")
    for x, hit in ((1, False), (2, False), (2, True), (1, False)):
        source = spark.createDataFrame([(x,)], "x int")
        df, was = cache.load_or_run(spark, path, lambda s=source: s, "copy", None, source)
        assert (df.first()["x"], was) == (x, hit)


@pytest.mark.parametrize(("n", "size", "lo", "hi"), [(1000, 64, -20, 33), (1000, 1000, -999, 999), (130, 64, 0, 0), (129, 64, -64, -3), (40, 64, -50, 50)])
def test_correlograms_of_all_pairs(spark, n, size, lo, hi):
    rng = np.random.default_rng(n)
    traces = {"a": rng.standard_normal(n) + 5, "b": rng.standard_normal(n).cumsum(), "flat": np.full(n, 2.0), "c": 100 + np.sin(np.arange(n) / 7)}
    rows = [(c, i, float(v)) for c, x in traces.items() for i, v in enumerate(x)]
    chunks = H.to_chunks(spark.createDataFrame(rows, "pop string, i long, v double"), ["pop"], size)
    pairs = [(a, b) for a in traces for b in traces if a <= b]
    found = G.correlograms(chunks, spark.createDataFrame(pairs, "pop_i string, pop_j string"), size, lo, hi).toPandas()
    lags = np.arange(max(lo, 1 - n), min(hi, n - 1) + 1)
    assert len(found) == len(pairs) * len(lags)
    for a, b in pairs:
        got = found[(found["pop_i"] == a) & (found["pop_j"] == b)].sort_values("lag")
        assert (got["lag"] == lags).all()
        for column, how in (("raw", {}), ("demeaned", {"demean": True}), ("normalised", {"demean": True, "normalise": True})):
            want = K.crosscorr(traces[a], traces[b], lags, **how)
            assert np.allclose(got[column], want, rtol=1e-9, atol=1e-9, equal_nan=True), (a, b, column)


def test_correlograms_of_bad_windows(spark):
    chunks = spark.createDataFrame([("a", 0, [1.0, 2.0])], "pop string, chunk long, values array<double>")
    pairs = spark.createDataFrame([("a", "a")], "pop_i string, pop_j string")
    with pytest.raises(ValueError, match="reversed"):
        G.correlograms(chunks, pairs, 2, 1, 0)
    with pytest.raises(ValueError, match="shorter"):
        G.correlograms(chunks, pairs, 2, -3, 0)
    assert G.correlograms(chunks.limit(0), pairs, 2, -1, 1).collect() == []
