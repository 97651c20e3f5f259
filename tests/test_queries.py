import duckdb
import pytest

from tests.conftest import SF, same
from tracewell import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", "rate_dynamics rate_epoch_fold rate_empty_pop isi_cv_cell gaussian_smooth mask_split_counts resample_linear sta_mask_split xcorr_raw psd_welch_median rate_spectra tf_stft bandpass_filter spectrogram_stack packed_events".split())
def test_signals_cover_all_days_that_have_events(spark, tmp_path, name):
    """48 days from before 2024: nothing is left out at either end. Equal up to the last rounded digit, as averages here stand on ties of it."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (ts - INTERVAL 12 DAY + (event_id % 3) * INTERVAL 9 DAY AS ts) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df, rel = QUERIES[name](spark, str(tmp_path)), con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)

    def rows(columns, found):  # floats last, so that a last digit's difference does not reorder rows
        at = sorted(range(len(columns)), key=lambda k: (isinstance(found[0][k], float), columns[k]))
        return sorted([tuple(r[k] for k in at) for r in found])

    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, rel.fetchall())
    assert len(got) == len(expected)
    last = 1e-9 if name in ("rate_spectra", "rate_dynamics") else 1.1e-6
    for a, b in zip(got, expected, strict=True):
        assert all(p == q or p == pytest.approx(q, rel=1e-9, abs=last, nan_ok=True) for p, q in zip(a, b, strict=True))
    if name == "rate_dynamics":
        assert df.agg({"rate": "sum"}).first()[0] * 3600 == pytest.approx(1000) and df.count() == 5 * 48 * 24


def test_signals_of_no_events(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT * FROM '{SF}/events.parquet' WHERE false) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert QUERIES["rate_dynamics"](spark, str(tmp_path)).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 * 720
    assert set(entry.oracle_sql()) <= set(entry.queries())
