import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tracewell.session import get_session

    s = get_session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    """A value as a comparable string; NaN and null are one."""
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
        if isinstance(v, float) and v != v:
            return "null"
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and abs(v) < 1e15 else False:
        return str(int(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, expected)
