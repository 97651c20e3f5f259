"""Rules and host reputation, conversation repair, whitening: against SQL, enumeration and dense algebra on small tables."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import turns, urls, whitening

PAGES = "page_id long, url string, html string, host string, path string, rule string, n long"


def pages(spark, found):
    return spark.createDataFrame([(i, u, "<p>", "x", "y", "z", 1) for i, u in enumerate(found)], PAGES)


def with_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


def agree(df, sql, **tables):
    names, rows = with_sql(sql, **tables)
    ours = [tuple(r[c] for c in names) for r in df.collect()]
    order = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(df.columns) == sorted(names)
    assert sorted(ours, key=order) == sorted(rows, key=order)


AWKWARD = [
    None, "", "no scheme", "https://", "http://Example.ORG/es/", "http://example.org", "http://example.org?x=/es/", "http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/",
    "http://com/fr/", "http://x.com/fr/1#f", "http://x.com/fr", "http://x.co.uk/", "ftp://user@h.co.uk:8080/a?b://c", "http://10.0.0.1:80/de/", "http://ÉÀ.com/de/É", "http://x.com/\n/de/",
    "http://x.com/de/" + "y" * 200_000, "http://" + "a." * 5_000 + "org/q", "//x.com/de/", "http://x.com/fr/1#f", "http://x.com/de/://", "http://.com/de/", "http://x.com./de/",
]


def test_urls_equal_sql_on_awkward_urls(spark):
    df = pages(spark, AWKWARD * 3)
    agree(urls.judge(df, urls.rule_table(spark, urls.RULES)), urls.SQL, pages=df.toArrow())


def test_urls_without_rows_or_rules(spark):
    assert urls.judge(pages(spark, []), urls.rule_table(spark, urls.RULES)).collect() == []
    rules = urls.rule_table(spark, urls.RULES).limit(0)
    found = urls.judge(pages(spark, ["http://x.com/a", None]), rules).collect()
    assert [(r["rule"], r["verdict"], r["bad_share"]) for r in found] == [(None, "allow", 0.5)] * 2


def test_urls_longest_rule_wins_and_block_wins_ties(spark):
    rules = urls.rule_table(spark, [("b.com/", "allow"), ("a.b.com/", "block"), ("com/x/y", "block"), ("b.com/xy", "allow"), ("b.com/xy", "block")])
    found = urls.judge(pages(spark, ["http://a.b.com/x/y", "http://b.com/x/yz", "http://b.com/xyz", "http://q.a.b.com/", "http://b.com"]), rules).orderBy("page_id").collect()
    assert [r["rule"] for r in found] == ["a.b.com/", "com/x/y", "b.com/xy", "a.b.com/", None]
    assert [r["verdict"] for r in found][:4] == ["block", "block", "block", "block"]


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rng = random.Random(5)
    rows = []
    for d in range(40):
        share = rng.betavariate(0.4, 0.4)
        for h in range(6):
            own = min(max(rng.gauss(share, 0.05), 0.01), 0.99)
            rows += [(f"h{h}.d{d}.com", rng.random() < own) for _ in range(rng.choice([0, 1, 3, 200]))] + [(f"h{h}.d{d}.com", None)]
    rows += [("new.d1.com", None), ("new.unknown.com", None), ("other.zz", None)]
    found = {r["host"]: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    labelled = {}
    for h, bad in rows:
        if bad is not None:
            labelled.setdefault(h, []).append(bad)
    for h, of in labelled.items():
        assert found[h]["labelled"] == len(of)
        if len(of) == 200:  # many labels: close to its own share
            assert abs(found[h]["bad_share"] - sum(of) / 200) < 0.08
    domain = [b for h, of in labelled.items() if h.endswith(".d1.com") for b in of]
    assert abs(found["new.d1.com"]["bad_share"] - sum(domain) / len(domain)) < 0.1
    assert abs(found["other.zz"]["bad_share"] - found["new.unknown.com"]["bad_share"]) < 0.2
    # with fewer labels the bound is lower
    one, many = (next(h for h, of in labelled.items() if len(of) == n and h.split(".")[1] == d) for d, n in _both(labelled))
    gap = lambda h: found[h]["bad_share"] - found[h]["bound"]
    assert gap(one) > gap(many) > 0
    # the moments find that hosts of a domain are alike and domains are not
    assert all(r["bound"] < r["bad_share"] for r in found.values())


def _both(labelled):
    """One domain that has a host with a single label and one with 200."""
    for d in {h.split(".")[1] for h in labelled}:
        sizes = {len(of) for h, of in labelled.items() if h.split(".")[1] == d}
        if {1, 200} <= sizes:
            return [(d, 1), (d, 200)]
    raise AssertionError


CONV = "conv_id long, turn long, role string, text string, c string, cost long, audit string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "a") for r in rows], CONV)


def made(seed, n, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2] if rng.random() < 0.9 else rng.choice(["system", "tool", None, "", "User"])
            text = rng.choice(["Yes.", "No", "Why? ", " \n\t", "", None, "a.b", "é!", "x" * 3, "Eh.\x0b"]) + str(rng.randrange(3)) if rng.random() < 0.6 and (text := None) else rng.choice(["Yes.", "No", "Why? ", " \n\t", "", None, "a.b", "é!", f"t{t}.", f"t{t}"])
            rows.append((conv, t if rng.random() < 0.9 else rng.choice([None, t + 1, t + 5, -t]), role, text))
    return rows


@pytest.mark.parametrize(("piece", "width"), [(64, 64), (3, 2)])
def test_turns_equal_sql(spark, piece, width):
    df = conversations(spark, made(piece, 60, 30))
    agree(turns.repair(df, piece, width), turns.SQL, conversations=df.toArrow())


def brute(rows):
    """The cheapest edits by trying all, of few rows: (cost, audit)."""
    grammar = lambda r: r == "" or (r[1:] if r[0] == "s" else r) == "ua" * (len(r[1:] if r[0] == "s" else r) // 2) and r != "s"
    seen, ways = set(), [(0, "", "")]
    for role, text in rows:
        shown = text.strip(turns.SPACES)
        must = not shown or (role, text) in seen
        seen.add((role, text))
        cut = bool(shown) and shown[-1] not in ".!?"
        inserts = [(0, "", "")] + [(2 * k, "I" * k, "".join(x)) for k in (1, 2) for x in itertools.product("ua", repeat=k)]
        edits = [(3, "D", "")] + ([] if must else [(2 + cut, "R", "u"), (2 + cut, "R", "a"), *([(int(cut), "K", role[0])] if role else [])])
        best = {}
        for (c, a, r), (c1, a1, r1), (c2, a2, r2) in itertools.product(ways, inserts, edits):
            whole = r + r1 + r2
            if any(grammar(whole + end) for end in ("", "a", "ua")):
                best[whole] = min(best.get(whole, (99, "")), (c + c1 + c2, a + a1 + a2))
        ways = [(c, a, r) for r, (c, a) in best.items()]
    return min((c + 2 * len(end), a + "I" * len(end)) for c, a, r in ways for end in ("", "a", "ua", "u") if grammar(r + end))


def test_turns_cost_by_enumeration(spark):
    rows = [r for r in made(7, 60, 6)]
    found = {r["conv_id"]: (r["cost"], r["audit"]) for r in turns.repair(conversations(spark, rows), 2, 2).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if fate == 4 else role, "" if fate == 1 else text.translate({46: None, 33: None, 63: None}) if fate == 2 else text
        by_conv[conv] += [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert set(found) == set(by_conv)
    for conv, its in by_conv.items():
        assert found[conv] == brute([(r[2], r[4]) for r in sorted(its)]), conv


def test_turns_one_long_conversation_and_empty(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}." if t % 50 else "again.") for t in range(3000)] + [(2, 1, "user", "x." * 50_000)]
    df = conversations(spark, rows)
    agree(turns.repair(df, 16, 4), turns.SQL, conversations=df.toArrow())
    assert turns.repair(conversations(spark, [])).collect() == []


def test_turns_dropped_whole(spark):
    conv = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turns.repair(conversations(spark, [(conv, 0, "user", "x.")])).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


EMB = "vec_id long, embedding array<float>, label int, x string, n long"


def embeddings(spark, vectors):
    return spark.createDataFrame([(None if i == 0 else i, None if v is None else [None if a is None else float(a) for a in v], 1, "x", 2) for i, v in enumerate(vectors)], EMB)


def test_whitening_equals_dense_algebra(spark):
    rng = np.random.default_rng(3)
    base = np.float32(rng.standard_normal((400, 40)) * np.linspace(1, 3, 40) + 5)
    vectors = [*base, *base[:50], *([base[0]] * 300)]  # repeated rows count once
    bad = [None, [1.0] * 39 + [None], [float("nan")] * 40, [float("inf")] + [0.0] * 39]
    found = whitening.whiten(embeddings(spark, [*vectors, *bad])).toPandas()
    x = np.floor(256 * np.stack(vectors).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    w = (x - s / n) @ q[:, :-5:-1] / np.sqrt(e[:-5:-1])
    assert len(found) == 4 * len(vectors) and set(found["n"]) == {n}
    first = found[found["component"] == 1]
    assert sorted(first["deviation"]) == sorted(((n * x - s) ** 2).sum(1))
    at = found["vec_id"].fillna(0).astype(int).to_numpy()
    ours = np.zeros((len(vectors), 4))
    ours[at, found["component"] - 1] = found["whitened"]
    assert np.abs(ours * np.sign((ours * w).sum(0)) - w).max() < 1e-9
    assert np.allclose(found.groupby("component")["explained"].first(), e[:-5:-1] / e.sum(), rtol=1e-9)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_whitening_degenerate_tables(spark):
    assert whitening.whiten(embeddings(spark, [])).collect() == []
    assert whitening.whiten(embeddings(spark, [None, [None]])).collect() == []
    same = whitening.whiten(embeddings(spark, [[1, 2, 3]] * 5)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in same] == [(k, 0, None, None) for _ in range(5) for k in (1, 2, 3)]
    short = whitening.whiten(embeddings(spark, [[1.0], [1.0, 0.0], [0.0, 0.0, 0.0]])).collect()  # zeros follow; two different vectors
    assert {r["n"] for r in short} == {2} and {(r["component"], round(r["explained"], 12)) for r in short} == {(1, 1.0), (2, 0.0), (3, 0.0)}
    assert {round(abs(r["whitened"]), 12) for r in short if r["component"] == 1} == {1.0}


def test_whitening_deviation_is_exact_or_null():
    sums = np.array([3, -(1 << 61)], object)
    x = np.array([[1, 2], [1 << 40, -5]])
    exact = [sum((1000 * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, 1000, sums) == [v if v < 1 << 63 else None for v in exact]
    small = np.array([3, -7], object)
    assert whitening.deviations(np.array([[1, 2]]), 10, small) == [7 * 7 + 27 * 27]


@pytest.mark.parametrize(("d", "block", "basis"), [(40, 8, 128), (300, 16, 64), (6, 16, 128)])
def test_subspace_iteration_certifies_leading_pairs(d, block, basis):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((2 * d, d))
    a[:, : d // 2] *= 1.2
    c = a.T @ a / len(a)
    q, e, passes = whitening.leading(lambda x: c @ x, d, 4, block, basis)
    want, vectors = np.linalg.eigh(c)
    assert passes < 200 and np.allclose(e, want[:-5:-1], rtol=1e-12)
    assert np.allclose(np.abs((q * vectors[:, :-5:-1]).sum(0)), 1, atol=1e-10)


def test_subspace_iteration_of_low_rank():
    v = np.linalg.qr(np.random.default_rng(1).standard_normal((50, 2)))[0]
    q, e, _ = whitening.leading(lambda x: v @ np.diag([3.0, 2.0]) @ (v.T @ x), 50, 4, 8)
    assert np.allclose(e, [3, 2, 0, 0], atol=1e-12) and np.allclose(q.T @ q, np.eye(4), atol=1e-12)


def test_whitening_matrix_reads_slices():
    rows = pa.array([[1], [2, 3], [4, 5, 6], []], pa.list_(pa.int64()))
    assert whitening.matrix(rows.slice(1), 3).tolist() == [[2, 3, 0], [4, 5, 6], [0, 0, 0]]
