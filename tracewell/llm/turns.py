"""Repair of conversation structure: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

A conversation's turns are cut into pieces of at most ``piece`` rows. In batches of pieces, dealt by hash, a recursive query
advances one turn of all pieces at once and keeps, for each state of the grammar, the least cost and the ASCII-least audit of
that cost. A piece that is not its conversation's first is taken from every state; pieces of one conversation are then
composed in the same way, 64 at a time, until one is left. So no conversation, however long, is one task's work, but for
its SHA-256, which has to see the repaired text in order: that task streams sorted rows. Texts are shuffled once, for
that; all else goes by their digests.

Two audits of the same cost that lead through the same rows to the same state are never one the other's beginning, so the
ASCII-least of a whole conversation has ASCII-least parts.

Defined cases: a null ``conv_id`` is a conversation of its own; nulls are one space in the damage's key, as role and as text.
Rows of one turn are taken by role, then by the text's MD5, copies beside each other; equal rows are repetitions and so
duplicates. A role counts by its first character, case as it is; an empty role has none and can't be kept. Blank rows are
no duplicates. Texts have any length. A conversation without rows after damage has zeros, an empty audit and the digest
of nothing; an empty table gives an empty result. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import drop_materialized, materialize, small_batches, table

PIECE = 64
#: Elements of a batch of the recursive query, and characters of their audits.
BATCH, AUDIT = 20_000, 8_000_000
#: Grammar: what may follow each state, the role that an inserted or rewritten turn takes there, and the cost of an end there.
STATES = ("start", "s", "u", "a")
FOLLOW = {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
EXPECTED = {"start": "u", "s": "u", "u": "a", "a": "u"}
END = {"start": "", "s": "II", "u": "I", "a": ""}
LEGAL = ("su", "ua", "au")
RULE = {"D": 3, "I": 2, "K": 0, "R": 2}
SPACES = " \t\n\x0b\f\r"
TRANS = "kind long, a int, b int, cost long, audit string"
PIECES = "c string, piece long, s int, q int, cost long, audit string, head string, tail string, illegal long"


def damaged(conversations: DataFrame) -> DataFrame:
    """``c`` (the conversation's key as text), ``known, t, role, text, copies`` after the damage."""
    conv, turn = (F.col(c).cast("string") for c in ("conv_id", "turn"))
    fate = F.crc32(F.concat_ws(":", F.coalesce(conv, F.lit(" ")), F.coalesce(turn, F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        key(F.col("conv_id")).alias("c"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 3, 2).otherwise(1).alias("copies"), (fate == 0).alias("_gone"),
    ).where(~F.col("_gone")).drop("_gone")


def key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(" "))


def marked(rows: DataFrame) -> DataFrame:
    """Different rows of a conversation: ``c, known, t, role, h, blank, cut, n`` and whether it is the first of its role and text."""
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    cut = ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    one = rows.groupBy("c", "known", "t", "role", F.unhex(F.md5("text")).alias("h"), (shown == "").alias("blank"), cut.alias("cut")).agg(F.sum("copies").alias("n"))
    firsts = one.groupBy("c", "role", "h").agg(F.min(F.struct("known", "t")).alias("_at")).select("c", "role", "h", "_at.known", "_at.t", F.lit(True).alias("first"))
    return one.join(firsts, ["c", "known", "t", "role", "h"], "left").fillna({"first": False})


def steps() -> list[tuple[int, int, int, int, str]]:
    """(kind, state before, state after, cost, audit) of a row with the inserts before it; see :func:`kind_of`."""
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for kind in range(12):
        initial, fault = ("s", "u", "a", "")[kind // 3], kind % 3
        for a in STATES:
            state, spent, audit = a, 0, ""
            for _ in range(3):  # up to two inserts: a third would pay for what one does
                ways = [("D", state, RULE["D"])]
                if fault < 2:
                    ways.append(("R", EXPECTED[state], RULE["R"] + fault))
                    if (state, initial) in FOLLOW:
                        ways.append(("K", FOLLOW[state, initial], RULE["K"] + fault))
                for edit, b, cost in ways:
                    at = (kind, STATES.index(a), STATES.index(b))
                    best[at] = min(best.get(at, (99, "")), (spent + cost, audit + edit))
                state, spent, audit = EXPECTED[state], spent + RULE["I"], audit + "I"
    return [(*at, *way) for at, way in sorted(best.items())]


def kind_of(initial: Column, must_go: Column, cut: Column) -> Column:
    """Number of a row's class: its role's initial (s, u, a, another), and 0 sound, 1 truncated, 2 to be deleted."""
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (role * 3 + F.when(must_go, 2).when(cut, 1).otherwise(0)).cast("long")


FOLD = """
WITH RECURSIVE ends AS (SELECT grp, max(pos) AS last, any_value(every) AS every FROM elems GROUP BY grp),
walk(grp, s, q, pos, best) USING KEY (grp, s, q) AS (
  SELECT grp, s, s, -1::BIGINT, row(0::BIGINT, '') FROM ends, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE s = 0 OR every
  UNION ALL
  SELECT w.grp, w.s, t.b, w.pos + 1, min(row(w.best[1] + t.cost, w.best[2] || t.audit))
  FROM walk w JOIN elems e ON e.grp = w.grp AND e.pos = w.pos + 1 JOIN trans t ON t.kind = e.kind AND t.a = w.q
  GROUP BY w.grp, w.s, t.b, w.pos + 1),
pairs AS (SELECT grp, pos, head, tail, illegal, lag(tail) OVER (PARTITION BY grp ORDER BY pos) AS before FROM elems),
sides AS (
  SELECT grp, arg_min(head, pos) AS head, arg_max(tail, pos) AS tail, sum(illegal + (before IS NOT NULL AND before || head NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal
  FROM pairs GROUP BY grp)
SELECT grp, s, q, best[1] AS cost, best[2] AS audit, head, tail, illegal FROM walk JOIN ends USING (grp) JOIN sides USING (grp) WHERE pos = last
"""


def fold(elems: pa.Table, trans: pa.Table) -> pa.Table:
    """Composes the elements ``pos`` 0, 1, ... of each ``grp``: for every state before, the best way to every state after."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": False})
    try:
        con.register("elems", elems)
        con.register("trans", trans)
        return con.sql(FOLD).to_arrow_table()
    finally:
        con.close()


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], batch: int = BATCH, audit: int = AUDIT) -> Iterator[pd.DataFrame]:
    """Sorted rows, again in batches that end where a group ends."""
    held: list[pd.DataFrame] = []
    for b in batches:
        rows = b.to_pandas()
        if len(rows):
            held.append(rows)
        if sum(map(len, held)) >= batch or "audit" in rows and sum(x["audit"].str.len().sum() for x in held) >= audit:
            whole = pd.concat(held, ignore_index=True)
            same = (whole[list(keys)] == whole[list(keys)].iloc[-1]).all(axis=1)
            if not same.all():
                yield whole[~same]
                whole = whole[same]
            held = [whole]
    if held:
        yield pd.concat(held, ignore_index=True)


def pieces_of(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows in the order of their conversations, cut: ``c, part, chunk, pos, kind, initial, every``.

    ``part`` is the task's number, so (part, chunk) orders the pieces of a conversation. ``every`` is set where the piece
    may not be its conversation's first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seen, head = TaskContext.get().partitionId(), None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            r = b.to_pandas()
            new = r["c"].ne(r["c"].shift(fill_value=conv))
            begun = new.cumsum()
            pos = r.groupby(begun).cumcount() + (begun == 0) * seen
            first = (begun == (0 if conv == r["c"].iloc[0] else 1)) & head  # of the task's first conversation, which may have begun elsewhere
            head = head and bool(first.iloc[-1])
            conv, seen = r["c"].iloc[-1], int(pos.iloc[-1]) + 1
            yield pa.RecordBatch.from_pydict({
                "c": r["c"], "part": [part] * len(r), "chunk": pos // piece, "pos": pos % piece, "kind": r["kind"], "initial": r["initial"], "every": first | (pos >= piece),
            }, schema=schema)

    order = ["c", "known", "t", "role", "h", "copy"]
    schema = pa.schema([("c", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int64()), ("kind", pa.int64()), ("initial", pa.string()), ("every", pa.bool_())])
    initial = F.substring("role", 1, 1)
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    each = each.select(*order, initial.alias("initial"), kind_of(initial, F.col("blank") | ~F.col("first") | (F.col("copy") > 1), F.col("cut")).alias("kind"))
    return each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "c string, part long, chunk long, pos long, kind long, initial string, every boolean")


def _named(found: pa.Table, grp: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch | None:
    out = found.to_pandas()
    out = out.join(grp, on="grp")
    return pa.RecordBatch.from_pandas(out[schema.names], schema=schema, preserve_index=False)


def fold_rows(rows: DataFrame) -> DataFrame:
    """Rows of :func:`pieces_of` to a row per piece, state before and state after."""
    trans = pd.DataFrame(steps(), columns=["kind", "a", "b", "cost", "audit"])
    schema = pa.schema([("c", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), ("s", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_table = pa.Table.from_pandas(trans, preserve_index=False)
        for r in groups(batches, ("c", "part", "chunk")):
            r = r.assign(grp=r.groupby(["c", "part", "chunk"], sort=False).ngroup(), head=r["initial"], tail=r["initial"], illegal=0)
            found = fold(pa.Table.from_pandas(r[["grp", "pos", "kind", "every", "head", "tail", "illegal"]], preserve_index=False), steps_table)
            yield _named(found, r.drop_duplicates("grp").set_index("grp")[["c", "part", "chunk"]], schema)

    keys = ["c", "part", "chunk"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(run, PIECES.replace("piece long", "part long, chunk long"))


def fold_pieces(pieces: DataFrame, width: int) -> DataFrame:
    """``width`` neighbouring pieces of a conversation become one."""
    schema = pa.schema([("c", pa.string()), ("piece", pa.int64()), ("s", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in groups(batches, ("c", "group")):
            r = r.assign(grp=r.groupby(["c", "group"], sort=False).ngroup(), pos=r["piece"] % width, every=r["group"] > 0)
            r["kind"] = r["grp"] * width + r["pos"]
            elems = r.drop_duplicates("kind")[["grp", "pos", "kind", "every", "head", "tail", "illegal"]]
            trans = r.rename(columns={"s": "a", "q": "b"})[["kind", "a", "b", "cost", "audit"]]
            found = fold(pa.Table.from_pandas(elems, preserve_index=False), pa.Table.from_pandas(trans, preserve_index=False))
            yield _named(found, r.drop_duplicates("grp").set_index("grp")[["c", "group"]].rename(columns={"group": "piece"}), schema)

    grouped = pieces.withColumn("group", F.floor(F.col("piece") / width).cast("long"))
    return grouped.repartition("c", "group").sortWithinPartitions("c", "group", "piece").mapInArrow(run, PIECES)


def audits(rows: DataFrame, piece: int = PIECE, width: int = 64) -> DataFrame:
    """``c, cost, audit, illegal`` of each conversation of :func:`marked` rows."""
    from pyspark.sql import Window

    pieces = materialize(fold_rows(pieces_of(rows, piece)), "pieces")
    held = pieces.groupBy("c", "part").agg((F.max("chunk") + 1).alias("k"))
    by_part = Window.partitionBy("c").orderBy("part")  # a row per task that has some of the conversation
    held = held.withColumn("before", F.sum("k").over(by_part.rowsBetween(Window.unboundedPreceding, -1)))
    held = held.withColumn("total", F.sum("k").over(Window.partitionBy("c"))).where("total > 1").select("c", "part", F.coalesce("before", F.lit(0)).alias("before"), "total")
    held = materialize(held, "cut")
    whole = pieces.join(held.select("c", "part"), ["c", "part"], "left_anti").select("c", "s", "cost", "audit", "q", "illegal")
    most = held.agg(F.max("total")).first()[0] or 1
    if most > 1:
        level = pieces.join(held, ["c", "part"]).withColumn("piece", F.col("before") + F.col("chunk")).select("c", "piece", "s", "q", "cost", "audit", "head", "tail", "illegal")
        while most > 1:
            level, most = materialize(fold_pieces(level, width), "composed"), math.ceil(most / width)
        whole = whole.unionByName(level.select(*whole.columns))
    end = F.element_at(F.array(*(F.lit(END[s]) for s in STATES)), F.col("q") + 1)
    way = F.struct((F.col("cost") + RULE["I"] * F.length(end)).alias("cost"), F.concat("audit", end).alias("audit"))
    return whole.where("s = 0").groupBy("c").agg(F.min(way).alias("_way"), F.max("illegal").alias("illegal")).select("c", "_way.cost", "_way.audit", "illegal")


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Plays an audit's edits on rows (role, text)."""
    state = "start"
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = {"u": "user", "a": "assistant"}[EXPECTED[state]]
        state = FOLLOW[state, role[:1]]
        yield role, text


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations' digests, ``c, repaired_sha256``: texts sorted within their conversations, audits before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = ((c, role, text, n) for b in batches for c, role, text, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        done: list[tuple[str, str]] = []
        ahead = next(flat, None)
        while ahead is not None:
            conv, _, audit, _ = ahead
            ahead = None

            def turns(conv=conv):
                nonlocal ahead
                for ahead in flat:
                    if ahead[0] != conv:
                        return
                    for _ in range(ahead[3]):
                        yield ahead[1], ahead[2]
                ahead = None

            digest, begun, its = hashlib.sha256(), False, turns()
            for role, text in repaired(audit, its):
                digest.update(("\n" * begun + role + ":" + text).encode("utf-8", "replace"))
                begun = True
            for _ in its:  # to the next conversation
                pass
            done.append((conv, digest.hexdigest()))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["c", "repaired_sha256"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["c", "repaired_sha256"])

    texts = rows.select("c", "role", "text", F.col("copies").alias("n"), F.lit(1).alias("_kind"), "known", "t", F.unhex(F.md5("text")).alias("h"))
    heads = found.select("c", F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("n"), F.lit(0).alias("_kind"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("t"), F.unhex(F.lit("")).alias("h"))
    every = texts.unionByName(heads).repartition("c").sortWithinPartitions("c", "_kind", "known", "t", "role", "h")
    return every.select("c", "role", "text", "n").mapInArrow(run, "c string, repaired_sha256 string")


def repair(conversations: DataFrame, piece: int = PIECE, width: int = 64) -> DataFrame:
    """A row per original ``conv_id``: faults, cost, audit and the digest of its repaired turns."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    one = materialize(marked(rows), "turns")
    sound = ~F.col("blank") & F.col("first")
    known = F.when(F.col("known"), F.col("t"))
    counts = one.groupBy("c").agg(
        (F.max(known) - F.min(known) + 1 - F.countDistinct(known)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("int"))).alias("duplicate"), F.sum((sound & F.col("cut")).cast("long")).alias("truncated"),
    )
    found = materialize(audits(one, piece, width), "audits")
    all_of = conversations.select("conv_id").distinct().withColumn("c", key(F.col("conv_id")))
    out = all_of.join(counts, "c", "left").join(found, "c", "left").join(repaired_rows(rows, found), "c", "left")
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


#: The same one row at a time over each whole conversation; states are ``''`` (start) and the last role's initial.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS tab),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ord(ch)::BIGINT)), lambda v, b: xor(v >> 8, tab[(xor(v, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, (SELECT unnest([1, 2]) AS copy) WHERE fate <> 0 AND (copy = 1 OR fate = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
seen AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows AS (
  SELECT conv_id, i, turn, role, text, role[1] AS ini, before, shown = '' AS blank, shown <> '' AND again AS dup, shown <> '' AND NOT again AND shown[-1] NOT IN ('.', '!', '?') AS cut FROM seen),
edits AS (
  SELECT st, ins, edit, ini, b, cost FROM (VALUES
    ('', '', ''), ('', 'I', 'u'), ('', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'),
    ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')) AS p(st, ins, mid)
  JOIN (VALUES
    ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('a', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0),
    ('', 'R', NULL, 'u', 2), ('s', 'R', NULL, 'u', 2), ('a', 'R', NULL, 'u', 2), ('u', 'R', NULL, 'a', 2),
    ('', 'D', NULL, '', 3), ('s', 'D', NULL, 's', 3), ('u', 'D', NULL, 'u', 3), ('a', 'D', NULL, 'a', 3)) AS e(mid, edit, ini, b, cost) USING (mid)),
walk(conv_id, i, st, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', row(0::BIGINT, '') FROM rows
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.b, min(row(w.best[1] + 2 * length(e.ins) + e.cost + (r.cut AND e.edit <> 'D')::INT, w.best[2] || e.ins || e.edit))
  FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN edits e ON e.st = w.st AND (e.ini IS NULL OR e.ini = r.ini) AND (e.edit = 'D' OR NOT (r.blank OR r.dup))
  GROUP BY w.conv_id, w.i + 1, e.b),
best AS (
  SELECT w.conv_id, min(row(w.best[1] + 2 * length(x.ins), w.best[2] || x.ins)) AS best
  FROM walk w JOIN (SELECT conv_id, max(i) AS n FROM rows GROUP BY conv_id) AS l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i
  JOIN (VALUES ('', ''), ('s', 'II'), ('u', 'I'), ('a', '')) AS x(st, ins) ON x.st = w.st GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(string_split(best[2], '')) AS edit, unnest(range(1, length(best[2]) + 1)) AS j FROM best),
numbered AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters),
kept AS (
  SELECT l.conv_id, l.j, l.edit, r.role, r.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS k,
         max(CASE WHEN l.edit = 'K' AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS sys
  FROM numbered l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role || ':' || text ELSE (CASE WHEN (k - sys) % 2 = 1 THEN 'user:' ELSE 'assistant:' END) || coalesce(text, '') END, chr(10) ORDER BY k) AS repaired
  FROM kept GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[1], 0)::BIGINT AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
