"""Secret scans: candidates by pattern, false positives removed by a random forest.

Native: candidates, features, training and scoring are DataFrame and SQL functions. A scan splits each text at its
candidates, so that a candidate's neighbours are the pieces around it, in one stage; only candidates are shuffled, for the sums that tell where they stand.

Features of a candidate are its length, character transitions (changes of character class, common letter
pairs), dictionary coverage, digits, alphabet, known prefixes, the path it stands in and neighbouring words.
The forest is grown level by level from labelled findings: each level is one aggregation of (tree, node, feature, bin)
counts, of which there are a fixed number; trees see Poisson-weighted rows and three fifths of the
features at each node. The grown trees are a column expression.

Without a table of labelled findings :func:`labelled_findings` makes one by rule. Cases: null and empty texts have
no findings; a null path has no path words; a null doc_id stays null; repeated rows give equal rows; texts of any length are
scanned whole; with labels of one kind only the forest is that constant; other columns are kept by :func:`redact`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import fresh, materialize, table

#: Candidates: key blocks (also of PGP), assignments to telling names, credentials in URLs, access key ids, and long runs with a digit.
#: A key block goes up to its END line, or, where that is missing, to the end of its base64 lines.
HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
BLOCK = HEAD + r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+(?:[A-Za-z0-9+/]{40,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+|(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{16,}+))*+)"
KEYED = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?[\"']?\s*+[=:]\s*+[\"']?[^\s\"',;]{6,}"
URL = r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\s/:@]++:[^\s/@]{3,}+@"
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
ACCESS = r"(?<![A-Za-z0-9+/_-])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9+/_-])"
CANDIDATE = f"{BLOCK}|{KEYED}|{URL}|{ACCESS}|{RUN}"

#: Words of the dictionary feature, and of the neighbour and path features (fixed values).
DICTIONARY = "example|sample|placeholder|change|default|password|secret|token|dummy|value|string|number|config|setting|user|admin|name|test|your|here|none|null|true|false|key|foo|bar|baz|page|post|article|title|image|index|content|version|release|build|branch|feature|module|package|class|function|method|object|table|column|field|order|item|list|data|file|path|http|www|com|org|html|json|xml|abc|qwerty|letmein|welcome|the|and|with|from|this|that|for|not"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
KNOWN = r"^(?:A[KS]IA[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-|sk-[A-Za-z0-9]{20,}|sk_live_|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{10,}|glpat-|-----BEGIN)"
TELLING = r"(?i)passw|pwd|secret|token|api.?key|access.?key|auth|credential|bearer|private"
NAMING = r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|uuid|guid|hash|revision|rev|etag|version|order|isbn|invoice|ticket|build|session|trace|request|serial|phone|id)\b"
TESTING = r"(?i)test|spec|example|sample|doc|fixture|mock|demo|tutorial"

FEATURES = ("length", "transitions", "pairs", "dictionary", "digits", "distinct", "hex", "known", "separators", "telling", "naming", "testing", "keyed", "vowels")
CONTEXT = 48


def features(value: Column, left: Column, right: Column, path: Column, keyed: Column) -> Column:
    """The features of one candidate, an array of doubles in the order of FEATURES."""
    n = F.length(value).cast("double")
    lower = F.lower(value)

    def share(text: Column, pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1.0))

    kinds = value
    for pattern, letter in (("[0-9]", "0"), ("[A-Z]", "A"), ("[a-z]", "a"), ("[^0-9A-Za-z]", "-")):
        kinds = F.regexp_replace(kinds, pattern, letter)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.array(
        n, (runs - 1) / F.greatest(n - 1, F.lit(1.0)), share(lower, PAIRS), share(lower, DICTIONARY), share(value, "[0-9]"),
        F.size(F.array_distinct(F.split(value, ""))) / F.greatest(n, F.lit(1.0)), flag(value.rlike("^[0-9a-fA-F]+$")), flag(value.rlike(KNOWN)), share(value, "[^0-9A-Za-z]"),
        flag(left.rlike(TELLING) | right.rlike(TELLING)), flag(left.rlike(NAMING)), flag(path.rlike(TESTING)), keyed.cast("double"), share(lower, "[aeiou]"),
    )


@dataclass(frozen=True)
class Forest:
    """Trees as nested tuples (feature, threshold, below, above), or a leaf's share of secrets."""

    trees: tuple

    def score(self, x: Column) -> Column:
        def expression(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, below, above = node
            return F.when(x[feature] <= threshold, expression(below)).otherwise(expression(above))

        parts = [expression(t) for t in self.trees]
        return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))

    def score_of(self, x: list[float]) -> float:
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.trees)


def grow(findings: DataFrame, trees: int = 16, depth: int = 7, bins: int = 12, least: float = 4.0) -> Forest:
    """Grow a forest from rows (``id``, ``x`` array of doubles, ``y`` 0 or 1).

    A level's statistics are at most trees * 2**level * features * bins counts, whatever the number of findings.
    """
    width = len(FEATURES)
    marks = [i / bins for i in range(1, bins)]
    cuts = findings.agg(*[F.percentile_approx(F.col("x")[k], marks).alias(f"c{k}") for k in range(width)]).first()
    cuts = [sorted({*(cuts[k] or ()), *((0.0,) if cuts[k] else ())}) for k in range(width)]
    rows = findings.select("id", "x", F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    # Poisson(1) weights from a hash: the share of draws at each count.
    u = F.pmod(F.xxhash64("id", "tree"), F.lit(1_000_000)) / 1e6
    rows = rows.withColumn("w", F.when(u < 0.3679, 0.0).when(u < 0.7358, 1.0).when(u < 0.9197, 2.0).when(u < 0.981, 3.0).otherwise(4.0)).where("w > 0")
    splits: dict[tuple[int, int], tuple[int, float]] = {}
    values: dict[tuple[int, int], float] = {}

    def node_at(level: int) -> Column:
        """The node of a row at a level (1 is a root, 2n and 2n + 1 are below n); null where its path ended before."""
        if not splits:
            return F.lit(1 if level == 0 else None).cast("int")
        at = F.map_from_arrays(F.array(*[F.lit(t * 1000 + n) for t, n in splits]), F.array(*[F.struct(F.lit(f).alias("f"), F.lit(c).alias("c")) for f, c in splits.values()]))

        def step(node: Column, _: Column) -> Column:
            split = F.try_element_at(at, F.col("tree") * 1000 + node)
            return F.when(split.isNotNull(), 2 * node + (F.get("x", split.f) > split.c).cast("int"))

        return F.aggregate(F.array(*[F.lit(k) for k in range(level)]), F.lit(1), step) if level else F.lit(1)

    for level in range(depth + 1):
        at = rows.withColumn("node", node_at(level)).where("node IS NOT NULL")
        if level == depth:
            for r in at.groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s")).collect():
                values[r.tree, r.node] = r.s / r.n
            break
        marks_of = F.array(*[F.array(*map(F.lit, c)) if c else F.array().cast("array<double>") for c in cuts])
        slot = F.transform("x", lambda v, k: F.struct(k.alias("feature"), F.size(F.filter(F.get(marks_of, k), lambda c: v > c)).alias("bin")))
        counts = at.select("tree", "node", "w", "y", F.explode(slot).alias("s")).groupBy("tree", "node", "s.feature", "s.bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()
        stats: dict = {}
        for r in counts:
            stats.setdefault((r.tree, r.node), {}).setdefault(r.feature, {})[r.bin] = (r.n, r.p)
        for (t, n), by_feature in stats.items():
            total, positive = (sum(v[i] for v in by_feature[0].values()) for i in (0, 1))
            values[t, n] = positive / total
            best = (1e-9, None)
            for f in sorted(by_feature):
                if hash((t, n, f)) % 5 < 2:  # three fifths of the features at each node
                    continue
                under = under_p = 0.0
                for b, c in enumerate(cuts[f]):
                    m, p = by_feature[f].get(b, (0.0, 0.0))
                    under, under_p = under + m, under_p + p
                    above, above_p = total - under, positive - under_p
                    if under >= least and above >= least:
                        gain = under_p**2 / under + above_p**2 / above - positive**2 / total
                        if gain > best[0]:
                            best = (gain, (f, float(c)))
            if best[1]:
                splits[t, n] = best[1]

    def build(t: int, n: int):
        if (t, n) in splits:
            return (*splits[t, n], build(t, 2 * n), build(t, 2 * n + 1))
        return values.get((t, n), values.get((t, n // 2), 0.0))

    return Forest(tuple(build(t, 1) for t in range(trees)))


def labelled_findings(spark: SparkSession, n: int = 5600) -> DataFrame:
    """Findings (value, before, after, path, keyed, y) made by rule: generated keys are secrets; words, hashes, ids and dates are not."""
    i = F.col("id")
    hexes = F.sha2(F.concat(F.lit("h"), i.cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i.cast("string")), 512))), "[+/=]", "x")
    upper = F.substring(F.translate(F.upper(hexes), "0189", "QRST"), 3, 16)
    word = lambda k: F.element_at(F.lit(DICTIONARY.split("|")), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(DICTIONARY.count("|"))) + 1).cast("int"))
    syllable = lambda k: F.element_at(F.lit(PAIRS.split("|")), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(PAIRS.count("|"))) + 1).cast("int"))
    prose = F.concat(*[syllable(k) for k in range(8)])
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)).cast("string")
    h, m = hexes, mixed
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    shapes = [  # value, words before, keyed, secret
        (F.substring(h, 1, 18), "password=", 1, 1), (F.substring(h, 1, 40), 'token = "', 1, 1), (F.concat(F.lit("AKIA"), upper), "key", 0, 1), (F.substring(m, 1, 40), "secret", 0, 1),
        (F.concat(F.lit("ghp_"), F.substring(m, 1, 36)), "use", 0, 1), (F.concat(F.lit("AKIA"), upper), "the of", 0, 1), (F.substring(m, 1, 24), "api_key: ", 1, 1), (F.concat(F.lit("sk-"), F.substring(m, 2, 40)), "in", 0, 1),
        (F.when(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2)) == 0, F.lit("-----BEGIN RSA PRIVATE KEY-----")).otherwise(F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.concat(F.substring(m, 1, 64), F.lit("\n")), 12), F.lit("-----END RSA PRIVATE KEY-----"))), "", 0, 1), (F.concat(F.substring(m, 3, 7), F.lit("!"), F.substring(h, 5, 5)), "pwd: ", 1, 1), (F.substring(m, 5, 12), "password: ", 1, 1),
        (F.concat_ws("_", word(1), word(2), word(3)), "password=", 1, 0), (F.concat(word(1), number), "token=", 1, 0), (F.concat(prose, F.lit("ing")), "secret: ", 1, 0), (F.substring(h, 1, 40), "commit", 0, 0),
        (uuid, "id", 0, 0), (F.substring(h, 1, 32), "md5", 0, 0), (h, "sha256 checksum", 0, 0), (F.concat_ws("-", word(1), word(2), word(3), word(4), number), "see", 0, 0),
        (F.concat(F.lit("2024/01/"), number, F.lit("/"), prose), "the", 0, 0), (F.concat(number, number, number, number, number, number), "order", 0, 0), (F.concat(F.lit("20240101T000000-"), number), "at", 0, 0),
        (F.concat(prose, number, prose), "of", 0, 0), (F.concat(F.repeat(F.lit("x"), 12), number, F.repeat(F.lit("0"), 6)), "token=", 1, 0), (F.concat_ws("/", word(1), word(2), word(3), number, word(5)), "in", 0, 0),
        (uuid, "request", 0, 0), (F.concat(F.lit("${"), word(2), F.lit("_"), word(3), F.lit("}")), "password: ", 1, 0), (F.concat_ws(".", word(1), word(2), word(3)), "token = ", 1, 0),
    ]
    pick = F.pmod(i, F.lit(len(shapes)))
    row = None
    for k, (value, before, keyed, y) in enumerate(shapes):
        s = F.struct(value.alias("value"), F.lit(before).alias("before"), F.lit(keyed).alias("keyed"), F.lit(y).alias("y"))
        row = F.when(pick == k, s) if row is None else row.when(pick == k, s)
    path = F.when(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)) == 0, "tests/fixture").otherwise("src")
    return spark.range(0, n, 1, 4).select("id", row.alias("r"), path.alias("path")).select("id", "r.value", "r.before", F.lit("").alias("after"), "path", "r.keyed", "r.y")


def train(findings: DataFrame, **options) -> Forest:
    """A forest from labelled findings (id, value, before, after, path, keyed, y)."""
    x = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), F.col("keyed"))
    return grow(materialize(findings.select("id", x.alias("x"), "y"), "findings"), **options)


def with_findings(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """docs with two columns more, the last two, of names that it had not: the texts between candidates, and an array of its candidates in order:
    ``raw`` (as it stands), ``value`` (the key itself), ``rule``, ``skipped`` (characters since the one before), ``score``, ``secret``."""
    raws, pieces, candidates = (fresh(docs, stem=x) for x in ("raw", "pieces", "found"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    cut = docs.withColumn(raws, F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)))
    cut = cut.withColumn(pieces, F.when(F.size(raws) > 0, F.split(body, CANDIDATE)))

    def candidate(raw: Column, i: Column) -> Column:
        block, url = raw.startswith("-----BEGIN"), raw.rlike(f"^{URL}$")
        keyed = raw.rlike(f"^(?:{KEYED})$") & ~block & ~url
        value = F.when(block, raw).when(url, F.regexp_extract(raw, r"://[^\s/:@]*:([^\s/@]*)@$", 1)).when(keyed, F.regexp_extract(raw, r"[=:]\s*[\"']?([^\s\"',;]{6,})$", 1)).otherwise(raw)
        rule = F.when(block, "block").when(url, "url").when(keyed, "keyed").otherwise("run")
        before = F.get(pieces, i)
        left = F.concat(F.substring(before, -CONTEXT, CONTEXT), F.when(keyed | url, F.substring(raw, 1, 24)).otherwise(""))
        return F.struct(raw.alias("raw"), value.alias("value"), rule.alias("rule"), F.length(before).cast("long").alias("skipped"), features(value, left, F.substring(F.get(pieces, i + 1), 1, CONTEXT), where, keyed | url).alias("x"))

    cut = cut.withColumn(candidates, F.transform(raws, candidate))
    scored = F.transform(candidates, lambda c: F.struct(c.raw.alias("raw"), c.value.alias("value"), c.rule.alias("rule"), c.skipped.alias("skipped"), forest.score(c.x).alias("score")))
    cut = cut.withColumn(candidates, scored)
    return cut.withColumn(candidates, F.transform(candidates, lambda c: c.withField("secret", c.score >= threshold))).select(*docs.columns, pieces, candidates)


def findings(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: ``doc_id, start, stop`` (characters), ``rule, value, score, secret``."""
    found = with_findings(docs.select(*dict.fromkeys([doc_id, text, *([path] if path else [])])), forest, text, path, threshold)
    candidates = found.columns[-1]
    rows = found.where(F.size(candidates) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), candidates)
    rows = rows.select("doc_id", "row", F.posexplode(candidates).alias("i", "c"))
    past = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("c.skipped") + F.length("c.raw")).over(past)
    return rows.withColumn("stop", stop).select("doc_id", (F.col("stop") - F.length("c.raw")).alias("start"), "stop", "c.rule", "c.value", "c.score", "c.secret")


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", mark: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """docs with every secret in ``text`` replaced by a mark; the other columns and rows stay."""
    found = with_findings(docs, forest, text, path, threshold)
    at, candidates = found.columns[-2:]
    c = lambda i: F.get(candidates, i)
    pieces = F.transform(at, lambda p, i: F.concat(p, F.coalesce(F.when(c(i).secret, F.replace(c(i).raw, c(i).value, F.lit(mark))).otherwise(c(i).raw), F.lit(""))))
    return found.withColumn(text, F.when(F.size(candidates) > 0, F.array_join(pieces, "")).otherwise(F.col(text))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    return found.select("doc_id", "start", "stop", "rule", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")
