"""Small tables with the awkward cases: nulls, empty texts, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, node long, score double"


def docs(spark, texts, source="s"):
    rows = [(i, t, "en", source, None if t is None else len(t), 1, 2, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


AWKWARD = [None, "", " ", "a", "\n\n", "word " * 30_000, "Ünïcödé ❤ 中文 text", "same text here", "same text here", "x" * 70_000, "\x00\x01 odd \x85 bytes"]
