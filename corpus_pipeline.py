"""A corpus pipeline: toxic documents go, near duplicates go, contaminated documents go, secrets are blanked, the rest is packed.

Each stage takes the rows that its predecessor kept and works on all of them. A stage's result is written as Parquet
and read again, so a lost executor repeats one stage's tasks at most.

Cases: null and empty texts are neither toxic nor contaminated, have no near duplicates and no secrets, and are packed as one end id; rows
without a doc_id go through all stages like others (of near duplicates they are kept only where all lack one); rows that
repeat a doc_id and its text are near duplicates, so one stays; texts of any length are taken whole; without benchmark items or
labels nothing is contaminated or toxic; an empty table gives no pieces; other columns are kept up to the packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontam, jaccard, packing, secrets, toxicity
from tracewell.llm._spark import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores is below 0.5."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of similar 5-word shingle sets (0.8 or more)."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of a benchmark item occurs."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, every source at its share of the corpus in each."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", blank_secrets),
    ("packing", pack),
]

#: The first stage's trained scores can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
