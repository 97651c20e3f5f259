from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.common import AWKWARD, docs
from tests.llm.test_forms import brute_classes, check_pieces
from tests.llm.test_scans import brute
from tracewell.llm import secrets, toxicity
from tracewell.llm._spark import materialize


def test_stages_by_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(d, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
    rows = sorted(d.collect(), key=lambda r: r.doc_id)
    rows = [r for r in rows if model.scores([r.text])[0][0] < 0.5]
    stage = P.drop_toxic(spark, d, SF)
    assert sorted(r.doc_id for r in stage.collect()) == [r.doc_id for r in rows] and stage.columns == d.columns
    classes = brute_classes([r.text for r in rows])
    rows = [r for i, (r, (_, c)) in enumerate(zip(rows, classes, strict=True)) if c == i]
    stage = P.drop_near_duplicates(spark, stage, SF)
    assert sorted(r.doc_id for r in stage.collect()) == [r.doc_id for r in rows] and stage.columns == d.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute([r.text for r in rows], items, 10)
    rows = [r for r, (_, n, _) in zip(rows, hits, strict=True) if not n]
    stage = P.drop_contaminated(spark, stage, SF)
    assert sorted(r.doc_id for r in stage.collect()) == [r.doc_id for r in rows] and stage.columns == d.columns
    found = secrets.findings(stage, secrets.train(secrets.labelled_findings(spark))).where("secret").collect()
    blanked = P.blank_secrets(spark, stage, SF)
    after = {r.doc_id: r for r in blanked.collect()}
    assert blanked.columns == d.columns and len(after) == len(rows)
    for r in rows:
        own = [f for f in found if f.doc_id == r.doc_id]
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        assert (after[r.doc_id].text == r.text) == (not own)
        assert all(f.value not in after[r.doc_id].text for f in own)
    pieces = P.pack(spark, blanked, SF).collect()
    check_pieces(pieces, {i: r.text for i, r in after.items()})


def test_stages_take_awkward_rows(spark):
    """Nulls, empty and very long texts, rows without an id and columns of any name go through all stages; one of equal texts stays."""
    d = docs(spark, AWKWARD)
    d = d.unionByName(d.where("doc_id IN (0, 3)").withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("g", "key", "row", "label", "times", "id", "y", "spans", "members", "text_"):
        d = d.withColumn(name, F.lit("own"))
    expected = {0: None, 1: "", 2: " ", 3: "a", 4: "\n\n", 5: AWKWARD[5], 6: AWKWARD[6], 7: AWKWARD[7], 9: AWKWARD[9], 10: AWKWARD[10]}
    stage = d
    for name, step in P.STAGES[:-1]:
        stage = materialize(step(spark, stage, SF), "awkward")
        assert stage.columns == d.columns, name
    rows = stage.collect()
    assert {r.doc_id: r.text for r in rows if r.doc_id is not None} == expected
    assert [r.text for r in rows if r.doc_id is None] == [None]  # "a" without an id is a copy of document 3
    assert all(r.g == r.key == r.row == r.label == r.spans == "own" for r in rows)
    packed = P.pack(spark, stage, SF).collect()
    check_pieces(packed, expected | {None: None})


def test_run_and_empty_table(spark):
    pieces = P.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(pieces.columns) and pieces.count() > 0
    none = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in P.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
