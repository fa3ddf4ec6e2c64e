"""The pipeline's stages against plain versions, on documents of the testdata."""

import collections
import re
from pathlib import Path

import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from chronokv.llm import cotrain, quality, registry
from chronokv.llm.common import written

from .test_operators import WORD, base_counts, removals, similar_by_all_pairs

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no testdata")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, str(SF)), "stage")
        rows = before.collect()
        if name == "quality rules":
            kept = {r.doc_id for r in quality.judged(before, quality.train(before, labels)).where("kept").collect()}
            assert {r.doc_id for r in after.collect()} == kept and not any(base_counts(r.text)[-1] for r in rows if r.doc_id in kept)
        elif name == "quality classifier":
            kept = {r.doc_id for r in cotrain.scored(before, cotrain.train(docs, labels)).where("kept").collect()}  # fitted on the raw table
            assert {r.doc_id for r in after.collect()} == kept
        elif name == "simhash near-dedup":
            left = {r.doc_id for r in after.collect()}
            want = {d for d, g in similar_by_all_pairs([(r.doc_id, r.text) for r in rows]).items() if d == g}
            assert left == want
        elif name == "substring dedup":
            want = {r.doc_id: [x for i, x in enumerate(w) if i not in gone] for r, (w, gone) in zip(rows, removals([(r.doc_id, r.text) for r in rows]), strict=True)}
            assert {r.doc_id: WORD.findall(r.text) for r in after.collect()} == want
        else:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rows}
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    assert corpus_pipeline.run(spark, str(SF)).count() == before.count()


def test_classifier_rejects_poor_documents_after_the_rules(spark, monkeypatch):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, raw, str(SF))
    poor = raw.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").select(*raw.columns)
    fitted = []
    train = cotrain.train
    monkeypatch.setattr(cotrain, "train", lambda *a, **k: fitted.append(train(*a, **k)) or fitted[-1])
    # Of poor labelled documents the rules keep none, so they are put in again under ids without labels.
    given = written(kept.union(poor.withColumn("doc_id", -poor["doc_id"] - 1)), "stage")
    left = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, given, str(SF)).collect()}
    assert fitted[0].content is not None and fitted[0].meta is not None
    injected = {-r.doc_id - 1 for r in poor.collect()}
    assert injected and not injected & left
    good = kept.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    assert {r.doc_id for r in good.collect()} <= left


def test_registry():
    numbers = collections.Counter(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES)
    assert numbers == {n: 1 for n in range(1, 11)}
    assert set(registry.QUERIES) | {"pipeline"} <= set(spark_entry.queries()) and set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
