"""Each stage of the pipeline against what its operator says about its own input."""

from __future__ import annotations

import collections

import corpus_pipeline as pipeline
from voxlake.llm.common import materialise
from voxlake.llm.near_dedup import near_duplicates
from voxlake.llm.quality_rules import quality_cascade
from voxlake.llm.substring_dedup import substring_dedup


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], small), name))
    ids = [sorted(r.doc_id for r in o.select("doc_id").collect()) for o in out]
    assert all(o.columns == columns for o in out[:-1])
    assert ids[1] == sorted(r.doc_id for r in quality_cascade(docs).where("kept").collect())
    assert set(ids[2]) <= set(ids[1])
    assert ids[3] == sorted(r.doc_id for r in near_duplicates(out[2]).where("kept").collect())
    assert ids[4] == ids[3]
    want = {r.doc_id: r.kept_text if r.n_removed else r.text for r in substring_dedup(out[3]).collect()}
    assert {r.doc_id: r.text for r in out[4].collect()} == want
    assert all(r.n_chars == len(r.text) for r in out[4].collect())
    assert set(ids[5]) == set(ids[4])
    placed = collections.defaultdict(list)
    for r in out[5].collect():
        placed[r.sequence_id].append((r.offset, r.length))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_run(spark, small):
    assert pipeline.run(spark, small).count() > 0


def test_stages_take_odd_rows(spark, small, edge):
    docs = edge.drop("n_words", "kept")
    for name, stage in pipeline.STAGES:
        out = materialise(stage(spark, docs, small), "odd-rows")
        assert (out.count() >= docs.count()) == (name in ("substring_dedup", "best_fit_packing"))
    empty = edge.drop("n_words", "kept").limit(0)
    for _, stage in pipeline.STAGES:
        empty = materialise(stage(spark, empty, small), "odd-rows")
    assert empty.count() == 0
