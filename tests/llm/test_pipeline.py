"""The pipeline, stage by stage, and the registered queries."""
from __future__ import annotations

import re

import __spark_entry__
import corpus_pipeline
import public_tokenizers
from signalyard.llm import common, queries
from tokenizers import Tokenizer

from . import fixtures
from .test_operators import base_spans, reference_components, reference_counts, reference_fingerprint


def test_stages_on_documents_that_stress_them(spark, sf):
    docs = fixtures.repeated_and_null(spark)
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = common.written(stage(spark, docs, sf), "t")
        rows = docs.collect()
        if k < 4:
            assert docs.columns == names
        if k == 0:
            good = {r["doc_id"] for r in before.collect() if not reference_counts(r["text"])[-1]}
            assert {r["doc_id"] for r in rows} <= good
        if k == 1:
            fps = {reference_fingerprint(r["text"]) for r in before.collect()}
            assert len(rows) == len(set(reference_components(fps).values()))
        if k == 2:
            assert all(not base_spans(r["text"]) for r in rows)
        if k == 3:
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.collect()}
        if k == 4:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sum(r["length"] for r in rows) == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())


def test_stages_on_an_empty_table(spark, sf):
    docs = fixtures.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), "t")
    assert docs.count() == 0


def test_run_gives_what_the_stages_give(spark, sf):
    a = corpus_pipeline.run(spark, sf)
    assert a.count() > 0 and a.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, sf).join(common.load(spark, sf, "labels"), "doc_id").filter("held_out")
    right = got.filter("predicted = toxic").count()
    assert right >= 0.95 * got.count()
    assert got.filter("toxic = 1 and predicted = 1").count() >= 0.8 * got.filter("toxic = 1").count()
