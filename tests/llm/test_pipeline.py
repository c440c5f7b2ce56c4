"""The pipeline against brute force over the smallest tables."""

import numpy as np

import corpus_pipeline
from isoline.llm import toxicity, tokens

from .test_dedup import fingerprint, lower, near_want
from .test_filters import held


def test_pipeline_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("toxic").collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(d in bad and not t for d, t in truth.items()) <= 0.03 * len(truth)  # few labels here; accuracy is tested on more
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    keep = {lower(t): k for k, t in sorted(rows)}
    rows = [(k, t) for k, t in rows if keep[lower(t)] == k]
    least = near_want(rows, np.array([fingerprint(t) for _, t in rows], np.uint64))
    rows = [r for r, c in zip(rows, least, strict=True) if r[0] == c]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(k, t) for k, t in rows if not any(held(t, q) >= 0.8 for q in items)]
    t = tokens.load(tokens.default_path("byte_bpe_50k.json"))
    want = {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in rows}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, small).collect()} == want


def test_stages_keep_columns_and_take_no_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 0
