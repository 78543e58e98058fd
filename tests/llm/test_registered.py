"""Registered queries as they stand, against slow references on the smallest tables."""

import numpy as np
from test_llm import suffix_reference

import __spark_entry__
from tallyframe.llm import suffix

SF = "/root/testdata/sf0.001"


def test_repeats_with_the_registered_lengths(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in __spark_entry__.queries()["op10_suffix_dedup"](spark, SF).collect()}
    assert rows == dict(zip(docs, suffix_reference(list(docs.values()), suffix.LENGTH), strict=True))
    assert any(r[1] for r in rows.values())


def test_quality_of_ids_not_learnt_from(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in __spark_entry__.queries()["op7_quality_ftrl"](spark, sf).where("held_out").collect() if r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.9


def test_each_document_lies_in_one_shard(spark):
    docs = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = __spark_entry__.queries()["op9_shard_compaction"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == docs
    of = {}
    for r in rows:
        of.setdefault(r.shard, []).append(r.shard_rows)
    assert all(set(n) == {len(n)} for n in of.values())


def test_planted_tokens_are_found(spark):
    """Keys after ``token = `` in the texts, which no label names: each is found and told from its neighbours."""
    import re

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keys = {(d, m[1]) for d, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    rows = __spark_entry__.queries()["op5_secret_forest"](spark, SF).collect()
    found = {(r.doc_id, r.secret) for r in rows if r.is_secret}
    assert len(keys & found) >= 0.9 * len(keys)
