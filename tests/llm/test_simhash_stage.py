"""The near-dedup stage finds links by SimHash, verifies them, and completes them."""

from test_llm import make_docs, prose
from test_nearcopies import edited, kept_reference

import corpus_pipeline
from tallyframe.llm import nearcopies


def test_stage_links_by_simhash_and_checks_by_shingles(spark, monkeypatch):
    texts = []
    for i in range(12):
        base = prose(i + 5_000, 400)
        texts += [base, edited(i, base, 1)]
    docs = make_docs(spark, texts)
    monkeypatch.setattr(nearcopies, "bands", lambda shingles: [])  # fingerprints alone
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert len(kept_reference(texts)) == 12 and len(got) <= 14
    assert set(kept_reference(texts)) <= set(got)  # no link that the exact check refuses


def test_fingerprint_of_a_set_is_that_of_its_shingles():
    from tallyframe.llm import simhash

    text = prose(3, 300)
    assert len(nearcopies.shingle_set(text.encode())) == 296  # no repeats
    assert nearcopies.print_of(nearcopies.shingle_set(text.encode())) == simhash.fingerprint(text.encode(), 5)
