"""The near-copy stage of the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from test_llm import make_docs, prose, widened

import corpus_pipeline
from tallyframe.llm import nearcopies, simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_reference(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [i for i in range(len(texts)) if find(i) == i]


def edited(seed, text, places):
    r, words = random.Random(seed), text.split()
    for k in r.sample(range(len(words) // 12), places):  # far apart: each edit changes five shingles
        words[12 * k + 5] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("cell", [2_000, 3])
def test_stage_keeps_one_of_what_is_alike_at_0_8(spark, cell, monkeypatch):
    monkeypatch.setattr(nearcopies, "CELL", cell)
    texts = [None, "", "one two", "one two", "three"]
    for i in range(60):
        base = prose(i + 2_000, 240)
        texts += [base, edited(i, base, i % 12)]  # similarities from 1 down to about 0.63
    base = prose(77, 240)
    texts += [edited(1_000 + i, base, 6) for i in range(40)]  # alike to the base, not to each other
    texts += [base]
    docs = widened(make_docs(spark, texts))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == kept_reference(texts)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_bands_recall_from_0_8_to_0_85():
    r = np.random.default_rng(3)
    met, n = 0, 3_000
    for _ in range(n):
        h = r.integers(0, 1 << 64, 220, np.uint64)
        away = int(r.integers(15, 21))  # (200 - away... ) of 200 in common: 0.81 to 0.86
        a, b = h[:200], np.r_[h[: 200 - away], h[200 : 200 + away]]
        met += bool(set(nearcopies.bands(a)) & set(nearcopies.bands(b)))
    assert met >= 0.999 * n


@pytest.mark.parametrize("module", [nearcopies, simhash])
def test_texts_of_one_id_are_told_apart(spark, module):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, a, "x"), (3, b, "x"), (None, a, "x"), (None, None, None), (4, None, "z"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text) for r in module.keep_one(docs).where("doc_id is not null").collect())
    assert got == [*sorted([(1, a), (1, b)]), (4, None)]
    assert module.keep_one(docs).where("doc_id is null").count() == 2


def test_a_large_group_below_the_similarity_writes_few_rows(spark):
    base = prose(5, 240)
    texts = [edited(3_000 + i, base, 9) for i in range(150)]  # about 0.7 to the base, less to each other
    docs = make_docs(spark, texts)
    kept = sorted(r.doc_id for r in nearcopies.keep_one(docs).collect())
    assert kept == kept_reference(texts)
