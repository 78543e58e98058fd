"""Cross-tokenizer alignment against whole texts tokenized one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from test_llm import prose, widened

import __spark_entry__
from tallyframe.llm import align

SIGNS = [" ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "▁", "\x00", "\x85", "a", "word", "'s", "don't", "12", "3,5", "é", "é", "語", "日本", "😀", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "<unk>", "!!", "...", "_", "-"]


def slow(texts):
    """The result columns of each text, tokenized whole."""
    a, b = align.vocabularies(align.FOLDER)
    token = lambda v, i: v.bytes[v.begin[i] : v.begin[i] + v.size[i]].tobytes()
    found = []
    for text in texts:
        ids = [v.encode(" " + text) for v in (a, b)] if text else [[], []]
        spelled = [[token(v, i) for i in x] for v, x in zip((a, b), ids, strict=True)]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            found.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(t) for t in s]).tolist(), range(len(s)), strict=True)) for s in spelled]
        common = sorted(ends[0].keys() & ends[1].keys())
        cut = [[-1, *(e[c] for c in common)] for e in ends]
        groups = [[x[p + 1 : q + 1] for p, q in zip(c, c[1:], strict=False)] for x, c in zip(ids, cut, strict=True)]
        links = [(ids[0][ends[0][c]], ids[1][ends[1][c]]) for c in common]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*groups, strict=True))
        found.append((len(ids[0]), len(ids[1]), len(common), links, hashlib.sha256(written.encode()).hexdigest()))
    count = Counter(link for f in found if f for link in f[3])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for f in found]


def rows_of(df):
    return sorted((x.doc_id is not None, x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in df.collect())


@pytest.mark.parametrize("block", [1 << 23, 400])
def test_hostile_texts(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "CALL", 200)
    monkeypatch.setattr(align, "SLICE", 7)
    r = random.Random(block)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randrange(30))) for _ in range(400)]
    texts += [" ".join(r.choice(SIGNS) for _ in range(r.randrange(30))) for _ in range(200)]
    texts += [None, "", " ", "  ", "a", " a", "a ", "  a  ", "\n", "x" * 3000, prose(1, 2000), prose(1, 2000), prose(2, 50) + " " * 300 + prose(3, 50), "▁ ok"]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [(i % 50 != 0, i if i % 50 else None, *x) for i, x in enumerate(slow(texts))]
    assert rows_of(align.align(widened(df))) == sorted(want)
    assert align.align(df.limit(0)).count() == 0


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = __spark_entry__.queries()["op13_token_align"](spark, sf)
    assert rows_of(got) == sorted((True, d.doc_id, *x) for d, x in zip(docs, slow([d.text for d in docs]), strict=True))
