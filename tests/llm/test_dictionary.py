"""The dictionary of the secret scans is counted over all texts."""

import re

from test_llm import make_docs, prose

from tallyframe.llm import secrets

RARE = "zubrowka"
SECRETS = [f"{RARE}-{RARE}-0123456789", "Xq7/zubrABCD+kladQ99", "0123456789012345678", "kladderadatsch_zubrowkab", "a1b2c3d4e5f6g7h8i9j0"]


def covered(secret, words):
    parts = [w for w in re.split(r"[^A-Za-z]+", secret) if w]
    hit = sum(len(w) for w in parts if w.lower() in words)
    return (hit + sum(1 for w in parts if w.lower() not in words for i in range(len(w) - 3) if w[i : i + 4].lower() in words)) / len(secret)


def test_words_of_few_texts_of_a_large_table_count(spark):
    texts = [prose(i, 8) for i in range(6_000)]
    for i in (100, 2_100, 4_100, 5_100):
        texts[i] = f"the {RARE} zubr klad"
    texts += SECRETS
    docs = make_docs(spark, texts)
    found = secrets.candidates(docs)
    words = secrets.dictionary(docs, "text")
    known = {r.w for r in words.collect()}
    assert {RARE, "zubr", "klad"} <= known
    got = {r.secret: r.features for r in secrets.with_coverage(found, words).collect()}
    assert set(got) == set(SECRETS)
    for s, x in got.items():
        assert len(x) == secrets.COVERAGE + 1 + secrets.AFTER + secrets.HASHED + secrets.PATHS
        assert abs(x[secrets.COVERAGE] - covered(s, known)) < 1e-12
    assert got[SECRETS[0]][secrets.COVERAGE] > 0.5
