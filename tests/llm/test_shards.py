"""Repeats of an anchor that one text holds at very many places."""

import hashlib
import random
from collections import Counter

from test_llm import make_docs, prose

from tallyframe.llm import suffix


def test_one_text_of_thousands_of_regions_of_one_anchor(spark):
    r = random.Random(5)
    head = prose(901, 120)[:380]
    lines = [head + r.randbytes(130).hex() for _ in range(6_000)]
    texts = ["\n".join([*lines, lines[17], lines[4_000][:450]]), "start " + lines[2_500] + " end", "other"]
    n, raw = suffix.LENGTH, [t.encode() for t in texts]
    seen = Counter(hash(t[i : i + n]) for t in raw for i in range(len(t) - n + 1))
    want = []
    for t in raw:
        kept, upto = bytearray(), 0
        for i in range(len(t)):
            if i + n <= len(t) and seen[hash(t[i : i + n])] > 1:
                upto = i + n
            if i >= upto:
                kept.append(t[i])
        want.append((len(t) - len(kept), hashlib.sha256(kept).hexdigest()))
    assert want[1][0] >= 640
    rows = suffix.repeated_spans(make_docs(spark, texts)).orderBy("doc_id").collect()
    assert [(x.n_removed, x.kept_sha256) for x in rows] == want
