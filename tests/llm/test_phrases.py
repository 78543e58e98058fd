"""Phrase mining against plain counting, and the compaction of graphs against the grams themselves."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_llm import widened

import __spark_entry__
from tallyframe.llm import phrases

WORDS = ["ab", "Ab", "cd", "ef", "gh", "ij", "x", "é", "語", "\x0b", "\xa0z"]


def slow(rows, least=phrases.LEAST, first=phrases.FIRST):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found, kept = {g: n for g, n in f.items() if len(g) > 1 and n >= least}, []
        for g, a in found.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(o) > len(g) and 100 * n >= 80 * a and any(o[i : i + len(g)] == g for i in range(len(o))) for o, n in found.items()):
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, total[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def made(seed, n, size):
    r = random.Random(seed)
    return [(r.choice(["en", "en", "de", None, "und"]), "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!? "]) for _ in range(r.randrange(size)))) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 23, 90])
def test_counting_in_blocks_and_parts(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "RANKED", 40)
    passage = "one two three four five six seven"
    rows = [*made(3, 120, 60), ("fr", None), ("fr", ""), ("fr", " \t ."), ("en", " ".join([passage] * 50)), ("en", "x" * 400 + " " + passage), *[("en", passage + ".")] * 40]
    df = widened(spark.createDataFrame(rows, "lang string, text string"))
    got = phrases.collocations(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = slow(rows)
    assert sorted(map(tuple, got)) == want and any(len(x[2].split()) == 4 for x in want)
    assert phrases.collocations(df, first=3).count() == sum(x[1] <= 3 for x in want)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_hot_words_are_spread(spark, monkeypatch):
    """With all words hot, sums of nodes and pairs come in parts."""
    rows = made(9, 800, 100)
    want = slow(rows)
    monkeypatch.setattr(phrases, "hot_above", lambda every: 0)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3)).collect()
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == want


def test_paths_hold_each_gram_once():
    r = np.random.default_rng(1)
    for n, kinds in ((400, 3), (400, 60), (50, 2), (3, 2)):
        x = r.integers(0, kinds, n)
        x = np.r_[x, x[: n // 2], 0, x[n // 3 :]]
        for starts in (len(x), len(x) - 2):
            words, offsets, weight = phrases.compacted(x, starts)
            got = Counter()
            for low, high, m in zip(offsets, offsets[1:], weight, strict=False):
                for i in range(low, high - 3):
                    assert tuple(words[i : i + 4]) not in got
                    got[tuple(words[i : i + 4])] = m
            want = Counter()
            for i in range(starts):
                run = x[i : i + 4].tolist()
                run = run[: run.index(0)] if 0 in run else run
                want[tuple([*run, 0, 0, 0, 0][:4])] += bool(run)
            assert got == +want
    words, offsets, weight = phrases.compacted(np.array([1, 2, 3, 4, 5, 6, 7, 0] * 9), 72)
    assert words.tolist() == [1, 2, 3, 4, 5, 6, 7, 0, 0, 0] and weight.tolist() == [9]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["op12_phrase_graph"])
    rows = __spark_entry__.queries()["op12_phrase_graph"](spark, sf).select(want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall()) and rows
