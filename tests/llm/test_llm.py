"""Operators of the llm part against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import decontam, knn, lines, mixing, quality, secrets, sharding, simhash, suffix, warc
from tallyframe.llm._graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "id string, key int, score string, h int, size int, _bytes0 int, _drop int, class int"
WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "th")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def make_docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def widened(df):
    """With further columns whose names operators might use themselves."""
    return df.selectExpr("*", *(f"cast(null as {kind}) `{name}`" for name, kind in (x.split() for x in EXTRA.split(", "))))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 120) for i in range(12)]
    near = base[0].split()
    near[60] = "changed"
    return [*base, base[1], base[1], " ".join(near), None, "", "   \n\t", prose(99, 20_000), "one two", "One TWO", base[2][:500] + base[3][:500]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make_docs(spark, texts)


# --- 1 ---------------------------------------------------------------------------------------------------------


def test_knn_is_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(700, 6)).round(2))]
    vectors += [(700 + i, vectors[0][1]) for i in range(30)]  # ties
    bad = [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (None, [1.0] * 6), (1300, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([*vectors, *bad], "vec_id long, embedding array<float>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in knn.top_inner_products(df, F.col("vec_id") % 100 == 0).collect()}
    ids = np.array([i for i, _ in vectors])
    q = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64)
    want = {}
    for i in ids[ids % 100 == 0]:
        score = q @ q[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:10]
        want |= {(i, k + 1): (ids[j], score[j]) for k, j in enumerate(order)}
    assert got == want


def test_knn_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>, id int, v string"
    assert knn.top_inner_products(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [0.5, 0.0], 1, "x"), (2, [-1.0, 0.0], 1, "x")], schema)
    assert [(r.rank, r.vec_id, r.score) for r in knn.top_inner_products(three, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(1, 1, 1024 * 512), (2, 2, -1024 * 1024)]


# --- 2 ---------------------------------------------------------------------------------------------------------


def substring_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_is_brute_force(spark):
    items = [prose(1000 + i, 12) for i in range(6)]
    r = random.Random(5)
    texts = [prose(i, 40) for i in range(20)] + [None, "", "short"]
    for i in range(20):
        passage = list(items[i % 6])
        for _ in range(r.randrange(0, 12)):
            passage[r.randrange(len(passage))] = r.choice("abcxyz")
        texts.append(prose(i + 50, 10) + " " + "".join(passage).upper() + "\n" + prose(i + 80, 5))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "tiny")], "item_id long, text string")
    found = decontam.contamination(widened(make_docs(spark, texts)), bench)
    got = {(x.doc_id, x.item_id): x.edits for x in found.collect()}
    norm = lambda t: re.sub(r"\s+", " ", (t or "").lower())
    want = {}
    for (d, t), (k, item) in itertools.product(enumerate(texts), enumerate(items)):
        e = substring_edits(item, norm(t))
        if e <= min(int(len(item) * 0.1), (len(item) - 8) // 8):
            want[d, k] = e
    assert got == want
    kept = {x.doc_id for x in decontam.keep_clean(widened(make_docs(spark, texts)), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_of_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, bench).count() == 0
    assert decontam.keep_clean(docs, bench).count() == docs.count()
    full = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontam.contamination(docs.limit(0), full).count() == 0


def test_item_blocks_find_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 15)) for i in range(9)], "item_id long, text string")
    whole = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "ITEM_BYTES", 100)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == whole
    assert {x[0] for x in whole} >= set(range(9))


def test_long_texts_are_scanned_in_parts(spark, monkeypatch):
    items = [prose(i + 40, 12) for i in range(3)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    index = next(decontam.item_indexes(bench))
    wide = (" " * 170).join(items[1].split())  # its white space is longer than a part
    text = " ".join([prose(1, 300), items[0], prose(2, 200), wide, "\n" * 400, items[2], prose(3, 10)]).encode()
    data, edge = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = sorted(decontam._scan(index, edge, data))
    monkeypatch.setattr(decontam, "PIECE", 150)
    monkeypatch.setattr(decontam, "BLOCK", 100)
    assert sorted(decontam._scan(index, edge, data)) == whole
    assert [(k, e) for _, k, e, *_ in whole] == [(0, 0), (1, 0), (2, 0)]
    for size in (151, 163, 333, 2_000):
        monkeypatch.setattr(decontam, "PIECE", size)
        assert sorted(decontam._scan(index, edge, data)) == whole


# --- 3 ---------------------------------------------------------------------------------------------------------


def water(sizes, weights, share=1.5, most=2.0):
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        level = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if level[s] > most * sizes[s]]
        if not over:
            return fixed | level
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_targets_and_copies(spark):
    sources = [["a", "b", None, "", "é", "z"][i * i % 6] for i in range(300)]
    texts = [prose(i, 1 + i % 40) if i % 17 else None for i in range(300)]
    df = widened(make_docs(spark, texts, sources))
    rows = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 25  # half of the longest document, and rounding
    many = mixing.mixed(df).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r.copies for r in rows if r.copies}
    assert {r.doc_id: r["count"] for r in many} == copies
    assert mixing.mixed(df).columns == df.columns


def test_mix_prefers_larger_values_and_takes_empty_tables(spark):
    df = make_docs(spark, [prose(i, 20) for i in range(400)], ["a"] * 200 + ["b"] * 200)
    rows = mixing.mix(df, value=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0), share=0.5, weight=F.lit(1.0)).collect()
    assert sum(r.copies for r in rows if r.doc_id % 2 == 0) > 1.5 * sum(r.copies for r in rows if r.doc_id % 2)
    assert sum(r.taken for r in rows) == pytest.approx(4000, abs=25)
    few = mixing.mix(df, value=F.when(F.col("doc_id") % 50 == 0, 100.0).otherwise(1.0), share=0.5, weight=F.lit(1.0)).collect()
    assert all(r.copies == 2 for r in few if r.doc_id % 50 == 0)  # held at the most, and the others take what that leaves
    assert sum(r.taken for r in few) == pytest.approx(4000, abs=25)
    nameless = mixing.mix(df.selectExpr("cast(null as long) doc_id", "text", "source"), share=0.5, weight=F.lit(1.0)).collect()
    assert sum(r.taken for r in nameless) == pytest.approx(4000, abs=25)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed(df.limit(0)).count() == 0
    one = mixing.mix(make_docs(spark, [None, ""], ["a", None])).collect()
    assert [r.taken for r in one] == [0, 0]


# --- 4 ---------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def line_reference(texts, t):
    every = [(d, p, x.strip(" \t\r")) for d, text in enumerate(texts) for p, x in enumerate((text or "").split("\n"))]
    every = [x for x in every if x[2]]
    distinct = sorted({x for _, _, x in every})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        most = min(t, min(len(a), len(b)) // 12)
        if abs(len(a) - len(b)) <= most and edits(a, b) <= most:
            root[find(a)] = find(b)
    first, out = {}, {}
    for d, p, x in every:
        first.setdefault(find(x), (d, p, x))
    for d in range(len(texts)):
        own = [(p, x) for e, p, x in every if e == d]
        gone = [(p, x) for p, x in own if first[find(x)][:2] != (d, p)]
        out[d] = (len(own), len(gone), sum(first[find(x)][2] != x for _, x in gone))
    return out


def test_lines_are_brute_force(spark):
    r = random.Random(11)
    base = [prose(i, 6) for i in range(14)] + [prose(i, 3) + " x" for i in range(6)] + [prose(40 + i, 5)[: 22 + i] for i in range(5)] + ["c" * 40, "c" * 41, "Copyright 2023 Acme", "éàü " + prose(77, 5), "x", "ab"]
    texts = [None, "", "\n \n"]
    for _ in range(40):
        chosen = []
        for _ in range(5):
            x = list(r.choice(base))
            for _ in range(r.randrange(0, 4)):
                k, p = r.randrange(3), r.randrange(len(x))
                if k == 0:
                    x[p] = r.choice("qé")
                elif k == 1:
                    x.insert(p, "q")
                elif len(x) > 1:
                    del x[p]
            chosen.append(r.choice(["", " ", "\t"]) + "".join(x))
        texts.append("\n".join(chosen))
    df = widened(make_docs(spark, texts))
    got = {x.doc_id: (x.n_lines, x.n_removed, x.n_near) for x in lines.deduplicate(df).collect()}
    assert got == line_reference(texts, 2)
    kept = lines.without_duplicate_lines(df).orderBy("doc_id").collect()
    assert kept[0].text is None and kept[1].text == ""
    for row in kept:
        n, gone, _ = got[row.doc_id]
        assert len([x for x in (row.text or "").split("\n") if x.strip()]) == n - gone
    assert lines.deduplicate(df.limit(0)).count() == 0


def test_probes_reach_every_edit(spark):
    r = random.Random(2)
    pairs = []
    for i in range(60):
        a = "".join(r.choice("abcd") for _ in range(r.randrange(24, 40)))
        b = list(a)
        for _ in range(2):
            k, p = r.randrange(3), r.randrange(len(b))
            b[p : p + (k != 1)] = [] if k == 2 else [r.choice("wxyz")]
        pairs += [(f"{2 * i:04}", a), (f"{2 * i + 1:04}", "".join(b))]
    df = spark.createDataFrame(pairs, "h string, line string")
    got = {(x.a, x.b) for x in lines.similar_lines(df).collect()}
    near = [(pairs[2 * i], pairs[2 * i + 1]) for i in range(60)]
    assert {(a, b) for (a, x), (b, y) in near if x != y and min(len(x), len(y)) >= 24} <= got


@pytest.mark.parametrize("most", [1, 2, 4])
def test_banded_distance_is_the_edit_distance(spark, most):
    r = random.Random(most)
    rows = [("a", "b"), ("ab", "ba"), ("é\U0001f600x", "éx\U0001f600"), ("a" * 70, "a" * 69 + "b"), ("x" * 20_000, "y" + "x" * 19_999)]
    for _ in range(400):
        a = "".join(r.choice("abé") for _ in range(r.randrange(1, 90)))
        b = list(a)
        for _ in range(r.randrange(0, 2 * most + 1)):
            k, p = r.randrange(3), r.randrange(len(b) + 1)
            b[p : p + (k != 1)] = [] if k == 2 else [r.choice("abé\u4e2d")]
        if abs(len(a) - len(b)) <= most and b:
            rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    for x in got:
        want = edits(x.a, x.b) if len(x.a) < 1_000 else 1
        assert (x.d == want) if want <= most else (x.d > most)


def test_lines_of_repeated_rows_and_texts_of_one_id(spark):
    a, b = prose(1, 6), prose(2, 6)
    rows = [(1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (1, f"{b}\nshort"), (None, f"{a}x\n"), (None, None), (2, "xyz" * 10_000), (3, "xyz" * 9_999 + "xyy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_near) for r in lines.deduplicate(df).collect()}
    assert got[None] == (1, 1, 1) and got[2] == (1, 0, 0) and got[3] == (1, 1, 1)
    assert got[1][0] == 6 and got[1][1] in (1, 2)  # b stays in the text whose hash is less, which is there once or twice
    texts = [r.text for r in lines.without_duplicate_lines(df).collect()]
    assert len(texts) == 7 and any(a in (t or "") for t in texts) and any(b in (t or "") for t in texts)


def test_one_very_common_line_gives_keys_once(spark):
    line = prose(3, 8)
    df = make_docs(spark, [f"{line}\n{prose(i, 7)}" for i in range(400)])
    every = lines.document_lines(df, "doc_id", "text")
    distinct = every.where("line is not null").select("h", "line").distinct()
    assert lines.line_keys(distinct, 2).where(F.col("h") == F.unhex(F.md5(F.lit(line).cast("binary")))).count() <= len(lines.segment_specs(2))
    assert sum(r.n_removed for r in lines.deduplicate(df).collect()) == 399


# --- 5 ---------------------------------------------------------------------------------------------------------


def secret_texts(n):
    r = random.Random(4)
    out = []
    for i in range(n):
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        kind = i % 5
        put = f'token = "{key}"' if kind == 0 else "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) if kind == 1 else "".join(r.choice(WORDS) for _ in range(5)) if kind == 2 else str(r.randrange(10**15, 10**16)) if kind == 3 else ""
        out.append(f"{prose(i, 30)} {put} {prose(i + 9999, 10)}")
    return out


def test_secrets_are_told_from_words_on_held_out_ids(spark):
    texts = [*secret_texts(600), None, ""]
    found = secrets.scan(widened(make_docs(spark, texts))).collect()
    for x in found:
        assert texts[x.doc_id][x.begin : x.end] == x.secret
    held = [x for x in found if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    right = [x.is_secret == (x.doc_id % 5 < 2) for x in held]
    assert len(held) > 50 and np.mean(right) > 0.97
    want = sum(len(secrets.CANDIDATE.findall(t or "")) for t in texts)
    assert len(found) == want


def test_secrets_without_findings_and_with_labels(spark):
    df = make_docs(spark, ["nothing here", None])
    assert secrets.scan(df).count() == 0
    assert secrets.scan(df.limit(0)).count() == 0
    own = spark.createDataFrame([("abcdefghijklmnop12", 1)], "secret string, label int")
    got = secrets.scan(make_docs(spark, ["x abcdefghijklmnop12 y"] * 3), own).collect()
    assert [r.is_secret for r in got] == [True] * 3


def test_forest_of_planted_findings_holds_on_ids_not_learnt_from(spark):
    """Precision and recall of planted keys among planted look-alikes, and the texts' own findings."""
    docs = make_docs(spark, [*secret_texts(900), None, ""])
    words = secrets.dictionary(docs, "text")
    found = secrets.with_coverage(secrets.planted_findings(docs), words).persist()
    forest = secrets.forest_of(found.where(secrets.learnt_from()).select("id", "begin", "features", "label"), 20_000)
    rows = secrets.scored(found.where(~secrets.learnt_from()), forest).select("label", "score").collect()
    right = sum(r.label == 1 and r.score >= 0.5 for r in rows)
    keys, named = sum(r.label for r in rows), sum(r.score >= 0.5 for r in rows)
    assert keys > 100 and len(rows) - keys > 80
    assert right / keys >= 0.9 and right / named >= 0.9
    made = secrets.planted(docs, "doc_id", "text", "source", 20_000).where("label = 1").collect()
    assert sum(bool(secrets.CANDIDATE.search(r.plant)) for r in made) >= 0.99 * len(made)  # but for short ones of letters alone
    assert {(r.id, r.plant) for r in made} == {(r.id, r.plant) for r in secrets.planted(docs.repartition(3), "doc_id", "text", "source", 20_000).where("label = 1").collect()}


def test_secrets_of_repeated_rows_and_very_long_texts(spark):
    key = "0123456789abcdef" * 2 + "01234567"
    rows = [(1, f'token = "{key}"', "a"), (1, f'token = "{key}"', "a"), (None, f"x {key}", None), (2, "a1" * 200_000, "b"), (3, prose(1, 60_000) + " " + key, "b"), (4, None, None), (5, "p@ssw0rd! abc", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = spark.createDataFrame([(key, 1), (key, 0), ("a1" * 200_000, 0), (None, 1)], "secret string, label int")
    got = [(r.doc_id, r.secret == key, r.is_secret) for r in secrets.scan(df, mixed).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, True, True), (1, True, True), (None, True, True), (2, False, False), (3, True, True), (5, False, got[[g[0] for g in got].index(5)][2])]))
    assert secrets.scan(df).count() == 6


# --- 6 ---------------------------------------------------------------------------------------------------------


def simhash_reference(texts, distance=4):
    fps = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", find(i)) for i in range(len(fps))}


def test_simhash_is_brute_force(spark, texts):
    df = widened(make_docs(spark, texts))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = simhash_reference(texts)
    assert got == want
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == {c for _, c in want.values()}
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprints_of_pieces_are_those_of_the_whole(monkeypatch):
    texts = [prose(4, 500).encode(), b"a b c", b"a b c d", b" ", b""]
    whole = [simhash.fingerprint(t, 4) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert [simhash.fingerprint(t, 4) for t in texts] == whole


@pytest.mark.parametrize("cell", [20_000, 40])
def test_links_join_all_that_lie_near(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(8)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(6):
            for b in r.sample(range(64), r.randrange(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df)).collect()}
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    for a, b in itertools.combinations(fps, 2):
        same = roots.get(sign(a), sign(a)) == roots.get(sign(b), sign(b))
        assert same == (find(a) == find(b))


def test_routes_miss_no_pair():
    r = random.Random(1)
    for n in (10, 10**7, 10**9, 10**12):
        masks = simhash.routes(n, 4)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_everything(spark):
    good = [prose(i, 60).capitalize() + "." for i in range(300)]
    bad = [" | ".join(prose(i, 40).upper().split()) for i in range(300)]
    texts = [x for p in zip(good, bad, strict=True) for x in p] + [None, "", prose(5, 30_000)]
    df = widened(make_docs(spark, texts))
    marks = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(600)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(df, marks).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 2 == 0) for r in held]) > 0.98
    kept = quality.keep_good(df, marks)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_quality_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(docs.limit(0), some).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [prose(i, 30).encode() for i in range(5)] + [b"", b"  ", "é à".encode()]
    alone = [tuple(sorted(quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1])) for t in texts]
    edge = np.r_[0, np.cumsum([len(t) for t in texts])]
    doc, at = quality.features(np.frombuffer(b"".join(texts), np.uint8), edge)
    assert [tuple(sorted(at[doc == i])) for i in range(len(texts))] == alone


def test_features_of_parts_are_those_of_the_whole(monkeypatch):
    r = random.Random(3)
    texts = [prose(6, 400), "one", "", " a  b\t", " ".join(r.choice(["a", "b", "C1", "d"]) for _ in range(600)), "x" * 290 + " y z"]
    for text in (t.encode() for t in texts):
        data, edge = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        whole = np.sort(quality.features(data, edge)[1])
        with monkeypatch.context() as m:
            m.setattr(quality, "BLOCK", 10)
            m.setattr(quality, "PIECE", 300)
            assert len(text) <= 300 or len(list(quality._parts(data, edge))) > 3
            parts = [at for *_, at in quality._features(data, edge, quality.BITS)]
            assert np.array_equal(np.sort(np.concatenate(parts)) if parts else np.zeros(0), whole)
            got = list(quality._examples(data, edge, quality.BITS))
        want = list(quality._examples(data, edge, quality.BITS))
        assert len(got) == len(want) == 1 and all(np.array_equal(a, b) for a, b in zip(got[0], want[0], strict=True))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_words_longer_than_a_part_are_one_word(monkeypatch, size):
    r = random.Random(size)
    texts = ["".join(r.choice("aaAB1 .\n-é") for _ in range(r.randrange(1, 90))) for _ in range(150)] + ["x" * 500, "aB" * 200 + " y", " " * 70 + "z" * 70]
    for text in (t.encode() for t in texts):
        data, edge = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        whole = np.sort(quality.features(data, edge)[1])
        with monkeypatch.context() as m:
            m.setattr(quality, "BLOCK", 1)
            m.setattr(quality, "PIECE", size)
            assert np.array_equal(np.sort(np.concatenate([at for *_, at in quality._features(data, edge, quality.BITS)])), whole)


def test_features_are_the_slow_ones():
    """Word and shape n-grams by a plain loop name the same coordinates."""
    text = "To be, or not  to be: To be 42 42 ABc-d abc"
    words = text.split()
    data = text.encode()
    _, at = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    pairs = list(itertools.pairwise(words))
    runs = lambda w: tuple(k for k, _ in itertools.groupby("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in w))
    shapes = [(runs(w), i > 0 and words[i - 1] == w, i > 0 and pairs[i - 1] in pairs[: i - 1]) for i, w in enumerate(words)]
    want = [*words, *pairs, *shapes, *itertools.pairwise(shapes), *zip(shapes, shapes[1:], shapes[2:], strict=False)]
    begin = np.cumsum([0, len(words), len(pairs), len(shapes), len(shapes) - 1, len(shapes) - 2])
    assert len(at) == len(want)
    for low, high in itertools.pairwise(begin.tolist()):  # in each kind of feature, equal where the slow ones are equal
        for i, j in itertools.combinations(range(low, high), 2):
            assert (at[i] == at[j]) == (want[i] == want[j])


def test_updates_are_the_slow_ones():
    r = np.random.default_rng(4)
    bits, alpha, beta, l1, l2 = 4, 0.1, 1.0, 0.02, 1.0
    fast = quality.Ftrl(np.zeros(17), np.zeros(17))
    z, n = [0.0] * 17, [0.0] * 17
    slow = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(300):
        at = np.sort(r.choice(1 << bits, 5, replace=False))
        x, y = r.random(5), float(r.random() < 0.5)
        fast.learn(at, x, y)
        row = [*zip(at.tolist(), x.tolist(), strict=True), (16, 1.0)]
        old = {i: slow(i) for i, _ in row}
        p = 1 / (1 + np.exp(-sum(old[i] * v for i, v in row)))
        for i, v in row:
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * old[i]
            n[i] += g * g
    assert np.allclose(fast.weights(), [slow(i) for i in range(17)])


# --- 8 ---------------------------------------------------------------------------------------------------------

RECORD = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>"


def test_revisits(spark):
    rows = [
        (1, "HTTP://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 10, "response", 200, '"v1"', None, {"Content-Type": "text/html", "Date": "old"}),
        (2, "https://a.com/x?a=1&b=2", 20, "revisit", 304, 'W/"v1"', None, {"date": "new", "Content-Type": "evil", "Vary": "Accept"}),
        (3, "https://a.com/x?a=1&b=2", 30, "response", 500, '"v2"', None, None),
        (4, "https://a.com/x?a=1&b=2", 40, "revisit", 304, '"v2"', None, None),
        (5, "https://a.com/y", 40, "revisit", 304, None, None, None),
        (6, "https://b.com", 5, "response", 200, None, "mon", None),
        (7, "https://b.com/", 6, "revisit", 304, '"z"', "mon", None),
        (8, "https://b.com/", 5, "revisit", 304, None, "mon", None),
        (9, None, 6, "revisit", 304, None, None, None),
        (10, "https://b.com/", 900, "revisit", 304, None, "tue", None),
        (11, "https://b.com/", 901, "revisit", 304, None, None, None),
        (11, "https://b.com/", 901, "revisit", 304, None, None, None),
    ]
    got = sorted((r.record_id, r.original_id, r.state, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect() if r.record_id != 11)
    assert got == [
        (2, 1, "resolved", {"content-type": "text/html", "date": "new", "vary": "Accept"}),
        (4, 1, "mismatch", None),
        (5, None, "no original", None),
        (7, 6, "resolved", {}),
        (8, None, "no original", None),
        (9, None, "no original", None),
        (10, 6, "mismatch", None),
    ]
    assert warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).where("record_id = 11 and state = 'unchecked'").count() == 2
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


@pytest.mark.parametrize("outlier", [0, 10**15])
def test_revisits_are_brute_force(spark, outlier):
    r = random.Random(6)
    rows = [(i, f"http://h{r.randrange(3) * r.randrange(2)}.org/p", r.randrange(300), r.choice(["response", "revisit"]), r.choice([200, 200, 404]), r.choice(['"a"', '"b"', None]), None, None) for i in range(500)]
    rows += [(900, "http://h0.org/p", outlier, "revisit", 304, None, None, None), (901, "http://h0.org/p", -outlier, "response", 200, None, None, None)]
    got = {x.record_id: (x.original_id, x.state) for x in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    want = {}
    for i, url, ts, kind, _, tag, *_ in rows:
        if kind == "revisit":
            before = [x for x in rows if x[1] == url and x[3] == "response" and x[4] == 200 and x[2] < ts]
            o = max(before, key=lambda x: (x[2], x[0]), default=None)
            want[i] = (None, "no original") if o is None else (o[0], "unchecked" if not (tag and o[5]) else "resolved" if tag == o[5] else "mismatch")
    assert got == want


# --- 9 ---------------------------------------------------------------------------------------------------------


def test_shards_keep_every_row_and_merge_by_tiers(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file:{tmp_path}/store", target=40_000)
    df = widened(make_docs(spark, [prose(i, 150) for i in range(300)] + [None, ""] + [prose(1, 150)] * 3))
    for part in range(3):
        store.append(df.where(F.col("doc_id") % 3 == part).repartition(6))
    before = store.manifest()
    assert (store.version(), before.count()) == (3, 18)
    assert store.compact() > 3
    after = store.manifest()
    assert after.count() < 18
    assert {r["added"] for r in before.collect()} == {1, 2, 3}
    key = lambda d: sorted(map(str, d.collect()))
    assert key(store.read().select(df.columns)) == key(df)
    assert key(store.read(3).select(df.columns)) == key(df)  # an older version still reads the same
    assert all(r.bytes <= 2.5 * 40_000 for r in after.collect())
    with pytest.raises(sharding.Conflict):
        store.commit(after, 1)
    assert store.manifest().count() == after.count()
    assert store.vacuum() == []  # all of it is too young
    assert len(store.vacuum(grace=-60)) >= 3
    assert key(store.read().select(df.columns)) == key(df)


def test_sharding_names_the_shard_of_each_row(spark, tmp_path, docs):
    got = sharding.shard(docs.repartition(5), f"file:{tmp_path}/s")
    assert got.count() == docs.count()
    assert got.groupBy("shard", "shard_rows").count().where("count <> shard_rows").count() == 0
    assert sharding.shard(docs.limit(0), f"file:{tmp_path}/empty").count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------


def suffix_reference(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    out = []
    for t in raw:
        mark = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        kept = bytes(x for x, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1_000, 3])
def test_repeats_are_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    shared = [prose(i + 500, 30) for i in range(4)]
    r = random.Random(9)
    texts = [None, "", "é" * 300, "ab" * 200, "x" * 59, "x" * 60]
    for i in range(40):
        parts = [prose(i, 12), r.choice(shared), prose(i + 100, 8), r.choice(shared)[: r.randrange(50, 160)]]
        texts.append(" ".join(parts))
    texts += [texts[10], texts[11], texts[11], prose(3, 3000) + shared[0] + prose(3, 3000)]
    df = widened(make_docs(spark, texts))
    rows = suffix.repeated_spans(df, length=60, gram=20).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows] == suffix_reference(texts, 60)
    for x in rows:
        assert sum(b - a for a, b in x.spans) == x.n_removed
    assert suffix.repeated_spans(df.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 700)
    monkeypatch.setattr(suffix, "BLOCK", 500)
    long = prose(1, 900)
    texts = [long + prose(2, 300), prose(4, 400) + long[1000:3000], prose(5, 20)]
    rows = suffix.repeated_spans(make_docs(spark, texts), length=60, gram=20).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows] == suffix_reference(texts, 60)


# --- all -------------------------------------------------------------------------------------------------------


def test_rows_with_nulls_in_every_column(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, prose(1, 60), None, None, None), (1, prose(1, 60), "en", "a", 3), (1, prose(1, 60), "en", "a", 3), (2, None, "en", None, None), (3, prose(2, 60), None, "b", None)]
    df = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(None, prose(2, 20)), (5, None)], "item_id long, text string")
    marks = spark.createDataFrame([(None, None), (1, 1), (3, 0)], "doc_id long, quality int")
    assert [(r.doc_id, r.item_id) for r in decontam.contamination(df, bench).collect()] == [(3, None)]
    assert decontam.keep_clean(df, bench).count() == 5
    assert sorted(r.size for r in mixing.mix(df).collect()) == [0, 0, 60, 60, 60, 60]
    assert sum(r.n_lines for r in lines.deduplicate(df).collect()) == 4
    assert secrets.scan(df).count() == 0
    assert simhash.near_duplicates(df).count() == 6
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["1", "2", "3", "None", "None"]
    assert quality.classify(df, marks).count() == 6
    assert sharding.shard(df, f"file:{tmp_path}/nulls").count() == 6
    assert [r.n_removed for r in suffix.repeated_spans(df, length=60, gram=20).where("doc_id = 1").collect()] == [len(prose(1, 60))] * 2
