"""The kNN join on repeated rows, large components and vectors of unequal length."""

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import knn

TOP = (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>"


def reference(rows, k=10):
    """(query_id, vector) -> ranked (vec_id, score), by whole numbers of any size."""
    data = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    out = {}
    for i, q in {(i, tuple(v)) for i, v in data if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in data if j != i)
        out.setdefault(i, []).append([(j, max(-TOP - 1, min(TOP, -s))) for s, j in scored[:k]])
    return out


def found(spark, rows):
    got = knn.top_inner_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank, r.vec_id)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_each_vector_three_times(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(260, 5)).round(2))] * 3
    want = {i: [(k + 1, *x) for k, x in enumerate(lists[0])] for i, lists in reference(rows).items()}
    assert found(spark, rows) == want


def test_two_vectors_of_one_id_ask_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0])]
    got = found(spark, rows)[0]
    assert sorted(got) == sorted((k + 1, *x) for ranked in reference(rows)[0] for k, x in enumerate(ranked))


def test_large_components(spark):
    """Squares of them and some scores pass 64 bits."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v * 10 ** r.integers(0, 8)]) for i, v in enumerate(r.normal(size=(400, 4)))]
    want = {i: [(k + 1, *x) for k, x in enumerate(lists[0])] for i, lists in reference(rows).items()}
    assert found(spark, rows) == want


def test_scores_beyond_64_bits_stop_at_the_limit(spark):
    rows = [(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [-1e9, -1e9]), (3, [1.0, 1.0]), (4, [1e300, 0.0])]
    got = {v: s for _, v, s in found(spark, rows)[0]}
    assert got == {1: TOP, 2: -TOP - 1, 3: 2 * 1024 * 1024 * 10**9, 4: TOP}


def test_vectors_of_unequal_length(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, [1.0, 1.0, 1.0, 9.0]), (3, []), (100, [2.0, 2.0])]
    want = {i: [(k + 1, *x) for k, x in enumerate(lists[0])] for i, lists in reference(rows).items()}
    assert found(spark, rows) == want


def test_small_cells_share_groups():
    pivots = np.arange(12.0).reshape(6, 2)
    got = knn.packed({0: 3, 1: 3, 2: 3, 4: 25, 5: 1}, pivots, 10)
    assert got[0][0] == got[1][0] == got[2][0] and got[4][1] == 3
    used = [g + i for g, p in {got[c] for c in got} for i in range(p)]
    assert len(used) == len(set(used))


def test_many_chunks_of_clustered_vectors(spark, monkeypatch):
    """Chunks of 128 rows: cells share one or fill several, and most queries reach some of them only."""
    monkeypatch.setattr(knn, "CHUNK", 1)
    monkeypatch.setattr(knn, "GROUP", 1)
    r = np.random.default_rng(10)
    centres = r.normal(size=(6, 3)) * 40
    rows = [(i, [float(x) for x in centres[0 if i % 3 else i % 6] + r.normal(size=3)]) for i in range(3_000)]
    want = {i: [(k + 1, *x) for k, x in enumerate(lists[0])] for i, lists in reference(rows).items()}
    assert found(spark, rows) == want


def test_every_row_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(knn, "CHUNK", 1)
    rows = [(i, [0.5, -0.5]) for i in range(700)]
    want = {i: [(k + 1, *x) for k, x in enumerate(lists[0])] for i, lists in reference(rows).items()}
    assert found(spark, rows) == want
