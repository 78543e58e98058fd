"""Boosted trees against a slow version that holds all rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyframe.operators import boosting
from tallyframe.operators.boosting import Point


def slow(x, y, learn, stop, p, rounds):
    """Margins of all rows, losses on ``stop`` rows and the splits of each tree, node by node."""
    w = np.where(y > 0, (y[learn] == 0).sum() / y[learn].sum() if p.balanced else 1.0, 1.0)
    margin = np.full(len(y), np.log((w * y)[learn].sum() / (1 - y)[learn].sum()))
    shrink = lambda g: np.sign(g) * max(abs(g) - p.reg_alpha, 0)
    losses, trees = [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        losses.append(-np.where(y > 0, np.log(prob), np.log(1 - prob))[stop].mean())
        g, h = (prob - y) * w, prob * (1 - prob) * w
        splits, step = [], np.zeros(len(y))

        def visit(rows, depth):
            inside = rows[learn[rows]]
            best = (max(p.gamma, 1e-6), None)
            value = lambda at: shrink(g[at].sum()) ** 2 / (h[at].sum() + p.reg_lambda)
            for f in range(x.shape[1]) if depth < p.max_depth else ():
                for c in np.unique(x[inside, f])[:-1]:
                    left, right = inside[x[inside, f] <= c], inside[x[inside, f] > c]
                    if min(h[left].sum(), h[right].sum()) >= p.min_child_weight and min(len(left), len(right)) >= max(p.min_rows, 1):
                        gain = value(left) + value(right) - value(inside)
                        if gain > best[0] + 1e-9 * max(1, best[0]):
                            best = (gain, (f, c))
            if best[1] is None:
                step[rows] = -p.rate * shrink(g[inside].sum()) / (h[inside].sum() + p.reg_lambda)
                return
            f, c = best[1]
            splits.append((f, float(c)))
            visit(rows[x[rows, f] <= c], depth + 1)
            visit(rows[x[rows, f] > c], depth + 1)

        visit(np.arange(len(y)), 0)
        trees.append(sorted(splits))
        margin = margin + step
    return margin, losses, trees


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(11)
    x = np.stack([r.integers(0, 12, 400), r.integers(0, 5, 400), r.integers(0, 2, 400)], axis=1).astype(float)
    y = ((x[:, 0] > 6) ^ (x[:, 1] > 2) | (r.random(400) < 0.1)).astype(float)
    return x, y, r.integers(0, 2, 400)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    df = spark.createDataFrame([(int(i), float(b), int(f), Vectors.dense(a)) for i, (a, b, f) in enumerate(zip(x, y, fold, strict=True))], ["key", "label", "fold", "features"]).withColumn("fold", F.col("fold").cast("int")).repartition(3)
    cuts = boosting.cut_points(df, "features", 3)
    return boosting.binned(df, "features", cuts, ["key", "label", "fold"]), cuts


POINTS = [
    Point(max_depth=2, rate=0.3, min_child_weight=1.0, subsample=1.0, colsample=1.0, rounds=12, held=1),
    Point(max_depth=3, rate=0.2, min_child_weight=3.0, gamma=2.0, reg_lambda=5.0, reg_alpha=0.4, subsample=1.0, colsample=1.0, rounds=12, held=1),
    Point(max_depth=3, rate=0.1, min_child_weight=0.0, min_rows=30, reg_lambda=0.0, subsample=1.0, colsample=1.0, rounds=12, held=0, balanced=False),
]


def test_splits_losses_and_scores_are_the_slow_ones(monkeypatch, rows, data):
    monkeypatch.setattr(boosting, "WRITE", 5)  # margins are written in between
    (table, cuts), (x, y, fold) = rows, data
    models = boosting.grow(table, [Point(**{**p.__dict__, "best": False}) for p in POINTS], cuts)
    got = boosting.scores(table, models, ["key"]).collect()
    for i, (p, m) in enumerate(zip(POINTS, models, strict=True)):
        margin, losses, trees = slow(x, y, fold != p.held, fold == p.held, p, p.rounds)
        assert m.losses[: p.rounds] == pytest.approx(losses) and len(m.trees) == p.rounds
        for tree, want in zip(m.trees, trees, strict=True):
            assert sorted((int(f), float(cuts[f][c])) for f, c in zip(tree.feature, tree.cut, strict=True) if f >= 0) == want
        scored = {r.key: r.predicted_probability for r in got if r.point == i}
        assert [scored[k] for k in range(len(y))] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_stops_where_the_loss_no_longer_falls(rows):
    table, cuts = rows
    noise = table.withColumn("label", F.pmod(F.xxhash64("key"), F.lit(2)).cast("double"))
    model = boosting.grow(noise, [Point(max_depth=2, rate=0.5, min_child_weight=0.0, rounds=60, patience=4, held=1)], cuts)[0]
    best = int(np.argmin(model.losses))
    assert len(model.losses) == best + 5 < 60 and len(model.trees) == best


def test_first_rounds_are_those_of_a_shorter_fit(rows):
    table, cuts = rows
    points = [Point(max_depth=2, rounds=n, subsample=0.7, colsample=0.7, min_child_weight=0.0, best=False, held=1) for n in (3, 9)]
    short, long = boosting.grow(table, points, cuts)
    assert [t.value.tolist() for t in short.trees] == [t.value.tolist() for t in long.trees[:3]] and len(long.trees) == 9


def test_samples_rows_and_columns(rows):
    u = boosting.uniforms(np.arange(20_000), 3)
    assert abs((u < 0.8).mean() - 0.8) < 0.02 and abs(np.corrcoef(u, boosting.uniforms(np.arange(20_000), 4))[0, 1]) < 0.03
    table, cuts = rows
    model = boosting.grow(table, [Point(max_depth=1, rounds=8, colsample=0.34, min_child_weight=0.0, best=False, held=1)], cuts)[0]
    assert len({int(t.feature[0]) for t in model.trees}) > 1


def test_nothing_to_learn(rows):
    table, cuts = rows
    one_class = boosting.grow(table.withColumn("label", F.lit(0.0)), [Point(rounds=3, patience=2, held=1)], cuts)[0]
    assert all((t.feature < 0).all() for t in one_class.trees)
    assert boosting.grow(table.limit(0), [Point(rounds=3)], cuts)[0].trees == []


def test_trees_send_rows_where_a_walk_does():
    r = np.random.default_rng(3)
    columns = r.integers(0, 64, (5, 500)).astype(np.uint8)
    for depth in (1, 3, 8):
        tree = boosting.Tree.of(depth)
        inner = (1 << depth) - 1
        tree.feature[:inner] = r.integers(-1, 5, inner)
        tree.cut[:inner] = r.integers(0, 63, inner)
        tree.value[:] = r.normal(size=len(tree.value))
        want = []
        for row in columns.T:
            node = 0
            while tree.feature[node] >= 0:
                node = 2 * node + 1 + int(row[tree.feature[node]] > tree.cut[node])
            want.append(node)
        assert tree.leaves(columns).tolist() == want and tree.values(columns).tolist() == tree.value[want].tolist()


def test_only_features_that_may_split_are_counted():
    r = np.random.default_rng(3)
    columns, offsets = r.integers(0, 4, (6, 200)).astype(np.uint8), np.arange(7) * 4
    seen = {"key": np.arange(200), "draws": {}, "label": np.ones(200), "columns": columns, "learn": np.ones(200, bool), "stop": np.zeros(200, bool), "weight": np.ones(200), "margin": np.zeros(200)}
    model = boosting.Model(boosting.Point(subsample=1.1))
    sums = boosting._histograms(0, 0, {0: boosting.Tree.of(2)}, offsets, {0: np.array([2, 4])})(0, model, seen)[:-2].reshape(3, 24)
    for f in range(6):
        counts = sums[2, f * 4 : f * 4 + 4]
        assert counts.tolist() == (np.bincount(columns[f], minlength=4).tolist() if f in (0, 2, 4) else [0] * 4)


def test_features_counted_together_and_siblings_left_over_are_the_plain_sums():
    r = np.random.default_rng(5)
    sizes = [51, 3, 2, 7, 4, 60]
    offsets, n = np.r_[0, np.cumsum(sizes)], 700
    columns = np.stack([r.integers(0, k, n) for k in sizes]).astype(np.uint8)
    seen = lambda: {"key": np.arange(n), "draws": {}, "label": (np.arange(n) % 3 == 0) * 1.0, "columns": columns, "learn": np.arange(n) % 7 > 0, "stop": np.arange(n) % 7 == 0, "weight": np.ones(n), "margin": np.linspace(-1, 1, n)}
    tree, model, features = boosting.Tree.of(2), boosting.Model(Point(max_depth=2, subsample=0.8)), np.array([0, 2, 3, 5])
    groups = boosting._together(sizes)
    assert sorted(f for g in groups for f in g) == list(range(6)) and len(groups) == 3
    above = counted = None
    for level in (0, 1):
        nodes = 1 << level
        plain = boosting._histograms(level, 0, {0: tree}, offsets, {0: features})(0, model, seen())
        joint = boosting._finished(nodes, groups, offsets)(boosting._histograms(level, 0, {0: tree}, offsets, {0: features}, groups, counted and {0: counted[0]})(0, model, seen()))
        want, got = (x[: 3 * nodes * offsets[-1]].reshape(3, nodes, -1).transpose(1, 0, 2).copy() for x in (plain, joint))
        if level:
            assert got[~counted[0]].sum() == 0 < want[~counted[0], 2].sum()
            got = boosting._with_siblings(got, above, counted[0])
        else:
            assert joint[-2:].tolist() == plain[-2:].tolist()
        for f in features:
            assert got[:, :, offsets[f] : offsets[f + 1]] == pytest.approx(want[:, :, offsets[f] : offsets[f + 1]], abs=1e-9)
        tree.feature[0], tree.cut[0] = 3, 1
        above, counted = got, {0: boosting._lighter(tree, 0, got, offsets)} if level == 0 else None
        assert level or counted[0].tolist() == [True, False]  # 2 of 7 bins lie to the left


def test_points_of_one_kind_are_counted_as_one_until_their_splits_differ(monkeypatch, rows):
    table, cuts = rows
    common = {"max_depth": 3, "rate": 0.3, "subsample": 0.9, "colsample": 1.0, "rounds": 7, "held": 1, "best": False}
    points = [Point(min_child_weight=w, gamma=g, reg_alpha=a, **common) for w in (1.0, 1.5) for g in (0.0, 0.01, 9.0) for a in (0.0, 0.3)] + [Point(**{**common, "rounds": 4})]
    alone = [boosting.grow(table, [p], cuts)[0] for p in points]
    counted, real = [], boosting._pass
    monkeypatch.setattr(boosting, "_pass", lambda rows, models, *a: counted.append(len(models)) or real(rows, models, *a))
    for m, want in zip(boosting.grow(table, points, cuts), alone, strict=True):
        assert m.losses == pytest.approx(want.losses) and len(m.trees) == len(want.trees) == m.point.rounds
        for tree, other in zip(m.trees, want.trees, strict=True):
            assert tree.feature.tolist() == other.feature.tolist() and tree.cut.tolist() == other.cut.tolist() and tree.value == pytest.approx(other.value)
    assert counted[1] == 2 and max(counted[2:]) > 2  # the first pass counts the starts; 13 points before


def test_sums_are_the_same_added_by_the_driver_or_by_tasks(monkeypatch, rows):
    table, cuts = rows
    points = [Point(max_depth=2, rounds=2, min_child_weight=w, held=1, best=False) for w in (0.0, 30.0)]
    monkeypatch.setattr(boosting, "TASK_ROWS", (100, 100))
    direct = boosting.grow(table, points, cuts)
    monkeypatch.setattr(boosting, "DIRECT_BYTES", 0)
    monkeypatch.setattr(boosting, "LANES", 2)
    for a, b in zip(direct, boosting.grow(table, points, cuts), strict=True):
        assert a.losses == pytest.approx(b.losses) and all(x.value == pytest.approx(y.value) and x.cut.tolist() == y.cut.tolist() for x, y in zip(a.trees, b.trees, strict=True))
