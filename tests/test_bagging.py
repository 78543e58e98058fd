"""Forests grown together against pyspark.ml's trees and against fits of one point."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyframe.operators import bagging, boosting, training
from tallyframe.operators.bagging import Bag

N = 3000


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    x = np.stack([r.integers(0, k, N) for k in (25, 13, 2, 2, 7)], axis=1).astype(float)
    y = ((x[:, 0] + 3 * x[:, 4] + r.normal(size=N) * 6 + 5 * x[:, 2]) > 30).astype(float)
    weights = float(N / (2 * (y == 0).sum())), float(N / (2 * y.sum()))
    made = [(i, float(b), i % 3, weights[int(b)], Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(made, ["key", "label", "fold", "weight", "features"]).withColumn("fold", F.col("fold").cast("int")).repartition(3).cache()
    cuts = boosting.cut_points(df, "features", 5, bagging.BINS)
    return df, boosting.binned(df, "features", cuts, ["key", "label", "fold"]).cache(), bagging.Layout([len(c) + 1 for c in cuts]), weights


def scored(rows, trees, variant, depth, weights):
    forest = [(t.steps(variant), len(t.levels(variant)) - 1, [t.votes(variant, depth, weights)]) for t in trees]
    got = bagging.scores(rows, ["key"], [forest], [(0, 0, len(trees), 0)]).collect()
    return np.array([r.predicted_probability for r in sorted(got, key=lambda r: r.key)])


@pytest.mark.parametrize("node_bytes", [bagging.NODE_BYTES, 3000, 100])  # all handed over; some; nearly all split by passes
def test_trees_are_those_of_spark(monkeypatch, data, node_bytes):
    monkeypatch.setattr(bagging, "NODE_BYTES", node_bytes)
    df, rows, layout, weights = data
    tree = bagging.grow(rows, [Bag(0, 5, (10, 40), 6, weights=weights, drawn=False)], layout, {-1: N})
    for variant, least in enumerate((10, 40)):
        for depth in (3, 6):
            model = RandomForestClassifier(numTrees=1, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="all", bootstrap=False, weightCol="weight").fit(df)
            want = {r.key: r.p for r in model.transform(df).select("key", vector_to_array("probability")[1].alias("p")).collect()}
            assert scored(rows, tree, variant, depth, weights) == pytest.approx(np.array([want[k] for k in range(N)]), abs=1e-9)


def test_draws_features_folds_and_variants_do_not_depend_on_what_is_grown_beside(monkeypatch, data):
    _, rows, layout, weights = data
    bags = [Bag(n, 2, (2, 30), 5, held, weights=weights) for held in (0, 1) for n in range(3)]
    together = bagging.grow(rows, bags, layout, {0: 2000, 1: 2000})
    monkeypatch.setattr(bagging, "NODE_BYTES", 2000)
    monkeypatch.setattr(bagging, "TABLE_BYTES", 1)
    monkeypatch.setattr(bagging, "SENT_BYTES", 1)
    apart = bagging.grow(rows.repartition(2), bags, layout, {0: 2000, 1: 2000})
    alone = bagging.grow(rows, [Bag(n, 2, (30,), 5, 1, weights=weights) for n in range(3)], layout, {1: 2000})
    for variant in (0, 1):
        assert scored(rows, together[:3], variant, 5, weights) == pytest.approx(scored(rows, apart[:3], variant, 5, weights), abs=1e-12)
    assert scored(rows, together[3:], 1, 5, weights) == pytest.approx(scored(rows, alone, 0, 5, weights), abs=1e-12)
    assert not np.allclose(scored(rows, together[:1], 0, 5, weights), scored(rows, together[1:2], 0, 5, weights))
    assert abs(together[0].counts[0].sum() - 2000) < 200  # drawn with replacement
    assert sorted({bags[0].rows(np.arange(20_000))[i] for i in range(20_000)})[:4] == [0, 1, 2, 3]
    assert bags[0].rows(np.arange(20_000)).mean() == pytest.approx(1, abs=0.03) and (Bag(0, 2).tried(np.arange(1, 50), 5).sum(axis=1) == 2).all()


def test_rules_of_features():
    got = {rule: bagging.features_tried(rule, 25, 10) for rule in ("all", "auto", "sqrt", "log2", "onethird", "0.5", "7")}
    assert got == {"all": 25, "auto": 5, "sqrt": 5, "log2": 5, "onethird": 9, "0.5": 13, "7": 7}


def test_no_rows_and_one_class(data):
    _, rows, layout, _ = data
    for few in (rows.limit(0), rows.withColumn("label", F.lit(0.0))):
        tree = bagging.grow(few, [Bag(0, 5, (1,), 4)], layout, {-1: 0})[0]
        assert len(tree.counts) == 1 and tree.votes(0, 4, (1.0, 1.0)).tolist() == [0.0]


def test_a_search_of_a_forest_fits_no_forest_of_spark(monkeypatch, spark):
    """24 points over 5 folds were 60 fits of pyspark.ml, each with passes of its own."""
    r = np.random.default_rng(7)
    x, z = r.normal(size=(2, 600))
    y = (x + 0.3 * z + r.normal(size=600) > 0.8).astype(float)
    frame = spark.createDataFrame([(f"b{i}", 2008, ["train", "train", "train", "validation", "test"][i % 5], float(y[i]), float(x[i]), float(z[i]), "ab"[i % 2]) for i in range(600)], "bene_id string, year int, split_name string, label double, x double, z double, group string")
    monkeypatch.setattr(training, "estimators", lambda *a: pytest.fail("a fit of pyspark.ml"))
    grid = training.points({"numTrees": [3, 8], "maxDepth": [2, 5], "minInstancesPerNode": [5, 10], "featureSubsetStrategy": ["sqrt", "0.5"]})
    ranked, scores = training.bagged(frame, ["x", "z"], ["group"], ["bene_id", "split_name", "label"], grid, 3)
    assert len(ranked) == 16 and all(len(p["folds"]) == 3 for p in ranked) and ranked[0]["mean"] >= ranked[-1]["mean"] > 0.35
    alone = training.bagged(frame, ["x", "z"], ["group"], ["bene_id", "split_name", "label"], [ranked[5]["params"], grid[0]], 3)[0]
    assert next(p for p in alone if p["params"] == ranked[5]["params"])["folds"] == pytest.approx(ranked[5]["folds"], abs=1e-12)
    assert scores.count() == 600
    out = training.train_and_score(frame, "random_forest", ["x", "z"], ["group"], "r1", ["bene_id", "year"], grid, 3)
    assert {q.split_name: q["count"] for q in out.groupBy("split_name").count().collect()} == {"train": 360, "validation": 120, "test": 120}
