"""Forests of pyspark.ml read as tables of nodes: one that is deep and large holds those of fewer levels and trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.scratch import delete, scratch_path


@dataclass(frozen=True)
class Nodes:
    """The nodes of all trees, numbered through. feature -1: a leaf. A row goes left where its value is at most ``cut``, or, of a
    feature with categories, where the bit of its category is set in ``kinds``. ``roots``: the first node of each tree."""

    feature: np.ndarray
    cut: np.ndarray
    category: np.ndarray
    kinds: np.ndarray
    left: np.ndarray
    right: np.ndarray
    vote: np.ndarray
    said: np.ndarray
    roots: np.ndarray

    def reached(self, values: np.ndarray, root: int) -> np.ndarray:
        """The leaf that each row of ``values`` ends in."""
        out = np.full(len(values), root)
        moving = np.arange(len(values)) if self.feature[root] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            node = out[moving]
            x = values[moving, self.feature[node]]
            low = x <= self.cut[node]
            of_category = self.category[node]
            if of_category.any():
                low[of_category] = (self.kinds[node[of_category]] >> x[of_category].astype(np.int64)) & 1 == 1
            out[moving] = node = np.where(low, self.left[node], self.right[node])
            moving = moving[self.feature[node] >= 0]
        return out

    def votes(self, depth: int) -> np.ndarray:
        """By node the vote of the leaf that holds it in trees of at most ``depth`` levels.

        As in a fit of that depth, a node is a leaf there too where all leaves below it say the same.
        """
        level, above = np.zeros(len(self.left), np.int64), np.full(len(self.left), -1)
        inner = np.flatnonzero(self.feature >= 0)
        for node in inner.tolist():  # a node stands before its children
            for child in (self.left[node], self.right[node]):
                level[child], above[child] = level[node] + 1, node
        leaf = (self.feature < 0) | (level >= depth)
        for node in inner[::-1].tolist():
            a, b = self.left[node], self.right[node]
            leaf[node] |= leaf[a] and leaf[b] and self.said[a] == self.said[b]
        at, out = np.arange(len(level)), self.vote.copy()
        for node in np.flatnonzero(above >= 0).tolist():
            if leaf[above[node]]:
                leaf[node], at[node] = True, at[above[node]]
        return out[at]


def nodes(spark: SparkSession, model) -> Nodes:
    """The nodes of a fitted forest's trees, read from its written form."""
    path = scratch_path(spark, "forest")
    model.save(path)
    n = F.col("nodeData")
    rule = n["split"]
    table = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("said"), n["impurityStats"].alias("stats"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        rule["featureIndex"].alias("feature"), rule["leftCategoriesOrThreshold"].alias("at"), rule["numCategories"].alias("categories"),
    ).toArrow().sort_by([("tree", "ascending"), ("id", "ascending")])
    delete(spark, path)
    tree = table["tree"].to_numpy()
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    first = roots[np.searchsorted(roots, np.arange(len(tree)), "right") - 1]
    inner, stats = table["left"].to_numpy() >= 0, np.array(table["stats"].to_pylist(), float)
    category = inner & (table["categories"].to_numpy() >= 0)
    at = table["at"].to_pylist()
    return Nodes(
        feature=np.where(inner, table["feature"].to_numpy(), -1),
        cut=np.array([x[0] if i and not c else 0.0 for x, i, c in zip(at, inner, category, strict=True)]),
        category=category,
        kinds=np.array([sum(1 << int(k) for k in x) if c else 0 for x, c in zip(at, category, strict=True)], np.int64),
        left=np.where(inner, table["left"].to_numpy() + first, -1),
        right=np.where(inner, table["right"].to_numpy() + first, -1),
        vote=stats[:, 1] / np.maximum(stats.sum(axis=1), 1e-300) if stats.shape[1] > 1 else np.zeros(len(tree)),
        said=table["said"].to_numpy(),
        roots=roots,
    )


def scores(rows: DataFrame, forests: list[Nodes], wanted: list[tuple[int, int, int]]) -> DataFrame:
    """label, point and predicted_probability of rows with features, by each wanted (point, trees, levels): the mean vote of the
    first so many trees, cut at so many levels. Forests stand in the order of their trees."""
    votes = {depth: [f.votes(depth) for f in forests] for depth in {d for _, _, d in wanted}}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            values, grown = batch.column("x").flatten().to_numpy().reshape(len(batch), -1), 0
            total = {depth: np.zeros(len(batch)) for depth in votes}
            for i, forest in enumerate(forests):
                for root in forest.roots.tolist():
                    leaf, grown = forest.reached(values, root), grown + 1
                    for depth, vote in votes.items():
                        total[depth] += vote[i][leaf]
                    for point, trees, depth in wanted:
                        if trees == grown:
                            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.full(len(batch), point, np.int32)), pa.array(total[depth] / trees)], ["label", "point", "predicted_probability"])

    return rows.select("label", vector_to_array("features").alias("x")).mapInArrow(scored, "label double, point int, predicted_probability double")
