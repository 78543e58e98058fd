"""Forests of many points and folds, grown together from binned rows.

Nodes with many rows are split by passes: one pass for each level counts rows by node, bin and label for all trees, and tasks
that each hold one tree's sums choose the splits. A node with few enough rows is handed over: its rows, a few bytes each, meet
in one task, which grows all that lies below. Trees that differ only in the rows a side must have are one tree with variants,
which part where their best splits do; those of fewer levels or trees are parts of the larger ones.

Splits, leaves and votes are those of pyspark.ml: gini of weighted classes, rows drawn with replacement (Poisson), features
drawn anew at each node, and leaves of one answer joined. The draws depend on key, tree, node and seed only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import boosting

#: Bins of a feature, as pyspark.ml has by default.
BINS = 32
#: Bytes of a node's rows up to which one task takes them.
NODE_BYTES = 32 << 20
#: Bytes of sums that a task holds in one pass.
TABLE_BYTES = 256 << 20
#: Bytes of rows that are handed over in one job.
SENT_BYTES = 2 << 30
#: Bytes of rows in one batch that are handed over.
BATCH_BYTES = 8 << 20
#: Rows that are worked on together.
BLOCK = 1 << 16
#: Odds of being drawn at most 0, 1, 2, ... times.
DRAWN = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])


@dataclass(frozen=True)
class Bag:
    """One tree. ``number`` and ``seed`` draw its rows and features, ``held`` is the fold that it doesn't learn from, ``take`` the
    features tried at a node, ``least`` the rows that a side must have, by variant, ``weights`` those of the two classes."""

    number: int
    take: int
    least: tuple[int, ...] = (1,)
    depth: int = 8
    held: int = -1
    seed: int = 42
    weights: tuple[float, float] = (1.0, 1.0)
    drawn: bool = True

    def rows(self, key: np.ndarray) -> np.ndarray:
        """How many times each row is drawn."""
        if not self.drawn:
            return np.ones(len(key), np.uint8)
        u, out = boosting.uniforms(key, 2 * self.number + 1_000_003 * self.seed), np.zeros(len(key), np.uint8)
        for odds in DRAWN:
            out += u >= odds
        return out

    def tried(self, path: np.ndarray, features: int) -> np.ndarray:
        """(nodes, features): which features are tried at the nodes of these heap numbers."""
        if self.take >= features:
            return np.ones((len(path), features), bool)
        u = boosting.uniforms(path[:, None] * (1 << 20) + np.arange(features), 2 * self.number + 1 + 1_000_003 * self.seed)
        out = np.zeros(u.shape, bool)
        np.put_along_axis(out, np.argpartition(u, self.take - 1, axis=1)[:, : self.take], True, axis=1)
        return out


class Layout:
    """Where the bins of features stand: ``offsets`` in sums by feature, and the byte that features with few bins share."""

    def __init__(self, sizes: list[int]):
        self.sizes = np.array(sizes)
        self.offsets = np.r_[0, np.cumsum(sizes)]
        self.groups = boosting._together(sizes)
        self.widths = [math.prod(self.sizes[g].tolist()) for g in self.groups]
        self.place = np.zeros(len(sizes), np.int64)
        self.digit = np.zeros((len(sizes), 256), np.uint8)
        for k, (group, width) in enumerate(zip(self.groups, self.widths, strict=True)):
            for f, digits in zip(group, np.unravel_index(np.arange(width), self.sizes[group].tolist()), strict=True):
                self.place[f] = k
                self.digit[f, :width] = digits

    @cached_property
    def of_cell(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def apart(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each byte the cells of its features, and which of them each value of the byte counts for."""
        out = []
        for group, width in zip(self.groups, self.widths, strict=True):
            cells = np.concatenate([np.arange(self.offsets[f], self.offsets[f + 1]) for f in group])
            counts = np.concatenate([self.digit[f, :width, None] == np.arange(self.sizes[f]) for f in group], axis=1)
            out.append((cells, counts.astype(np.float64)))
        return out

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """(bytes, rows) of bins by feature."""
        out = np.zeros((len(self.groups), columns.shape[1]), np.uint8)
        for k, group in enumerate(self.groups):
            for f in group:
                out[k] = out[k] * np.uint8(self.sizes[f] % 256) + columns[f]
        return out

    def counts(self, codes: list[np.ndarray], place: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
        """(nodes, 2, cells): rows by node, label and bin. ``place``: twice the node, and the label."""
        out = np.empty((2 * nodes, int(self.offsets[-1])))
        for code, width, (cells, counts) in zip(codes, self.widths, self.apart, strict=True):
            joint = np.bincount(place * width + code, weight, 2 * nodes * width)
            out[:, cells] = joint.reshape(2 * nodes, width) @ counts
        return out.reshape(nodes, 2, -1)


@dataclass
class Shape:
    """The nodes of a tree in all its variants. counts: rows by label; feature, cut and left by variant; left -1: a leaf. A row goes to
    left where its bin is at most ``cut``, else to the node after it."""

    counts: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(variants: int) -> Shape:
        return Shape(np.zeros((1, 2)), np.full((variants, 1), -1), np.zeros((variants, 1), np.int64), np.full((variants, 1), -1))

    def packed(self) -> bytes:
        return b"".join((self.counts.astype(np.int64).tobytes(), self.left.astype(np.int32).tobytes(), self.feature.astype(np.int16).tobytes(), self.cut.astype(np.uint8).tobytes()))

    @staticmethod
    def unpacked(data: bytes, variants: int) -> Shape:
        n = len(data) // (16 + 7 * variants)
        ends = np.cumsum([16 * n, 4 * n * variants, 2 * n * variants])
        part = lambda low, high, kind: np.frombuffer(data[low:high], kind)
        return Shape(part(0, ends[0], np.int64).reshape(n, 2).astype(float), *(part(low, high, kind).reshape(variants, n).astype(np.int64) for low, high, kind in ((ends[1], ends[2], np.int16), (ends[2], len(data), np.uint8), (ends[0], ends[1], np.int32))))

    def grown(self, parent: np.ndarray, feature: np.ndarray, cut: np.ndarray, joined: np.ndarray, low: np.ndarray) -> tuple[Shape, np.ndarray]:
        """With two children for each branch, and the left ones' numbers. ``joined``: (variants, branches); ``low``: the counts on the left."""
        n, b = len(self.counts), len(parent)
        left = n + 2 * np.arange(b)
        children = np.stack([low, self.counts[parent] - low], axis=1).reshape(-1, 2)
        wide = lambda x, fill: np.concatenate([x, np.full((len(x), 2 * b), fill)], axis=1)
        out = Shape(np.concatenate([self.counts, children]), wide(self.feature, -1), wide(self.cut, 0), wide(self.left, -1))
        for v, own in enumerate(joined):
            out.feature[v, parent[own]], out.cut[v, parent[own]], out.left[v, parent[own]] = feature[own], cut[own], left[own]
        return out, left

    def with_subtree(self, at: int, below: Shape) -> Shape:
        """With ``below`` in place of the node ``at``."""
        n = len(self.counts)
        joined = [np.concatenate([a, b[..., 1:]], axis=-1) for a, b in ((self.feature, below.feature), (self.cut, below.cut), (self.left, np.where(below.left < 0, -1, below.left + n - 1)))]
        out = Shape(np.concatenate([self.counts, below.counts[1:]]), *joined)
        out.counts[at] = below.counts[0]
        out.feature[:, at], out.cut[:, at] = below.feature[:, 0], below.cut[:, 0]
        out.left[:, at] = np.where(below.left[:, 0] < 0, -1, below.left[:, 0] + n - 1)
        return out

    def steps(self, variant: int = 0) -> np.ndarray:
        """Each node as one number: where it leads, feature and cut; a leaf leads to itself."""
        inner = self.left[variant] >= 0
        to = np.where(inner, self.left[variant], np.arange(len(inner)))
        return to << 24 | np.where(inner, self.feature[variant], 0) << 8 | np.where(inner, self.cut[variant], 255)

    def levels(self, variant: int = 0) -> list[np.ndarray]:
        """The nodes of each level that a variant has."""
        found, left = [np.zeros(1, np.int64)], self.left[variant]
        while len(below := left[found[-1]][left[found[-1]] >= 0]):
            found.append(np.concatenate([below, below + 1]))
        return found

    def votes(self, variant: int, depth: int, weights: tuple[float, float]) -> np.ndarray:
        """By node the positive share of the leaf that holds it in trees of at most ``depth`` levels; a node is a leaf there too where
        all leaves below it say the same."""
        left, (no, yes) = self.left[variant], (self.counts * weights).T
        out, said, leaf = yes / np.maximum(no + yes, 1e-300), yes > no, left < 0
        levels = self.levels(variant)
        for nodes in levels[depth:]:
            leaf[nodes] = True
        for nodes in levels[:depth][::-1]:
            inner = nodes[left[nodes] >= 0]
            a = left[inner]
            leaf[inner] = leaf[a] & leaf[a + 1] & (said[a] == said[a + 1])
        for nodes in levels:
            shut = nodes[(left[nodes] >= 0) & leaf[nodes]]
            for child in (left[shut], left[shut] + 1):
                out[child], leaf[child] = out[shut], True
        return out


def walked(steps: np.ndarray, columns: np.ndarray, levels: int, rows: np.ndarray) -> np.ndarray:
    """The node that each of ``rows`` ends in. ``columns``: bins by feature."""
    flat, n, node = columns.ravel(), columns.shape[1], np.zeros(len(rows), np.int64)
    for _ in range(levels):
        step = steps.take(node)
        node = (step >> 24) + (flat.take((step >> 8 & 0xFFFF) * n + rows) > (step & 255))
    return node


def best_splits(layout: Layout, bag: Bag, table: np.ndarray, path: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, rows on the left by label) of the best split of each node, by variant; feature -1: none.

    ``own``: (variants, nodes), the nodes that a variant has. Equal gains go to the first feature and cut.
    """
    v, n = own.shape
    feature, cut, low = np.full((v, n), -1), np.zeros((v, n), np.int64), np.zeros((v, n, 2))
    for at in range(0, n, 256):
        part = slice(at, min(at + 256, n))
        run = np.cumsum(table[part], axis=2)
        start = np.concatenate([np.zeros((*run.shape[:2], 1)), run], axis=2)[:, :, layout.offsets[:-1]]
        left = run - start[:, :, layout.of_cell]
        total = table[part][:, :, : layout.sizes[0]].sum(axis=2)[:, :, None]
        rows = left.sum(axis=1)
        fewer = np.minimum(rows, total.sum(axis=1) - rows)
        a, b = left[:, 0] * bag.weights[0], left[:, 1] * bag.weights[1]
        all_a, all_b = total[:, 0] * bag.weights[0], total[:, 1] * bag.weights[1]
        pure = lambda x, y: (x * x + y * y) / np.maximum(x + y, 1e-300)
        gain = (pure(a, b) + pure(all_a - a, all_b - b) - pure(all_a, all_b)) / np.maximum(all_a + all_b, 1e-300)
        allowed = bag.tried(path[part], len(layout.sizes))[:, layout.of_cell]
        allowed[:, layout.offsets[1:] - 1] = False  # nothing lies to the right of a feature's last bin
        for i, least in enumerate(bag.least):
            fits = np.where(allowed & (fewer >= max(least, 1)), gain, -1.0)
            cell = fits.argmax(axis=1)
            nodes = np.arange(len(cell))
            good = (fits[nodes, cell] > 1e-12) & own[i, part]
            f = layout.of_cell[cell]
            feature[i, part], cut[i, part] = np.where(good, f, -1), np.where(good, cell - layout.offsets[f], 0)
            low[i, part] = left[nodes, :, cell]
    return feature, cut, low


def _branches(feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, node, joined) of the distinct splits: the first variant that has it, and all that do (variants, branches)."""
    key, found = np.where(feature < 0, -1, feature * 256 + cut), []
    for v in range(len(key)):
        at = np.flatnonzero((key[v] >= 0) & (key[:v] != key[v]).all(axis=0))
        found.append((np.full(len(at), v), at, key[:, at] == key[v, at]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found], axis=1)


def _splittable(bag: Bag, counts: np.ndarray, own: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Which nodes may have a split: of both classes, with rows for two sides, above the last level."""
    least = np.where(own, np.maximum(np.array(bag.least), 1)[:, None], 1 << 60).min(axis=0)
    return own.any(axis=0) & (counts.min(axis=1) > 0) & (counts.sum(axis=1) >= 2 * least) & (path < 1 << bag.depth)


def grow_below(layout: Layout, bag: Bag, codes: np.ndarray, label: np.ndarray, weight: np.ndarray, path: int = 1, own: np.ndarray | None = None) -> Shape:
    """The tree below one node, of whose rows all are here. Of two siblings only the one with fewer rows is counted."""
    flat, m = codes.ravel(), codes.shape[1]
    shape, ids, paths = Shape.of(len(bag.least)), np.zeros(1, np.int64), np.array([path])
    own = np.ones((len(bag.least), 1), bool) if own is None else own
    table = layout.counts(list(codes), label.astype(np.int64), weight.astype(np.float64), 1)
    shape.counts[0] = table[0, :, : layout.sizes[0]].sum(axis=1)
    at, node = np.arange(m), np.zeros(m, np.int64)
    if not _splittable(bag, shape.counts, own, paths)[0]:
        return shape
    while len(ids):
        feature, cut, low = best_splits(layout, bag, table, paths, own)
        variant, parent, joined = _branches(feature, cut)
        if not len(parent):
            break
        f, c = feature[variant, parent], cut[variant, parent]
        shape, left = shape.grown(ids[parent], f, c, joined, low[variant, parent])
        children, mine = np.stack([left, left + 1], axis=1).ravel(), np.repeat(joined, 2, axis=1)
        numbers = np.stack([2 * paths[parent], 2 * paths[parent] + 1], axis=1).ravel()
        alive = _splittable(bag, shape.counts[children], mine, numbers)
        goes_on = alive.reshape(-1, 2).any(axis=1)
        if not goes_on.any():
            break
        # rows move to the children of branches that go on, once for each branch
        moved = []
        for v in np.unique(variant):
            branch = np.full(len(ids), -1)
            mine_v = np.flatnonzero((variant == v) & goes_on)
            branch[parent[mine_v]] = mine_v
            of_row = branch.take(node)
            rows = np.flatnonzero(of_row >= 0)
            of_row, source = of_row.take(rows), at.take(rows)
            right = layout.digit[f] > c[:, None]
            moved.append((source, 2 * of_row + right.ravel().take(of_row * 256 + flat.take(layout.place[f].take(of_row) * m + source))))
        at, node = (np.concatenate(x) if len(moved) > 1 else x[0] for x in zip(*moved, strict=True))
        sizes = shape.counts[children].sum(axis=1).reshape(-1, 2)
        kept = np.flatnonzero(goes_on)
        lighter = 2 * kept + (sizes[kept, 0] > sizes[kept, 1])
        number = np.full(len(children), -1)
        number[lighter] = np.arange(len(kept))
        of_row = number.take(node)
        rows = np.flatnonzero(of_row >= 0)
        source = at.take(rows)
        counted = layout.counts([x.take(source) for x in codes], 2 * of_row.take(rows) + label.take(source), weight.take(source).astype(np.float64), len(kept))
        both = np.empty((len(children), *table.shape[1:]))
        both[lighter] = counted
        both[lighter ^ 1] = table[parent[kept]] - counted
        # children that may split are the nodes of the next level
        goes = np.flatnonzero(alive)
        ids, paths, own, table = children[goes], numbers[goes], mine[:, goes], both[goes]
        number = np.full(len(children), -1)
        number[goes] = np.arange(len(goes))
        node = number.take(node)
        rows = np.flatnonzero(node >= 0)
        at, node = at.take(rows), node.take(rows)
    return shape


def _blocks(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows of several batches together: their columns, and bins by feature."""
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= BLOCK:
            yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in keep], np.concatenate([boosting._columns(b) for b in held], axis=1)
            held, size = [], 0
    if size:
        yield [np.concatenate([b.column(c).to_numpy() for b in held]) for c in keep], np.concatenate([boosting._columns(b) for b in held], axis=1)


@dataclass
class Top:
    """The upper levels of a tree. ``open``: nodes split by the next pass; ``near``: those handed over; with their heap numbers and variants."""

    shape: Shape
    path: np.ndarray
    own: np.ndarray
    open: np.ndarray
    near: np.ndarray

    def reached(self, columns: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, place among ``wanted``) of the rows that end in these nodes; one that variants part may end in several."""
        if len(self.path) == 1:
            return rows, np.zeros(len(rows), np.int64)
        number = np.full(len(self.path), -1)
        number[wanted] = np.arange(len(wanted))
        ends, found = [], []
        for v in range(len(self.own)):
            if v and all(np.array_equal(x[v], x[v - 1]) for x in (self.shape.left, self.shape.feature, self.shape.cut)):
                continue
            end = number.take(walked(self.shape.steps(v), columns, len(self.shape.levels(v)) - 1, rows))
            at = np.flatnonzero((end >= 0) & np.all([e != end for e in ends], axis=0)) if ends else np.flatnonzero(end >= 0)
            ends.append(end)
            found.append((rows.take(at), end.take(at)))
        a, b = zip(*found, strict=True)
        return np.concatenate(a), np.concatenate(b)


def _learnt(bags: dict[int, Bag], key: np.ndarray, fold: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tree, its rows, how many times all rows are drawn); trees that draw the same rows follow each other."""
    last, drawn = None, np.zeros(0)
    for i, bag in sorted(bags.items(), key=lambda x: (x[1].number, x[1].held)):
        if last is None or (last.number, last.seed, last.drawn) != (bag.number, bag.seed, bag.drawn):
            drawn = bag.rows(key)
        if last is None or last.held != bag.held or last.number != bag.number:
            rows = np.flatnonzero((drawn > 0) & (fold != bag.held))
        last = bag
        yield i, rows, drawn


def _split_by_pass(rows: DataFrame, layout: Layout, bags: dict[int, Bag], tops: dict[int, Top]) -> dict[int, tuple[np.ndarray, ...]]:
    """By tree the best splits of its open nodes and the nodes' rows by label."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for (key, label, fold), columns in _blocks(batches, ("key", "label", "fold")):
            codes, positive = layout.codes(columns), (label > 0).astype(np.int64)
            for i, own, drawn in _learnt(bags, key, fold):
                at, place = tops[i].reached(columns, own, tops[i].open)
                found = layout.counts([c.take(at) for c in codes], 2 * place + positive.take(at), drawn.take(at).astype(np.float64), len(tops[i].open))
                totals[i] = totals[i] + found if i in totals else found
        for i, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "data"])

    def chosen(group: pa.Table) -> pa.Table:
        i = group.column("tree")[0].as_py()
        table = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("data")).reshape(len(tops[i].open), 2, -1)
        feature, cut, low = best_splits(layout, bags[i], table, tops[i].path[tops[i].open], tops[i].own[:, tops[i].open])
        total = table[:, :, : layout.sizes[0]].sum(axis=2)
        data = np.concatenate([x.ravel().astype(np.float64) for x in (feature, cut, low, total)])
        return pa.table({"tree": group.column("tree")[:1], "data": pa.array([data.tobytes()], pa.binary())})

    found = {}
    for row in rows.mapInArrow(summed, "tree int, data binary").groupBy("tree").applyInArrow(chosen, "tree int, data binary").collect():
        v, n = len(bags[row.tree].least), len(tops[row.tree].open)
        feature, cut, low, total = np.split(np.frombuffer(row.data, np.float64), np.cumsum([v * n, v * n, 2 * v * n]))
        found[row.tree] = feature.reshape(v, n).astype(np.int64), cut.reshape(v, n).astype(np.int64), low.reshape(v, n, 2), total.reshape(n, 2)
    return found


def _parts(sizes: dict[int, float], most: float) -> list[list[int]]:
    """Trees in runs whose sizes add up to ``most`` at most, if they have several."""
    out, total = [], math.inf
    for i, size in sizes.items():
        if total + size > most:
            out.append([])
            total = 0.0
        out[-1].append(i)
        total += size
    return out


def _extended(bag: Bag, top: Top, found: tuple[np.ndarray, ...], few: float) -> Top:
    """With the splits of a pass: children of at most ``few`` rows are handed over, others are open."""
    feature, cut, low, total = found
    shape = top.shape
    shape.counts[top.open] = total
    variant, parent, joined = _branches(feature, cut)
    parts = top.open[parent]
    shape, left = shape.grown(parts, feature[variant, parent], cut[variant, parent], joined, low[variant, parent])
    children, mine = np.stack([left, left + 1], axis=1).ravel(), np.repeat(joined, 2, axis=1)
    path = np.concatenate([top.path, np.stack([2 * top.path[parts], 2 * top.path[parts] + 1], axis=1).ravel()])
    alive = _splittable(bag, shape.counts[children], mine, path[children]) if len(children) else np.zeros(0, bool)
    small = shape.counts[children].sum(axis=1) <= few
    return Top(shape, path, np.concatenate([top.own, mine], axis=1), children[alive & ~small], np.concatenate([top.near, children[alive & small]]))


def _handed_over(rows: DataFrame, layout: Layout, bags: dict[int, Bag], tops: dict[int, Top], tasks: int) -> dict[int, list[tuple[int, Shape]]]:
    """By tree its nodes that were handed over, and what grew below them."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, places, data, size = [], [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(places, pa.int32()), pa.array(data, pa.binary())], ["tree", "place", "data"])
        for (key, label, fold), columns in _blocks(batches, ("key", "label", "fold")):
            codes, positive = layout.codes(columns), (label > 0).astype(np.uint8)
            for i, own, drawn in _learnt(bags, key, fold):
                at, place = tops[i].reached(columns, own, tops[i].near)
                ends = np.array([len(at)])
                if len(tops[i].near) > 1:
                    at = at.take(np.argsort(place.astype(np.uint16), kind="stable"))
                    ends = np.cumsum(np.bincount(place, None, len(tops[i].near)))
                sent = [*(c.take(at) for c in codes), drawn.take(at) * np.uint8(2) + positive.take(at)]
                for p, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if high > low:
                        trees.append(i)
                        places.append(p)
                        data.append(b"".join(x[low:high].tobytes() for x in sent))
                        size += len(data[-1])
                if size > BATCH_BYTES:
                    yield batch()
                    trees, places, data, size = [], [], [], 0
        if trees:
            yield batch()

    def finished(group: pa.Table) -> pa.Table:
        i, place = group.column("tree")[0].as_py(), group.column("place")[0].as_py()
        x = np.concatenate([np.frombuffer(d.as_buffer(), np.uint8).reshape(len(layout.groups) + 1, -1) for d in group.column("data")], axis=1)
        node = tops[i].near[place]
        grown = grow_below(layout, bags[i], x[:-1], x[-1] & 1, x[-1] >> 1, int(tops[i].path[node]), tops[i].own[:, [node]])
        return pa.table({"tree": group.column("tree")[:1], "place": group.column("place")[:1], "data": pa.array([grown.packed()], pa.binary())})

    schema, out = "tree int, place int, data binary", defaultdict(list)
    sent = rows.mapInArrow(dealt, schema).repartition(tasks, "tree", "place")
    for row in sent.groupBy("tree", "place").applyInArrow(finished, schema).collect():
        out[row.tree].append((int(tops[row.tree].near[row.place]), Shape.unpacked(row.data, len(bags[row.tree].least))))
    return out


def grow(rows: DataFrame, bags: list[Bag], layout: Layout, sizes: dict[int, int]) -> list[Shape]:
    """The trees of all bags on ``rows`` (key: long, label, fold: int, bins). ``sizes``: by fold that is held the rows to learn from."""
    rows = rows.select("key", "label", "fold", "bins")  # all columns there are go to a pass
    few = NODE_BYTES / (len(layout.groups) + 1)
    tops, one = {}, np.zeros(1, np.int64)
    for i, bag in enumerate(bags):
        near = sizes[bag.held] <= few
        tops[i] = Top(Shape.of(len(bag.least)), np.ones(1, np.int64), np.ones((len(bag.least), 1), bool), one[:0] if near else one, one if near else one[:0])
    while any(len(t.open) for t in tops.values()):
        for part in _parts({i: 16.0 * len(t.open) * int(layout.offsets[-1]) for i, t in tops.items() if len(t.open)}, TABLE_BYTES):
            found = _split_by_pass(rows, layout, {i: bags[i] for i in part}, {i: tops[i] for i in part})
            for i in part:
                top = tops[i]
                tops[i] = _extended(bags[i], top, found[i], few) if i in found else Top(top.shape, top.path, top.own, one[:0], top.near)
    bytes_ = {i: (t.shape.counts[t.near].sum() or sizes[bags[i].held]) * (len(layout.groups) + 1) for i, t in tops.items() if len(t.near)}
    shapes = {i: t.shape for i, t in tops.items()}
    most = 16 * rows.sparkSession.sparkContext.defaultParallelism
    for part in _parts(bytes_, SENT_BYTES):
        tasks = min(sum(len(tops[i].near) for i in part), most)
        for i, below in _handed_over(rows, layout, {i: bags[i] for i in part}, {i: tops[i] for i in part}, tasks).items():
            for node, grown in below:
                shapes[i] = shapes[i].with_subtree(node, grown)
    return [shapes[i] for i in range(len(bags))]


def scores(rows: DataFrame, keep: list[str], forests: list[list[tuple[np.ndarray, int, list[np.ndarray]]]], wanted: list[tuple[int, int, int, int]]) -> DataFrame:
    """``keep``, point and predicted_probability by each wanted (point, forest, trees, votes): the mean vote of the forest's first so many trees.
    Each tree: its steps, its levels, and votes by node of one or several kinds."""
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            columns, every = boosting._columns(batch), np.arange(len(batch))
            held = [batch.column(c) for c in keep]
            for k, forest in enumerate(forests):
                total = np.zeros((len(forest[0][2]), len(batch)))
                for n, (steps, levels, votes) in enumerate(forest, 1):
                    leaf = walked(steps, columns, levels, every)
                    for kind, vote in enumerate(votes):
                        total[kind] += vote.take(leaf)
                    for point, own, trees, kind in wanted:
                        if own == k and trees == n:
                            yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(batch), point, np.int32)), pa.array(total[kind] / n)], [*keep, "point", "predicted_probability"])

    return rows.select(*keep, "bins").mapInArrow(scored, f"{fields}, point int, predicted_probability double")


def features_tried(rule: str, features: int, trees: int) -> int:
    """How many features a node tries, by pyspark.ml's names of the rules."""
    named: dict[str, Callable[[], float]] = {"all": lambda: features, "sqrt": lambda: math.sqrt(features), "log2": lambda: math.log2(features), "onethird": lambda: features / 3, "auto": lambda: features if trees == 1 else math.sqrt(features)}
    if rule in named:
        n = named[rule]()
    else:
        n = int(rule) if rule.isdigit() else float(rule) * features
    return max(1, min(features, math.ceil(n)))


def counts_by_fold(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """By fold its negative and positive rows."""
    found = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("p")).collect()
    return {r.fold: (r.n - r.p, r.p) for r in found}
