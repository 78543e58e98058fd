"""Second-order boosted trees, many parameter points at once, with rows that never leave their partitions.

Features are binned once. Each level of a round is one pass over the rows that sums gradients, hessians and counts by
node and bin for every point that still grows; a pass returns a table per point, whose size depends on the depth and the
bins only, and the splits follow from it. Margins are written into the table every few rounds, so a pass applies the
trees of these rounds only. Points stop by themselves when their loss on held rows no longer falls. Points that differ in what
a split must reach alone are counted as one for as long as they choose the same splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.scratch import drop, saved

#: Bins of a feature; a bin number is one byte.
BINS = 64
#: Rounds after which margins are written: a pass sends rows down each tree since then, for every model.
WRITE = 3
#: Cells that features with few bins may have together where they are counted as one.
JOINT = 256
#: Rows that a pass works on together.
BLOCK = 1 << 15
#: Rows of a task of a pass: at least, where there are fewer tasks than cores, and at most.
TASK_ROWS = 50_000, 500_000
#: Partitions above which sums are added up in two steps.
LANES = 64
#: Bytes of all tasks' sums up to which the driver adds them, which saves a pass its second stage.
DIRECT_BYTES = 8 << 20


@dataclass(frozen=True)
class Point:
    """Parameters of one model. ``held``: the fold that its trees don't learn from. ``stop_share``: of the rows it may learn
    from, the share whose loss decides when to stop; 0 takes the held fold. ``tolerance``: what counts as a lower loss.
    ``best``: whether the model ends at its lowest loss or where it stopped."""

    max_depth: int = 4
    rate: float = 0.05
    min_child_weight: float = 5.0
    min_rows: int = 0
    gamma: float = 0.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    subsample: float = 0.8
    colsample: float = 0.8
    rounds: int = 1000
    patience: int = 50
    tolerance: float = 0.0
    balanced: bool = True
    best: bool = True
    held: int = -1
    stop_share: float = 0.0


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 (bin <= cut) and 2i + 2. feature -1: a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def leaves(self, columns: np.ndarray, node: int = 0) -> np.ndarray:
        """The node that each row ends in, below ``node``. ``columns``: bins by feature, each a run of bytes. A node compares
        one run and picks one of its children's answers by a mask, so that no row is looked up by itself."""
        kind, feature = (np.uint8 if len(self.feature) <= 256 else np.uint32), int(self.feature[node])
        if feature < 0:
            return np.array(node, kind) if node else np.zeros(columns.shape[1], kind)
        left, right = self.leaves(columns, 2 * node + 1), self.leaves(columns, 2 * node + 2)
        return left ^ ((left ^ right) & np.negative((columns[feature] > int(self.cut[node])).astype(kind)))

    def values(self, columns: np.ndarray) -> np.ndarray:
        """The value of the node that each row ends in."""
        return self.value.take(self.leaves(columns))


@dataclass
class Model:
    point: Point
    start: float = 0.0
    positive: float = 1.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, columns: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        total = np.zeros(columns.shape[1])
        for tree in self.trees[low:high]:
            total += tree.values(columns)
        return total


def cut_points(train: DataFrame, column: str, n: int, bins: int = BINS) -> list[np.ndarray]:
    """For each of n features its distinct approximate quantiles: at most ``bins`` - 1, so the model's size bounds them."""
    at = F.array(*(F.lit(i / (bins - 1)) for i in range(bins - 1)))
    found = train.select(vector_to_array(column).alias("x")).agg(*(F.percentile_approx(F.col("x")[i], at, F.lit(10_000)).alias(f"q{i}") for i in range(n))).first()
    return [np.unique(np.array(x or [0.0])) for x in found]


def binned(df: DataFrame, column: str, cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` and bins: one byte for each feature, the number of cut points below its value."""
    rows = df.select(*keep, vector_to_array(column).alias("x"))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.drop("x").dtypes)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), len(cuts))
            cells = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            column = pa.array([c.tobytes() for c in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], [*keep, "bins"])

    return rows.mapInArrow(to_bins, f"{fields}, bins binary")


def uniforms(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and seed only."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _sum_tables(tables: DataFrame, tasks: int, size: int) -> dict[int, np.ndarray]:
    """The element-wise sum of the tables of each model, of which each of ``tasks`` has ``size`` bytes: by the driver if they
    are few, in two steps for many partitions."""
    if tasks * size <= DIRECT_BYTES:
        totals: dict[int, np.ndarray] = {}
        for r in tables.collect():
            found = np.frombuffer(r.sums, np.float64)
            totals[r.model] = totals[r.model] + found if r.model in totals else found
        return totals
    schema = "model int, lane int, sums binary"

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("sums"))
        return pa.table({"model": group.column("model")[:1], "lane": group.column("lane")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    if tasks > LANES:
        tables = tables.groupBy("model", "lane").applyInArrow(add, schema)
    return {r.model: np.frombuffer(r.sums, np.float64) for r in tables.groupBy("model").applyInArrow(add, schema).collect()}


Measure = Callable[[int, Model, dict], np.ndarray]


def _pass(rows: DataFrame, models: dict[int, Model], written: dict[int, int], place: dict[int, int], measure: Measure, tasks: int, size: int, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[int, np.ndarray]:
    """Per model the sum of ``measure`` over all rows, which sees columns (bins by feature), label, learn, stop, weight, margin,
    key, and draws, a place for what all models share. ``place``: where each model's written margin stands. ``finish``: what becomes
    of a task's sums, ``size`` bytes of all models."""
    pending = {i: replace(m, trees=m.trees[written[i] :], losses=[]) for i, m in models.items()}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals: dict[int, np.ndarray] = {}
        for key, label, fold, columns, margins in _blocks(batches):
            share, draws = uniforms(key, 1) if any(m.point.stop_share for m in pending.values()) else None, {}
            for i, m in pending.items():
                own = fold != m.point.held
                stop = own & (share < m.point.stop_share) if m.point.stop_share else ~own
                margin = m.start + m.margins(columns) + margins[place[i]]
                seen = {"key": key, "draws": draws, "label": label, "columns": columns, "learn": own & ~stop, "stop": stop, "margin": margin, "weight": np.where(label > 0, m.positive, 1.0)}
                totals[i] = totals.get(i, 0) + measure(i, m, seen)
        context = TaskContext.get()
        lane = (context.partitionId() if context else 0) % LANES
        if totals:
            columns = [pa.array(list(totals), pa.int32()), pa.array([lane] * len(totals), pa.int32()), pa.array([np.asarray(finish(t), np.float64).tobytes() for t in totals.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["model", "lane", "sums"])

    return _sum_tables(rows.mapInArrow(summed, "model int, lane int, sums binary"), tasks, size)


#: A block of rows in one: their values, bins by feature and margins by model, each a run of bytes.
PACKED = "key binary, label binary, fold binary, bins binary, margins binary"


def _packed(rows: DataFrame, margins: int) -> DataFrame:
    """Rows in blocks, with margins of zero, as rows one by one cost more to read than to count."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            values = [np.ascontiguousarray(batch.column(c).to_numpy(), kind) for c, kind in (("key", np.int64), ("label", np.float64), ("fold", np.int32))]
            data = [*values, _columns(batch), np.zeros((margins, len(batch)))]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], ["key", "label", "fold", "bins", "margins"])

        for batch in batches:
            held += [batch] if len(batch) else []
            if sum(map(len, held)) >= BLOCK:
                yield block()
                held.clear()
        if held:
            yield block()

    return rows.select("key", "label", "fold", "bins").mapInArrow(packed, PACKED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """key, label, fold, bins by feature and margins by model of each block."""
    for batch in batches:
        for row in range(len(batch)):
            key, label, fold, bins, margins = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("key", np.int64), ("label", np.float64), ("fold", np.int32), ("bins", np.uint8), ("margins", np.float64)))
            yield key, label, fold, bins.reshape(-1, len(key)), margins.reshape(-1, len(key))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Byte strings of one length as rows, read where they lie."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    """The bins of a batch by feature."""
    return np.ascontiguousarray(_matrix(batch.column("bins"), np.uint8).T)


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _losses(m: Model, seen: dict) -> np.ndarray:
    at = seen["stop"]
    p = np.clip(_probability(seen["margin"][at]), 1e-16, 1 - 1e-16)
    return np.array([-np.where(seen["label"][at] > 0, np.log(p), np.log(1 - p)).sum(), at.sum()])


def _together(sizes: list[int]) -> list[list[int]]:
    """Features by the cells that they are counted in: those with few bins share one, up to JOINT cells."""
    groups, cells = [], JOINT + 1
    for f in sorted(range(len(sizes)), key=lambda f: sizes[f]):
        if cells * sizes[f] > JOINT:
            groups.append([])
            cells = 1
        groups[-1].append(f)
        cells *= sizes[f]
    return groups


def _codes(columns: np.ndarray, sizes: np.ndarray, group: list[int]) -> np.ndarray:
    """The joint cell of a group's features by row, a byte."""
    out = columns[group[0]]
    for f in group[1:]:
        out = out * np.uint8(sizes[f]) + columns[f]
    return out


def _apart(sums: np.ndarray, nodes: int, groups: list[list[int]], offsets: np.ndarray) -> np.ndarray:
    """(3, nodes, cells by feature) of sums over joint cells."""
    sizes, out, low = np.diff(offsets), np.zeros((3, nodes, int(offsets[-1]))), 0
    for group in groups:
        shape = sizes[group].tolist()
        joint = sums[:, :, low : low + math.prod(shape)].reshape(3, nodes, *shape)
        low += math.prod(shape)
        for axis, f in enumerate(group):
            out[:, :, offsets[f] : offsets[f + 1]] = joint.sum(axis=tuple(2 + k for k in range(len(group)) if k != axis))
    return out


def _histograms(level: int, turn: int, trees: dict[int, Tree], offsets: np.ndarray, sampled: dict[int, np.ndarray], groups: list[list[int]] | None = None, counted: dict[int, np.ndarray] | None = None) -> Measure:
    """Gradient, hessian and count by node of a level and cell; before the first level also the loss so far. Only the
    features that a model may split by are counted, and the first one, which tells the totals; ``groups`` are counted together,
    in joint cells. ``counted``: the nodes of each model whose rows are counted, by default all."""
    nodes, sizes = 1 << level, np.diff(offsets)
    groups = groups or [[f] for f in range(len(sizes))]
    width = [math.prod(sizes[g].tolist()) for g in groups]
    ends = np.r_[0, np.cumsum(width)]
    wanted = {i: [k for k, g in enumerate(groups) if {0, *features.tolist()} & set(g)] for i, features in sampled.items()}

    def measure(i: int, m: Model, seen: dict) -> np.ndarray:
        draws, p = seen["draws"], m.point
        if turn not in draws:
            draws[turn] = uniforms(seen["key"], turn + 2)
            draws["cells"] = [_codes(seen["columns"], sizes, g) for g in groups]
        alike = ("rows", p.held, p.stop_share, p.subsample)
        if alike not in draws:  # models that learn from the same rows share their cells and, at the root, their counts
            at = np.flatnonzero(seen["learn"] & (draws[turn] < p.subsample))
            cells = [c[at] for c in draws["cells"]]
            draws[alike] = at, cells, [np.bincount(c, None, w) for c, w in zip(cells, width, strict=True)] if level == 0 else []
        at, cells, counts = draws[alike]
        sums = np.zeros((3, nodes, int(ends[-1])))
        if level:
            node = trees[i].leaves(seen["columns"])[at].astype(np.int64) - (nodes - 1)
            among = np.flatnonzero((node >= 0) & (True if counted is None else counted[i][np.maximum(node, 0)]))
            at, node = at[among], node[among]
        probability, weight = _probability(seen["margin"][at]), seen["weight"][at]
        gradient, hessian = (probability - seen["label"][at]) * weight, probability * (1 - probability) * weight
        for k in wanted[i]:
            cell, n = cells[k][among] + node * width[k] if level else cells[k], nodes * width[k]
            for place, x in enumerate((gradient, hessian)):
                sums[place, :, ends[k] : ends[k + 1]] = np.bincount(cell, x, n).reshape(nodes, -1)
            sums[2, :, ends[k] : ends[k + 1]] = np.bincount(cell, None, n).reshape(nodes, -1) if level else counts[k]
        return np.concatenate([sums.ravel(), _losses(m, seen)]) if level == 0 else sums.ravel()

    return measure


def _finished(nodes: int, groups: list[list[int]], offsets: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A task's sums by feature; what stands behind the tables (the loss) stays."""
    width = sum(math.prod(np.diff(offsets)[g].tolist()) for g in groups)

    def finish(sums: np.ndarray) -> np.ndarray:
        table, rest = sums[: 3 * nodes * width], sums[3 * nodes * width :]
        return np.concatenate([_apart(table.reshape(3, nodes, width), nodes, groups, offsets).ravel(), rest])

    return finish


def _lighter(tree: Tree, level: int, table: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of the next level's nodes the child with fewer rows of each node that was split: its sibling's sums are what is left."""
    nodes = 1 << level
    out = np.zeros(2 * nodes, bool)
    for node in range(nodes):
        f, cut = int(tree.feature[nodes - 1 + node]), int(tree.cut[nodes - 1 + node])
        if f >= 0:
            counts = table[node, 2, offsets[f] : offsets[f + 1]]
            out[2 * node + int(2 * counts[: cut + 1].sum() > counts.sum())] = True
    return out


def _with_siblings(found: np.ndarray, above: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The sums of a level, of which only the ``counted`` nodes were summed: the others are what these leave of the node above."""
    at = np.flatnonzero(counted)
    found[at ^ 1] = above[at >> 1] - found[at]
    return found


def _with_margins(rows: DataFrame, models: list[Model], place: list[int]) -> DataFrame:
    """The table with the margins at ``place`` alone, the trees of ``models`` added to them."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (_, _, _, columns, margins) in enumerate(_blocks([batch])):
                data = b"".join((margins[at] + m.margins(columns)).tobytes() for at, m in zip(place, models, strict=True))
                yield batch.slice(row, 1).set_column(batch.schema.get_field_index("margins"), "margins", pa.array([data], pa.binary()))

    return rows.mapInArrow(added, PACKED)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _gains(sums: np.ndarray, offsets: np.ndarray, features: np.ndarray, p: Point) -> tuple[np.ndarray, ...]:
    """Of all cuts of (nodes, 3, cells): feature by cell, whether it may be cut there, sums on the left and right, and gain."""
    of_cell = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    allowed = np.isin(of_cell, features)
    allowed[offsets[1:] - 1] = False  # nothing lies to the right of a feature's last bin
    run = np.cumsum(sums, axis=2)
    left = run - np.concatenate([np.zeros((*sums.shape[:2], 1)), run], axis=2)[:, :, offsets[:-1]][:, :, of_cell]
    total = sums[:, :, : offsets[1]].sum(axis=2)[:, :, None]
    right = total - left
    score = lambda x: _shrunk(x[:, 0], p.reg_alpha) ** 2 / np.maximum(x[:, 1] + p.reg_lambda, 1e-16)
    return of_cell, allowed, left, right, score(left) + score(right) - score(total)


def best_splits(sums: np.ndarray, offsets: np.ndarray, features: np.ndarray, p: Point, gains: tuple[np.ndarray, ...] | None = None) -> list[tuple | None]:
    """For each node of (nodes, 3, cells) its best split, or None: (feature, cut, left g, left h, right g, right h).

    Gain: the rise of T(G)^2 / (H + lambda) over both sides, T shrinking G by alpha; it must reach gamma, and each side
    the least hessian and rows. Equal gains go to the first feature and cut. ``gains``: these of ``_gains``, if known.
    """
    of_cell, allowed, left, right, gain = gains or _gains(sums, offsets, features, p)
    fits = allowed & (np.minimum(left[:, 1], right[:, 1]) >= p.min_child_weight) & (np.minimum(left[:, 2], right[:, 2]) >= max(p.min_rows, 1))
    gain = np.where(fits, gain, -np.inf)
    most = gain.max(axis=1)
    at = np.argmax(gain > (most - 1e-9 * np.maximum(1.0, np.abs(most)))[:, None], axis=1)
    found: list[tuple | None] = []
    for node, cell in enumerate(at.tolist()):
        f = int(of_cell[cell])
        good = fits[node].any() and gain[node, cell] > 1e-6 and gain[node, cell] >= p.gamma
        found.append((f, cell - int(offsets[f]), *left[node, :2, cell], *right[node, :2, cell]) if good else None)
    return found


def _leaf(g: float, h: float, p: Point) -> float:
    return float(-p.rate * _shrunk(np.array(g), p.reg_alpha) / max(h + p.reg_lambda, 1e-16))


def _stops(m: Model) -> bool:
    """Whether ``patience`` rounds have passed without a lower loss, or all rounds are done."""
    best, since = math.inf, 0  # the first loss is that of no tree
    for loss in m.losses:
        best, since = (loss, 0) if loss < best - m.point.tolerance else (best, since + 1)
    return since >= m.point.patience or len(m.trees) >= m.point.rounds


def _starts(rows: DataFrame, models: dict[int, Model], tasks: int) -> None:
    """Each model's weight of positive rows and its first margin, the log odds of the weighted rows it learns from."""
    counts = _pass(rows, models, dict.fromkeys(models, 0), dict.fromkeys(models, 0), lambda i, m, seen: np.array([seen["learn"].sum(), (seen["learn"] & (seen["label"] > 0)).sum()]), tasks, 16 * len(models))
    for i, (n, positive) in counts.items():
        m, negative = models[i], n - positive
        m.positive = negative / positive if m.point.balanced and positive and negative else 1.0
        m.start = math.log(positive * m.positive / negative) if positive and negative else 0.0


def _kind(p: Point) -> Point:
    """The point without what decides only whether a split is taken and when the model stops."""
    return replace(p, min_child_weight=0.0, min_rows=0, gamma=0.0, rounds=0, patience=0, tolerance=0.0, best=False)


def grow(rows: DataFrame, points: list[Point], cuts: list[np.ndarray], seed: int = 42) -> list[Model]:
    """The models of all points on ``rows`` (key: long, label, fold: int, bins).

    A pass serves all points that still grow, so jobs grow with rounds and depth, not with points. Points of one kind
    are twins until their splits differ: a pass counts for one of them, and the table holds one margin for all. Labels are
    0 or 1. Where there is nothing to split trees are single leaves; without rows there are no trees.
    """
    offsets = np.r_[0, np.cumsum([len(c) + 1 for c in cuts])]
    groups = _together(np.diff(offsets).tolist())
    models = {i: Model(p) for i, p in enumerate(points)}
    kinds = list(dict.fromkeys(_kind(p) for p in points))
    twin = {i: kinds.index(_kind(p)) for i, p in enumerate(points)}
    place = dict(twin)  # where the written margin of each model stands
    state = saved(_packed(rows.select("key", "label", "fold", "bins").repartition(_tasks(rows)), len(kinds)), "boosting")
    written, turn = dict.fromkeys(models, 0), 0
    tasks = state.rdd.getNumPartitions()  # asked once for each table, as it plans the scan
    _starts(state, models, tasks)
    growing = dict(models)
    while growing:
        trees = {i: Tree.of(m.point.max_depth) for i, m in growing.items()}
        columns = {i: np.random.default_rng([seed, turn]).choice(len(cuts), max(1, int(len(cuts) * m.point.colsample)), replace=False) for i, m in growing.items()}
        level, active, tables, counted = 0, _by_twin(growing, twin), {}, {i: np.ones(1, bool) for i in growing}
        while active:
            measure = _histograms(level, turn, {i: trees[i] for i in active}, offsets, {i: columns[i] for i in active}, groups, {i: counted[i] for i in active})
            sums = _pass(state, {i: models[i] for i in active}, written, place, measure, tasks, len(active) * (24 * (1 << level) * int(offsets[-1]) + 16), _finished(1 << level, groups, offsets))
            below: dict[int, list[int]] = {}
            for i, alike in active.items():
                found, going = sums.get(i), alike
                if found is not None and level == 0:
                    found, (loss, n) = found[:-2], found[-2:]
                    for j in alike:
                        models[j].losses.append(loss / n if n else 0.0)
                if found is None or level == 0:
                    going = [j for j in alike if found is not None and not _stops(models[j])]
                    for j in set(alike) - set(going):
                        del growing[j]
                if not going:
                    continue
                table = found.reshape(3, 1 << level, -1).transpose(1, 0, 2)
                table = _with_siblings(table.copy(), tables[i], counted[i]) if level else table
                gains, apart = _gains(table, offsets, columns[i], models[i].point), {}
                for j in going:
                    more = _split(trees[j], level, table, offsets, columns[j], models[j].point, gains) and level + 1 < models[j].point.max_depth
                    apart.setdefault((more, trees[j].feature.tobytes(), trees[j].cut.tobytes()), []).append(j)
                for (more, _, _), same in apart.items():
                    twin |= dict.fromkeys(same, len(points) + same[0]) if len(apart) > 1 else {}
                    if more:
                        below[same[0]], tables[same[0]], counted[same[0]] = same, table, _lighter(trees[same[0]], level, table, offsets)
            level, active = level + 1, below
        for i, m in growing.items():
            m.trees.append(trees[i])
        turn += 1
        if turn % WRITE == 0 and growing:
            one = _by_twin(growing, twin)
            old, state = state, saved(_with_margins(state, [replace(models[i], trees=models[i].trees[written[i] :]) for i in one], [place[i] for i in one]), "boosting")
            place = {j: at for at, alike in enumerate(one.values()) for j in alike}
            written, tasks = {i: len(m.trees) for i, m in models.items()}, state.rdd.getNumPartitions()
            drop(old)
    drop(state)
    for m in models.values():
        if m.point.best and m.losses:
            m.trees = m.trees[: int(np.argmin(m.losses))]
    return list(models.values())


def _tasks(rows: DataFrame) -> int:
    """Equal tasks for every core, fewer for few rows, more for very many."""
    n, (least, most) = rows.count(), TASK_ROWS
    return max(1, min(n // least, rows.sparkSession.sparkContext.defaultParallelism), -(-n // most))


def _by_twin(growing: dict[int, Model], twin: dict[int, int]) -> dict[int, list[int]]:
    """The models that still grow by the first of their twins."""
    out: dict[int, list[int]] = {}
    for i in growing:
        out.setdefault(twin[i], []).append(i)
    return {alike[0]: alike for alike in out.values()}


def _split(tree: Tree, level: int, table: np.ndarray, offsets: np.ndarray, columns: np.ndarray, p: Point, gains: tuple[np.ndarray, ...]) -> bool:
    """Splits the nodes of a level; whether any was split."""
    splits, first = best_splits(table, offsets, columns, p, gains), (1 << level) - 1
    if level == 0:
        g, h, _ = table[0][:, : offsets[1]].sum(axis=1)
        tree.value[0] = _leaf(g, h, p)
    for node, split in enumerate(splits, first):
        if split is not None:
            tree.feature[node], tree.cut[node], lg, lh, rg, rh = split
            tree.value[2 * node + 1], tree.value[2 * node + 2] = _leaf(lg, lh, p), _leaf(rg, rh, p)
    return any(s is not None for s in splits)


def scores(rows: DataFrame, models: list[Model], keep: list[str], upto: list[int | None] | None = None) -> DataFrame:
    """``keep``, point and predicted_probability of rows with bins: of each model, after its first ``upto`` trees."""
    ends = upto or [None] * len(models)
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                columns = _columns(batch)
                for i, (m, end) in enumerate(zip(models, ends, strict=True)):
                    p = _probability(m.start + m.margins(columns, 0, end))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.full(len(batch), i, np.int32)), pa.array(p)], [*keep, "point", "predicted_probability"])

    return rows.select(*keep, "bins").mapInArrow(scored, f"{fields}, point int, predicted_probability double")
