"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

A text that holds an item of m bytes within e edits keeps at least m - q + 1 - q * e of the item's q-grams, on
diagonals (place in the text less place in the item) that lie within e of each other. Each document is scanned
once: its q-grams are looked up in an index of all items, hits are counted in bands two steps of e wide that
overlap by one step, and a band with fewer hits is dropped. What remains is aligned within its band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import blocks, byte_column

Q = 8
#: Edits allowed, as a share of an item's length.
EDITS = 0.1
BLOCK = 1 << 18
PIECE = 1 << 22
#: Bytes of items that one scan of the documents holds in memory; more items take more scans.
ITEM_BYTES = 1 << 23
_TABLE_BITS = 21
_HASH = np.uint64(0x9E3779B97F4A7C15)
_SPACE = [32, *range(9, 14)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[_SPACE] = 32


def normalised(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with capitals A-Z lowered and runs of white space as one space, and the place of each in ``data``."""
    text = _LOWER[data]
    space = text == 32
    at = np.flatnonzero(~(space & np.r_[False, space[:-1]]))
    return text[at], at


def q_grams(text: np.ndarray) -> np.ndarray:
    """The q bytes at each place as one number."""
    return np.ndarray((max(len(text) - Q + 1, 0),), "<u8", np.ascontiguousarray(text), strides=(1,)) if len(text) >= Q else np.zeros(0, np.uint64)


@lru_cache(2)
def _index(ids: tuple, texts: tuple[bytes, ...], share: float) -> ItemIndex:
    return ItemIndex(list(ids), list(texts), share)


@dataclass
class ItemIndex:
    """All q-grams of some items, sorted, with the item and place of each; edits and least hits of each item.

    Tasks are sent the items alone; a worker process builds the rest (some 30 bytes for each byte of items) and keeps it.
    """

    ids: list
    texts: list[bytes]
    share: float = EDITS
    edits: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)
    table: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((size * self.share).astype(np.int64), (size - Q) // Q)
        self.least = size - Q + 1 - Q * self.edits
        grams = [q_grams(np.frombuffer(t, np.uint8)) for t in self.texts]
        key = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.first, self.count = self.first.astype(np.int32), self.count.astype(np.int32)

    def __reduce__(self):
        return _index, (tuple(self.ids), tuple(self.texts), self.share)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, entry of the index) for all q-grams of the text that items have."""
        if self.table is None:
            self.table = np.zeros(1 << _TABLE_BITS, bool)
            self.table[(self.keys * _HASH) >> np.uint64(64 - _TABLE_BITS)] = True
        at = np.flatnonzero(self.table[(grams * _HASH) >> np.uint64(64 - _TABLE_BITS)])
        found = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[found] == grams[at]
        at, found = at[same], found[same]
        times = self.count[found]
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[found], times)
        return np.repeat(at, times), entry


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """(edits, end) of the best place of the whole item in the text on diagonals low to high; edits most + 1 where there is none."""
    width = high - low + 1
    padded = np.zeros(max(0, -low) + len(text) + len(item) + max(0, high) + 2, np.uint8)
    shift = max(0, -low)
    padded[shift : shift + len(text)] = text
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    for i in range(len(item)):
        begin = i + low + shift
        cost = row + (padded[begin : begin + width] != item[i])
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        row = np.minimum.accumulate(cost - step) + step
        if row.min() > most:
            return most + 1, 0
    k = int(row.argmin())
    return int(row[k]), min(len(item) + low + k, len(text))


def _place(item: bytes, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the item in the text, or None."""
    begin = max(0, low - most)
    window = text[begin : max(begin, high + len(item) + most)].tobytes()
    if (exact := window.find(item)) >= 0:
        return 0, begin + exact, begin + exact + len(item)
    pattern = np.frombuffer(item, np.uint8)
    edits, end = align(pattern, text, low - most, high + most, most)
    if edits > most:
        return None
    head = text[max(0, end - len(item) - most) : end]
    _, size = align(pattern[::-1], head[::-1], -most, most, most)
    return edits, max(0, end - size), end


def matches(index: ItemIndex, data: np.ndarray, edge: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, begin, end) for the texts data[edge[i]:edge[i+1]]: the best place of each item in each text."""
    text, at = normalised(data)
    return _matches(index, text, at, np.searchsorted(at, edge))


def _matches(index: ItemIndex, text: np.ndarray, at: np.ndarray, edge: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """As ``matches``, of normalised texts text[edge[i]:edge[i+1]] whose bytes come from the places ``at``."""
    place, entry = index.hits(q_grams(text))
    row = np.searchsorted(edge, place, "right") - 1
    inside = place + Q <= edge[row + 1]
    place, entry, row = place[inside], entry[inside], row[inside]
    item = index.item[entry]
    step = np.maximum(index.edits[item], 1)
    diagonal = place - edge[row] - index.place[entry]
    band = diagonal // step
    order = np.lexsort((band, item, row))
    row, item, band = row[order], item[order], band[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]) if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(row)])
    row, item, band = row[new], item[new], band[new]
    near = np.r_[(row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1), False] if len(row) else np.zeros(0, bool)
    both = count + np.where(near, np.r_[count[1:], 0], 0)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in np.flatnonzero(both >= index.least[item]).tolist():
        r, k = int(row[i]), int(item[i])
        if best.get((r, k), (1,))[0] == 0:
            continue
        e = int(index.edits[k])
        s = max(e, 1)
        found = _place(index.texts[k], text[edge[r] : edge[r + 1]], int(band[i]) * s, (int(band[i]) + 2) * s, e)
        if found and ((r, k) not in best or found < best[r, k]):
            best[r, k] = found
    return [(r, k, e, int(at[edge[r] + a]), int(at[edge[r] + b - 1]) + 1) for (r, k), (e, a, b) in best.items()]


def item_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", share: float = EDITS) -> Iterator[ItemIndex]:
    """The items in blocks of at most ITEM_BYTES (or one item). Items of fewer than Q normalised bytes hold no q-gram and take no part."""
    rows = benchmark.select(id_col, F.col(text_col).cast("string").cast("binary")).where(F.length(text_col) >= Q)
    ids, texts, size = [], [], 0
    for item_id, text in rows.toLocalIterator():
        clean = normalised(np.frombuffer(bytes(text), np.uint8))[0].tobytes().strip()
        if len(clean) < Q:
            continue
        if texts and size + len(clean) > ITEM_BYTES:
            yield ItemIndex(ids, texts, share)
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(clean)
        size += len(clean)
    if texts:
        yield ItemIndex(ids, texts, share)


def _scan(index: ItemIndex, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, edits, begin, end) for all texts of a batch. A text above PIECE bytes is read in parts. Each begins with
    the last normalised bytes of the one before, more than any item can cover, however much white space lies in them."""
    overlap = 4 * max(map(len, index.texts))
    for low, high in blocks(offsets, BLOCK):
        base, end = int(offsets[low]), int(offsets[high])
        if high - low > 1 or end - base <= PIECE:
            edge = offsets[low : high + 1] - base
            for r, k, e, a, b in matches(index, data[base:end], edge):
                yield low + r, k, e, a - int(edge[r]), b - int(edge[r])
            continue
        best: dict[int, tuple[int, int, int]] = {}
        text, at = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        for begin in range(base, end, PIECE):
            more, places = normalised(data[begin : min(end, begin + PIECE)])
            again = int(len(text) > 0 and text[-1] == 32 and more[0] == 32)  # white space that runs over the cut is one space
            text, at = np.r_[text[-overlap:], more[again:]], np.r_[at[-overlap:], places[again:] + (begin - base)]
            for _, k, *found in _matches(index, text, at, np.array([0, len(text)])):
                best[k] = min(best.get(k, tuple(found)), tuple(found))
        yield from ((low, k, *x) for k, x in best.items())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", share: float = EDITS) -> DataFrame:
    """(id, item, edits, begin, end): each item that a text holds within the edit budget, at its best place.

    begin and end count bytes of the text's UTF-8; case (A-Z) and runs of white space don't count as edits.
    The budget is ``share`` of the item's normalised length, at most (length - Q) / Q, so that at least one
    q-gram must remain. Ties go to the first place. Null or empty texts and items match nothing; repeated rows
    and repeated items each give their row; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = dict(benchmark.dtypes)[item_col]
    schema = f"id {dict(rows.dtypes)['id']}, item {kind}, edits int, begin long, end long"
    out = spark.createDataFrame([], schema)
    for index in item_indexes(benchmark, item_col, "text", share):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = byte_column(batch.column(1))
                if found := list(_scan(index, offsets, data)):
                    r, k, e, a, b = zip(*found, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array(r)), pa.array([index.ids[i] for i in k]), pa.array(e, pa.int32()), pa.array(a), pa.array(b)], names=["id", "item", "edits", "begin", "end"])

        out = out.unionAll(rows.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", share: float = EDITS) -> DataFrame:
    """``docs`` without the rows whose text holds an item; rows pass through one scan, nothing is shuffled."""
    columns = docs.columns
    for index in item_indexes(benchmark, item_col, "text", share):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = byte_column(batch.column(batch.num_columns - 1))
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in _scan(index, offsets, data)]] = False
                yield batch.filter(pa.array(clean)).select(list(range(batch.num_columns - 1)))

        free = next(n for n in (f"_bytes{i}" for i in range(len(columns) + 1)) if n not in columns)
        raw = docs.select("*", F.col(text_col).cast("string").cast("binary").alias(free))
        docs = raw.mapInArrow(run, docs.schema).select(*columns)
    return docs
