"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch, blocks, byte_column, uniform

#: Coordinates of the model; with it the size of all that is collected and sent to the executors.
BITS = 18
#: Labelled rows that the fit reads at most (in expectation); a random part of them where there are more.
TRAIN_ROWS = 20_000
SHARDS = 4
EPOCHS = 3
BLOCK = 1 << 18
PIECE = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_CLASS = np.ones(256, np.uint64)  # letters; below: capitals, digits, white space, and each other sign for itself
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
for _c in range(128):
    if not chr(_c).isalnum():
        _CLASS[_c] = 256 + _c


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    return h ^ (h >> np.uint64(29))


class Carry:
    """What of a text read so far bears on its next part: the last two words and their shapes, all pairs of words, and the
    word that its last part ended in (sum and count of its bytes; sum, count and last kind of its runs), if it goes on."""

    def __init__(self) -> None:
        self.words, self.shapes, self.pairs = (np.zeros(0, np.uint64),) * 3
        self.open: tuple[np.uint64, int, np.uint64, int, np.uint64] | None = None


def _onward(x: np.uint64, n: int) -> np.uint64:
    """x times the n-th power of BASE."""
    return x * np.uint64(pow(int(BASE), n, 1 << 64))


def _glued(head: tuple, byte_sum: np.uint64, size: int, run_sum: np.uint64, runs: int, first: np.uint64, last: np.uint64) -> tuple:
    """The sums of a word from those of its head and of the rest; a run that the cut divides is one run."""
    with np.errstate(over="ignore"):
        if first == head[4]:
            run_sum, runs = (run_sum - first) * _INVERSE, runs - 1
        return head[0] + _onward(byte_sum, head[1]), head[1] + size, head[2] + _onward(run_sum, head[3]), head[3] + runs, last


def words_of(data: np.ndarray, offsets: np.ndarray, carry: Carry | None = None, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, hash of the shape) of each word of the texts data[offsets[i]:offsets[i+1]].

    A shape is a word with runs of like characters drawn together. With ``carry`` the data are the next part of one text:
    its open word goes on in the first sign, and with ``goes_on`` the word at the end stays open.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    base = offsets[0]
    text, edge = data[base : offsets[-1]], offsets - base
    n = len(text)
    if not n:
        return none
    inside = ~_SPACE[text]
    cut = np.zeros(n + 1, bool)
    cut[edge] = True
    first = inside & np.r_[True, ~inside[:-1]] | inside & cut[:-1]
    start = np.flatnonzero(first)
    last = inside & np.r_[~inside[1:], True] | inside & cut[1:]
    end = np.flatnonzero(last) + 1
    power, back = _powers(BASE, n + 1), _powers(_INVERSE, n + 1)
    total = np.r_[np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:n])]
    byte_sum = (total[end] - total[start]) * back[start]
    kind = _CLASS[text]
    change = first | np.r_[True, kind[1:] != kind[:-1]]
    place = np.cumsum(change)  # of a run; relative to the first run of its word, as powers of another base
    total = np.r_[np.uint64(0), np.cumsum(np.where(change & inside, kind, np.uint64(0)) * power[place])]
    run_sum = (total[end] - total[start]) * back[place[start]]
    doc = np.searchsorted(edge, start, "right") - 1
    if carry is not None:
        if carry.open is not None:
            head, carry.open = carry.open, None
            if len(start) and start[0] == 0:
                runs = int(place[end[0] - 1] - place[0] + 1)
                head = _glued(head, byte_sum[0], int(end[0]), run_sum[0], runs, kind[0], kind[end[0] - 1])
                byte_sum[0], run_sum[0] = head[0], head[2]
            else:
                doc, byte_sum, run_sum = np.r_[0, doc], np.r_[head[0], byte_sum], np.r_[head[2], run_sum]
        else:
            head = None
        if goes_on and len(end) and end[-1] == n:
            alone = head is not None and len(start) == 1 and start[0] == 0
            runs = int(place[n - 1] - place[start[-1]] + 1)
            carry.open = head if alone else (byte_sum[-1], int(n - start[-1]), run_sum[-1], runs, kind[n - 1])
            doc, byte_sum, run_sum = doc[:-1], byte_sum[:-1], run_sum[:-1]
    return doc, _mix(byte_sum), _mix(run_sum)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, carry: Carry | None = None, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(document of each feature, coordinate of each feature) for the texts data[offsets[i]:offsets[i+1]].

    Word 1- and 2-grams, and 1-, 2- and 3-grams of word shapes. With the shape goes whether the word is the one before
    it, and whether the pair of both was read within this text already. With ``carry`` the data are the next part of
    one text, and with ``goes_on`` not its last one; features of all parts are those of the whole.
    """
    doc, word, shape = words_of(data, offsets, carry, goes_on)
    carry = Carry() if carry is None else carry
    old = len(carry.words)
    doc, word = np.r_[np.zeros(old, np.int64), doc], np.r_[carry.words, word]
    follows = np.r_[False, doc[1:] == doc[:-1]][: len(doc)]
    before = np.where(follows, np.r_[np.uint64(7), word[:-1]][: len(word)], np.uint64(7))
    pair = _mix(word + before * BASE)
    seen = np.zeros(len(word), bool)
    order = np.lexsort((pair, doc))
    order = order[order >= old]
    seen[order[1:]] = (pair[order[1:]] == pair[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    if old:
        seen |= np.isin(pair, carry.pairs)
    shape = np.r_[carry.shapes, _mix(shape + ((word == before) & follows)[old:] * np.uint64(0x51) + seen[old:] * np.uint64(0xA7))]
    two = _mix(shape + np.r_[np.uint64(5), shape[:-1]][: len(shape)] * ODD)
    three = _mix(two + np.r_[np.uint64(5), np.uint64(5), shape[:-2]][: len(shape)] * BASE)
    third = follows & np.r_[False, follows[:-1]][: len(doc)]
    carry.words, carry.shapes = word[-2:], shape[-2:]
    carry.pairs = np.union1d(carry.pairs, pair[old:])
    new = np.arange(len(doc)) >= old
    grams = [(new, word), (new & follows, pair), (new, shape), (new & follows, two), (new & third, three)]
    shift = np.uint64(64 - bits)
    return np.concatenate([doc[m] for m, _ in grams]), np.concatenate([_mix(h[m] + np.uint64(i)) >> shift for i, (m, h) in enumerate(grams)]).astype(np.int64)


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, edges): blocks of texts; a text above PIECE bytes comes in parts."""
    for low, high in blocks(offsets, BLOCK):
        at, end = int(offsets[low]), int(offsets[high])
        if high - low > 1 or end - at <= PIECE:
            yield low, high, offsets[low : high + 1]
            continue
        for cut in range(at, end, PIECE):
            yield low, high, np.array([cut, min(end, cut + PIECE)])


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row of each feature from the first, coordinate of each feature) by blocks and parts of texts."""
    for (low, high), parts in groupby(_parts(data, offsets), lambda x: x[:2]):
        carry = Carry() if high - low == 1 else None
        for _, _, edge in parts:
            yield low, high, *features(data, edge, bits, carry, carry is not None and edge[-1] < offsets[high])


def _examples(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its coordinates and their values, count by the root of the text's feature count."""
    for (low, high), parts in groupby(_features(data, offsets, bits), lambda x: x[:2]):
        rows = high - low
        held: dict[int, np.ndarray] = {}
        for _, _, doc, at in parts:  # one part unless a text is very long
            key, count = np.unique((doc << bits) | at, return_counts=True)
            if rows == 1:
                held[0] = held.get(0, np.zeros(1 << bits, np.int64))
                held[0][key] += count
                continue
            cut = np.searchsorted(key >> bits, np.arange(rows + 1))
            for i in range(rows):
                c = count[cut[i] : cut[i + 1]]
                yield (key[cut[i] : cut[i + 1]] & ((1 << bits) - 1)), c / np.sqrt(max(c.sum(), 1))
        if rows == 1:
            at = np.flatnonzero(held[0])
            yield at, held[0][at] / np.sqrt(max(held[0].sum(), 1))


class Ftrl:
    """State of follow-the-regularised-leader updates: sums of gradients and of their squares by coordinate."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example; the last coordinate is the constant's."""
        at, x = np.r_[at, len(self.z) - 1], np.r_[x, 1.0]
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id's digits is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights of a model for label 1, learnt from labelled rows that are not held out.

    At most about ``rows`` labelled ids take part, by a hash of the id, so ids and labels alone are broadcast. Texts
    become coordinates (at most 2^bits of them each) before the sample is divided among ``SHARDS`` tasks. A task
    reads its part as a stream, in the order of a hash, and holds the state alone; after each of EPOCHS passes the states
    of all tasks are averaged by coordinate, and the next pass starts from there. Without any labelled row
    all weights are 0. Of several labels of an id the smallest counts; labels other than 0 and 1 do not.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    marked = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(id_col))
    marked = marked.groupBy(id_col).agg(F.min("_y").alias("_y"))
    there = marked.count()
    order = uniform(id_col, seed="sample")
    sample = marked.where(order < F.lit(min(1.0, rows / max(there, 1))))
    lines = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_t")).join(F.broadcast(sample), id_col)
    lines = lines.select("_t", F.col("_y").cast("double").alias("y"), uniform(id_col, seed="order").alias("o"), F.pmod(F.xxhash64(id_col), F.lit(SHARDS)).cast("int").alias("s"))

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, x) in enumerate(_examples(*byte_column(batch.column(0)), bits)):
                yield pa.record_batch([*(c.slice(i, 1) for c in batch.columns[1:]), pa.array([at], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.float64()))], names=["y", "o", "s", "at", "x"])

    coded = scratch.save(lines.mapInArrow(coordinates, "y double, o double, s int, at array<int>, x array<double>"))
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        start = docs.sparkSession.sparkContext.broadcast((z, n))

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            states: dict[int, Ftrl] = {}
            for batch in batches:
                for y, s, at, x in zip(batch.column("y"), batch.column("s"), batch.column("at"), batch.column("x"), strict=True):
                    if s.as_py() not in states:
                        states[s.as_py()] = Ftrl(*(v.copy() for v in start.value))
                    states[s.as_py()].learn(at.values.to_numpy(), x.values.to_numpy(), y.as_py())
            for state in states.values():
                at = np.flatnonzero(state.n)
                yield pa.record_batch([pa.array(at), pa.array(state.z[at]), pa.array(state.n[at])], names=["at", "z", "n"])

        parts = coded.repartitionById(SHARDS, "s").sortWithinPartitions("s", "o", "y").mapInArrow(learn, "at long, z double, n double")
        merged = parts.groupBy("at").agg((F.sum("z") / SHARDS).alias("z"), (F.sum("n") / SHARDS).alias("n")).toArrow()  # three columns; as rows they would be objects of the driver, many times their size
        at, z, n = merged["at"].to_numpy(), np.zeros(size), np.zeros(size)
        z[at], n[at] = merged["z"].to_numpy(), merged["n"].to_numpy()
        start.unpersist()
    scratch.drop(coded)
    return Ftrl(z, n).weights()


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score double: the probability of label 1, from the whole text alone.

    A null or empty text gets the score of the constant.
    """
    bits = int(len(weights) - 1).bit_length() - 1
    model = weights.astype(np.float32)
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("_t"), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(0))
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for low, high, doc, at in _features(data, offsets, bits):
                total[low:high] += np.bincount(doc, model[at], high - low)
                count[low:high] += np.bincount(doc, minlength=high - low)
            p = 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(count, 1)) + model[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], names=[*batch.schema.names[1:], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score, predicted): predicted is 1 from ``threshold`` upwards.

    Repeated rows stay repeated, an empty table gives an empty result, other columns are not read.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col, rows), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    threshold = options.pop("threshold", 0.3)
    weights = fit(docs, labels, id_col, text_col, **options)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    return score(packed, weights, "doc", "text").where(F.col("score") >= threshold).select("doc.*")
