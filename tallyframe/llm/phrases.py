"""Phrase collocations from a weighted de Bruijn graph of word 4-grams.

Nodes are three words in a row, an edge is the 4-gram that leads from one node to the next. A block of texts becomes the
graph of its frequent words (those that a candidate may hold), whose unary paths are compacted: a passage is one path with
a weight, however often the block repeats it. Paths open into edges, which are summed over all blocks. A node's count is
its outgoing flow plus the piece ends that stand in it, written as edges to nothing; that of a pair is the flow of its
nodes and ends in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch, blocks, byte_column

BLOCK = 1 << 21
LEAST = 30
FIRST = 2_000
#: Edges that a task opens before it deals them out, and words of the corpus for each bucket.
EDGES = 1 << 18
BUCKET = 200_000
#: Longer phrases with so many hundredths of a candidate's count take its place.
SHARE = 80
SCALE = 2_000_000
#: Candidates that one task of a ranking may hold before they are ranked in two steps.
RANKED = 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_TAIL = re.compile(rb"(?:[\x20\x09]*[^\x20\x09.,;:!?\x0A-\x0D]+){0,3}")
_GRAM = ["w1", "w2", "w3", "w4"]


def _parts(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, end with what follows): parts of one text, cut after a sign that is in no word; up to three words follow."""
    while low < high:
        cut = min(high, low + BLOCK)
        if cut < high:
            between = np.flatnonzero(_KIND[data[low:cut]])
            if not len(between):
                later = next((at for at in range(cut, high, BLOCK) if _KIND[data[at : min(high, at + BLOCK)]].any()), None)
                between = [high - low - 1] if later is None else [later - low + np.flatnonzero(_KIND[data[later : min(high, later + BLOCK)]])[0]]
            cut = low + int(between[-1]) + 1
        end, size = cut, 1 << 10
        while cut < high and _KIND[data[cut - 1]] != 2:
            end = cut + _TAIL.match(data[cut : min(high, cut + size)].tobytes()).end()
            if end < cut + size or cut + size >= high:
                break
            size *= 2
        yield low, cut, end
        low = cut


def _stream(data: np.ndarray, offsets: np.ndarray, cut: int) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """(distinct words, how often each stands before ``cut``, places of words in order with -1 between pieces, words from ``cut`` on)."""
    kind = _KIND[data]
    word = kind == 0
    start = word & np.r_[True, ~word[:-1]]
    start[offsets[:-1][offsets[:-1] < len(data)]] |= word[offsets[:-1][offsets[:-1] < len(data)]]
    at = np.flatnonzero(start)
    edge = np.r_[np.flatnonzero(start[word]), np.count_nonzero(word)]
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(_LOWER[data[word]])).dictionary_encode()
    index = words.indices.to_numpy()
    piece = np.cumsum(kind == 2)[at] + np.searchsorted(offsets, at, "right")
    ends = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    own = int(np.searchsorted(at, cut))
    counts = np.bincount(index[:own], minlength=len(words.dictionary))
    return words.dictionary, counts, np.insert(index, ends, -1), len(at) - own


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block, whose texts are of one language."""
    from pyspark import TaskContext

    context = TaskContext.get()
    count = (context.partitionId() if context else 0) << 32
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            data, at = byte_column(batch.column("text").filter(pa.array(langs.indices.to_numpy() == code)))
            for low, high in blocks(at, BLOCK):
                whole = (int(at[low]), int(at[high]), int(at[high]))
                for begin, cut, end in [whole] if high - low > 1 else _parts(data, whole[0], whole[1]):
                    edge = at[low : high + 1] - begin if high - low > 1 else np.array([0, end - begin])
                    words, counts, stream, tail = _stream(data[begin:end], edge, cut - begin)
                    if len(words):
                        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
                        columns = [pa.array([count]), pa.array([lang]), one(stream, pa.int32()), pa.array([tail]), one(words, None), one(counts, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "stream", "tail", "words", "counts"])
                        count += 1


def compacted(x: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of all paths, offsets, weights): the unary paths of the 4-gram graph of ``x``, 0 between runs of words.

    Grams start in the first ``starts`` places; one that meets the end of its run goes on with zeros. Windows of
    four over a path are its distinct edges, and its weight is the count of each.
    """
    n, wide = len(x), np.r_[x, 0, 0, 0].astype(np.int64)
    y1 = wide[1 : n + 1]
    y2 = np.where(y1 > 0, wide[2 : n + 2], 0)
    y3 = np.where(y2 > 0, wide[3 : n + 3], 0)
    size = int(x.max(initial=0)) + 1
    _, pair = np.unique(x * size + y1, return_inverse=True)
    _, node = np.unique(pair * size + y2, return_inverse=True)
    begin = np.flatnonzero(x[:starts] > 0)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    _, first, weight = np.unique(node[begin] * size + y3[begin], return_index=True, return_counts=True)
    order = np.argsort(first)  # of distinct edges, as the texts first hold them
    first, weight = begin[first[order]], weight[order]
    onward = y1[first] > 0
    to = node[np.minimum(first + 1, n - 1)]
    nodes = int(node.max()) + 1
    outward, inward = np.bincount(node[first], minlength=nodes), np.bincount(to[onward], minlength=nodes)
    # an edge goes on in the next one, if the node between has no other edge and no piece begins or ends in it
    joins = (first[1:] == first[:-1] + 1) & onward[:-1] & (outward[to[:-1]] == 1) & (inward[to[:-1]] == 1) & (weight[1:] == weight[:-1])
    head = np.flatnonzero(np.r_[True, ~joins])
    length = np.diff(np.r_[head, len(first)])
    last = first[head] + length - 1
    offsets = np.r_[0, np.cumsum(length + 3)]
    words = wide[np.repeat(first[head] - offsets[:-1], length + 3) + np.arange(offsets[-1])]
    for k, y in enumerate((y1, y2, y3)):
        words[offsets[1:] - 3 + k] = y[last]
    return words, offsets, weight[head]


def _paths(block: pa.Table, known: pa.Table) -> pa.Table:
    """The compacted graph of one block; words are their ids."""
    stream = block.column("stream").combine_chunks().flatten().to_numpy()
    ids = np.r_[0, known.column("id").to_numpy()]
    local = np.zeros(int(stream.max(initial=0)) + 2, np.int64)  # the last one is for the end of a piece
    local[known.column("place").to_numpy()] = np.arange(1, len(ids))
    tail = block.column("tail")[0].as_py()
    starts = np.flatnonzero(stream >= 0)[-tail] if tail else len(stream)
    words, offsets, weight = compacted(local[stream], int(starts))
    return pa.table({"path": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[words])), "n": weight})


def _planes(values: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on: the high bytes of small numbers compress to nothing."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _summed(w: list[np.ndarray], n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, sum) of runs of equal first k words."""
    new = np.zeros(len(n), bool)
    new[:1] = True
    for x in w[:k]:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return at, np.add.reduceat(n, at) if len(at) else n


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Paths open into edges; a row holds those of one bucket. Grams of one pair share a bucket, or if both words are hot
    those of one node, or if all three are those of one edge. Ends after a single word are left out, as words are counted."""
    held, size = [], 0

    def dealt() -> pa.RecordBatch:
        *w, n = (np.concatenate(c) for c in zip(*held, strict=True))
        slot, hot = w[0].astype(np.uint64), w[0] & 1
        for k in (1, 2, 3):
            deeper = (slot ^ (slot >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[k].astype(np.uint64)
            slot = deeper if k == 1 else np.where(hot > 0, deeper, slot)
            hot = hot & w[k]
        slot = (slot ^ (slot >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((slot ^ (slot >> np.uint64(33))) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((w[3], w[2], w[1], w[0], bucket))
        bucket, w, n = bucket[order], [x[order] for x in w], n[order]
        at, n = _summed([bucket, *w], n, 5)
        bucket, w = bucket[at], [x[at] for x in w]
        side = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        packed = [[_planes(x[low:high]) for low, high in zip(side, side[1:], strict=False)] for x in (*w, n)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[side[:-1]]), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", *_GRAM, "n"])

    for batch in batches:
        paths = batch.column("path")
        offsets = paths.offsets.to_numpy() - paths.offsets[0].as_py()
        words, length = paths.flatten().to_numpy(), np.diff(offsets) - 3
        at = np.repeat(offsets[:-1] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        at = at[words[at + 1] > 0]
        if len(at):
            path = np.searchsorted(offsets, at, "right") - 1
            held.append([*(words[at + k] for k in range(4)), batch.column("n").to_numpy()[path]])
            size += len(at)
        if size >= EDGES:
            yield dealt()
            held, size = [], 0
    if size:
        yield dealt()


def _flows(bucket: pa.Table) -> pa.Table:
    """Sums of one bucket's grams for each edge, node and pair: parts of sums where words are hot, else complete ones of LEAST or more."""
    *w, n = (np.concatenate([_numbers(x.as_buffer()) for x in bucket.column(c)]) for c in (*_GRAM, "n"))
    order = np.lexsort(w[::-1])
    w, n = [x[order] for x in w], n[order]
    hot, made = w[0] & 1, []
    for k in (2, 3, 4):
        at, total = _summed(w, n, k)
        hot = hot & w[k - 1]
        keep = (w[k - 1][at] > 0) & ((hot[at] > 0) & (k < 4) | (total >= LEAST))
        made.append([x[at[keep]] if i < k else np.zeros(keep.sum(), np.int64) for i, x in enumerate(w)] + [total[keep]])
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], [*_GRAM, "n"])


def hot_above(every: int) -> int:
    """The count above which words are hot: a pair has no more rows than its rarer word, so pairs of hot words alone are
    spread over tasks. The last bit of a word's id says whether it is hot; sums are the same either way."""
    return max(10_000, min(1_000_000, every // 2_000))


def gram_counts(docs: DataFrame, lang_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, words, totals) of all texts.

    grams: w1 to w4 (ids, 0 after the end) and n, for each run of 2 to 4 words with n of LEAST or more.
    words: id, lang, word, n, for words with LEAST or more. totals: lang, n of all words.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    encoded = scratch.save(rows.mapInArrow(_encoded, "block long, lang string, stream array<int>, tail long, words array<string>, counts array<long>"))
    held = encoded.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("block", "lang", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = scratch.save(held.groupBy("lang").agg(F.sum("n").alias("n")))
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot = hot_above(every)
    words = held.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    words = scratch.save(words.withColumn("id", (F.monotonically_increasing_id() + 1) * 2 + (F.col("n") > hot).cast("long")))
    known = held.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("home"), "place", "id")
    paths = encoded.select("block", "stream", "tail").groupBy("block").cogroup(known.groupBy("home")).applyInArrow(_paths, "path array<long>, n long")
    buckets = max(every // BUCKET, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    edges = paths.mapInArrow(lambda x: _dealt(x, buckets), "bucket long, w1 binary, w2 binary, w3 binary, w4 binary, n binary")
    sums = edges.groupBy("bucket").applyInArrow(_flows, "w1 long, w2 long, w3 long, w4 long, n long")
    grams = scratch.save(sums.groupBy(*_GRAM).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    scratch.drop(encoded)
    return grams, words, totals


def _key(*ids: str) -> list[Column]:
    return [F.col(c).alias(f"k{i}") for i, c in enumerate(ids)] + [F.lit(0).cast("long").alias(f"k{i}") for i in range(len(ids), 3)]


def _subphrases() -> Column:
    """What the count or spelling of which a phrase of k words needs: its words, and first and last parts of 2 or 3 words."""
    spans = [(i, i + 1) for i in range(4)] + [(0, 2), (0, 3), (1, 3), (1, 4), (2, 4)]
    rows = [F.when((F.col("k") >= to) & ((to - low == 1) | (low == 0) & (to < F.col("k")) | (low > 0) & (to == F.col("k"))), F.struct(F.lit(low).alias("low"), F.lit(to).alias("to"), *_key(*_GRAM[low:to]))) for low, to in spans]
    return F.array_compact(F.array(*rows))


def _length() -> Column:
    return sum(((F.col(c) > 0).cast("int") for c in _GRAM), F.lit(0))


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase that no longer one replaces."""
    counts = grams.where("w4 = 0").select(*_key(*_GRAM[:3]), "n", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word"))
    counts = counts.unionByName(words.select(*_key("id"), "n", "lang", "word"))
    candidates = grams.withColumn("k", _length())
    needed = candidates.select(*_GRAM, "k", F.col("n").alias("a"), F.inline(_subphrases()))
    met = needed.join(counts, ["k0", "k1", "k2"])
    at = lambda low, to, c: F.max(F.when((F.col("low") == low) & (F.col("to") == to), F.col(c)))
    spans = [(low, to) for low in range(4) for to in range(low + 1, 5) if to - low < 4]
    wide = met.groupBy(*_GRAM, "k", "a").agg(F.max("lang").alias("lang"), *(at(low, to, "n").alias(f"n{low}{to}") for low, to in spans), *(at(i, i + 1, "word").alias(f"t{i}") for i in range(4)))
    cuts = []
    for k in (2, 3, 4):
        for c in range(1, k):
            left, right = F.col(f"n0{c}"), F.col(f"n{c}{k}")
            score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(n0{c} as decimal(20, 0)) + n{c}{k})")
            cuts.append(F.when(F.col("k") == k, F.struct(score.alias("score"), F.lit(c).alias("c"), left.alias("l"), right.alias("r"))))
    best = wide.withColumn("best", F.array_min(F.array(*cuts)))
    whole = F.when(F.col("w4") > 0, F.array(F.struct(*_key("w1", "w2", "w3")), F.struct(*_key("w2", "w3", "w4")))).when(F.col("w3") > 0, F.array(F.struct(*_key("w1", "w2")), F.struct(*_key("w2", "w3"))))
    cover = grams.select("n", F.inline(whole)).groupBy("k0", "k1", "k2").agg(F.max("n").alias("cover"))
    cover = cover.select(F.col("k0").alias("w1"), F.col("k1").alias("w2"), F.col("k2").alias("w3"), F.lit(0).cast("long").alias("w4"), "cover")
    kept = best.join(cover, _GRAM, "left").where(F.expr(f"cover is null or 100 * cast(cover as decimal(20, 0)) < {SHARE} * cast(a as decimal(20, 0))"))
    return kept.select("lang", F.concat_ws(" ", "t0", "t1", "t2", "t3").alias("phrase"), "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", first: int = FIRST) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to 4 words of one piece. A null text is empty, a null language is ``und``; repeated rows all count, no
    rows give no rows, and other columns are not read. Long texts are read in parts that share three words. Equal scores
    go by count, then by the phrase's bytes.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    grams, words, totals = gram_counts(docs, lang_col, text_col, scratch)
    found, left = scratch.save(scored(grams, words)), grams.count()
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while left > 2 * RANKED:  # the first of each part hold the first of all
        lanes = left // RANKED + 1
        part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(lanes))).orderBy(*order)
        found, left = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= first).drop("rank"), min(left - 1, lanes * first)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals.withColumnRenamed("n", "n_"), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_").alias("n"), "score")
