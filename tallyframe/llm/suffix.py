"""Suffix-array deduplication of byte strings that occur more than once.

A string of ``length`` bytes that starts at two places has the same anchor in both: the least hash of its
k-grams. So each text is cut into runs of start positions with one anchor, anchors that occur once are put
aside, and what is left is dealt out by anchor: all places where a string can occur again meet in one shard.
Each shard sorts its suffixes by Larsson-Sadakane refinement, measures common prefixes as Kasai does, and
marks the starts whose prefix is long enough. An anchor with very many places is divided among shards; their
strings meet by their hashes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch, blocks, byte_column, whole_groups

LENGTH = 400
GRAM = 128
BLOCK = 1 << 18
#: Longer texts are read in pieces of so many start positions; pieces overlap, so nothing is lost.
PIECE = 1 << 22
PLACE_BITS = 24
#: Places of one anchor above which they are divided among shards.
HOT = 1_000
SHARD_ROWS = 1_500
#: Bytes of regions that are sorted together at most, unless one group of an anchor has more.
SHARD_BYTES = 1 << 20
LANES = 64
_BASE = 0xD6E8FEB86659FD93
_SPREAD = np.uint64(0x9FB21C651E98DF25)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _table(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(BLOCK.bit_length(), n.bit_length()))[:n]


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes that depends on these bytes only."""
    n = len(text)
    total = np.r_[np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _table(_BASE, n))]
    h = (total[k:] - total[: n - k + 1]) * _table(pow(_BASE, -1, 1 << 64), n - k + 1)
    h = (h ^ (h >> np.uint64(32))) * _SPREAD
    return h ^ (h >> np.uint64(28))


def anchors(text: np.ndarray, edge: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash) for the texts text[edge[i]:edge[i+1]]; starts count from the text's begin."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(text) < length:
        return none
    h = gram_hashes(text, gram)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    grams, width = length - gram + 1, 1
    while width * 2 <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if grams > width:
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    start = np.arange(len(text) - length + 1)
    row = np.searchsorted(edge, start, "right") - 1
    whole = start + length <= edge[row + 1]
    start, row, at = start[whole], row[whole], (least[: len(start)] & place)[whole].astype(np.int64)
    if not len(start):
        return none
    new = np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    base = edge[row[first]]
    return row[first], start[first] - base, start[last] - base, h[at[first]]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in their order: doubling that touches only groups not yet told apart."""
    n = len(text)
    b = n.bit_length()
    assert 3 * b <= 63, "shards are kept under 2 MB"
    width = (63 - b) // 8
    padded = np.r_[text, np.zeros(width, np.uint8)]
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key << np.uint64(8)) | padded[i : i + n]
    packed = np.sort((key << np.uint64(b)) | np.arange(n, dtype=np.uint64))
    sa = (packed & np.uint64((1 << b) - 1)).astype(np.int64)
    head = np.r_[True, (packed[1:] >> np.uint64(b)) != (packed[:-1] >> np.uint64(b))]
    rank = np.zeros(n + 1, np.int64)  # 0: past the end; else one more than where the group begins
    h = width
    while True:
        begin = np.flatnonzero(head)
        rank[sa] = np.repeat(begin, np.diff(np.r_[begin, n])) + 1
        mixed = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(mixed):
            return sa
        suffix = sa[mixed]
        group, then = rank[suffix], rank[np.minimum(suffix + h, n)]
        packed = np.sort((group.astype(np.uint64) << np.uint64(2 * b)) | (then.astype(np.uint64) << np.uint64(b)) | np.arange(len(mixed), dtype=np.uint64))
        sa[mixed] = suffix[(packed & np.uint64((1 << b) - 1)).astype(np.int64)]
        packed >>= np.uint64(b)
        head[mixed] |= np.r_[True, packed[1:] != packed[:-1]]
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``sa``, the prefix it shares with the place before, ``most`` at most.

    Kasai's rule (the next suffix of the text shares at most one byte less) on LANES stretches side by side.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(16, np.uint8)]
    word = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    lane = np.arange(0, n, LANES)
    shared = np.zeros(len(lane), np.int64)
    for step in range(LANES):
        i = lane + step
        i = i[i < n]
        j, l = before[i], np.maximum(shared[: len(i)] - 1, 0)
        room = np.where(j < 0, 0, np.minimum(n - np.maximum(i, j), most))
        go = np.flatnonzero(l < room)
        while len(go):
            x = word[i[go] + l[go]] ^ word[j[go] + l[go]]
            l[go] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            go = go[(x == 0) & (l[go] < room[go])]
        l = np.minimum(l, room)
        out[i], shared[: len(i)] = l, l
    return out[sa]


def repeated_starts(regions: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per region, for each start of a string of ``length`` bytes: whether it occurs at another start of any region, and a class of equal strings."""
    text = np.frombuffer(b"".join(regions), np.uint8)
    size = np.fromiter(map(len, regions), np.int64, len(regions))
    edge = np.r_[0, np.cumsum(size)]
    sa = suffix_array(text)
    prefix = common_prefixes(text, sa, length)
    left = np.repeat(edge[1:], size) - np.arange(len(text))
    full = np.flatnonzero(left[sa] >= length)
    low = np.minimum.reduceat(np.r_[prefix, 0], np.r_[0, full + 1])[:-1]
    same = np.r_[False, low[1:] >= length]
    kind = np.cumsum(~same)
    count = np.bincount(kind, minlength=kind[-1] + 1)
    flag, of = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
    flag[sa[full]], of[sa[full]] = count[kind] > 1, kind
    return [flag[a : b - length + 1] for a, b in zip(edge[:-1], edge[1:], strict=True)], [of[a : b - length + 1] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            data, offsets = byte_column(batch.column(1))
            for low, high in blocks(offsets, BLOCK):
                begin, end = offsets[low], offsets[high]
                pieces = [(begin, end, offsets[low : high + 1] - begin)] if end - begin <= PIECE else [(p, min(end, p + PIECE + length - 1), None) for p in range(begin, end, PIECE)]
                for a, b, edge in pieces:
                    row, first, last, h = anchors(data[a:b], np.array([0, b - a]) if edge is None else edge, length, gram)
                    yield pa.record_batch({"key": keys.take(pa.array(row + low)), "anchor": pa.array(h.view(np.int64)), "first": pa.array((first + (a - begin) * (edge is None)).astype(np.int32)), "last": pa.array((last + (a - begin) * (edge is None)).astype(np.int32))})

    return run


def _regions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"anchor": [], "salt": [], "region": [], "key": [], "starts": []}
            for key, text, hits in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("hits"), strict=True):
                text, found = text.as_py(), defaultdict(list)
                for anchor, first, last, parts in zip(*(x.to_pylist() for x in hits.values.flatten()), strict=True):
                    found[anchor, text[first : last + length], parts].append(first)
                for (anchor, region, parts), starts in found.items():
                    # by text and region, so that neither one text nor one common region fills a shard
                    salt = xxhash.xxh64_intdigest(key + region) % parts if parts > 1 else -1
                    for column, x in zip(out.values(), (anchor, salt, region, key, starts), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(out["anchor"], pa.int64()), pa.array(out["salt"], pa.int32()), pa.array(out["region"], pa.binary()), pa.array(out["key"], pa.binary()), pa.array(out["starts"], pa.list_(pa.int32()))], names=list(out))

    return run


def _runs(flag: np.ndarray) -> np.ndarray:
    """First and one past the last of each run of true."""
    change = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
    return change.reshape(-1, 2)


def _shards(members: dict[tuple, list], most: int) -> Iterator[dict[tuple, list]]:
    """Whole groups (anchor, salt) of ``members`` with at most ``most`` bytes of regions together (one group, where it alone has more)."""
    groups: dict[tuple, dict] = defaultdict(dict)
    for m, places in members.items():
        groups[m[:2]][m] = places
    held, size = {}, 0
    for group in groups.values():
        n = sum(len(m[2]) for m in group)
        if held and size + n > most:
            yield held
            held, size = {}, 0
        held, size = held | group if held else group, size + n
    if held:
        yield held


def _solve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_groups(batches, ["anchor", "salt"], SHARD_ROWS):
            members: dict[tuple, list] = defaultdict(list)
            for anchor, salt, region, key, starts in zip(*(got.column(c).to_pylist() for c in ("anchor", "salt", "region", "key", "starts")), strict=True):
                members[anchor, salt, region].append((key, starts))
            yield from (_solved(shard, length) for shard in _shards(members, SHARD_BYTES))

    return run


def _solved(members: dict[tuple, list], length: int) -> pa.RecordBatch:
    distinct: dict[tuple, int] = defaultdict(int)
    for anchor, salt, _ in members:
        distinct[anchor, salt] += 1
    # one text at all its places needs no sorting: it occurs again or it does not
    sort = [m for m in members if distinct[m[:2]] > 1 or m[1] >= 0]
    marks, kinds = (dict(zip(sort, x, strict=True)) for x in (repeated_starts([m[2] for m in sort], length) if sort else ([], [])))
    out: dict[str, list] = {"key": [], "low": [], "high": [], "h1": [], "h2": []}
    told: set[int] = set()
    for m, places in members.items():
        times = sum(len(s) for _, s in places)
        mark = np.ones(len(m[2]) - length + 1, bool) if times > 1 else marks.get(m, np.zeros(len(m[2]) - length + 1, bool))
        for low, high in _runs(mark):
            for key, starts in places:
                for s in starts:
                    for column, x in zip(out.values(), (key, s + low, s + high + length - 1, None, None), strict=True):
                        column.append(x)
        if m[1] < 0:
            continue
        for i, kind in enumerate(kinds[m].tolist()):  # to meet the other shards of this anchor
            if kind not in told:
                told.add(kind)
                h = hashlib.blake2b(m[2][i : i + length], digest_size=16).digest()
                key, s = (None, 0) if mark[i] else (places[0][0], places[0][1][0] + i)
                for column, x in zip(out.values(), (key, s, s + length, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)), strict=True):
                    column.append(x)
    return pa.record_batch([pa.array(out["key"], pa.binary()), pa.array(out["low"], pa.int32()), pa.array(out["high"], pa.int32()), pa.array(out["h1"], pa.int64()), pa.array(out["h2"], pa.int64())], names=list(out))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted strings of several shards, the places of those that more than one shard has."""
    for got in whole_groups(batches, ["h1", "h2"], 1 << 16):
        h1, h2 = got.column("h1").to_numpy(), got.column("h2").to_numpy()
        new = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        run = np.searchsorted(new, np.arange(len(h1)), "right") - 1
        times = np.diff(np.r_[new, len(h1)])[run]
        yield from got.filter(pa.array(times > 1)).select(["key", "low", "high"]).drop_null().to_batches()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text, merged = text.as_py() or b"", []
            for low, high in sorted((x["low"], x["high"]) for x in spans.as_py() or ()):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            edges = [0, *(x for s in merged for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for column, x in zip(out.values(), (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), merged), strict=True):
                column.append(x)
        yield pa.record_batch([batch.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(pa.list_(pa.int32())))], names=[batch.schema.names[0], *out])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and spans ([from, to) of removed bytes).

    A byte is removed where a string of ``length`` bytes covers it that starts anywhere else too, in this or
    another document. A null text is empty; texts under ``length`` bytes lose nothing; overlapping repeats
    count; of exact copies (repeated rows too) all are removed. An empty table gives an empty result; other
    columns are not read. Ids need not be unique: rows are told apart by their text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(raw)).alias("key"), raw.alias("text"))
    long = texts.where(F.length("text") >= length)
    copies = scratch.save(long.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.max(F.length("text")).alias("size")))
    places = scratch.save(long.select("key", "text").mapInArrow(_anchor_rows(length, gram), "key binary, anchor long, first int, last int"))
    again = scratch.save(places.groupBy("anchor").count().where("count > 1").select("anchor", F.ceil(F.col("count") / max(1, min(HOT, SHARD_BYTES // (2 * length)))).cast("int").alias("parts")))
    hits = places.join(again, "anchor").groupBy("key").agg(F.collect_set(F.struct("anchor", "first", "last", "parts")).alias("hits"))
    hits = hits.join(copies, "key").select("key", F.col("least").alias("id"), "hits")
    met = long.join(hits, (long["key"] == hits["key"]) & long["id"].eqNullSafe(hits["id"])).select(long["key"], "text", "hits")
    regions = met.mapInArrow(_regions(length), "anchor long, salt int, region binary, key binary, starts array<int>")
    found = regions.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_solve(length), "key binary, low int, high int, h1 long, h2 long")
    found = scratch.save(found)
    scratch.drop(places)
    scratch.drop(again)
    shared = found.where("h1 is not null and key is null").dropDuplicates(["h1", "h2"]).unionAll(found.where("h1 is not null and key is not null"))
    apart = shared.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(_merge, "key binary, low int, high int")
    whole = copies.where("copies > 1").select("key", F.lit(0).alias("low"), F.col("size").alias("high"))
    spans = found.where("h1 is null").select("key", "low", "high").unionAll(apart).join(whole.select("key"), "key", "left_anti").unionAll(whole)
    spans = scratch.save(spans.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans")))
    return texts.join(spans, "key", "left").select("id", "text", "spans").mapInArrow(_digest, f"id {dict(texts.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>").withColumnRenamed("id", id_col)
