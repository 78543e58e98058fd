"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints of whole texts are computed in Arrow batches. Equal fingerprints are one node. Nodes are routed by
bit blocks (of fingerprints within d bits, some choice of blocks is equal), each bucket is sorted by Gray rank,
and runs of neighbours become index nodes whose masks hold the bits that all members share. A pair of index
nodes is cut as soon as the fixed bits of both differ in more than d places; only what remains is compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch, local_roots, one_of_each, whole_groups
from tallyframe.llm._graph import connected_components

SEED = 42
FANOUT = 8
#: Bytes of a text that are held as words at a time.
PIECE = 1 << 22
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Pairs that one step of the index walk expands at a time.
PAIRS = 1 << 18
#: Fingerprints of a bucket above which it is divided into cells that are joined two by two.
CELL = 20_000


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut at white space."""
    begin = 0
    while begin < len(text):
        space = _SPACE.search(text, begin + PIECE)
        end = space.start() if space else len(text)
        yield text[begin:end]
        begin = end


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """A bit is set where over half of the shingle hashes have it; very long texts are read piece by piece."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or b"").lower()):
        words += piece.split()
        if len(words) < shingle:
            continue
        h = shingle_hashes(words, shingle)
        n += len(h)
        for low in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[low : low + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        words = words[len(words) - shingle + 1 :]
    if not n:  # fewer words than a shingle has: all of them are one
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, doc long, fp long): a hash and the 64-bit fingerprint of each whole text; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["id", "doc", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, doc long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def routes(n: int, distance: int, bits: int = 64, most: int = 256) -> list[list[int]]:
    """Bit masks of which any two fingerprints within ``distance`` share at least one value.

    distance + r blocks leave r blocks untouched. r grows with the count of fingerprints, so that a bucket
    holds about ``most`` of them at any size.
    """
    for kept in range(1, 5):
        parts = distance + kept
        edge = [round(i * bits / parts) for i in range(parts + 1)]
        if n / 2 ** (bits * kept / parts) <= most or kept == 4:
            blocks = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(parts)]
            return [sum(x) for x in combinations(blocks, kept)]
    raise AssertionError


def linked_pairs(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group within ``distance`` bits. Rows are sorted by group and Gray rank."""
    levels = [(fp, fp, group, np.arange(len(fp)), np.ones(len(fp), np.int64))]  # bits all have, bits any has, group, first child, children
    while True:
        ands, ors, of, _, _ = levels[-1]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        size = np.diff(np.r_[starts, len(of)])
        if size.max() <= 1:
            break
        place = np.arange(len(of)) - np.repeat(starts, size)
        first = np.flatnonzero(place % FANOUT == 0)
        levels.append((np.bitwise_and.reduceat(ands, first), np.bitwise_or.reduceat(ors, first), of[first], first, np.diff(np.r_[first, len(of)])))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    top = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, top, top)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        ands, ors, _, first, count = levels[level]
        apart = np.bitwise_count((ands[a] & ~ors[b]) | (ands[b] & ~ors[a]))
        near = apart <= distance
        a, b = a[near], b[near]
        if level == 0:
            keep = a < b
            found.append((a[keep], b[keep]))
            continue
        pairs = count[a] * count[b]
        i = np.repeat(np.arange(len(a)), pairs)
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        x, y = first[a][i] + k // count[b][i], first[b][i] + k % count[b][i]
        keep = x <= y
        if keep.any():
            todo.append((level - 1, x[keep], y[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def fingerprint_links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) over the distinct fingerprints ``nodes`` (fp): links enough to join all that lie within ``distance``."""
    n = nodes.count()
    masks = routes(max(n, 1), distance)
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("route"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.route", "k.bits")
    hot = keyed.groupBy("route", "bits").count().where(F.col("count") > CELL).select("route", "bits", F.ceil(F.col("count") / CELL).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    spread = keyed.join(hot, ["route", "bits"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    spread = spread.withColumn("side", cell).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    spread = spread.select("fp", "side", F.xxhash64("route", "bits", F.least("side", "other"), F.greatest("side", "other")).alias("bucket"), "route", "bits", F.least("side", "other").alias("c1"), F.greatest("side", "other").alias("c2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_groups(batches, ["route", "bits", "c1", "c2"], 1 << 15):
            fp = got.column("fp").to_numpy().view(np.uint64)
            side = got.column("side").to_numpy()
            keys = [got.column(k).to_numpy() for k in ("route", "bits", "c1", "c2")]
            order = np.lexsort((gray_rank(fp), *reversed(keys)))
            fp, side, keys = fp[order], side[order], [k[order] for k in keys]
            new = np.zeros(len(fp), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            group = np.cumsum(new)
            mixed = keys[2] != keys[3]  # of two cells only what crosses; each cell meets itself elsewhere
            a, b = linked_pairs(group, fp, distance)
            keep = ~mixed[a] | (side[a] != side[b])
            a, b = a[keep], b[keep]
            root = local_roots(len(fp), a, b)
            far = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.record_batch({"a": pa.array(fp[far].view(np.int64)), "b": pa.array(fp[root[far]].view(np.int64))})

    return spread.repartition("bucket").sortWithinPartitions("route", "bits", "c1", "c2").select("fp", "side", "route", "bits", "c1", "c2").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: id, doc (a hash of the text), fingerprint (16 hex digits), fp (the same as a signed long) and component_id.

    component_id is the smallest id reachable over links of at most ``distance`` differing bits. Null and empty
    texts have fingerprint 0, which links like any other. Repeated rows stay repeated. A null id never is a
    component's id unless all ids of the component are null. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, shingle))
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), distance), "simhash-components")
    named = scratch.save(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.save(named.join(first, "root").select("fp", "root", "component_id"))
    scratch.drop(nodes)
    scratch.drop(named)
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "doc", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of the smallest id (of several texts of that id one).

    Of rows equal in id and text one stays. Rows with a null id stay, as nothing names them in the result.
    """
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, **options).withColumnRenamed("root", "class"), id_col, text_col)
