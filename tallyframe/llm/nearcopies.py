"""Near copies by the exact Jaccard similarity of their word shingles.

SimHash comes first: fingerprints of the same shingles within DISTANCE bits are linked over the Gray-order index, and a
link stays if its texts are alike by the exact similarity. At similarity 0.8 about 10 of 64 bits differ, so what
fingerprints leave apart is completed by bands of least shingle hashes, which route texts into buckets: of two texts at
similarity s some band is equal with odds 1 - (1 - s^ROWS)^BANDS (0.9999 at 0.8). Each link is verified by the shingles themselves. A bucket first compares its members with its lead, the one that
meets most others in all buckets, as an original does among its copies. What that leaves apart from the lead's component
is then compared with all others of the bucket, in cells of bounded size; a cell holds the shingles of its members and
gives no more links than it joins components, so the rows written grow with the members, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch, byte_column, one_of_each
from tallyframe.llm._graph import connected_components
from tallyframe.llm.simhash import SEED, fingerprint_links, pieces, shingle_hashes

SHINGLE, SIMILARITY, DISTANCE = 5, 0.8, 4
BANDS, ROWS = 24, 5
#: Shingles that are hashed by all functions at a time.
BLOCK = 1 << 12
#: Members of a bucket, and shingles of members, above which they are dealt into cells that meet two by two.
CELL, CELL_SHINGLES = 2_000, 1 << 21
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in order; a text of fewer words is one shingle, an empty one has none."""
    found, words = [], []
    for piece in pieces((text or b"").lower()):
        words += piece.split()
        if len(words) < shingle:
            continue
        found.append(np.unique(shingle_hashes(words, shingle)))
        words = words[len(words) - shingle + 1 :]
    if found:
        return np.unique(np.concatenate(found))
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)


def bands(shingles: np.ndarray) -> list[int]:
    """One hash for each band, of its ROWS least values; no shingles have no bands."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for low in range(0, len(shingles), BLOCK):
        least = np.minimum(least, ((shingles[low : low + BLOCK] ^ _FLIP[:, None]) * _ODD[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(b, i) for i, b in enumerate(least.reshape(BANDS, ROWS).astype("<u8").view("V40").ravel().tolist())]


def print_of(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is set where over half of the hashes have it; an empty set has 0."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(shingles), BLOCK):
        ones += np.unpackbits(shingles[low : low + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _bytes(text_col: str) -> Column:
    return F.col(text_col).cast("string").cast("binary").alias("text")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, doc, node, size, fp, bands): doc, a hash of the text, tells texts of one id apart; node names the set of shingles, size counts it, fp is its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, prints, keys = [], [], [], []
            for text in batch.column(2):
                got = shingle_set(text.as_py(), shingle)
                node.append(_node(got))
                size.append(len(got))
                prints.append(print_of(got))
                keys.append(bands(got))
            flat = _signed([k for x in keys for k in x])
            edge = pa.array(np.r_[0, np.cumsum([len(x) for x in keys])], pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), _signed(node), pa.array(size, pa.int32()), _signed(prints), pa.ListArray.from_arrays(edge, flat)], names=["id", "doc", "node", "size", "fp", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), _bytes(text_col))
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, doc long, node long, size int, fp long, bands array<long>")


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, id, doc: a row that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column("text")]
            yield pa.record_batch([batch.column("node"), pa.array(out, pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), _bytes(text_col))
    met = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["doc"] == wanted["doc"])).select("node", "text")
    return met.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def _cells(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """placed (bucket, node, size, root, minor) with own (the row's cell) and the tasks (across, i, j) that it goes to.

    Minor rows, those outside of the lead's component, are to meet each other and all rows of that component. Where
    they are one cell, they meet each other in the first task that they have with the others.
    """

    def cells(of: Column) -> Column:
        rows, shingles = F.count(F.when(of, 1)) / CELL, F.coalesce(F.sum(F.when(of, F.col("size"))), F.lit(0)) / CELL_SHINGLES
        return F.greatest(F.ceil(rows), F.ceil(shingles)).cast("int")

    plan = placed.groupBy("bucket").agg(cells(F.col("minor")).alias("minors"), cells(~F.col("minor")).alias("majors"))
    rows = placed.join(scratch.save(plan.where("minors > 0")), "bucket")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))

    def task(across: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"))

    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    out = F.transform(upto("majors"), lambda j: task(1, F.col("own"), j))
    among = F.transform(upto("minors"), lambda o: task(0, F.least("own", o), F.greatest("own", o)))
    minor = F.when(F.col("minors") > 1, F.concat(out, among)).otherwise(out)
    to = F.when(F.col("minor"), minor).otherwise(F.transform(upto("minors"), lambda i: task(1, i, F.col("own"))))
    return rows.withColumn("to", F.explode(to)).select("bucket", "to.*", "node", "root", "minor", "own", (F.col("minors") == 1).alias("single"))


def _joining(similarity: float):
    """Of the rows of one task links (a, b) that are at least ``similarity`` alike and join all roots that such links can."""

    def run(got: pa.Table) -> pa.Table:
        node, minor, own, root = (got.column(c).to_numpy() for c in ("node", "minor", "own", "root"))
        i, j = got.column("i")[0].as_py(), got.column("j")[0].as_py()
        if got.column("across")[0].as_py():
            left, right = minor, ~minor | (got.column("single")[0].as_py() and j == 0)
        else:
            left, right = own == i, own == j
        data, at = byte_column(got.column("shingles").combine_chunks() if got.column("shingles").num_chunks == 1 else pa.concat_arrays(got.column("shingles").chunks))
        flat = data[at[0] : at[-1]].copy().view(np.uint64)
        size = np.diff(at) // 8
        order = np.argsort(size, kind="stable")
        edge = np.r_[0, np.cumsum(size[order])]
        begin = (at[:-1] - at[0]) // 8
        word = np.unique(flat, return_inverse=True)[1]
        word = word[np.repeat(begin[order] - edge[:-1], size[order]) + np.arange(len(word))]
        node, left, right, root, size = node[order], left[order], right[order], root[order], size[order]
        mark, out = np.zeros(int(word.max(initial=-1)) + 1, np.int64), []
        for x in np.flatnonzero(left).tolist():
            low, high = np.searchsorted(size, similarity * size[x] - 1e-9), np.searchsorted(size, (size[x] + 1e-9) / similarity, "right")
            free = right[low:high] & (root[low:high] != root[x])
            if not free.any():
                continue
            mark[word[edge[x] : edge[x + 1]]] = 1
            both = np.add.reduceat(mark[word[edge[low] : edge[high]]], edge[low:high] - edge[low])
            mark[word[edge[x] : edge[x + 1]]] = 0
            alike = np.flatnonzero(free & (both >= similarity * (size[x] + size[low:high] - both) - 1e-9)) + low
            for y in alike[np.unique(root[alike], return_index=True)[1]].tolist():
                out.append((max(node[x], node[y]), min(node[x], node[y])))
                root[root == root[y]] = root[x]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _close(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): nodes whose SimHashes are linked within DISTANCE bits, each fingerprint by its least node, and nodes of one fingerprint with that one.

    Only sizes that can be alike are met; which links are exact is verified by their shingles.
    """
    filled = nodes.where("size > 0").select("node", "size", "fp")
    first = filled.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("f")).select("fp", F.col("f.node").alias("node"), F.col("f.size").alias("size"))
    same = filled.join(first.withColumnsRenamed({"node": "b", "size": "other"}), "fp").select(F.col("node").alias("a"), "size", "b", "other")
    ends = fingerprint_links(first.select("fp"), DISTANCE).withColumnsRenamed({"a": "p", "b": "q"})
    ends = ends.join(first.select(F.col("fp").alias("p"), F.col("node").alias("a"), "size"), "p").join(first.select(F.col("fp").alias("q"), F.col("node").alias("b"), F.col("size").alias("other")), "q")
    met = same.unionByName(ends.select("a", "size", "b", "other")).where("a <> b")
    return met.where(F.least("size", "other") >= similarity * F.greatest("size", "other") - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, doc, component_id) for each row: doc is a hash of its text, component_id the smallest id reachable over links of at least ``similarity``.

    Words are split at ASCII white space, letters A-Z count as small ones. Texts without words are alike. Repeated
    rows stay repeated, different texts of one id are told apart; a null id names a component only if all its ids
    are null. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "nearcopies")
    signed = scratch.save(signatures(docs, id_col, text_col, shingle))
    nodes = scratch.save(signed.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "doc")).alias("row"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    close = scratch.save(_close(nodes, similarity))
    keyed = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = scratch.save(keyed.groupBy("bucket").count().where("count > 1"))
    met = scratch.save(keyed.join(shared, "bucket").select("bucket", "node", "size", "count"))
    weight = met.groupBy("node").agg(F.sum("count").alias("weight"))
    leads = met.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "size")).alias("l"))
    leads = scratch.save(leads.select("bucket", F.col("l.node").alias("lead"), F.col("l.size").alias("lead_size")))
    used = met.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = nodes.join(used, "node", "left_semi").select("node", "row.id", "row.doc")
    sets = scratch.save(_sets(docs, wanted, id_col, text_col, shingle))
    scratch.drop(shared)

    alike = F.least("size", "lead_size") >= similarity * F.greatest("size", "lead_size") - 1e-9
    tried = met.join(leads, "bucket").where(F.col("node") != F.col("lead")).where(alike).select(F.col("node").alias("a"), F.col("lead").alias("b")).union(close).distinct()
    both = tried.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    linked = both.select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a long, b long")
    roots = scratch.save(connected_components(linked, "nearcopies-components"))

    major = leads.join(roots, leads["lead"] == roots["node"], "left").select("bucket", F.coalesce("root", "lead").alias("major"))
    rooted = met.join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    rooted, major = scratch.save(rooted), scratch.save(major)
    placed = scratch.save(rooted.join(major, "bucket").withColumn("minor", F.col("root") != F.col("major")).drop("major"))
    sent = _cells(placed, scratch).join(sets, "node")
    more = sent.groupBy("bucket", "across", "i", "j").applyInArrow(_joining(similarity), "a long, b long")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)
    roots = connected_components(links, "nearcopies-components")
    named = scratch.save(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    for used in (met, leads, sets, placed, rooted, major, nodes, close):
        scratch.drop(used)
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.save(named.join(first, "root").select("node", "root", "component_id"))
    return signed.join(classes, "node").select(F.col("id").alias(id_col), "doc", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: of the smallest id (of several texts of that id one).

    Of rows equal in id and text one stays. Rows with a null id stay, as nothing names them in the result.
    """
    return one_of_each(docs, near_copies(docs, id_col, text_col, **options).withColumnRenamed("root", "class"), id_col, text_col)
