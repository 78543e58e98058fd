"""Alignment of two tokenizers over one text: where do tokens of both end at the same byte, and which pairs of ids meet there?

Texts are cut into units at single spaces that no token of either vocabulary crosses, so that the tokens of the units are
those of the text; a block of texts tokenizes its distinct units once. Tokens are flat Arrow lists with the unit of each
as its parent; their byte ends are cumulative sums within the unit, links an Acero hash join on (unit, end), and counts of
id pairs an Acero group-by for each block, which Spark merges. A block's units and pairs then meet the corpus-wide counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch, blocks, byte_column

#: Where the tokenizers' files lie, on every machine.
FOLDER = "/opt/tokenizers"
BLOCK = 1 << 22
#: Bytes of distinct units that are tokenized in one call.
CALL = 1 << 14
#: Units of one text whose groups are written out at a time.
SLICE = 1 << 18

# A byte after a space at which no text is cut: signs that are or may begin white space (of one to three bytes).
_OPEN = np.ones(256, bool)
_OPEN[0x21:0x7F] = False
_OPEN[0xC3:] = False
_OPEN[[0xE1, 0xE2, 0xE3]] = True


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer with the bytes of each id, as one buffer."""

    def __init__(self, tokens: list[bytes], encode):
        self.encode = encode
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)][:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, joined."""
        size = self.size[ids]
        to = np.cumsum(size)
        return self.bytes[np.repeat(self.begin[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]


@lru_cache(2)
def vocabularies(folder: str) -> tuple[Vocabulary, Vocabulary]:
    """The byte-level tokenizer (A) and the piece tokenizer (B); both encode texts that begin with a space."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json"), SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    a.encode_special_tokens = True
    alphabet, names = byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    left = [bytes(alphabet.get(c, 0x3F) for c in names.get(i, "")) for i in range(max(names) + 1)]
    right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    crossing = [p for p in map(b.id_to_piece, range(b.get_piece_size())) if "▁" in p.lstrip("▁")]
    if crossing:
        raise ValueError("pieces go over the end of a word, so texts can't be cut there")
    return Vocabulary(left, lambda t: a.encode(t, add_special_tokens=False).ids), Vocabulary(right, lambda t: b.encode(t[1:]))


def unit_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each unit and the end of the last, units before each text) for texts that begin with a space each.

    A text is cut before a space after another sign and before one that is surely no white space.
    """
    space = data == 0x20
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-2] = space[1:-1] & ~space[:-2] & ~_OPEN[data[2:]]
    cut[offsets] = True
    inner = offsets[1:-1] - 1
    cut[inner[cut[inner] & (inner > offsets[:-2])]] = False  # a text's last sign, next to another text
    edge = np.flatnonzero(cut)
    return edge, np.searchsorted(edge, offsets)


def _tokens(words: pa.Array, vocabularies: tuple[Vocabulary, Vocabulary]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(ids of A and B, unit of each) and whether a unit's tokens spell it, for distinct units.

    Units that begin and end as units within a text do are joined for one call and told apart by their ends.
    """
    data, at = byte_column(words)
    size = np.diff(at)
    head, tail = at[:-1], at[1:] - 1
    marked = pc.match_substring(words, "▁").to_numpy(zero_copy_only=False)
    plain = (size > 1) & ~_OPEN[data[np.minimum(head + 1, tail)]] & (data[tail] != 0x20) & ~marked
    order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
    run = np.cumsum(size[order])
    call = np.where(plain[order], (run - 1) // CALL, run[-1] // CALL + 1 + np.arange(len(order)) if len(run) else 0)
    begins = np.flatnonzero(np.r_[True, call[1:] != call[:-1]][: len(call)])
    ids, units, good = ([], []), ([], []), np.ones(len(words), bool)

    def encode(members: np.ndarray) -> bool:
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), words.take(pa.array(members))), "")[0].as_py()
        want, edge = np.frombuffer(text.encode(), np.uint8), np.cumsum(size[members])
        found = [np.array(v.encode(text), np.int64) for v in vocabularies]
        ends = [np.cumsum(v.size[i]) for v, i in zip(vocabularies, found, strict=True)]
        if not all(np.array_equal(v.spelled(i), want) and np.isin(edge, e).all() for v, i, e in zip(vocabularies, found, ends, strict=True)):
            return False
        for k in (0, 1):
            ids[k].append(found[k])
            units[k].append(members[np.searchsorted(edge, ends[k], "left")])
        return True

    for low, high in zip(begins, np.r_[begins[1:], len(order)], strict=True):
        members = order[low:high]
        if not encode(members):
            for one in members:
                good[one] = len(members) > 1 and encode(np.array([one]))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return [join(x) for x in ids], [join(x) for x in units], good


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]."""
    return np.diff(np.r_[0, np.cumsum(values)][offsets])


class Aligned:
    """Distinct units with their tokens, links and groups.

    n_a, n_b, n_links: by unit. links: the local pair of each link, in order of unit and end; link_at: their offsets.
    pairs: the table a, b of local pairs. groups: each unit's groups as text. good: the tokens of both spell the unit.
    """

    def __init__(self, words: pa.Array, vocabularies: tuple[Vocabulary, Vocabulary]):
        n = len(words)
        ids, units, self.good = _tokens(words, vocabularies)
        tables, ends = [], []
        for k, name in enumerate("ab"):
            order = np.argsort(units[k], kind="stable")
            ids[k], units[k] = ids[k][order], units[k][order]
            first = np.searchsorted(units[k], np.arange(n + 1))  # offsets of the flat list of tokens
            total = np.r_[0, np.cumsum(vocabularies[k].size[ids[k]])]
            ends.append(total[1:] - np.repeat(total[first[:-1]], np.diff(first)))
            tables.append(pa.table({"unit": units[k], "end": ends[k], name: ids[k]}))
            setattr(self, f"n_{name}", np.diff(first))
        links = tables[0].join(tables[1], ["unit", "end"], join_type="inner", use_threads=False)
        unit, end, a, b = (links.column(c).to_numpy() for c in ("unit", "end", "a", "b"))
        order = np.lexsort((end, unit))
        unit, end, a, b = unit[order], end[order], a[order], b[order]
        self.link_at = np.searchsorted(unit, np.arange(n + 1))
        self.n_links = np.diff(self.link_at)
        code, self.links = np.unique(a * len(vocabularies[1].size) + b, return_inverse=True)
        self.pairs = pa.table({"a": code // len(vocabularies[1].size), "b": code % len(vocabularies[1].size)})
        # groups end where links do: a token belongs to the first link that ends with it or later
        width = int(max((e.max() for e in ends if len(e)), default=0)) + 1
        key, written = unit * width + end, []
        for k in (0, 1):
            group = np.searchsorted(key, units[k] * width + ends[k], "left")
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(len(key) + 1)), pa.int32()), pc.cast(pa.array(ids[k]), pa.string()))
            written.append(pc.binary_join(lists, ","))
        groups = pc.binary_join_element_wise(*written, "|")
        self.groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.link_at, pa.int32()), groups), ";")


def _digest(groups: pa.Array, units: np.ndarray) -> str:
    """SHA-256 of a text's groups, some units at a time."""
    found = hashlib.sha256()
    for low in range(0, len(units), SLICE):
        part = groups.take(pa.array(units[low : low + SLICE]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), ";")
        found.update(b";" if low else b"")
        found.update(joined[0].as_buffer())
    return found.hexdigest()


_LISTS = "pair_a array<int>, pair_b array<int>, pair_n array<long>, link_at array<int>, links array<int>"
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _lists(values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """A column whose first value is the whole list and whose other n values are null."""
    return pa.ListArray.from_arrays(pa.array([0, *([len(values)] * (n + 1))], pa.int32()), pa.array(values, kind), mask=pa.array([False] + [True] * n))


def _align(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """For each block one row of what its units hold, then a row for each text."""
    from pyspark import TaskContext

    both, count, context = vocabularies(folder), 0, TaskContext.get()
    base = (context.partitionId() if context else 0) << 32
    for batch in batches:
        texts = batch.column("text")
        for low, high in blocks(byte_column(texts)[1], BLOCK):
            n = high - low
            spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), pc.fill_null(texts.slice(low, n), ""), "")
            data, at = byte_column(spaced)
            edge, first = unit_edges(data, at)
            units = pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
            index, found = units.indices.to_numpy(), Aligned(units.dictionary, both)
            blank = np.diff(at) == 1
            good = ~blank & (_sums(~found.good[index], first) == 0)
            held = np.repeat(good, np.diff(first))
            weight = np.bincount(index[held], minlength=len(units.dictionary))
            links = pa.table({"pair": found.links, "n": np.repeat(weight, found.n_links)})
            counts = links.group_by("pair", use_threads=False).aggregate([("n", "sum")])
            counted = np.zeros(len(found.pairs), np.int64)
            counted[counts.column("pair").to_numpy()] = counts.column("n_sum").to_numpy()
            numbers = [np.where(good, _sums(x[index], first), 0) for x in (found.n_a, found.n_b, found.n_links, found.n_links)]
            digests = [_digest(found.groups, index[first[i] : first[i + 1]]) if good[i] else "" for i in range(n)]
            empty = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, base + count)),
                    pa.concat_arrays([pa.nulls(1, batch.schema.field("doc").type), batch.column("doc").slice(low, n)]),
                    *(pa.concat_arrays([empty, pa.array(x, pa.int64())]) for x in numbers),
                    pa.array([None, *digests], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, first], pa.int32()), pa.array(index, pa.int32())),
                    pa.array([True] + [False] * n),
                    *(_lists(found.pairs.column(c).to_numpy(), n, pa.int32()) for c in "ab"),
                    _lists(counted, n, pa.int64()),
                    _lists(found.link_at, n, pa.int32()),
                    _lists(found.links, n, pa.int32()),
                ],
                ["block", "doc", *_NUMBERS, "groups_sha256", "units", "is_block", "pair_a", "pair_b", "pair_n", "link_at", "links"],
            )
            count += 1
    pa.default_memory_pool().release_unused()


def _scored(block: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one block with the counts of their links."""
    block = block.combine_chunks()
    is_block = block.column("is_block").to_numpy()
    lists = block.slice(int(np.flatnonzero(is_block)[0]), 1)
    docs = block.filter(pa.array(~is_block))
    link_at, links = (lists.column(c).combine_chunks().flatten().to_numpy() for c in ("link_at", "links"))
    n_pairs = len(lists.column("pair_a").combine_chunks().flatten())
    count, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    place = pairs.column("place").to_numpy()
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    units = docs.column("units").combine_chunks()
    first, index = units.offsets.to_numpy() - units.offsets[0].as_py(), units.flatten().to_numpy()
    linked = docs.column("n_links").to_numpy() > 0
    sums = {c: pa.array(np.where(linked, _sums(_sums(x[links], link_at)[index], first), 0)) for c, x in (("n_best", best), ("count_sum", count))}
    return pa.table({c: docs.column(c) for c in ("doc", *_NUMBERS)} | sums | {"groups_sha256": docs.column("groups_sha256")})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each pair of ids in the corpus, and 1 where no pair of this b has more, else 0."""
    pairs = aligned.where("is_block").select(F.inline(F.arrays_zip("pair_a", "pair_b", "pair_n"))).where("pair_n > 0")
    pairs = pairs.groupBy(F.col("pair_a").alias("a"), F.col("pair_b").alias("b")).agg(F.sum("pair_n").alias("count"))
    # a window holds one row for each id of A at most
    return pairs.withColumn("best", (F.col("count") == F.max("count").over(W.partitionBy("b"))).cast("int"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """Per text: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Texts that are null or empty, or whose tokens of A or B don't spell a space and the text, have zeros and ''. Repeated
    rows and null ids stay rows of their own and all count; no rows give no rows; other columns are not read. Long texts
    are tokenized by distinct units, so memory grows with these and with the longest run without a single space.
    """
    scratch = Scratch(docs.sparkSession, "align")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc"]
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    aligned = scratch.save(rows.mapInArrow(lambda x: _align(x, folder), f"block long, doc {kind}, {numbers}, groups_sha256 string, units array<int>, is_block boolean, {_LISTS}"))
    pairs = aligned.where("is_block").select("block", F.arrays_zip("pair_a", "pair_b", "pair_n").alias("pairs")).select("block", F.posexplode("pairs").alias("place", "p"))
    pairs = pairs.where("p.pair_n > 0").select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    counted = pairs.join(pair_counts(aligned), ["a", "b"]).select(F.col("block").alias("home"), "place", "count", "best")
    scored = aligned.groupBy("block").cogroup(counted.groupBy("home")).applyInArrow(_scored, f"doc {kind}, {numbers}, n_best long, count_sum long, groups_sha256 string")
    return scored.withColumnRenamed("doc", id_col)
