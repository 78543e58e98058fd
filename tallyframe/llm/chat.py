"""Chat formatting: conversations become training text by columnar byte assembly.

Turns are dealt out by ranges of (conversation, turn), so that a conversation of any length is spread over tasks. A block
of turns is a pool of bytes (marks, roles, texts) and a list of segments of it; segment lengths, their cumulative offsets
and the scatter indices are numpy arrays, and all bytes are copied into one buffer that an Arrow array then wraps.

Every turn stands between marks that name its role. A control string inside a text or role gets one backslash more
after its first sign, so no text can end a turn or begin one, and reading back takes one backslash away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import blocks, byte_column

BLOCK = 1 << 21
#: Bytes of text above which a conversation is written in several parts.
PART = 1 << 24


@dataclass(frozen=True)
class Template:
    """Opening and closing mark of each known role; another role is written out between ``named``'s first two marks.

    ``controls`` are the strings that texts must not hold. No two of them may overlap, and each mark holds one.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
    )
    named: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
    learnt: str = "assistant"

    def control(self, slashes: str) -> str:
        """A pattern of control strings with so many backslashes after the first sign."""
        return "|".join(f"{re.escape(c[0])}{slashes}{re.escape(c[1:])}" for c in self.controls)

    def turn(self) -> re.Pattern[bytes]:
        """One formatted turn: opening mark, role where it is written out, text, closing mark."""
        known = "|".join(re.escape(a) for a, _ in self.marks.values())
        ends = "|".join(re.escape(b) for b in [*(b for _, b in self.marks.values()), self.named[2]])
        first, then = map(re.escape, self.named[:2])
        return re.compile(f"({known}|{first}(.*?){then})(.*?)(?:{ends})".encode(), re.DOTALL)


TEMPLATE = Template()


def unescape(text: bytes, template: Template = TEMPLATE) -> bytes:
    """The text as it was before it was escaped."""
    return re.sub(template.control(r"\\+").encode(), lambda m: m[0][:1] + m[0][2:], text)


def _insertions(column: pa.Array, data: np.ndarray, offsets: np.ndarray, template: Template) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``data``) of each backslash that escaping puts into the strings of a column, in order."""
    pattern = re.compile(template.control(r"\\*").encode())
    held = np.flatnonzero(pc.match_substring_regex(column, template.control(r"\\*")).to_numpy(zero_copy_only=False))
    row, place = [], []
    for i in held:
        base = int(offsets[i])
        found = [base + m.start() + 1 for m in pattern.finditer(data[base : offsets[i + 1]].tobytes())]
        row += [i] * len(found)
        place += found
    return np.array(row, np.int64), np.array(place, np.int64)


def _split(start: np.ndarray, size: np.ndarray, segment: np.ndarray, place: np.ndarray, slash: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, segment it came from) of segments cut at ``place``, with the backslash of the pool before each cut."""
    n, m = len(start), len(place)
    which = np.r_[np.arange(n), segment, segment]
    at = np.r_[start, place, place]
    kind = np.r_[np.zeros(n), np.ones(m), np.full(m, 2)]  # the segment's head, a backslash, what follows it
    order = np.lexsort((kind, at, which))
    which, at, kind = which[order], at[order], kind[order]
    cut = np.r_[kind[1:] == 1, False]
    # a piece ends where the next backslash of its segment stands, else where the segment ends
    to = np.where(cut & (np.r_[which[1:], -1] == which), np.r_[at[1:], 0], (start + size)[which])
    is_slash = kind == 1
    return np.where(is_slash, slash, at), np.where(is_slash, 1, to - at), which


def assemble(role: pa.Array, text: pa.Array, template: Template = TEMPLATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin of each turn and the end, begin and end of each text, learnt) of formatted turns; no nulls go in."""
    n = len(text)
    marks = [m for pair in template.marks.values() for m in pair] + list(template.named) + ["\\"]
    sizes = np.array([len(m.encode()) for m in marks])
    where = np.r_[0, np.cumsum(sizes)]
    header = np.frombuffer("".join(marks).encode(), np.uint8)
    role_bytes, role_at = byte_column(role)
    text_bytes, text_at = byte_column(text)
    pool = np.concatenate([header, role_bytes[role_at[0] : role_at[-1]], text_bytes[text_at[0] : text_at[-1]]])
    role_shift, text_shift = len(header) - role_at[0], len(header) + int(role_at[-1] - role_at[0]) - text_at[0]

    known = pc.fill_null(pc.index_in(role, pa.array(list(template.marks), role.type)), -1).to_numpy(zero_copy_only=False)
    other, first = known < 0, 2 * len(template.marks)
    opening, closing = np.where(other, first, 2 * known), np.where(other, first + 2, 2 * known + 1)
    # five segments a turn: opening mark, role, mark after the role, text, closing mark
    start, size = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, mark in ((0, opening), (2, np.full(n, first + 1)), (4, closing)):
        start[:, k], size[:, k] = where[mark], sizes[mark]
    for k, at, shift in ((1, role_at, role_shift), (3, text_at, text_shift)):
        start[:, k], size[:, k] = at[:-1] + shift, np.diff(at)
    size[~other, 1:3] = 0
    start, size, which = start.ravel(), size.ravel(), np.arange(5 * n)
    row_r, at_r = _insertions(role, role_bytes, role_at, template)
    row_t, at_t = _insertions(text, text_bytes, text_at, template)
    used = other[row_r] if len(row_r) else np.zeros(0, bool)
    if len(row_t) or used.any():
        segment, place = np.r_[row_r[used] * 5 + 1, row_t * 5 + 3], np.r_[at_r[used] + role_shift, at_t + text_shift]
        start, size, which = _split(start, size, segment, place, int(where[-2]))

    to = np.cumsum(size)
    out = np.empty(int(to[-1]) if n else 0, np.uint8)
    shift = np.repeat(start - (to - size), size)
    np.take(pool, shift + np.arange(len(out)), out=out)
    ends = np.zeros(5 * n, np.int64)
    ends[which] = to  # the last piece of a segment counts
    begins = np.r_[0, ends[:-1]][: 5 * n]
    learnt = known == list(template.marks).index(template.learnt) if template.learnt in template.marks else np.zeros(n, bool)
    return out, np.r_[0, ends[4::5]], begins[3::5], ends[3::5], learnt


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are alike."""
    if len(column) < 2:
        return np.ones(len(column), bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.r_[True, ~same.to_numpy(zero_copy_only=False)]


def _formatted(batches: Iterator[pa.RecordBatch], template: Template, part: int) -> Iterator[pa.RecordBatch]:
    seq = 0
    for batch in batches:
        _, text_at = byte_column(batch.column("text"))
        for low, high in blocks(text_at, BLOCK):
            rows = batch.slice(low, high - low)
            data, at, begin, end, learnt = assemble(rows.column("role"), rows.column("text"), template)
            new = _changes(rows.column("conv"))
            # a conversation's bytes before each turn, in units of a part: the next part begins where they change
            owner = np.flatnonzero(new)[np.cumsum(new) - 1]
            before = (at[:-1] - at[owner]) // part
            cut = np.flatnonzero(new | np.r_[True, before[1:] != before[:-1]])
            sides = np.r_[cut, len(rows)]
            conv_of = np.cumsum(new)[cut]
            alone = (np.bincount(conv_of)[conv_of] == 1) & (conv_of != conv_of[0]) & (conv_of != conv_of[-1])
            spans = np.flatnonzero(learnt)
            owner = np.searchsorted(cut, spans, "right") - 1
            base = at[cut][owner]
            loss = pa.StructArray.from_arrays([pa.array(begin[spans] - base), pa.array(end[spans] - base)], ["start", "end"])
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(sides))), pa.int32()), loss)
            text = pa.StringArray.from_buffers(len(cut), pa.py_buffer(at[sides].astype(np.int32)), pa.py_buffer(data))
            picked = rows.take(pa.array(cut))
            yield pa.RecordBatch.from_arrays(
                [picked.column("conv"), picked.column("turn"), picked.column("tie"), pa.array(np.arange(seq, seq + len(cut))), pa.array(alone), pa.array(np.diff(sides)), text, loss],
                ["conv", "turn", "tie", "part", "whole", "n_turns", "formatted", "loss"],
            )
            seq += len(cut)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = TEMPLATE, part: int = PART) -> DataFrame:
    """Formatted conversations: conv, turn, tie, part (their order), whole, n_turns, formatted, loss (start, end: bytes of ``formatted``).

    A conversation is one row (whole), or several in the order of turn, tie and part, cut between turns: where it is longer
    than ``part`` bytes or where it meets the border of a task's block. Null texts and roles are empty, an unknown role is
    written out; null turns come first, rows of one turn follow a hash of role and text; repeated rows all stay; rows
    without a conversation form one of their own. No rows give no rows; other columns are not read. One turn may have 2 GB.
    """
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), string(role_col).alias("role"), string(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    kinds = dict(rows.dtypes)
    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, tie long, part long, whole boolean, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
    dealt = rows.repartitionByRange("conv", "turn", "tie").sortWithinPartitions("conv", "turn", "tie")
    return dealt.mapInArrow(lambda batches: _formatted(batches, template, part), schema)


class Digest:
    """What has been read back of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


class Reader:
    """Reads formatted text by its template."""

    def __init__(self, template: Template):
        self.template, self.pattern = template, template.turn()
        self.roles = {a.encode(): role.encode() for role, (a, _) in template.marks.items()}

    def add(self, to: Digest, formatted: bytes, loss: list[dict]) -> None:
        at = 0
        for m in self.pattern.finditer(formatted):
            if m.start() != at:
                break
            at = m.end()
            role = self.roles[m[1]] if m[2] is None else unescape(m[2], self.template)
            to.turns.update(role + b"\n" + unescape(m[3], self.template) + b"\n")
            to.n_turns += 1
        if at != len(formatted):
            raise ValueError("formatted text does not follow its template")
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]], self.template)
            to.loss.update(text)
            to.loss_chars += len(text.decode())
        to.chars += len(formatted.decode())

    def digest(self, parts: list[tuple[bytes, list[dict]]]) -> tuple:
        found = Digest()
        for formatted, loss in parts:
            self.add(found, formatted, loss)
        return found.row()


_DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _digests(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]


def _read_whole(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Whole conversations become digests; parts stay as they are."""
    reader = Reader(template)
    for batch in batches:
        whole, formatted, loss = (batch.column(c) for c in ("whole", "formatted", "loss"))
        rows = [reader.digest([(formatted[i].as_buffer().to_pybytes(), loss[i].as_py())]) if whole[i].as_py() else (None,) * 5 for i in range(len(batch))]
        if rows:
            keep = [pc.if_else(whole, pa.scalar(None, c.type), c) for c in (formatted, loss)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "turn", "tie", "part")), *keep, *_digests(rows)], ["conv", "turn", "tie", "part", "formatted", "loss", *_DIGESTS])


def _read_parts(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Digests pass; the parts of a conversation, which lie in order, are read as a stream."""
    reader, now, conv, kind = Reader(template), None, None, None
    for batch in batches:
        kind, convs = batch.schema.field("conv").type, batch.column("conv")
        done, formatted, loss = [], batch.column("formatted"), batch.column("loss")
        known = batch.filter(pc.is_null(formatted)).select(["conv", *_DIGESTS])
        if known.num_rows:
            yield known
        for i in np.flatnonzero(pc.is_valid(formatted).to_numpy(zero_copy_only=False)).tolist():
            value = convs[i].as_py()
            if now is None or value != conv:
                if now is not None:
                    done.append((conv, now.row()))
                now, conv = Digest(), value
            reader.add(now, formatted[i].as_buffer().to_pybytes(), loss[i].as_py())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), *_digests([r for _, r in done])], ["conv", *_DIGESTS])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), *_digests([now.row()])], ["conv", *_DIGESTS])


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from ``format_chats``'s rows alone.

    Whole conversations are read where they lie; the parts of others meet by conversation and are read in order as a
    stream, so no task holds more than one part. Text that the template can't have made is an error.
    """
    kinds = dict(formatted.dtypes)
    digests = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    order = f"conv {kinds['conv']}, turn {kinds['turn']}, tie long, part long"
    read = formatted.select("conv", "turn", "tie", "part", "whole", "formatted", "loss").mapInArrow(lambda x: _read_whole(x, template), f"{order}, formatted string, loss {kinds['loss']}, {digests}")
    met = read.repartition("conv").sortWithinPartitions("conv", "turn", "tie", "part")
    return met.mapInArrow(lambda x: _read_parts(x, template), f"conv {kinds['conv']}, {digests}")
