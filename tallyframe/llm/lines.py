"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Of two lines within t edits, one of t + 1 segments of the shorter one occurs unchanged in the other, near the
same place. So distinct lines are indexed by length and segment and probed with the substrings that can be such a
segment. Keys are counted first; only lines of keys that can join meet, and a pair that meets is verified inside the
join, so that no unverified pair is written.

The verification is the banded bit-parallel edit distance: the differences of neighbouring cells on 2t + 1 diagonals
are bits of one number, and one step for each character of a line updates all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch
from tallyframe.llm._graph import connected_components

#: Edits allowed: one for each SPAN characters of the shorter line, EDITS at most.
EDITS, SPAN = 2, 12
#: Keys that are sent to all executors (8 MB of them) to choose the rows that can join; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Four bytes that stand for no character.
_NONE = b"\xff\xff\xff\xff"


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, place, line, h): all lines without white space at their ends, null for blank ones and for a null text's one line.

    doc, a hash of the text, tells different texts of one id apart. h, a hash of 128 bits, stands for the line.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("place", "line"))
    line = F.nullif(F.btrim("line", F.lit(" \t\r")), F.lit(""))
    lines = lines.select("id", "doc", F.coalesce("place", F.lit(0)).alias("place"), line.alias("line"))
    return lines.withColumn("h", F.unhex(F.md5(F.col("line").cast("binary"))))


def budget(length: Column, edits: int) -> Column:
    """Edits that a pair may have whose shorter line has this length."""
    return F.least(F.floor(length / SPAN).cast("int"), F.lit(edits))


def segment_specs(edits: int) -> list[tuple[int, int, int, int, int]]:
    """(side, t, d, i, shift) of all keys of a line under a budget of t edits. Side 0, index: its own segments i. Side 1,
    probe: substrings that segment i of a line that is d shorter can be, ``shift`` characters from where that segment
    begins; the index serves for those of d = shift = 0.

    At most i edits lie before the segment, or at most t - i behind it, so only begins that keep to both bounds are needed.
    """
    out = []
    for t in range(1, edits + 1):
        out += [(0, t, 0, i, 0) for i in range(t + 1)]
        for d in range(t + 1):
            for i in range(t + 1):
                out += [(1, t, d, i, s) for s in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1) if d or s]
    return out


def line_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(h, key, side) for the lines (h, line). One expression serves all keys; the specifications are rows of a constant.

    Of t + 1 segments the first ones are shorter where the length does not divide evenly. Lines are cut in a coding of
    four bytes for each character, so that no cut walks over the characters before it.
    """
    names = ("side", "t", "d", "i", "shift")
    rows = [(spec, F.struct(*(F.lit(x).alias(n) for n, x in zip(names, spec, strict=True)))) for spec in segment_specs(edits)]
    every, most = F.array(*(row for _, row in rows)), F.array(*(row for spec, row in rows if spec[1] == edits))
    coded = lines.select("h", F.encode("line", "UTF-32").alias("code")).withColumn("length", (F.octet_length("code") / 4).cast("int"))
    coded = coded.where(F.col("length") >= SPAN)
    each = coded.select("h", "code", "length", F.explode(F.when(F.col("length") >= edits * (SPAN + 1), most).otherwise(every)).alias("s")).select("h", "code", "length", "s.*")
    each = each.withColumn("of", F.col("length") - F.col("d")).where(F.col("t") == budget(F.col("of"), edits))  # the length of the line whose segment is meant
    parts = F.col("t") + 1
    each = each.withColumns({"short": parts - F.col("of") % parts, "size": F.floor(F.col("of") / parts).cast("int")})
    each = each.withColumn("begin", (F.col("i") * F.col("size") + F.greatest(F.col("i") - F.col("short"), F.lit(0)) + F.col("shift")).cast("int"))
    each = each.withColumn("size", F.col("size") + (F.col("i") >= F.col("short")).cast("int"))
    each = each.where((F.col("begin") >= 0) & (F.col("begin") + F.col("size") <= F.col("length")))
    return each.select("h", F.xxhash64("of", "i", F.substr("code", F.col("begin") * 4 + 1, F.col("size") * 4)).alias("key"), "side")


def odd_characters() -> Column:
    """64 bits: which classes of characters occur an odd number of times in ``line``."""
    return F.expr("aggregate(split(line, ''), 0L, (a, c) -> a ^ shiftleft(1L, pmod(ascii(c), 64)))")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """The edit distance of two strings whose lengths differ by ``edits`` at most; some greater number where it is above ``edits``.

    Column j holds the rows j - edits to j + edits of the table of distances as bits 0 to 2 * edits. For each: whether
    a cell is one more (up) or one less (down) than the cell above it in the column before, and whether it equals the cell
    before it on its diagonal (same). The count of steps on the diagonal of the last cell that are not the same
    is its distance. Outside of the band cells count as one more, which no path within the budget comes to use.
    """
    pad, codes = F.lit(_NONE), lambda c: F.encode(c, "UTF-32")
    both = F.struct(F.concat(*[pad] * edits, codes(x), *[pad] * (2 * edits)).alias("a"), codes(y).alias("b"), F.length(y).alias("n"), (F.length(x) - F.length(y)).alias("drop"))
    return _let(both, lambda pair: _banded(pair["a"], pair["b"], pair["n"], pair["drop"], edits))


def _banded(a: Column, b: Column, n: Column, drop: Column, edits: int) -> Column:
    band = (1 << 2 * edits + 1) - 1
    cell = lambda code, at: F.substr(code, at * 4 - 3, F.lit(4))
    masked = lambda bits: bits.bitwiseAND(F.lit(band))

    def step(now: Column, j: Column) -> Column:
        def equal(c: Column) -> Column:
            bits = [F.when(cell(a, j + i) == c, 1 << i).otherwise(0) for i in range(2 * edits + 1)]
            return sum(bits[1:], bits[0])

        def update(same: Column) -> Column:
            more = masked(now["down"].bitwiseOR(F.bitwise_not(same.bitwiseOR(now["up"]))))
            less, next_same = same.bitwiseAND(now["up"]), F.shiftright(same, 1)
            missed = (j > -drop) & (F.call_function("shiftright", same, drop + edits).bitwiseAND(F.lit(1)) == 0)
            return F.struct(masked(less.bitwiseOR(F.bitwise_not(next_same.bitwiseOR(more)))).alias("up"), next_same.bitwiseAND(more).alias("down"), (now["cost"] + missed.cast("int")).alias("cost"))

        met = lambda pm: masked((pm.bitwiseAND(now["up"]) + now["up"]).bitwiseXOR(now["up"]).bitwiseOR(pm).bitwiseOR(now["down"]))
        moved = _let(cell(b, j), lambda c: _let(equal(c), lambda pm: _let(met(pm), update)))
        return F.when(now["cost"] > edits, now).otherwise(moved)

    first = F.struct(F.lit(band - (1 << edits) + 1).alias("up"), F.lit(0).alias("down"), F.abs(drop).alias("cost"))
    return F.aggregate(F.sequence(F.lit(1), n), first, step, lambda end: end["cost"])


def similar_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): links between different lines (h, line; each line once) within their budget of edits; every linked pair is found.

    Keys are counted (pre-aggregated before their shuffle); then only the lines of keys that several rows have, one of
    them an index row, take part in the join.
    """
    scratch = Scratch(lines.sparkSession, "lines")
    counts = line_keys(lines, edits).groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("side") == 0, 1)).alias("indexed"))
    keys = scratch.save(counts.where("n > 1 and indexed > 0").select("key"))
    shared = F.broadcast(keys) if keys.count() <= BROADCAST else keys
    own = scratch.save(line_keys(lines, edits).join(shared, "key", "left_semi").distinct())
    scratch.drop(keys)
    texts = scratch.save(lines.join(own.select("h").distinct(), "h", "left_semi").withColumn("odd", odd_characters()))
    met = scratch.save(own.join(texts, "h").withColumn("length", F.length("line")))
    scratch.drop(own)
    scratch.drop(texts)
    x, y = met.where("side = 0").alias("x"), met.alias("y")
    once = (F.col("y.side") == 1) | (F.col("x.h") < F.col("y.h"))
    most = budget(F.least("x.length", "y.length"), edits)
    alike = F.bit_count(F.col("x.odd").bitwiseXOR(F.col("y.odd"))) <= 2 * most  # an edit changes two of these bits at most
    near = once & (F.abs(F.col("x.length") - F.col("y.length")) <= most) & alike & (banded_distance(F.col("x.line"), F.col("y.line"), edits) <= most)
    links = scratch.save(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h") != F.col("y.h")) & near).select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct())
    scratch.drop(met)
    return links


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """(id, doc, place, h, class, keep, near) for each line: the class it is in, whether it is the class's first, and whether
    it differs from that; h and class are null for blank lines.

    Lines are in one class where links lead from one to the other; equal lines are in one class. The first line
    is that of the smallest id (null last), hash of the text, and place.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    every = scratch.save(document_lines(docs, id_col, text_col))  # split once, read by column below
    counted = scratch.save(every.where("line is not null").groupBy("h", "line").agg(F.count("*").alias("n")))
    places = scratch.save(every.select("id", "doc", "place", "h"))
    scratch.drop(every)  # from here on each text is held once
    links = similar_lines(counted.where(F.length("line") >= SPAN).select("h", "line"), edits)
    roots = connected_components(links, "line-components").withColumnRenamed("node", "h")
    shared = scratch.save(counted.where("n > 1").select("h").join(roots, "h", "full_outer").select("h", F.coalesce("root", "h").alias("class")))
    scratch.drop(counted)
    classed = scratch.save(places.join(shared, "h", "left").select("id", "doc", "place", "h", "class"))
    scratch.drop(places)
    scratch.drop(shared)
    there = F.col("h").isNotNull()
    alone = classed.where("class is null").select("id", "doc", "place", "h", F.col("h").alias("class"), there.alias("keep"), F.when(there, F.lit(False)).alias("near"))
    several = classed.where("class is not null")  # only these lines meet by class
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc", "place")
    first = scratch.save(several.groupBy("class").agg(F.min(order).alias("first"), F.min_by("h", order).alias("first_h")))
    keep = F.struct("id", "doc", "place").eqNullSafe(F.struct("first.id", "first.doc", "first.place"))
    joined = several.join(first, "class").select("id", "doc", "place", "h", "class", keep.alias("keep"), (F.col("h") != F.col("first_h")).alias("near"))
    return joined.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """Per id: n_lines, n_removed (lines that are not the first of their class), n_near (of these, with another text than the first).

    Lines are compared without white space at their ends; blank ones are neither counted nor removed. Lines of less
    than SPAN characters have a budget of no edits: they are duplicates where they are equal. A null or empty text
    has no lines. Rows of one id are counted together, a null id is an id like others; rows equal in id and
    text are one document that is there several times: the first lines of all of them stay. An empty table gives an empty result.
    """
    lines = line_classes(docs, id_col, text_col, edits)
    there = F.col("h").isNotNull()
    counts = lines.groupBy("id").agg(F.count(F.when(there, 1)).alias("n_lines"), F.count(F.when(there & ~F.col("keep"), 1)).alias("n_removed"), F.count(F.when(there & ~F.col("keep") & F.col("near"), 1)).alias("n_near"))
    return counts.withColumnRenamed("id", id_col)


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """``docs`` without the lines that are not the first of their class; blank lines stay. Ids may be repeated or null."""
    drop = line_classes(docs, id_col, text_col, edits).where("h is not null and not keep").groupBy("id", "doc").agg(F.collect_set("place").alias("_drop"))
    joined = docs.join(drop, docs[id_col].eqNullSafe(drop["id"]) & (F.xxhash64(docs[text_col]) == drop["doc"]), "left")
    kept = F.filter(F.split(docs[text_col], "\n"), lambda _, i: ~F.array_contains(drop["_drop"], i))
    text = F.when(drop["_drop"].isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
