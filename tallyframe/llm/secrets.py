"""Secret scans whose false positives a random forest removes.

The forest learns from labelled findings. Where no reviewed ones are at hand, examples of ``findings.FORMS`` are put
between words of the scanned texts: their labels are known and come from nothing that the features see. What the texts
hold themselves has no label and is not learnt from.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch, uniform
from tallyframe.llm.findings import FORMS, Form, example

_SIGN = r"[A-Za-z0-9+/_\-.!@$%^&*#~?]"
#: Runs of 8 signs or more with a letter and a digit, and of 16 signs of keys or more with or without them.
CANDIDATE = re.compile(rf"(?<!{_SIGN})(?={_SIGN}*[0-9])(?={_SIGN}*[A-Za-z]){_SIGN}{{8,}}={{0,2}}|[A-Za-z0-9+/_\-]{{16,}}={{0,2}}")
#: Words before a finding that speak of keys, and of other strings of such signs.
OF_KEYS = re.compile(r"(?i)(token|secret|passw|pwd|api|auth|bearer|credential|private|key|log in|://\w+:$)")
OF_OTHERS = re.compile(r"(?i)(sha-?\d|md5|commit|checksum|digest|revision|etag|integrity|base64|https?://[^:]*$|href|src=|uuid|doi|mailto|image)")
_PREFIX = re.compile(r"[A-Za-z]{2,10}[_\-.]")
#: Labelled findings that the forest is fitted on at most (in expectation).
TRAIN_ROWS = 20_000
#: Share of all texts that hold a word of the dictionary, and the least count of them.
DICTIONARY_SHARE = 1e-4
DICTIONARY_LEAST = 3
#: Examples that one text gets at most.
MOST = 20
TREES, DEPTH = 30, 8
NEAR = 24
HASHED = 16
PATHS = 8
#: Place of the dictionary coverage among the features, and how many follow it before the hashed ones.
COVERAGE = 8
AFTER = 7
_SCHEMA = "id {id}, path string, begin long, end long, secret string, before string, after string, features array<double>"


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(secret: str, before: str, after: str, path: str | None) -> list[float]:
    """Length; shares of the four kinds of characters; transitions between kinds, and distinct characters, per
    character; entropy; dictionary coverage (0 until ``with_coverage``); kind of the neighbouring signs; words before it that
    speak of keys or of other strings; whether all signs are hexadecimal; a prefix; separators per character; hashed
    neighbouring words and hashed path."""
    n = len(secret)
    kinds = [_kind(c) for c in secret]
    count = Counter(secret)
    p = np.fromiter(count.values(), float) / n
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    out = [float(n), *(kinds.count(k) / n for k in range(4)), changes / n, len(count) / n, float(-(p * np.log2(p)).sum()), 0.0, float(before[-1:] in "=:\"'") if before else 0.0, float(after[:1] in "\"';,") if after else 0.0]
    out += [float(bool(OF_KEYS.search(before))), float(bool(OF_OTHERS.search(before))), float(not secret.strip("0123456789abcdef")), float(bool(_PREFIX.match(secret))), sum(c in "-_./@" for c in secret) / n]
    near = [0.0] * HASHED
    for i, w in enumerate([*re.findall(r"\w+", before)[-2:], *re.findall(r"\w+", after)[:1]]):
        near[zlib.crc32(f"{i > 1}{w.lower()}".encode()) % HASHED] += 1
    of_path = [0.0] * PATHS
    of_path[zlib.crc32((path or "").encode()) % PATHS] = 1.0
    return [*out, *near, *of_path]


def dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    """(w): the words that at least DICTIONARY_SHARE of all texts hold (DICTIONARY_LEAST of them at least).

    Only words of the letters a-z are kept, as parts of candidates have no others.
    """
    least = max(DICTIONARY_LEAST, DICTIONARY_SHARE * docs.count())
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+"))).alias("w"))
    return words.where(F.col("w").rlike("^[a-z]{3,15}$")).groupBy("w").count().where(F.col("count") >= least).select("w")


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, w, whole, grams): the letters-only parts of each secret with their length, and 4-grams of them with their count."""
    for batch in batches:
        keys, out = batch.column("key"), []
        for i, secret in enumerate(batch.column("secret").to_pylist()):
            for part, w in enumerate(x.lower() for x in re.split(r"[^A-Za-z]+", secret) if x):
                if 3 <= len(w) <= 15:
                    out.append((i, part, w, len(w), 0))
                out += ((i, part, gram, 0, n) for gram, n in Counter(w[k : k + 4] for k in range(len(w) - 3)).items())
        at, part, w, whole, grams = zip(*out, strict=True) if out else ([],) * 5
        yield pa.record_batch([keys.take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(w, pa.string()), pa.array(whole, pa.int32()), pa.array(grams, pa.int32())], names=["key", "part", "w", "whole", "grams"])


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the dictionary coverage among its features: of parts that are words their letters, of others the 4-grams that are words, per character."""
    keyed = found.withColumn("key", F.unhex(F.md5("secret")))
    probes = keyed.select("key", "secret").distinct().mapInArrow(_probes, "key binary, part int, w string, whole int, grams int")
    parts = probes.join(words, "w").groupBy("key", "part").agg(F.max("whole").alias("whole"), F.sum("grams").alias("grams"))
    covered = parts.groupBy("key").agg(F.sum(F.when(F.col("whole") > 0, F.col("whole")).otherwise(F.col("grams"))).alias("covered"))
    share = F.coalesce("covered", F.lit(0)).cast("double") / F.length("secret")
    whole = F.concat(F.slice("features", 1, COVERAGE), F.array(share), F.slice("features", COVERAGE + 2, AFTER + HASHED + PATHS))
    return keyed.join(covered, "key", "left").withColumn("features", whole).select(*found.columns)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, begin, end, secret, before, after, features): all matches of CANDIDATE in whole texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], {"path": [], "begin": [], "end": [], "secret": [], "before": [], "after": [], "features": []}
            for i, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                text = text.as_py()
                for m in CANDIDATE.finditer(text):
                    before, after = text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + NEAR]
                    at.append(i)
                    for column, x in zip(out.values(), (path, m.start(), m.end(), m[0], before, after, features(m[0], before, after, path)), strict=True):
                        column.append(x)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(out.values(), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())), strict=True))], names=["id", *out])

    return rows.mapInArrow(run, _SCHEMA.format(id=kind))


def planted(docs: DataFrame, id_col: str, text_col: str, path_col: str, rows: int, forms: tuple[Form, ...] = FORMS) -> DataFrame:
    """(id, path, text, plant, label): pieces of texts with one example of a key (label 1) or look-alike (0) each, about ``rows`` of either.

    All of it follows from the id: where it is put, its form, the signs around it and its characters. Where there are
    fewer texts than ``rows`` a text gets several examples, MOST at most.
    """
    count = max(docs.count(), 1)
    share, each = min(1.0, rows / count), max(1, min(MOST, rows // count))
    texts = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = texts.where(uniform("id", seed="plants") < F.lit(share)).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
    at = (uniform("id", "n", "label", seed="place") * F.length("text")).cast("int")
    near = base.select("id", "path", "label", F.concat_ws("|", F.col("id").cast("string"), "n", "label").alias("seed"), F.substr("text", F.greatest(at - 60, F.lit(1)), F.least(at, F.lit(60))).alias("left"), F.substr("text", at + 1, F.lit(200)).alias("right"))
    of_label = {k: tuple(f for f in forms if f.label == k) for k in (0, 1)}
    kind = dict(near.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, plants = [], []
            for label, seed, left, right in zip(*(batch.column(c).to_pylist() for c in ("label", "seed", "left", "right")), strict=True):
                before, plant, after = example(of_label[label], seed, re.findall(r"[A-Za-z]{4,12}", f"{left} {right}"))
                made.append(f"{left} {before}{plant}{after} {right[:60]}")
                plants.append(plant)
            yield pa.record_batch([batch.column("id"), batch.column("path"), pa.array(made, pa.string()), pa.array(plants, pa.string()), batch.column("label")], names=["id", "path", "text", "plant", "label"])

    return near.where(F.col("label").isin([k for k in of_label if of_label[k]])).mapInArrow(run, f"id {kind}, path string, text string, plant string, label int")


def planted_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", rows: int = TRAIN_ROWS, forms: tuple[Form, ...] = FORMS) -> DataFrame:
    """Findings in ``planted`` texts, with label: 1 for the key, 0 for the look-alike."""
    texts = planted(docs, id_col, text_col, path_col, rows, forms).where("plant <> ''").withColumn("row", F.struct("id", "plant", "label"))
    found = candidates(texts, "row", "text", "path")
    inside = F.contains("secret", F.substr("id.plant", F.lit(1), F.lit(8))) | F.contains("id.plant", "secret")
    found = found.where(inside).withColumns({"label": F.col("id.label"), "id": F.col("id.id")})
    return found.select("id", *[c for c in found.columns if c not in ("id", "label")], "label")


def forest_of(train: DataFrame, rows: int):
    """A forest fitted on about ``rows`` labelled findings (features, label), or the one label that there is (0 without any)."""
    count = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    if len(count) < 2:
        return float(next(iter(count), 0))
    share = min(1.0, rows / sum(count.values()))
    sample = train.where(uniform("id", "begin", "label", seed="findings") < F.lit(share)).select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=64).fit(sample)


def scored(found: DataFrame, forest) -> DataFrame:
    """``found`` with score, the forest's probability that a finding is a secret."""
    if isinstance(forest, float):
        return found.withColumn("score", F.lit(forest))
    return forest.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def learnt_from(id_col: str = "id") -> Column:
    """Whether findings of an id may be learnt from: its crc32 is not divisible by 5. The others measure the forest."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(True))


def scan(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """(id, begin, end, secret, score, is_secret): every candidate, with the forest's probability that it is a secret.

    labels: reviewed findings (secret string, label 0/1) to learn from; of several labels of one the largest counts.
    Without them examples of ``findings.FORMS`` are planted. Only findings of ids whose crc32 is not divisible by 5 are
    learnt from, at most about ``rows`` of each kind. A score of ``threshold`` makes a secret. With labels of one
    value only, that value is the score. begin and end count characters. Null or empty texts have no findings,
    repeated rows repeat theirs, an empty table gives an empty result. Texts are read whole; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    words = scratch.save(dictionary(docs, text_col))
    raw = scratch.save(candidates(docs, id_col, text_col, path_col))
    found = scratch.save(with_coverage(raw, words))
    scratch.drop(raw)
    if labels is None:
        train = with_coverage(planted_findings(docs, id_col, text_col, path_col, rows), words)
        train = scratch.save(train.where(learnt_from()).select("id", "begin", "features", "label"))
        forest = forest_of(train, 2 * rows)
        scratch.drop(train)
    else:
        marked = found.join(labels.groupBy("secret").agg(F.max("label").alias("label")), "secret").where("label is not null").where(learnt_from())
        forest = forest_of(marked, rows)
    result = scored(found.select("id", "begin", "end", "secret", "features"), forest)
    return result.select(F.col("id").alias(id_col), "begin", "end", "secret", "score", (F.col("score") >= threshold).alias("is_secret"))
