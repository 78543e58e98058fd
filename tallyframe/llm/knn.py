"""Exact top-k search by inner product as a Voronoi kNN join.

With one more component, sqrt(M - |v|^2) for data (M: the largest squared norm) and 0 for queries, the largest
inner products are the smallest Euclidean distances. Data and queries go to the cell of their nearest pivot.
Summaries of the cells (the k least distances to the pivot and those of a query's own rows, the least and the largest) bound each query's
k-th distance; the triangle inequality then gives, for a group of queries and a cell, the ring of distances in
which data can matter. Only that ring is sent to the group, in chunks, and each chunk is solved by itself. A chunk holds cells
next to each other, or a part of a large cell, and a query goes to the chunks of its own rings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch

PIVOTS = (8, 256)
QUERIES_PER_PIVOT = 64
#: Components of the queries and of the rows that one task holds: 8 MB and 16 MB.
GROUP = 1 << 20
CHUNK = 1 << 21
STEP = 128


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * component) of each component; null where the vector or a component is null or not finite."""
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """One row per vector; shorter vectors are filled up with 0, which changes no inner product."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.list_(pa.int64()))
    size = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(array), dims), np.int64)
    out[np.repeat(np.arange(len(array)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = array.flatten().to_numpy()
    return out


def _distances(v: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each vector with the given last component to each pivot."""
    own = np.c_[v.astype(float), last]
    squared = (own**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * own @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every sum stays below 2^53, by whole numbers of any
    size where one could pass 64 bits."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return q @ v.T
    return q.astype(object) @ v.T.astype(object)


def packed(sizes: dict[int, int], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """Per cell of given size: (first group, count of groups). Small cells share a group of about ``most`` members with the
    cells next to them; a cell with more has several groups.

    Each group of queries is sent the rows that its rings reach, so fewer groups mean fewer copies of the data; and
    queries are sent to groups of rows, so fewer of these mean fewer copies of queries.
    """
    left, out, at, group, held = set(sizes), {}, None, 0, 0
    while left:
        at = min(left) if at is None else min(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        left.remove(at)
        if held and held + sizes[at] > most:
            group, held = group + 1, 0
        parts = -(-sizes[at] // most)
        out[at] = (group, parts)
        group, held = (group + parts, 0) if parts > 1 else (group, held + sizes[at])
    return out


def top_inner_products(data: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest inner product, ties to smaller ids.

    ``is_query`` chooses queries among the rows; rows with a query's own id are not its candidates. Vectors
    that are null or hold a null or non-finite component, and rows with a null id, take no part. With fewer
    than k candidates all are returned; an empty table gives an empty result. Repeated rows are candidates each,
    but ask once; rows of one id with different vectors ask each, and each has its ranks from 1. Vectors of fewer
    components count as filled up with 0. Components beyond 64 bits, and scores as returned (not as ranked), stop at the limits of a
    long. Other columns are not read.
    """
    spark = data.sparkSession
    scratch = Scratch(spark, "knn")
    rows = data.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = scratch.save(rows.where("id is not null and v is not null"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, queries, largest, dims = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.max(norm), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not queries:
        return spark.createDataFrame([], schema)
    # a query's own rows lie among the least distances too, and are none of its candidates
    own = rows.where("q").groupBy("id").count().agg(F.max("count")).first()[0]
    reach = k + own
    slack = 1e-3 + 1e-6 * float(np.sqrt(largest))  # of distances taken as roots of differences
    count = min(max(-(-queries // QUERIES_PER_PIVOT), PIVOTS[0]), PIVOTS[1])
    chosen = rows.select("v", norm.alias("n")).orderBy(F.xxhash64("id"), "id").limit(count).collect()
    pivots = np.array([[*r.v, *[0] * (dims - len(r.v)), np.sqrt(max(largest - r.n, 0))] for r in chosen], float)
    cells = len(pivots)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            d = _distances(v, np.sqrt(np.maximum(largest - (v.astype(float) ** 2).sum(1), 0)), pivots)
            cell = d.argmin(1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=["id", "v", "cell", "d"])

    cellwise = scratch.save(rows.select("id", "v").mapInArrow(to_cells, "id long, v array<long>, cell int, d double"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        most: dict[int, float] = {}
        for batch in batches:
            cell, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                near = np.sort(np.r_[d[cell == c], least.get(c, np.zeros(0))])
                most[c] = max(most.get(c, 0.0), near[-1])
                least[c] = near[:reach]
        yield pa.record_batch([pa.array(list(least), pa.int32()), pa.array([x.tolist() for x in least.values()], pa.list_(pa.float64())), pa.array(list(most.values()), pa.float64())], names=["cell", "least", "most"])

    parts = cellwise.select("cell", "d").mapInArrow(summarise, "cell int, least array<double>, most double")
    summary = parts.groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, reach).alias("least"), F.max("most").alias("most")).collect()
    near, inner, outer = np.full((cells, reach), np.inf), np.full(cells, np.inf), np.full(cells, -np.inf)
    for s in summary:
        near[s.cell, : len(s.least)], inner[s.cell], outer[s.cell] = s.least, s.least[0], s.most

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                v = _matrix(part.column(1), dims)
                d = _distances(v, np.zeros(len(v)), pivots)
                bound = np.partition((d[:, :, None] + near[None]).reshape(len(d), -1), reach - 1, axis=1)[:, reach - 1]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(d.argmin(1).astype(np.int32)), pa.array(bound * (1 + 1e-9) + slack), pa.array(list(d), pa.list_(pa.float64()))], names=["id", "v", "cell", "bound", "d"])

    asked = scratch.save(rows.where("q").select("id", "v").distinct().mapInArrow(to_groups, "id long, v array<long>, cell int, bound double, d array<double>"))
    scratch.drop(rows)
    width = max(dims, 1)

    def dealt(df: DataFrame, most: int) -> dict[int, tuple[int, int]]:
        return packed({r.cell: r["count"] for r in df.groupBy("cell").count().collect()}, pivots, max(most // width, STEP))

    def of_cell(places: dict[int, tuple[int, int]]) -> Column:
        """The group, or chunk, of a row by its cell and id."""
        place = F.element_at(F.create_map(*[F.lit(x) for c, (first, parts) in places.items() for x in (c, F.struct(F.lit(first).alias("first"), F.lit(parts).alias("parts")))]), F.col("cell"))
        return (place["first"] + F.pmod(F.xxhash64("id"), place["parts"])).cast("int")

    chunks = dealt(cellwise, CHUNK)
    asked = asked.withColumn("group", of_cell(dealt(asked, GROUP))).withColumn("asker", F.xxhash64("id", "v"))
    by_cell = {"inner": inner.tolist(), "outer": outer.tolist(), "first": [chunks.get(c, (0, 1))[0] for c in range(cells)], "last": [sum(chunks.get(c, (0, 1))) - 1 for c in range(cells)]}
    each = F.arrays_zip("d", *(F.lit(x).alias(c) for c, x in by_cell.items()))
    reached = lambda c: (c["d"] - F.col("bound") <= c["outer"]) & (c["d"] + F.col("bound") >= c["inner"])
    rings = asked.select("group", "bound", F.posexplode(each).alias("cell", "c")).where(reached(F.col("c")))
    rings = scratch.save(rings.groupBy("group", "cell").agg(F.min(F.expr("c.d - bound")).alias("from"), F.max(F.expr("c.d + bound")).alias("to")))
    sent = cellwise.join(rings, "cell").where("d between `from` and `to`").select("group", of_cell(chunks).alias("chunk"), "id", "v")
    own_chunks = F.array_distinct(F.flatten(F.transform(F.filter(each, reached), lambda c: F.sequence(c["first"], c["last"]))))
    askers = asked.select("group", F.explode(own_chunks).alias("chunk"), "id", "v", "asker")

    def solve(q: pa.Table, data: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and data.num_rows:
            ids, of, asker = data.column("id").to_numpy(), q.column("id").to_numpy(), q.column("asker").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v, asking = ids[order], _matrix(data.column("v"), dims)[order], _matrix(q.column("v"), dims)
            for low in range(0, len(of), STEP):
                score = _products(asking[low : low + STEP], v)
                for i, who, row in zip(of[low : low + STEP], asker[low : low + STEP], score, strict=True):
                    at = np.flatnonzero(ids != i)
                    if len(at) > k:
                        cut = np.partition(row[at], len(at) - k)[len(at) - k]
                        at = at[row[at] >= cut]
                        at = at[np.argsort(-row[at], kind="stable")[:k]]
                    out.append((np.full(len(at), i), np.full(len(at), who), ids[at], np.clip(row[at], -(1 << 63), (1 << 63) - 1).astype(np.int64), row[at].astype(float)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [*[np.zeros(0, np.int64)] * 4, np.zeros(0)]
        return pa.table(dict(zip(("query_id", "asker", "vec_id", "score", "size"), map(pa.array, columns), strict=True)))

    found = askers.groupBy("group", "chunk").cogroup(sent.groupBy("group", "chunk")).applyInArrow(solve, "query_id long, asker long, vec_id long, score long, size double")
    rank = F.row_number().over(W.partitionBy("query_id", "asker").orderBy(F.desc("score"), F.desc("size"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
