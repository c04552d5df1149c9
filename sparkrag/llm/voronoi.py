"""Exact top-k search by inner product as a Voronoi join.

Vectors are quantised to whole numbers and equal vectors are merged, each keeping its K+1 smallest
ids, which is all that any query can need. Pivots, a bounded sample of the vectors, split the space
into cells. For each cell a summary holds its row count, its radius and the distances of the K+1
rows nearest to the pivot. From the summaries every query gets a lower bound of its (K+1)-th best
score and, for every cell, an upper bound of any score in it:

    q.x <= q.p + |q| radius        q.x >= q.p - |q| distance

A query is sent to the cells whose upper bound reaches its lower bound, and to no other. Queries and
data meet in blocks of bounded size, each block pair keeps its K+1 best rows a query, and those are
ranked once more. Of the two sides the queries are replicated, as they are fewer by far.

Vectors of different lengths have no product: each is searched among those of its own length, whose cells
have pivots of that length. Only the MOST_LENGTHS most frequent lengths have pivots; the others are dealt to as
many cells without one, where a query meets every vector of its length.

Cases: null ids, null or empty vectors, and vectors with null or non-finite components take no part; a repeated (id, vector) row counts once; ties go to the smaller id; with
fewer candidates than K all are returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.llm.common import stored

#: Rows of a data block and of a query block, and the most pivots.
BLOCK, MOST_PIVOTS = 4096, 1024
#: Lengths that have pivots, and cells that the other lengths share.
MOST_LENGTHS = 64


def quantised(col: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(col, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(col: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return col.isNotNull() & (F.size(col) > 0) & ~F.exists(col, bad)


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles where no sum can pass 2**53."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch for each length of their vectors `v`, with the vectors as a matrix."""
    size = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        part = batch.take(pa.array(np.flatnonzero(size == n)))
        yield part, matrix(part["v"])


class Pivots:
    """centres: a vector for each cell; cells of the same length are told apart by distance. The last MOST_LENGTHS
    cells have no centre and are those of the lengths that no centre has."""

    def __init__(self, centres: list[list[int]]):
        size = np.array([len(c) for c in centres])
        self.centres, self.count = len(centres), len(centres) + MOST_LENGTHS
        self.of = {int(n): (at := np.flatnonzero(size == n), np.array([centres[i] for i in at], np.float64)) for n in np.unique(size)}

    def shared(self, length: int) -> int:
        """The cell of a length that has no centre."""
        return self.centres + length % MOST_LENGTHS


def _cells(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in by_length(batch):
                if x.shape[1] in pivots.of:
                    cells, centres = pivots.of[x.shape[1]]
                    x = x.astype(np.float64)
                    far = np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)
                    best = far.argmin(1)
                    cell, reach = cells[best], np.linalg.norm(x - centres[best], axis=1)
                else:
                    cell, reach = np.full(len(x), pivots.shared(x.shape[1])), np.zeros(len(x))
                yield pa.record_batch([part["key"], part["v"], part["ids"], pa.array(cell), pa.array(reach)], names=["key", "v", "ids", "cell", "reach"])

    return run


class Summary:
    """What the driver keeps of the cells: as many rows as there are pivots."""

    def __init__(self, pivots: Pivots, rows: list, keep: int):
        self.pivots, self.keep, n = pivots, keep, pivots.count
        self.count, self.radius, self.near = np.zeros(n, np.int64), np.full(n, -1.0), np.full((n, keep), np.inf)
        for r in rows:
            self.count[r["cell"]], self.radius[r["cell"]] = r["n"], r["radius"]
            self.near[r["cell"], : len(r["near"])] = r["near"]

    def needed(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of q and cells that may hold one of their best rows."""
        if q.shape[1] not in self.pivots.of:
            return np.arange(len(q)), np.full(len(q), self.pivots.shared(q.shape[1]))
        cells, centres = self.pivots.of[q.shape[1]]
        near, radius = self.near[cells], np.maximum(self.radius[cells], 0)
        q = q.astype(np.float64)
        at, size = q @ centres.T, np.linalg.norm(q, axis=1)[:, None]
        slack = 1e-6 * (1 + np.abs(at) + size * radius)
        with np.errstate(invalid="ignore"):
            low = np.nan_to_num(at[:, :, None] - size[:, :, None] * near[None], nan=-np.inf).reshape(len(q), -1)
        low[:, np.isinf(near.reshape(-1))] = -np.inf
        least = np.partition(low, -self.keep, axis=1)[:, -self.keep]
        row, cell = np.nonzero((at + size * radius + slack >= (least - slack.max(axis=1))[:, None]) & (self.count[cells] > 0))
        return row, cells[cell]


def _sent(summary: Summary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for part, q in by_length(batch.slice(at, 256)):
                    row, cell = summary.needed(q)
                    yield pa.record_batch([part["key"].take(pa.array(row)), part["v"].take(pa.array(row)), pa.array(cell)], names=["key", "v", "cell"])

    return run


def _best(keep: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = matrix(data["v"]), matrix(queries["v"])
        ids = data["ids"].combine_chunks()
        row, ids = np.repeat(np.arange(len(x)), np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy()
        keys, out = queries["key"].to_pylist(), []
        for at in range(0, len(q), 512):
            scores = inner_products(q[at : at + 512], x)
            for i, s in enumerate(scores):
                level = np.partition(s, -keep)[-keep] if len(s) > keep else s.min()
                mine = np.flatnonzero(s[row] >= level)
                top = mine[np.lexsort((ids[mine], -s[row[mine]]))[:keep]]
                out.append((keys[at + i], ids[top], s[row[top]]))
        return pa.table([pa.array(np.repeat(np.array([k for k, _, _ in out], object), [len(i) for _, i, _ in out]), pa.string()), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))], schema=schema)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all other rows."""
    keep = k + 1
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col)).alias("v"))
    rows = stored(rows.withColumn("key", F.sha2(F.to_json("v"), 256)), "vectors")
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(MOST_LENGTHS).collect()
    if not sizes:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))

    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    merged = rows.select("key", "id").distinct().withColumn("at", first).where(F.col("at") <= keep).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = merged.join(rows.groupBy("key").agg(F.first("v").alias("v")), "key").select("key", "v", "ids")

    n = sum(r["n"] for r in sizes)
    n_pivots = pivots or int(min(MOST_PIVOTS, max(8, n // block)))
    centres = []  # at most MOST_PIVOTS rows, and one for each length
    for r in sizes:
        share = max(1, round(n_pivots * r["n"] / n))
        centres += [c["v"] for c in rows.where(F.size("v") == r["size"]).select("key", "v").distinct().orderBy(F.substring("key", 9, 16), "key").limit(share).collect()]
    centres = Pivots(centres)
    data = stored(distinct.mapInArrow(_cells(centres), "key string, v array<long>, ids array<long>, cell long, reach double"), "cells")

    nearest = F.row_number().over(Window.partitionBy("cell").orderBy("reach"))
    near = data.select("cell", "reach").withColumn("at", nearest).where(F.col("at") <= keep).groupBy("cell").agg(F.array_sort(F.collect_list("reach")).alias("near"))
    sizes = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius"))
    summary = Summary(centres, sizes.join(near, "cell").collect(), keep)  # a row for each pivot

    asked = rows.where(F.col("id") % every == 0).select("key", F.col("id").alias("query_id")).distinct()
    queries = asked.select("key").distinct().join(data.select("key", "v"), "key")
    sent = stored(queries.mapInArrow(_sent(summary), "key string, v array<long>, cell long"), "sent")
    load = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    blocks = lambda count: F.element_at(F.lit([max(1, -(-int(count.get(c, 0)) // block)) for c in range(centres.count)]), F.col("cell").cast("int") + 1)
    data_blocks, query_blocks = blocks(dict(enumerate(summary.count.tolist()))), blocks(load)
    number = F.abs(F.xxhash64("key"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), c.cast("int") - 1))
    left = data.withColumn("d", (number % data_blocks).cast("int")).withColumn("q", spread(query_blocks))
    right = sent.withColumn("q", (number % query_blocks).cast("int")).withColumn("d", spread(data_blocks))
    where, size = ["cell", "size", "d", "q"], F.size("v").alias("size")
    found = left.select("cell", size, "d", "q", "v", "ids").groupBy(*where).cogroup(right.select("cell", size, "d", "q", "key", "v").groupBy(*where)).applyInArrow(_best(keep), "key string, vec_id long, score long")

    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("at") <= keep).select("key", "vec_id", "score")
    own = asked.join(best, "key").where(F.col("vec_id") != F.col("query_id"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
