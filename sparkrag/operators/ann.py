"""Approximate nearest neighbours: an inverted file of product-quantised vectors.

A unit vector belongs to the cell of its nearest centre and is stored as a code of one byte for each of its
`parts`: the number of the nearest word of that part's book. A query looks its product with every word up
once, and its product with a vector is then a sum of `parts` looked-up numbers. Only the codes of the
cells nearest to the query are added up, and only the best `shortlist` of a query are ranked by their
full vectors. Centres and books are fitted on a bounded sample; every vector is in the index.

Null vectors aren't in the index; a zero vector scores 0; vectors of another length than the index's have no cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.operators.retrieval import BLOCK, QUERY_BLOCK, block_pairs, top_by, unit_rows
from sparkrag.settings import DEFAULTS
from sparkrag.sources.io import settled

#: Cells, cells searched, parts of a code, words of a book, and vectors of the sample that centres and books are fitted on.
LISTS, PROBES, PARTS, WORDS, SAMPLE = 100, 90, 32, 256, 20_000


class IvfIndex(NamedTuple):
    """centres: a row for each cell; books: (part, word, component); codes: (workspace_id, chunk_id, cell, code)."""

    centres: np.ndarray
    books: np.ndarray
    codes: DataFrame


def fitted(x: np.ndarray, words: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centres of k-means over the rows of x, `words` of them or one for each different row."""
    different = np.unique(x, axis=0)
    centres = different[np.random.default_rng(seed).permutation(len(different))[:words]].astype(np.float64)
    for _ in range(rounds if len(different) > words else 0):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(1)[None] - 2 * x[at : at + 4096] @ centres.T).argmin(1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (row, part, component), filled up with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def encoded(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    pieces = _cut(x, len(books))
    return np.stack([nearest(pieces[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)


def ivf_index(chunks: DataFrame, lists: int = LISTS, parts: int = PARTS, sample: int = SAMPLE) -> IvfIndex:
    """chunks: (workspace_id, chunk_id, embedding)."""
    rows = chunks.where("embedding is not null").select("workspace_id", "chunk_id", "embedding")
    learned = unit_rows(rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks())  # `sample` vectors
    parts = max(1, min(parts, learned.shape[1]))
    centres = fitted(learned, lists)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    pieces = _cut(learned, parts)
    books = [fitted(pieces[:, p], WORDS) for p in range(parts)]
    full = max(map(len, books))
    books = np.stack([np.pad(b, ((0, full - len(b)), (0, 0)), mode="edge") if len(b) else np.zeros((full, pieces.shape[2])) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit_rows(b["embedding"])
            good = x.shape[1] == learned.shape[1] and len(centres) > 0
            cell = (x @ centres.T).argmax(1).astype(np.int32) if good else np.zeros(0, np.int32)
            code = [c.tobytes() for c in encoded(x, books)] if good else []
            part = b if good else b.slice(0, 0)
            yield pa.record_batch([part["workspace_id"], part["chunk_id"], pa.array(cell), pa.array(code, pa.binary())], names=["workspace_id", "chunk_id", "cell", "code"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    coded = rows.mapInArrow(run, f"workspace_id {kind('workspace_id')}, chunk_id {kind('chunk_id')}, cell int, code binary")
    return IvfIndex(centres, books, settled(coded, "codes"))


def _shortlisted(centres: np.ndarray, books: np.ndarray, probes: int, most: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", queries.schema.field("query_id").type), ("chunk_id", chunks.schema.field("chunk_id").type), ("near", pa.float64())])
        if not chunks.num_rows or not queries.num_rows:
            return schema.empty_table()
        q = unit_rows(queries["embedding"].combine_chunks())
        if q.shape[1] != centres.shape[1]:
            return schema.empty_table()
        chunks = chunks.sort_by("chunk_id")  # ties go to the smaller id
        codes = np.frombuffer(b"".join(chunks["code"].to_pylist()), np.uint8).reshape(chunks.num_rows, -1).T.astype(np.int64)
        cell, ids, asked, found, scores = chunks["cell"].to_numpy(), chunks["chunk_id"].combine_chunks(), [], [], []
        part = np.arange(len(books))[:, None]
        order = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        for i, pieces in enumerate(_cut(q, len(books))):
            table = np.einsum("pwc,pc->pw", books, pieces)
            probed = np.zeros(len(centres), bool)
            probed[order[i]] = True
            rows = np.flatnonzero(probed[cell])
            near = table[part, codes[:, rows]].sum(axis=0)
            best = np.arange(len(rows)) if len(rows) <= most else np.flatnonzero(near >= np.partition(near, -most)[-most])
            best = best[np.argsort(-near[best], kind="stable")[:most]]
            asked.append(np.full(len(best), i))
            found.append(rows[best])
            scores.append(near[best])
        return pa.table([queries["query_id"].combine_chunks().take(pa.array(np.concatenate(asked))), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], schema=schema)

    return run


def cosine(a: Column, b: Column) -> Column:
    """max(0, cosine) of two vector columns, rounded to 12 places; 0 with a zero vector or other lengths."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            x, y = unit_rows(x), unit_rows(y)
            yield pa.array(np.round(np.maximum(0, (x * y).sum(1)), 12) if x.shape == y.shape else np.zeros(len(x)))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(a, b)


def shortlist(queries: DataFrame, index: IvfIndex, most: int, probes: int = PROBES) -> DataFrame:
    """(query_id, chunk_id, near, rank): the `most` chunks of the query's workspace that are nearest by their codes."""
    asked = queries.where("embedding is not null").select("workspace_id", "query_id", "embedding")
    left, right = block_pairs(index.codes, asked, ["workspace_id"], BLOCK, QUERY_BLOCK)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {index.codes.schema['chunk_id'].dataType.simpleString()}, near double"
    keys = ["workspace_id", "d", "q"]
    fresh = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in (*keys, *cols)]).groupBy(*keys)
    found = fresh(left, "chunk_id", "cell", "code").cogroup(fresh(right, "query_id", "embedding")).applyInArrow(_shortlisted(index.centres, index.books, probes, most), kinds)
    return top_by(found, most, ["query_id"], F.desc("near"), F.col("chunk_id"))


def ivf_knn(queries: DataFrame, chunks: DataFrame, k: int = DEFAULTS.candidates, index: IvfIndex | None = None, probes: int = PROBES, most: int | None = None) -> DataFrame:
    """Approximate `dense_knn`: (query_id, chunk_id, dense_score, rank). Full vectors are read for the `most` best of each
    query, 2k by default. `recall_of` tells how many of the neighbours are found."""
    index = ivf_index(chunks) if index is None else index
    near = shortlist(queries, index, most or 2 * k, probes).select("query_id", "chunk_id")
    rows = near.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id").join(chunks.select("chunk_id", F.col("embedding").alias("_c")), "chunk_id")
    scored = rows.select("query_id", "chunk_id", cosine(F.col("_q"), F.col("_c")).alias("dense_score"))
    return top_by(scored, k, ["query_id"], F.desc("dense_score"), F.col("chunk_id"))


def recall_of(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours that the approximate search found."""
    hit = exact.select("query_id", "chunk_id").join(approximate.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
