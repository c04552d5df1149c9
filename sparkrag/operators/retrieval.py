"""Tenant-scoped hybrid retrieval over tables of queries and chunks.

queries: (query_id, workspace_id, question[, embedding]); chunks: (chunk_id, workspace_id, file_id,
filename, content[, embedding]). Contents stay out of the search itself: it moves ids and scores, and
texts are joined to the few rows that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import content_tokens, rewrite_query, should_rewrite, title_tokens
from sparkrag.operators.keyword import KeywordIndex, keyword_index, keyword_search, postings  # noqa: F401
from sparkrag.settings import DEFAULTS, Settings
from sparkrag.sources.io import settled

#: Rows of a block of chunks, and of queries, that meet in one task.
BLOCK, QUERY_BLOCK = 8192, 1024


def acl_scope(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of a query and a chunk of its workspace."""
    return queries.join(chunks, "workspace_id")


def top_by(df: DataFrame, k: int, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def unit_rows(col: pa.Array) -> np.ndarray:
    rows = [np.asarray(x if x is not None else [], np.float64) for x in col.to_pylist()]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if len(r) == width:
            out[i] = r
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _nearest(k: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", queries.schema.field("query_id").type), ("chunk_id", chunks.schema.field("chunk_id").type), ("dense_score", pa.float64())])
        if not chunks.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = unit_rows(chunks["embedding"].combine_chunks()), unit_rows(queries["embedding"].combine_chunks())
        if x.shape[1] != q.shape[1]:
            return schema.empty_table()
        order = pc.sort_indices(chunks["chunk_id"].combine_chunks())  # ties go to the smaller id
        ids, x, asked, out = chunks["chunk_id"].combine_chunks().take(order), x[order.to_numpy()], queries["query_id"].to_pylist(), []
        for at in range(0, len(q), 256):
            scores = np.round(np.maximum(0, q[at : at + 256] @ x.T), 12)
            for i, s in enumerate(scores):
                best = np.argsort(-s, kind="stable")[:k] if len(s) <= 4 * k else (m := np.flatnonzero(s >= np.partition(s, -k)[-k]))[np.argsort(-s[m], kind="stable")[:k]]
                out.append((asked[at + i], best, s[best]))
        return pa.table([pa.array([n for n, b, _ in out for _ in b], schema.field("query_id").type), ids.take(pa.array(np.concatenate([b for _, b, _ in out]))), pa.array(np.concatenate([s for _, _, s in out]))], schema=schema)

    return run


def _blocks(df: DataFrame, by: list[str], size: int, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """df with a block number, and (by, n blocks): a large group gets as many blocks as it needs."""
    counts = df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(f"n_{name}"))
    return df.join(counts, by).withColumn(name, F.pmod(F.xxhash64(key), F.col(f"n_{name}")).cast("int")).drop(f"n_{name}"), counts


def block_pairs(rows: DataFrame, asked: DataFrame, by: list[str], size: int, asked_size: int) -> tuple[DataFrame, DataFrame]:
    """rows (by, chunk_id, ...) and asked (by, query_id, ...) with the numbers d and q of their blocks, each row once for every block of the other side that it meets."""
    data, n_data = _blocks(rows, by, size, "d", "chunk_id")
    queries, n_asked = _blocks(asked, by, asked_size, "q", "query_id")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    return data.join(n_asked, by).withColumn("q", spread("n_q")), queries.join(n_data, by).withColumn("d", spread("n_d"))


def dense_knn(queries: DataFrame, chunks: DataFrame, k: int = DEFAULTS.candidates, by: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_id, dense_score, rank): the k chunks of the workspace with the largest cosine, ties to
    the smaller chunk_id. Blocks of chunks meet blocks of queries of the same workspace in numpy; each
    pair of blocks returns k rows a query. dense_score is max(0, cosine), 0 with a zero vector."""
    by = by or ["workspace_id"]
    rows, asked = chunks.where("embedding is not null").select(*by, "chunk_id", "embedding"), queries.where("embedding is not null").select(*by, "query_id", "embedding")
    left, right = block_pairs(rows, asked, by, BLOCK, QUERY_BLOCK)
    keys = [*by, "d", "q"]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, dense_score double"
    fresh = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in (*keys, *cols)]).groupBy(*keys)  # noqa: E731  the sides may share a source
    pairs = fresh(left, "chunk_id", "embedding").cogroup(fresh(right, "query_id", "embedding"))
    return top_by(pairs.applyInArrow(_nearest(k), schema), k, ["query_id"], F.desc("dense_score"), F.col("chunk_id"))


def fuse(dense: DataFrame, keyword: DataFrame, min_score: float = DEFAULTS.min_score, overlap: str = "keyword_wins", settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, dense_score, keyword_score, score, rank) of rows (query_id, chunk_id, ..., rank).

    score = dense weight * dense_score + keyword weight * (rrf_k + 1) / (rrf_k + keyword rank). With
    "keyword_wins" a chunk found by both has no dense score; "merge" keeps it.
    """
    d = dense.select("query_id", "chunk_id", "dense_score", F.lit(True).alias("_d"))
    w = keyword.select("query_id", "chunk_id", "keyword_score", F.col("rank").alias("_k"))
    both = d.join(w, ["query_id", "chunk_id"], "full_outer")
    dense_score = F.coalesce("dense_score", F.lit(0.0))
    if overlap == "keyword_wins":
        dense_score = F.when(F.col("_k").isNotNull(), 0.0).otherwise(dense_score)
    share = F.coalesce((settings.rrf_k + 1) / (settings.rrf_k + F.col("_k")), F.lit(0.0))
    rows = both.select("query_id", "chunk_id", dense_score.alias("dense_score"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), share.alias("_share"))
    scored = rows.withColumn("score", settings.dense_weight * F.col("dense_score") + settings.keyword_weight * F.col("_share")).drop("_share").where(F.col("score") >= min_score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")))


def query_variants(queries: DataFrame, rewrite: bool = True) -> DataFrame:
    """(query_id, workspace_id, variant, question): the question, and its semantic and keyword variants if it is worth it."""
    asked = queries.select("query_id", "workspace_id", "question", rewrite_query(F.col("question")).alias("r"), (should_rewrite(F.col("question")) & F.lit(rewrite)).alias("more"))
    one = F.array("question")
    texts = F.when(F.col("more"), F.concat(one, F.filter(F.array("r.cleaned", "r.keyword"), lambda t: t != F.col("question")))).otherwise(one)
    return asked.select("query_id", "workspace_id", F.posexplode(F.array_distinct(texts)).alias("variant", "question"))


def multi_variant_candidates(found: DataFrame, score: str) -> DataFrame:
    """(query_id, chunk_id, score, rank) of hits (query_id, variant, rank, chunk_id, score): the first
    sighting's score, 0.05 more for each later one up to 1, in order of first sightings."""
    seen = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("variant", "rank", score)).alias("f"), F.count("*").alias("n"))
    total = F.least(F.lit(1.0), F.col(f"f.{score}") + 0.05 * (F.col("n") - 1))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("f.variant", "f.rank", "chunk_id"))
    return seen.select("query_id", "chunk_id", F.when(F.col("n") > 1, total).otherwise(F.col(f"f.{score}")).alias(score), position.alias("rank"))


def fallback_best(fused: DataFrame, dense: DataFrame, keyword: DataFrame) -> DataFrame:
    """fused, and for queries that have candidates but none over the threshold the single best, dense first."""
    zero = F.lit(0.0)
    d = dense.select("query_id", "chunk_id", "dense_score", zero.alias("keyword_score"), F.lit(0).alias("_list"), "rank")
    w = keyword.select("query_id", "chunk_id", zero.alias("dense_score"), "keyword_score", F.lit(1).alias("_list"), "rank")
    left = d.unionByName(w).join(fused.select("query_id").distinct(), "query_id", "left_anti")
    best = top_by(left.withColumnRenamed("rank", "_pos"), 1, ["query_id"], F.col("_list"), F.col("_pos"))
    return fused.unionByName(best.withColumn("score", zero).select(*fused.columns))


def _term_table(hits: DataFrame) -> DataFrame:
    """hits with words (distinct query terms), tokens, n, df and idf arrays by term. A hit list is small,
    so its terms are worked on as arrays in one window of the query."""
    w = Window.partitionBy("query_id")
    rows = hits.withColumns({"_terms": F.array_distinct(content_tokens(F.col("question"))), "_tokens": content_tokens(F.col("content"))})
    tf = F.transform("_terms", lambda t: F.size(F.filter("_tokens", lambda x: x == t)))
    rows = rows.withColumns({"_tf": tf, "_n": F.count("*").over(w), "_len": F.size("_tokens")})
    seen = F.collect_list(F.transform("_tf", lambda x: (x > 0).cast("int"))).over(w)
    rows = rows.withColumn("_seen", seen)
    return rows.withColumn("_df", F.transform("_terms", lambda _t, i: F.aggregate("_seen", F.lit(0), lambda s, x: s + x[i]))).drop("_seen")


def bm25_rerank(hits: DataFrame, top_n: int = 0, settings: Settings = DEFAULTS) -> DataFrame:
    """hits (query_id, question, filename, content, score, rank, ...) with a new rank and final score.

    BM25 over the query's own hits with a bonus for title terms, mixed with the score, both relative to
    the best; equal finals keep their order; fewer than two hits, or no terms, change nothing; top_n
    reorders only the first hits.
    """
    head = hits if not top_n else hits.where(F.col("rank") <= top_n)
    rows = _term_table(head).withColumn("_title", title_tokens(F.col("content"), F.coalesce("filename", F.lit(""))))
    w = Window.partitionBy("query_id")
    rows = rows.withColumn("_avg", F.coalesce(F.nullif(F.avg("_len").over(w), F.lit(0.0)), F.lit(1.0)))
    k1, b = settings.bm25_k1, settings.bm25_b
    norm = k1 * (1.0 - b + b * F.col("_len") / F.col("_avg"))

    def part(term, i):
        tf, df = F.col("_tf")[i], F.col("_df")[i]
        idf = F.log(1.0 + (F.col("_n") - df + 0.5) / (df + 0.5))
        bonus = F.when(F.array_contains("_title", term), idf * (settings.title_bonus - 1.0)).otherwise(0.0)
        return F.when(tf > 0, idf * (tf * (k1 + 1.0)) / (tf + norm) + bonus).otherwise(0.0)

    rows = rows.withColumn("_bm25", F.aggregate(F.transform("_terms", part), F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumns({"_bmax": F.max("_bm25").over(w), "_fmax": F.max("score").over(w)})
    relative = lambda x, most: F.when(F.col(most) > 0, F.col(x) / F.nullif(most, F.lit(0.0))).otherwise(0.0)
    bm, fu = relative("_bm25", "_bmax"), relative("score", "_fmax")
    final = F.when((F.col("_bmax") > 0) & (F.col("_fmax") > 0), settings.weight_bm25 * bm + settings.weight_fusion * fu).when(F.col("_bmax") > 0, bm).otherwise(fu)
    same = (F.col("_n") < 2) | (F.size("_terms") == 0)
    rows = rows.withColumn("final", F.when(same, F.lit(None)).otherwise(final))
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last(F.round("final", 12)), "rank"))
    done = rows.select(*[c for c in hits.columns if c != "rank"], "final", rank.alias("rank"))
    if not top_n:
        return done
    tail = hits.where(F.col("rank") > top_n).withColumn("final", F.lit(None).cast("double"))
    return done.unionByName(tail.select(*done.columns))


def lexical_confidence(hits: DataFrame) -> DataFrame:
    """hits (query_id, question, content, rank, ...) with confidence, matched_terms, total_terms, idf_sum and
    idf_matched: the idf share of the query's terms that each hit holds."""
    rows = _term_table(hits)
    idf = F.transform("_df", lambda df: F.when(df > 0, F.log(1.0 + (F.col("_n") - df + 0.5) / (df + 0.5))).otherwise(F.log(1.0 + F.col("_n"))))
    rows = rows.withColumn("_idf", idf)
    total = F.aggregate("_idf", F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate(F.zip_with("_idf", "_tf", lambda i, t: F.when(t > 0, i).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    matched = F.filter("_terms", lambda _t, i: F.col("_tf")[i] > 0)
    score = F.when(total > 0, own / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return rows.select(*hits.columns, F.round(score, 6).alias("confidence"), matched.alias("matched_terms"), F.size("_terms").alias("total_terms"), F.round(total, 6).alias("idf_sum"), F.round(own, 6).alias("idf_matched"))


def rerank(hits: DataFrame, fn, schema: str) -> DataFrame:
    """Any reranker: fn takes and returns the pandas rows of one query's hits."""
    return hits.groupBy("query_id").applyInPandas(fn, schema)


def with_content(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with question, filename, content and place, joined at the end to the few rows found."""
    extra = [c for c in ("file_id", "filename", "content", "locator_type", "locator_start", "locator_end") if c in chunks.columns]
    return hits.join(queries.select("query_id", "question"), "query_id").join(chunks.select("chunk_id", *extra), "chunk_id")


def retrieve(queries: DataFrame, chunks: DataFrame, index: KeywordIndex | None = None, k: int = DEFAULTS.top_k, candidates: int = DEFAULTS.candidates, rewrite: bool = False, rerank_hits: bool = True, overlap: str = "keyword_wins", dim: int = DEFAULTS.embed_dim, live: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Hybrid retrieval of a whole table of queries: dense and keyword candidates, of rewritten variants too,
    fused, with a fallback, reranked, and cut to k hits with their texts. live: (file_id) of the files to
    search, all by default."""
    from sparkrag.operators.embed import hash_embed

    if live is not None:
        chunks = chunks.join(live.select("file_id").distinct(), "file_id", "left_semi")
        index = None
    index = keyword_index(chunks) if index is None else index
    variants = query_variants(queries, rewrite).withColumn("key", F.concat_ws("|", F.col("query_id").cast("string"), "variant"))
    asked = variants.withColumnsRenamed({"query_id": "_query", "key": "query_id"})
    if "embedding" not in queries.columns:
        asked = hash_embed(asked, "question", dim)
    elif not rewrite:
        asked = asked.join(queries.select(F.col("query_id").alias("_query"), "embedding"), "_query")
    asked = settled(asked)
    link = asked.select("query_id", "_query", "variant")
    own = lambda found: found.join(link, "query_id").drop("query_id").withColumnRenamed("_query", "query_id")
    dense = settled(multi_variant_candidates(own(dense_knn(asked, chunks, candidates)), "dense_score"))
    words = settled(multi_variant_candidates(own(keyword_search(asked, index, candidates)), "keyword_score"))
    hits = settled(fallback_best(fuse(dense, words, settings.min_score, overlap, settings), dense, words))
    rows = with_content(hits, queries, chunks)
    if rerank_hits:
        rows = bm25_rerank(rows, settings.rerank_top_n, settings)
    return rows.where(F.col("rank") <= k)
