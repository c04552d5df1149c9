"""Embeddings: hashed bags of words, pluggable embedders, updates and drift."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.functions.text import content_tokens
from sparkrag.settings import DEFAULTS, STOPWORDS


_WORD = re.compile("[a-z0-9]{2,}")


def _blake2b(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")


def _md5(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16)


def _token_vectors(text: Column, dim: int, number: Callable[[str], int], kind: type) -> Column:
    """Unit vectors of the counts of a text's content tokens over `dim` buckets, a token's number's remainder; no tokens:
    zeros. The text goes to Python once and is cut into tokens there; each token is hashed once a worker."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bucket = dict.fromkeys(STOPWORDS, dim)  # one bucket more, which is thrown away
        for batch in batches:
            out = np.zeros((len(batch), dim), kind)
            for i in range(len(batch)):
                words = _WORD.findall(batch[i].as_py() or "")
                at = list(map(bucket.get, words))
                if None in at:
                    for w in {w for w, b in zip(words, at, strict=True) if b is None}:
                        bucket[w] = number(w) % dim
                    at = [bucket[w] for w in words]
                counts = np.bincount(at, minlength=dim + 1)[:dim].astype(float) if at else out[i]
                n = np.sqrt((counts * counts).sum())
                out[i] = counts / n if n else counts
            if len(bucket) > 400_000:
                bucket = dict.fromkeys(STOPWORDS, dim)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim)
            yield pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)), mask=batch.is_null() if batch.null_count else None)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>" if kind is np.float32 else "array<double>")(F.lower(text))


def hash_vectors(text: Column, dim: int = DEFAULTS.embed_dim) -> Column:
    """Vectors of a text's content tokens by an 8-byte BLAKE2b hash; null of null."""
    return _token_vectors(text, dim, _blake2b, np.float32)


def hash_embed(df: DataFrame, text: str = "content", dim: int = DEFAULTS.embed_dim, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, hash_vectors(F.col(text), dim))


def md5_bucket(token: Column, dim: int) -> Column:
    """A bucket from the first seven hexadecimal digits of MD5."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int") % dim


def md5_sparse(df: DataFrame, key: str = "chunk_id", text: str = "content", dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """Built-in twin of `hash_embed`: (key, bucket, weight) of the buckets that aren't zero."""
    words = df.select(key, F.explode(content_tokens(F.col(text))).alias("t")).groupBy(key, md5_bucket(F.col("t"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norm = words.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return words.join(norm, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def md5_embed(df: DataFrame, key: str = "chunk_id", text: str = "content", dim: int = DEFAULTS.embed_dim, out: str = "embedding") -> DataFrame:
    """df with the vectors of `md5_sparse` as arrays of doubles, zeros of null. All tokens of a text are in its row, so nothing is shuffled."""
    return df.withColumn(out, _token_vectors(F.coalesce(F.col(text), F.lit("")), dim, _md5, np.float64))


def embed(df: DataFrame, fn: Callable[[list[str]], np.ndarray], text: str = "content", out: str = "embedding", batch: int = DEFAULTS.embed_batch) -> DataFrame:
    """Vectors by a caller's function from a list of texts to a matrix, `batch` texts a call."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            rows = [v for i in range(0, len(texts), batch) for v in np.asarray(fn(texts.iloc[i : i + batch].fillna("").tolist()), np.float32)]
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def upsert_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the vectors of (chunk_id, embedding) where there is one."""
    new = vectors.select("chunk_id", F.col("embedding").alias("_new"))
    return chunks.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).select(*chunks.columns)


def reembed(chunks: DataFrame, workspace_id=None, dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """All vectors, or those of one workspace, from the contents anew. Only the chosen rows are embedded."""
    if workspace_id is None:
        return hash_embed(chunks, "content", dim).select(*chunks.columns)
    chosen = F.coalesce(F.col("workspace_id") == workspace_id, F.lit(False))
    return hash_embed(chunks.where(chosen), "content", dim).select(*chunks.columns).unionByName(chunks.where(~chosen))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 with a null or a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0))), F.lit(0.0))


def embedding_drift(pairs: DataFrame, level: float = 0.99) -> DataFrame:
    """min, mean and max cosine, and how many fall below the level, of rows (old, new)."""
    c = cosine(F.col("old"), F.col("new"))
    return pairs.select(c.alias("c")).agg(
        F.count("*").alias("n"), F.min("c").alias("min_cosine"), F.avg("c").alias("mean_cosine"), F.max("c").alias("max_cosine"), F.count_if(F.col("c") < level).alias("n_below")
    )
