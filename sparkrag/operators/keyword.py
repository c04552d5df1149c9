"""Keyword search with a bound: postings of a query's common tokens are read for few chunks only.

A chunk's score is the sum of its weights of the query's tokens, so what all of the tokens that are left can add
is known from the largest weight of each. The rare tokens are joined first. The score of the k-th best
chunk among those they lead to is a level that the answer reaches anyway. The most common tokens
whose largest weights together stay below that level can't bring a chunk in by themselves: their
postings are not joined. Chunks that the other tokens lead to, and that can still reach the level, get
the weights of the common tokens from a row of their own, which holds the chunk's HEAD most common
tokens of its workspace. Weights are whole billionths, so that sums and comparisons are exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import keywords
from sparkrag.settings import DEFAULTS
from sparkrag.sources.io import settled

#: Most common tokens of a workspace that a chunk's own row holds; postings of rare tokens to try first, for each of the k rows asked for.
HEAD, PROBE = 256, 6
#: Scores are ranked by millionths: chunks this close below a level may tie with it.
_UNIT, _TIE = 1_000_000_000, 1001
_WORD = re.compile("[a-z0-9]{2,}")


class KeywordIndex(NamedTuple):
    """tokens: (workspace_id, token, df, most, place), place only of the most common; postings: (workspace_id,
    token, chunk_id, w); heads: (workspace_id, chunk_id, head), weights by place."""

    tokens: DataFrame
    postings: DataFrame
    heads: DataFrame


def keyword_counts(text: Column) -> Column:
    """The distinct tokens of a text with their numbers, as `keywords` cuts them: array of (token, tf). The text goes to
    Python once and is counted there, so that no shuffle is needed to count."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = [Counter(_WORD.findall(t or "")) for t in batch.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
            words, numbers = pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int32())
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, numbers], names=["token", "tf"]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<token: string, tf: int>>")(F.lower(text))


def postings(chunks: DataFrame) -> DataFrame:
    """(workspace_id, chunk_id, token, tf)."""
    return chunks.select("workspace_id", "chunk_id", keyword_counts(F.col("content")).alias("counts")).select("workspace_id", "chunk_id", F.inline("counts"))


def _weight(tf: Column) -> Column:
    """1 + 1/4 + ... + 1/tf**2; the first 100 are looked up."""
    known = F.array(*[F.lit(round(math.fsum(1 / (j * j) for j in range(1, n + 1)), 9)) for n in range(1, 101)])
    return F.when(tf <= 100, F.get(known, tf - 1)).otherwise(F.round(F.aggregate(F.sequence(F.lit(1), tf.cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j)), 9))


def keyword_index(chunks: DataFrame, head: int = HEAD) -> KeywordIndex:
    """Stored tables of chunks (workspace_id, chunk_id, content), used by every keyword search."""
    found = settled(postings(chunks).select("workspace_id", "token", "chunk_id", F.round(_weight(F.col("tf")) * _UNIT).cast("int").alias("w")), "postings")
    counted = settled(found.groupBy("workspace_id", "token").agg(F.count("*").alias("df"), F.max("w").alias("most")), "counted")
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("df"), "token"))
    common = settled(counted.withColumn("place", place).where(F.col("place") <= head).select("workspace_id", "token", "place"), "common")
    entry = F.collect_list(F.struct("place", "w"))
    heads = found.join(common, ["workspace_id", "token"]).groupBy("workspace_id", "chunk_id").agg(F.map_from_entries(entry).alias("head"))
    return KeywordIndex(counted.join(common, ["workspace_id", "token"], "left"), found, settled(heads, "heads"))


def _head_sum(places: Column) -> Column:
    return F.coalesce(F.aggregate(places, F.lit(0).cast("long"), lambda s, p: s + F.coalesce(F.try_element_at("head", p), F.lit(0))), F.lit(0))


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def token_scores(terms: DataFrame, index: KeywordIndex, k: int, probe: int = PROBE) -> DataFrame:
    """(query_id, workspace_id, chunk_id, weight) that hold each query's k best chunks by distinct tokens
    terms (query_id, workspace_id, token), and all of its chunks if there are fewer; weight in billionths."""
    chunk = ["query_id", "workspace_id", "chunk_id"]
    rare = Window.partitionBy("query_id").orderBy("df", "token")
    known = terms.join(index.tokens, ["workspace_id", "token"])
    known = settled(known.withColumn("first", F.sum("df").over(rare) - F.col("df") < probe * k), "terms")
    tried = settled(known.where("first").join(index.postings, ["workspace_id", "token"]).groupBy(*chunk).agg(F.sum("w").alias("part")), "tried")

    # The level: the k-th best of what the rare tokens led to, by its rare and its common tokens.
    rest = known.where("not first")
    common = rest.where("place is not null").groupBy("query_id").agg(F.collect_list("place").alias("places"))
    least = tried.join(common, "query_id", "left").join(index.heads, ["workspace_id", "chunk_id"], "left").select("query_id", (F.col("part") + _head_sum(F.col("places"))).alias("least"))
    level = _top(least, k, F.desc("least")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("least").alias("least")).where(F.col("n") == k).select("query_id", (F.col("least") - _TIE).alias("level"))

    # The most common tokens come first: no token beyond the heads is more common than one of them.
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy(F.desc("df"), F.asc_nulls_last("place"), "token"))
    rest = rest.join(level, "query_id", "left").withColumn("upto", upto)
    rest = settled(rest.withColumn("skip", F.coalesce(F.col("place").isNotNull() & (F.col("upto") < F.col("level")), F.lit(False))), "rest")
    more = rest.where("not skip").join(index.postings, ["workspace_id", "token"]).groupBy(*chunk).agg(F.sum("w").alias("part"))
    part = tried.unionByName(more).groupBy(*chunk).agg(F.sum("part").alias("part"))
    skipped = rest.where("skip").groupBy("query_id").agg(F.sum("most").alias("bound"), F.collect_list("place").alias("places"), F.first("level").alias("level"))
    able = part.join(skipped, "query_id", "left").where(F.coalesce(F.col("part") + F.col("bound") >= F.col("level"), F.lit(True)))
    return able.join(index.heads, ["workspace_id", "chunk_id"], "left").select(*chunk, (F.col("part") + _head_sum(F.col("places"))).alias("weight"))


def keyword_search(queries: DataFrame, index: KeywordIndex, k: int = DEFAULTS.candidates, probe: int = PROBE) -> DataFrame:
    """(query_id, chunk_id, keyword_score, rank): chunks of the workspace with any query token, or with a
    token that holds the first one. Ranked by summed term frequency weights, then chunk_id; keyword_score is
    relative to the best of the k."""
    asked = queries.select("query_id", "workspace_id", keywords(F.col("question")).alias("words")).where(F.size("words") > 0)
    scored = token_scores(asked.select("query_id", "workspace_id", F.explode(F.array_distinct("words")).alias("token")), index, k, probe)
    weight = F.round(F.col("weight") / _UNIT, 6).alias("weight")
    best = settled(_top(scored.select("query_id", "chunk_id", weight), k, F.desc("weight"), F.col("chunk_id")).drop("rank"), "best")

    # The first word inside longer ones weighs nothing, so it counts only where fewer than k chunks hold a token.
    # It is matched against the distinct tokens of a workspace, then joined.
    full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    first = asked.select("query_id", "workspace_id", F.get("words", F.lit(0)).alias("first")).join(full, "query_id", "left_anti")
    grams = first.select("workspace_id", "first", F.substring("first", 1, 2).alias("gram")).distinct()
    split = index.tokens.join(first.select("workspace_id").distinct(), "workspace_id", "left_semi").select("workspace_id", "token", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2))))).alias("gram"))
    inside = split.join(grams, ["workspace_id", "gram"]).where(F.contains("token", "first")).select("workspace_id", "first", "token").distinct()
    holders = index.postings.join(inside, ["workspace_id", "token"]).select("workspace_id", "first", "chunk_id").distinct()
    loose = first.join(holders, ["workspace_id", "first"]).select("query_id", "chunk_id", F.lit(0.0).alias("weight"))
    both = best.unionByName(loose).groupBy("query_id", "chunk_id").agg(F.max("weight").alias("weight"))
    ranked = _top(both, k, F.desc("weight"), F.col("chunk_id"))
    most = F.max("weight").over(Window.partitionBy("query_id"))
    return ranked.select("query_id", "chunk_id", F.when(most > 0, F.col("weight") / most).otherwise(0.0).alias("keyword_score"), "rank")
