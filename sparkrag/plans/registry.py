"""Named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.operators.ingest import checksum
from sparkrag.sources.io import settled, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The given tables as the logical ones.


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of the workspaces that their sources stand for."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("indexed", "queued", "failed", "processing")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("workspace_id"), F.col("doc_id").alias("file_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
        F.octet_length("text").cast("long").alias("size_bytes"), status.alias("status"), (F.col("doc_id") % 17 == 0).alias("is_deleted"), (F.col("doc_id") % 3 + 1).cast("int").alias("current_version"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("created_at"), F.when(F.col("doc_id") % 4 == 2, "parse error").alias("error"), checksum(F.col("text")).alias("checksum"),
    )


FILES_SQL = """files AS (SELECT source AS workspace_id, doc_id AS file_id, 'doc-' || doc_id || '.md' AS filename, CAST(strlen(text) AS BIGINT) AS size_bytes,
  (['indexed', 'queued', 'failed', 'processing'])[doc_id % 4 + 1] AS status, doc_id % 17 = 0 AS is_deleted, CAST(doc_id % 3 + 1 AS INTEGER) AS current_version,
  make_timestamp((1700000000 + doc_id * 60) * 1000000) AS created_at, CASE WHEN doc_id % 4 = 2 THEN 'parse error' END AS error, sha256(text) AS checksum FROM documents)"""


def http_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: the type is the route, the value a latency in ms."""
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 50 == 7, 429).otherwise(200)
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("identity"), F.lit("GET").alias("method"), F.col("event_type").alias("route"),
        status.alias("status"), (F.col("value") / 1000).alias("latency_s"), "user_id",
    )


EVENTS_SQL = """http AS (SELECT event_id, ts, 'user-' || user_id AS identity, 'GET' AS method, event_type AS route,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 7 THEN 429 ELSE 200 END AS status, value / 1000 AS latency_s, user_id FROM events)"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in ("viewer", "contributor", "editor", "admin")]), ((F.col("user_id") + F.length("event_type")) % 4 + 1).cast("int"))
    pairs = read(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return pairs.select("user_id", F.col("event_type").alias("workspace_id"), role.alias("role"))


MEMBERS_SQL = """memberships AS (SELECT user_id, event_type AS workspace_id, (['viewer', 'contributor', 'editor', 'admin'])[(user_id + length(event_type)) % 4 + 1] AS role
  FROM (SELECT DISTINCT user_id, event_type FROM events))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as questions: (query_id, workspace_id, question, expected), a row for each document that
    holds the passage word for word; the workspace is the source of the lowest of them, or by the id's remainder.

    A passage is found by the first four words that it starts with: their hash is looked up among the hashes
    of all runs of four words, and the texts of the few documents found are searched.
    """
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    # Inner words only: the first word of a passage may follow other characters without a blank.
    three = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    keys = items.select("query_id", F.split("question", " ").alias("w")).select("query_id", three("w", F.lit(1)).alias("key"))
    runs = docs.select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") >= 3)
    grams = runs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: three("w", i))).alias("key"))
    pairs = grams.join(keys, "key").select("query_id", "doc_id").distinct()
    hits = settled(pairs.join(docs, "doc_id").join(items, "query_id").where(F.contains("text", "question")).select("query_id", "doc_id", "source"))
    own = hits.groupBy("query_id").agg(F.min_by("source", "doc_id").alias("_ws"))
    rows = items.join(own, "query_id", "left").join(hits.select("query_id", "doc_id"), "query_id", "left")
    workspace = F.coalesce("_ws", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return rows.select("query_id", workspace.alias("workspace_id"), "question", F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("expected"))


QUESTIONS_SQL = """hits AS (SELECT b.item_id AS query_id, d.doc_id, d.source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
questions AS (SELECT b.item_id AS query_id, coalesce(o.ws, 'src' || (b.item_id % 20)) AS workspace_id, b.text AS question, 'doc-' || h.doc_id || '.md' AS expected
  FROM benchmark b LEFT JOIN (SELECT query_id, arg_min(source, doc_id) AS ws FROM hits GROUP BY query_id) o ON o.query_id = b.item_id LEFT JOIN hits h ON h.query_id = b.item_id)"""
