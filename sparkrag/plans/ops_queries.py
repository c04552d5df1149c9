"""Queries of tenancy, chats, operations, streams' batch twins, and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrag.operators import evaluation as V
from sparkrag.operators import tenancy as J
from sparkrag.plans.registry import EVENTS_SQL, FILES_SQL, MEMBERS_SQL, files, http_events, memberships, query, read
from sparkrag.plans.text_queries import chunks_sql, sanitized_sql
from sparkrag.sources import index, io
from sparkrag.streaming import jobs as K


_scratch = io.shared_path
#: Bytes of files in a micro-batch for each core.
BATCH_BYTES = 64 << 20
#: Folders of files that a task writes; Spark lists up to 32 on the driver.
_FOLDERS = 40


def streamed(spark, sf_dir, name, at_once=False):
    """A given table, a file or a folder of files, as a stream of its rows that ends. at_once: in one micro-batch, for
    what depends on the order of arrival across micro-batches."""
    source = spark.readStream.schema(read(spark, sf_dir, name).schema)
    source = source if at_once else source.option("maxBytesPerTrigger", str(BATCH_BYTES * spark.sparkContext.defaultParallelism))
    return source.parquet(f"{sf_dir}/{name}.parquet*")


@query("s1_read_files", "SELECT source AS workspace_id, CAST(doc_id AS VARCHAR) AS file_id, CAST(doc_id % 3 + 1 AS INTEGER) AS version, CAST(strlen(text) + 1 AS BIGINT) AS size_bytes, sha256(text || chr(10)) AS checksum FROM documents")
def s1_read_files(spark, sf_dir):
    """A file for each document, a version each, written in folders and read back by `read_files`.

    A folder's name tells the file's place, and the workspace in hexadecimal digits, since some characters can't stand in
    one. Each task writes folders of its own, more than Spark lists one by one, so that they are moved
    and listed as few. On a local disk the files have no checksum files beside them.
    """
    root = _scratch(spark, "files")
    docs = io.spread(read(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("value")))
    place = F.concat(F.coalesce(F.concat(F.lit("w"), F.hex("source")), F.lit("none")), F.lit("~"), F.col("doc_id").cast("string"), F.lit("~v"), (F.col("doc_id") % 3 + 1).cast("string"))
    part = F.concat(F.spark_partition_id().cast("string"), F.lit("-"), F.pmod(F.xxhash64("doc_id"), F.lit(_FOLDERS)).cast("string"))
    local = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    docs.select("value", part.alias("part"), place.alias("file")).write.partitionBy("part", "file").options(maxRecordsPerFile=1, **local).text(root)
    found = io.read_files(spark, root, r"/file=([^/~]+)~([^/~]+)~v(\d+)/([^/]+)$")
    workspace = F.when(F.startswith("workspace_id", F.lit("w")), F.unhex(F.substring("workspace_id", 2, 1 << 30)).cast("string"))
    return found.select(workspace.alias("workspace_id"), "file_id", "version", "size_bytes", F.sha2("content", 256).alias("checksum"))


@query("s2_eval_dataset", "SELECT 'bench' AS dataset, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS query_id, text AS question FROM benchmark")
def s2_eval_dataset(spark, sf_dir):
    path = _scratch(spark, "eval")
    items = F.array_sort(F.collect_list(F.struct("item_id", F.col("text").alias("question"))))
    rows = read(spark, sf_dir, "benchmark").agg(items.alias("q"))  # an evaluation set is one JSON object
    rows.select(F.to_json(F.struct(F.lit("bench").alias("name"), F.transform("q", lambda x: F.struct(x["question"].alias("question"))).alias("queries"))).alias("value")).write.text(path)
    return io.read_eval_dataset(spark, path)[1].select("dataset", "query_id", "question")


@query("s3_audit_jsonl", "SELECT event_type AS action, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY ALL")
def s3_audit_jsonl(spark, sf_dir):
    path = _scratch(spark, "audit")
    rows = read(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.lit("w").alias("workspace_id"), F.col("user_id").cast("string").alias("user_id"))
    io.write_audit_jsonl(rows, path)
    return io.read_audit_jsonl(spark, path).groupBy("action", "user_id").agg(F.count("*").alias("n"))


@query("s4_write_table", "SELECT source AS workspace_id, CASE WHEN source = 'src3' THEN 2 ELSE 1 END AS gen, count(*) AS n FROM documents GROUP BY ALL")
def s4_write_table(spark, sf_dir):
    """A partitioned table of which one partition is written anew."""
    path = _scratch(spark, "table")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("workspace_id"), F.lit(1).alias("gen"))
    io.write_table(rows, path, ["workspace_id"])
    io.write_table(rows.where("workspace_id = 'src3'").withColumn("gen", F.lit(2)), path, ["workspace_id"], "overwrite")
    return io.read_table(spark, path).groupBy("workspace_id", "gen").agg(F.count("*").alias("n"))


@query("s7_eval_report", "SELECT '| ' || item_id || ' | ' || regexp_replace(replace(text, '|', '\\|'), '\r\n|\r|\n', '<br>', 'g') || ' |' AS value FROM benchmark")
def s7_eval_report(spark, sf_dir):
    path = _scratch(spark, "report")
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text")
    io.write_eval_report(rows.agg(F.count("*").alias("value")), rows, path)
    return spark.read.text(f"{path}/lines")


@query("j1_list_files", f"WITH {FILES_SQL} SELECT workspace_id, file_id, filename, status FROM files WHERE NOT is_deleted AND status = 'indexed' AND contains(lower(filename), 'c-1')")
def j1_list_files(spark, sf_dir):
    return J.list_files(files(spark, sf_dir), status="indexed", name_like="C-1").select("workspace_id", "file_id", "filename", "status")


@query("j2_list_chats", "SELECT conv_id AS chat_id, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def j2_list_chats(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "chat_id")
    chats = rows.select("chat_id").distinct().withColumn("created_at", F.col("chat_id"))
    return J.list_chats(chats, rows).select("chat_id", "n_messages")


@query("j3_chat_detail", "SELECT conv_id AS chat_id, count(*) AS n_messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS h, CAST(sum(CASE WHEN role = 'assistant' THEN 2 ELSE 0 END) AS BIGINT) AS n_citations FROM conversations GROUP BY conv_id")
def j3_chat_detail(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"), "role", F.col("text").alias("content"))
    cited = rows.where("role = 'assistant'").select("message_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"), F.lit("x").alias("filename"))
    out = J.chat_detail(rows, cited)
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("chat_id", F.size("messages").cast("long").alias("n_messages"), F.md5(text).alias("h"), F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.size(m["citations"])).alias("n_citations"))


@query("j4_user_workspaces", f"WITH {MEMBERS_SQL} SELECT user_id, workspace_id, 'slug-' || workspace_id AS slug, role FROM memberships")
def j4_user_workspaces(spark, sf_dir):
    m = memberships(spark, sf_dir)
    return J.user_workspaces(m, m.select("workspace_id").distinct().withColumn("slug", F.concat(F.lit("slug-"), "workspace_id")))


@query("j4_members", f"WITH {MEMBERS_SQL} SELECT workspace_id, user_id, user_id || '@x' AS email, role FROM memberships")
def j4_members(spark, sf_dir):
    m = memberships(spark, sf_dir)
    return J.members(m, m.select("user_id").distinct().withColumn("email", F.concat(F.col("user_id").cast("string"), F.lit("@x"))))


@query("j5_access_decisions", f"""WITH {MEMBERS_SQL}, r AS (SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN 'elsewhere' ELSE event_type END AS workspace_id, (['viewer', 'editor', 'admin'])[event_id % 3 + 1] AS min_role FROM events)
SELECT event_id, CASE WHEN m.role IS NULL THEN 'not_found' WHEN list_position(['viewer', 'contributor', 'editor', 'admin'], m.role) < list_position(['viewer', 'contributor', 'editor', 'admin'], min_role) THEN 'forbidden' ELSE 'allow' END AS decision
FROM r LEFT JOIN memberships m ON m.user_id = r.user_id AND m.workspace_id = r.workspace_id""")
def j5_access_decisions(spark, sf_dir):
    least = F.element_at(F.array(F.lit("viewer"), F.lit("editor"), F.lit("admin")), (F.col("event_id") % 3 + 1).cast("int"))
    r = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 9 == 0, "elsewhere").otherwise(F.col("event_type")).alias("workspace_id"), least.alias("min_role"))
    return J.access_decisions(r, memberships(spark, sf_dir)).select("event_id", "decision")


@query("j6_active_sessions", "SELECT event_id AS session_id FROM events WHERE event_id % 5 <> 0 AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15' AND user_id % 4 <> 0")
def j6_active_sessions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    sessions = e.select(F.col("event_id").alias("session_id"), "user_id", F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("revoked_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    users = e.select("user_id").distinct().withColumn("is_active", F.col("user_id") % 4 != 0)
    return J.active_sessions(sessions, users, F.lit("2024-01-15").cast("timestamp")).select("session_id")


@query("j7_last_admin", f"WITH {MEMBERS_SQL} SELECT workspace_id, count(*) FILTER (role = 'admin') AS n_admins FROM memberships GROUP BY workspace_id HAVING count(*) FILTER (role = 'admin') <= 1")
def j7_last_admin(spark, sf_dir):
    return J.last_admin(memberships(spark, sf_dir))


@query("j7_last_admin_of_pairs", """WITH m AS (SELECT DISTINCT user_id, event_type || '-' || user_id // 2 AS workspace_id, CASE WHEN (user_id + length(event_type)) % 4 < 2 THEN 'admin' ELSE 'viewer' END AS role FROM events)
SELECT workspace_id, count(*) FILTER (role = 'admin') AS n_admins FROM m GROUP BY workspace_id HAVING count(*) FILTER (role = 'admin') <= 1""")
def j7_last_admin_of_pairs(spark, sf_dir):
    """Small workspaces, of two users each, of all users."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    role = F.when((F.col("user_id") + F.length("event_type")) % 4 < 2, "admin").otherwise("viewer")
    return J.last_admin(e.select("user_id", F.concat("event_type", F.lit("-"), F.floor(F.col("user_id") / 2).cast("string")).alias("workspace_id"), role.alias("role")))


@query("j8_status_counts", f"WITH {FILES_SQL} SELECT workspace_id, status, count(*) AS n_files FROM files GROUP BY ALL")
def j8_status_counts(spark, sf_dir):
    return J.status_counts(files(spark, sf_dir))


@query("j8_recent_failures", f"WITH {FILES_SQL} SELECT workspace_id, file_id, filename, error FROM files WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, file_id) <= 10")
def j8_recent_failures(spark, sf_dir):
    return J.recent_failures(files(spark, sf_dir)).drop("created_at")


@query("j9_apply_feedback", "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'down' END END AS feedback FROM conversations")
def j9_apply_feedback(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"), "role", F.lit(None).cast("string").alias("feedback"))
    given = rows.where("turn % 2 = 1").select("message_id", F.explode(F.array(F.struct(F.lit(1).alias("ts"), F.lit("up").alias("value")), F.struct(F.lit(2).alias("ts"), F.when(F.col("conv_id") % 2 == 0, "down").alias("value")))).alias("f")).select("message_id", "f.*")
    return J.apply_feedback(rows, given).select("conv_id", "turn", "feedback")


@query("j10_reconcile_counts", "SELECT 'documents' AS table_name, (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM documents) AS right_rows, true AS matches UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), (SELECT count(*) FROM labels WHERE toxic = 0), (SELECT count(*) FROM labels WHERE toxic <> 0) = 0")
def j10_reconcile_counts(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return J.reconcile_counts({"documents": docs, "labels": labels}, {"documents": docs, "labels": labels.where("toxic = 0")})


@query("k1_ingest", f"WITH RECURSIVE {chunks_sql('source')}, x AS (SELECT doc_id, source, {sanitized_sql('content')} AS body FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE starts_with(text, '#!') OR starts_with(text, 'MZ') OR text = '')) SELECT source AS workspace_id, doc_id AS file_id, count(*) AS n_chunks, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM x GROUP BY ALL")
def k1_ingest(spark, sf_dir):
    """Documents through the ingestion stream, which ends with what is there, and read from the index that it wrote."""
    path = _scratch(spark, "index")
    rows = streamed(spark, sf_dir, "documents").select(
        F.col("source").alias("workspace_id"), F.col("doc_id").alias("file_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("version"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.encode("text", "UTF-8").alias("content"),
    )
    K.ingest_stream(rows, path, f"{path}-progress", K.ingest_batch).awaitTermination()
    made = index.read_index(spark, f"{path}/chunks")
    return made.groupBy("workspace_id", "file_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


@query("k2_rate_limit", """WITH RECURSIVE e AS (SELECT event_id, event_type AS identity, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT identity, i, 1 + count(*) OVER (PARTITION BY identity ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 60 SECOND FOLLOWING) AS next FROM e),
ok AS (SELECT identity, CAST(1 AS BIGINT) AS i FROM e WHERE i = 1 UNION ALL SELECT n.identity, n.next FROM ok JOIN n ON n.identity = ok.identity AND n.i = ok.i)
SELECT event_id, e.identity, ok.i IS NOT NULL AS allowed FROM e LEFT JOIN ok ON ok.identity = e.identity AND ok.i = e.i""")
def k2_rate_limit(spark, sf_dir):
    """One request a minute for each event type, so that limits are met."""
    return K.rate_limit(http_events(spark, sf_dir).withColumn("identity", F.col("route")), 1).select("event_id", "identity", "allowed")


@query("k2_rate_limit_of_users", """WITH RECURSIVE e AS (SELECT event_id, 'user-' || user_id AS identity, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT identity, i, 1 + count(*) OVER (PARTITION BY identity ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 60 SECOND FOLLOWING) AS next FROM e),
ok AS (SELECT identity, CAST(1 AS BIGINT) AS i FROM e WHERE i = 1 UNION ALL SELECT n.identity, n.next FROM ok JOIN n ON n.identity = ok.identity AND n.i = ok.i)
SELECT event_id, e.identity, ok.i IS NOT NULL AS allowed FROM e LEFT JOIN ok ON ok.identity = e.identity AND ok.i = e.i""")
def k2_rate_limit_of_users(spark, sf_dir):
    """One request a minute for each user: as many tasks as there are users."""
    return K.rate_limit(http_events(spark, sf_dir), 1).select("event_id", "identity", "allowed")


@query("k3_dedup_requests", """WITH r AS (SELECT event_id AS request_id, user_id, event_type AS endpoint, CASE WHEN event_id % 4 > 0 THEN 'k' || (event_id % 40) END AS key, 'h' || (event_id % 3) AS request_hash, 'r' || event_id AS response, ts FROM events),
f AS (SELECT *, key IS NOT NULL AND row_number() OVER w > 1 AS again, first_value(response) OVER w AS answer, first_value(request_hash) OVER w AS hash FROM r WINDOW w AS (PARTITION BY user_id, endpoint, key ORDER BY ts, request_id))
SELECT request_id, again AS replayed, CASE WHEN again THEN answer ELSE response END AS answer, again AND hash <> request_hash AS conflict FROM f""")
def k3_dedup_requests(spark, sf_dir):
    """What the stream answers to each request: its own response, or that of the first request with its key. First by time,
    in whichever order the files hold them, so they are one micro-batch; its buckets grow in number with the rows."""
    path = _scratch(spark, "requests")
    key = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("k"), (F.col("event_id") % 40).cast("string")))
    hashed, response = F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")), F.concat(F.lit("r"), F.col("event_id").cast("string"))
    buckets = max(256, read(spark, sf_dir, "events").count() // 20_000)
    rows = streamed(spark, sf_dir, "events", at_once=True).select(
        F.col("event_id").alias("request_id"), "user_id", F.col("event_type").alias("endpoint"), key.alias("key"), hashed.alias("request_hash"), response.alias("response"), F.col("ts").cast("timestamp").alias("ts")
    )
    with K.rocksdb(spark):
        K.dedup_stream(rows, buckets=buckets).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("request_id", "replayed", "answer", "conflict")


_BUCKETS = "[count(*) FILTER (latency_s <= 0.05), count(*) FILTER (latency_s <= 0.1), count(*) FILTER (latency_s <= 0.25), count(*) FILTER (latency_s <= 0.5), count(*) FILTER (latency_s <= 1.0), count(*) FILTER (latency_s <= 2.5), count(*) FILTER (latency_s <= 5.0), count(*) FILTER (latency_s <= 10.0), count(*)]"


@query("k4_request_metrics", f"WITH {EVENTS_SQL} SELECT method, route, CAST(status AS INTEGER) AS status, count(*) AS requests, round(sum(latency_s), 6) AS latency_sum, {_BUCKETS} AS buckets FROM http GROUP BY ALL")
def k4_request_metrics(spark, sf_dir):
    out = K.request_metrics(http_events(spark, sf_dir))
    return out.select("method", "route", "status", "requests", F.round("latency_sum", 6).alias("latency_sum"), "buckets")


@query("k4_latest_samples", f"WITH {EVENTS_SQL} SELECT event_id, route FROM http QUALIFY row_number() OVER (PARTITION BY method, route ORDER BY ts DESC, event_id DESC) <= 100")
def k4_latest_samples(spark, sf_dir):
    return K.latest_samples(http_events(spark, sf_dir), 100).select("event_id", "route")


@query("k5_error_rate", f"WITH {EVENTS_SQL} SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS requests, count(*) FILTER (status >= 500) AS errors, round(count(*) FILTER (status >= 500) / count(*), 6) AS error_rate FROM http GROUP BY 1")
def k5_error_rate(spark, sf_dir):
    return K.error_rate(http_events(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 6))


@query("k5_sliding_error_rate", f"""WITH {EVENTS_SQL}, p AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS pane, count(*) AS n, count(*) FILTER (status >= 500) AS bad FROM http GROUP BY 1),
w AS (SELECT pane - i * INTERVAL 1 MINUTE AS window_start, n, bad FROM p, range(5) t(i))
SELECT window_start, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(bad) AS BIGINT) AS errors, round(sum(bad) / sum(n), 6) AS error_rate FROM w GROUP BY 1""")
def k5_sliding_error_rate(spark, sf_dir):
    """Windows of five minutes, one a minute, put together from panes of a minute."""
    return K.error_rate(http_events(spark, sf_dir), "5 minutes", "1 minute").withColumn("error_rate", F.round("error_rate", 6))


@query("k5_rate_limited_rate", f"WITH {EVENTS_SQL} SELECT route, count(*) AS requests, count(*) FILTER (status = 429) AS limited, round(count(*) FILTER (status = 429) / count(*), 6) AS limited_rate FROM http GROUP BY 1")
def k5_rate_limited_rate(spark, sf_dir):
    return K.rate_limited_rate(http_events(spark, sf_dir)).withColumn("limited_rate", F.round("limited_rate", 6))


@query("k6_histogram_quantile", f"""WITH {EVENTS_SQL}, m AS (SELECT route, {_BUCKETS} AS b FROM http GROUP BY route), u AS (SELECT route, unnest(b) AS c, unnest(range(len(b))) AS i, b[9] AS n FROM m),
l AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY route ORDER BY i), 0) AS low, [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0] AS bounds FROM u), h AS (SELECT * FROM l WHERE c >= 0.95 * n QUALIFY row_number() OVER (PARTITION BY route ORDER BY i) = 1)
SELECT route, round(CASE WHEN i >= 8 THEN 10.0 ELSE CASE WHEN i = 0 THEN 0 ELSE bounds[i] END + (bounds[i + 1] - CASE WHEN i = 0 THEN 0 ELSE bounds[i] END) * (0.95 * n - low) / (c - low) END, 6) AS quantile FROM h""")
def k6_histogram_quantile(spark, sf_dir):
    out = K.histogram_quantile(K.request_metrics(http_events(spark, sf_dir)), 0.95, ["route"])
    return out.withColumn("quantile", F.round("quantile", 6))


@query("k7_slo_report", f"""WITH {EVENTS_SQL}, m AS (SELECT 'p95_api_ms' AS metric, quantile_cont(latency_s * 1000, 0.95) AS value FROM http UNION ALL SELECT 'error_rate', count(*) FILTER (status >= 500) / count(*) FROM http),
o(metric, how, level) AS (VALUES ('p95_chat_ms', '<=', 5000.0), ('p95_api_ms', '<=', 2000.0), ('p95_health_ms', '<=', 200.0), ('recall', '>=', 0.8), ('citation_correctness', '>=', 0.8), ('hallucination_rate', '<=', 0.0), ('error_rate', '<=', 0.01))
SELECT o.metric, round(value, 6) AS value, coalesce(CASE WHEN how = '>=' THEN value >= level ELSE value <= level END, false) AS passed FROM o LEFT JOIN m USING (metric)""")
def k7_slo_report(spark, sf_dir):
    e = http_events(spark, sf_dir)
    one = lambda name, value: e.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    m = V.percentiles(e.withColumn("ms", F.col("latency_s") * 1000), "ms", (95,)).select(F.lit("p95_api_ms").alias("metric"), F.col("p95").alias("value")).unionByName(one("error_rate", F.count_if(F.col("status") >= 500) / F.count("*")))
    return K.slo_report(m).select("metric", F.round("value", 6).alias("value"), "passed")


@query("k8_audit_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, CAST(user_id % 5 AS VARCHAR) AS workspace_id, event_type AS action, count(*) AS n_events FROM events GROUP BY ALL")
def k8_audit_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("action"), (F.col("user_id") % 5).cast("string").alias("workspace_id"), F.col("user_id").cast("string").alias("user_id"))
    return K.audit_counts(rows)
