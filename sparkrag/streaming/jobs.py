"""Ingestion, rate limits, de-duplication and request metrics, as batch functions and as streams.

events: (ts, identity, method, route, status, latency_s)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkrag.settings import DEFAULTS, LATENCY_BUCKETS
from sparkrag.sources.index import BUCKETS, write_generation
from sparkrag.sources.io import settled, spread

_SPAN = pd.Timedelta(seconds=60)
#: Shares that a route's requests are ranked in.
SHARES = 64


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as state by maps, lists and timers needs it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ingest_stream(files: DataFrame, index_path: str, checkpoint: str, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Runs `build` (files to chunks and failures) on each micro-batch and adds its chunks to the index table
    {index_path}/chunks as a generation of the files' buckets, and its failures to {index_path}/failures. A batch that is
    run again replaces its own output, and `read_index` reads the newest generation of each file, so repeats
    change nothing. How many files a batch has is the source's option."""

    def step(batch: DataFrame, batch_id: int) -> None:
        chunks, failures = build(spread(batch))
        write_generation(chunks, f"{index_path}/chunks", batch_id, buckets)
        failures.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{index_path}/failures")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_batch(files: DataFrame, dim: int = DEFAULTS.embed_dim) -> tuple[DataFrame, DataFrame]:
    """(chunks, failures) of files (workspace_id, file_id, version, filename, size_bytes, content)."""
    from sparkrag.functions.text import sanitize_index_text
    from sparkrag.operators.chunking import chunk_sections
    from sparkrag.operators.embed import hash_embed
    from sparkrag.operators.ingest import scan_content, validate_files
    from sparkrag.operators.sections import route_format

    checked = scan_content(validate_files(files)).withColumn("error", F.coalesce("reject_reason", "scan_reason"))
    sections, unread = route_format(checked.where("error is null"), key="file_id")
    chunks = chunk_sections(sections, "file_id").join(files.select("file_id", "workspace_id", "version", "filename"), "file_id")
    named = chunks.withColumns({"content": sanitize_index_text(F.col("content")), "chunk_id": F.format_string("%s:%d:%06d", F.col("file_id").cast("string"), F.col("version").cast("int"), F.col("seq"))})
    return hash_embed(named, "content", dim), checked.where("error is not null").select("file_id", "error").unionByName(unread)


class Limiter:
    """Accepted times of one identity, in microseconds or timestamps: those over 60 s old are forgotten, rejected ones never count."""

    def __init__(self, times=(), limit: int = DEFAULTS.rate_limit_per_minute, burst: int = 0, span=_SPAN):
        self.times, self.most, self.span = deque(times), None if limit <= 0 else limit + max(0, burst), span

    def allow(self, ts) -> bool:
        if self.most is None:
            return True
        while self.times and ts - self.times[0] > self.span:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(ts)
        return True


_MICROS = 60_000_000


def _decided(limit: int, burst: int, starts: dict[int, list[int]] | None = None):
    """Works through rows (part, key, identity, at) sorted by part, identity, time and key. Without `starts`: what stands
    before the first cut of a part, a gap of over 60 s or a change of identity, stays open (allowed is null), for it depends
    on the part before. With `starts`, the times accepted before each part, those rows are decided. Ends each part with
    a row that tells its last accepted times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, who, last, limiter, names = None, None, 0, None, None

        def end() -> pa.RecordBatch:
            kept = None if limiter is None else [t for t in limiter.times if last - t <= _MICROS]
            row = [[part], [None], [who], [last], [None], [kept]]
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, names, strict=True)], schema=names)

        for batch in batches:
            names = pa.schema([*batch.schema, ("allowed", pa.bool_()), ("accepted", pa.list_(pa.int64()))]) if names is None else names
            allowed = []
            for p, identity, at in zip(*(batch[c].to_pylist() for c in ("part", "identity", "at")), strict=True):
                if p != part:
                    if part is not None:
                        yield end()
                    part, who, last = p, identity, at
                    limiter = None if starts is None else Limiter(starts[p], limit, burst, _MICROS)
                elif identity != who or at - last > _MICROS:
                    limiter = Limiter((), limit, burst, _MICROS)
                who, last = identity, at
                allowed.append(None if limiter is None else limiter.allow(at))
            yield pa.record_batch([*batch.columns, pa.array(allowed, pa.bool_()), pa.nulls(len(allowed), pa.list_(pa.int64()))], schema=names)
        if part is not None:
            yield end()

    return run


def rate_limit(events: DataFrame, limit: int = DEFAULTS.rate_limit_per_minute, burst: int = DEFAULTS.rate_limit_burst, key: str = "event_id", parts: int | None = None) -> DataFrame:
    """events (key, identity, ts) with allowed, in order of time, then key; rows with a null identity or time are left out.

    Rows are dealt out by ranges of identity and time, so that an identity of many events is many tasks'
    work. A gap of over 60 s empties an identity's state, so from its first gap on each part is decided on its own.
    What stands before goes on from the part before it: with that part's accepted times, of which there are
    at most `limit`, and in one round more unless the part before has no gap either. The driver gets a row for each part.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    own = events.select(F.col(key).alias("key"), "identity", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("identity is not null and at is not null")
    spark = events.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"part int, key {kinds[key]}, identity {kinds['identity']}, at long, allowed boolean, accepted array<long>"
    ranged = own.repartitionByRange(parts, "identity", "at", "key").sortWithinPartitions("identity", "at", "key").select(F.spark_partition_id().alias("part"), "key", "identity", "at")
    first = settled(ranged.mapInArrow(_decided(limit, burst), schema), "limits")
    done = [first.where("allowed is not null")]
    undecided = first.where("allowed is null and accepted is null and key is not null")
    # A part's first row, and the row that it ends with: a row or two for each part.
    begins = {r["part"]: (r["identity"], r["at"]) for r in undecided.groupBy("part").agg(F.min_by(F.struct("identity", "at"), F.struct("at", "key")).alias("b")).select("part", "b.*").collect()}
    ends = {r["part"]: (r["identity"], r["at"], r["accepted"]) for r in first.where("key is null").collect()}
    order = sorted(ends)
    before = dict(zip(order[1:], order, strict=False))
    known = {p: list(e[2]) for p, e in ends.items() if e[2] is not None}
    waiting = set(begins)
    while waiting:
        starts = {}
        for p in waiting:
            if p not in before or ends[before[p]][0] != begins[p][0] or begins[p][1] - ends[before[p]][1] > _MICROS:
                starts[p] = []
            elif before[p] in known:
                starts[p] = known[before[p]]
        mine = undecided.where(F.col("part").isin(*starts)).select("part", "key", "identity", "at")
        solved = settled(mine.repartition(max(1, min(parts, len(starts))), "part").sortWithinPartitions("part", "identity", "at", "key").mapInArrow(_decided(limit, burst, starts), schema), "limits")
        done.append(solved.where("key is not null"))
        for r in solved.where("key is null").select("part", "accepted").collect():  # a row for each part of the round
            known.setdefault(r["part"], r["accepted"])
        waiting -= set(starts)
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("key").alias(key), "identity", F.timestamp_micros("at").alias("ts"), "allowed")


class _RateState(StatefulProcessor):
    def __init__(self, limit: int, burst: int):
        self.limit, self.burst = limit, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("accepted", "times array<timestamp>", ttlDurationMs=120_000)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.state.get() if self.state.exists() else None
        limiter = Limiter([pd.Timestamp(t) for t in (known[0] or [])] if known else (), self.limit, self.burst)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        batch = batch.assign(allowed=[limiter.allow(t) for t in batch["ts"]])
        self.state.update(([t.to_pydatetime() for t in limiter.times],))
        yield batch[["event_id", "identity", "ts", "allowed"]]

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int = DEFAULTS.rate_limit_per_minute, burst: int = DEFAULTS.rate_limit_burst) -> DataFrame:
    """The same on a stream of (event_id, identity, ts): sorted within a micro-batch; events older than
    what an identity has seen count at the place they arrive. Needs the RocksDB state store."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.select("event_id", "identity", "ts").groupBy("identity").transformWithStateInPandas(
        statefulProcessor=_RateState(limit, burst), outputStructType=f"event_id {kinds['event_id']}, identity {kinds['identity']}, ts timestamp, allowed boolean", outputMode="Append", timeMode="ProcessingTime"
    )


class _Replay(StatefulProcessor):
    """Keeps for each key of a bucket the first request's response and hash."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "id string", "answer string, request_hash string", ttlDurationMs=self.keep_ms)

    def handleInitialState(self, key: tuple, rows: pd.DataFrame, timer_values) -> None:  # noqa: N802
        for name, answer, request_hash in zip(rows["id"], rows["answer"], rows["request_hash"], strict=True):
            if not self.first.containsKey((name,)):
                self.first.updateValue((name,), (answer, request_hash))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        # A bucket of many rows comes in several frames, each numbered from 0; the rows are joined to their answers by number.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "request_id"], kind="stable")
        seen: dict[str, tuple] = {}
        out = []
        for name, response, request_hash in zip(batch["id"], batch["response"], batch["request_hash"], strict=True):
            if name is None:  # without a key
                out.append((False, response, False))
                continue
            known = seen.get(name) or self.first.getValue((name,))
            if known is None:
                known = response, request_hash
                self.first.updateValue((name,), known)
                out.append((False, response, False))
            else:
                out.append((True, known[0], known[1] != request_hash))
            seen[name] = tuple(known)
        flags = pd.DataFrame(out, columns=["replayed", "answer", "conflict"], index=batch.index)
        yield batch[["request_id", "user_id", "endpoint", "key", "ts"]].join(flags)

    def close(self) -> None:
        pass


def _request_key() -> Column:
    return F.when(F.col("key").isNotNull(), F.to_json(F.struct("user_id", "endpoint", "key")))


def dedup_stream(requests: DataFrame, keep: str | None = None, known: DataFrame | None = None, buckets: int = 256) -> DataFrame:
    """(request_id, user_id, endpoint, key, ts, replayed, answer, conflict) of a stream of requests (request_id, user_id,
    endpoint, key, request_hash, response, ts).

    The first request of a key gives its own response; later ones get that response, and conflict tells that
    their hash is another one. Within a micro-batch the order is by time and id, across micro-batches that of arrival.
    Requests without a key pass. Keys are kept for good, or for `keep` after they were written; the latter is for a stream that
    goes on, since it looks at the clock again and again. known: (user_id, endpoint, key,
    answer, request_hash), keys that a stored table has, to start from. Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    rows = requests.withColumn("id", _request_key()).withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("id", F.col("request_id").cast("string"))), F.lit(buckets)))
    start = None if known is None else known.where("key is not null").withColumn("id", _request_key()).select(bucket, "id", "answer", "request_hash").groupBy("bucket")
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("request_id", "user_id", "endpoint", "key", "ts")) + ", replayed boolean, answer string, conflict boolean"
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Replay(keep_ms), outputStructType=schema, outputMode="Append", timeMode="None" if keep is None else "ProcessingTime", initialState=start)


def _buckets(latency: Column) -> Column:
    """Cumulative counts for each upper bound, then all."""
    return F.array(*[F.count_if(latency <= b) for b in LATENCY_BUCKETS], F.count("*"))


def request_metrics(events: DataFrame, window: str | None = None, watermark: str | None = None) -> DataFrame:
    """([window_start,] method, route, status, requests, latency_sum, buckets)."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    by = [F.window("ts", window).alias("w")] if window else []
    out = rows.groupBy(*by, "method", "route", "status").agg(F.count("*").alias("requests"), F.sum("latency_s").alias("latency_sum"), _buckets(F.col("latency_s")).alias("buckets"))
    return out.withColumn("window_start", F.col("w.start")).drop("w") if window else out


def latest_samples(events: DataFrame, n: int = 2000) -> DataFrame:
    """The latest n latencies of each method and route. Ranked among shares of a route first, so that no task sorts
    more than its shares' n latest and a route's history is spread."""
    order = [F.desc("ts"), F.desc("event_id")]
    share = F.pmod(F.xxhash64("event_id", "ts"), F.lit(SHARES))
    some = events.withColumn("_share", share).withColumn("_at", F.row_number().over(Window.partitionBy("method", "route", "_share").orderBy(*order))).where(F.col("_at") <= n).drop("_at", "_share")
    return some.withColumn("_at", F.row_number().over(Window.partitionBy("method", "route").orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def error_rate(events: DataFrame, window: str = "5 minutes", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window_start, requests, errors, error_rate): the share of statuses from 500 on.

    A sliding window is put together from panes as long as its slide, which have to add up to it: each event is
    counted once, in its pane, and only the counts are added up to windows. watermark: for a stream (in append
    mode), how late an event may be; a later one is in no pane, and the query's progress tells how many there were.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    bad = F.count_if(F.col("status") >= 500)
    out = rows.groupBy(F.window("ts", slide or window).alias("w")).agg(F.count("*").alias("requests"), bad.alias("errors"))
    if slide and pd.Timedelta(slide) != pd.Timedelta(window):
        if pd.Timedelta(window) % pd.Timedelta(slide):
            raise ValueError("the slide has to divide the window")
        whole = F.window(F.window_time("w"), window, slide).alias("w")
        out = out.groupBy(whole).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
    return out.select(F.col("w.start").alias("window_start"), "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate"))


def rate_limited_rate(events: DataFrame) -> DataFrame:
    """(route, requests, limited, limited_rate): the share of status 429."""
    out = events.groupBy("route").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == 429).alias("limited"))
    return out.withColumn("limited_rate", F.col("limited") / F.col("requests"))


def histogram_quantile(metrics: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, quantile) from cumulative bucket counts, linear within a bucket; beyond the last bound, that bound."""
    summed = metrics.select(*by, F.posexplode("buckets").alias("i", "c")).groupBy(*by, "i").agg(F.sum("c").alias("c"))
    bounds = F.array(*[F.lit(b) for b in LATENCY_BUCKETS])
    w = Window.partitionBy(*by).orderBy("i")
    rows = summed.withColumns({"_low": F.coalesce(F.lag("c").over(w), F.lit(0)), "_n": F.max("c").over(Window.partitionBy(*by))})
    want = q * F.col("_n")
    hit = rows.where((F.col("c") >= want) & (F.col("_n") > 0)).withColumn("_at", F.row_number().over(w)).where("_at = 1")
    start = F.when(F.col("i") == 0, 0.0).otherwise(F.get(bounds, F.col("i") - 1))
    inside = start + (F.get(bounds, F.col("i")) - start) * F.coalesce((want - F.col("_low")) / F.nullif(F.col("c") - F.col("_low"), F.lit(0)), F.lit(0.0))
    return hit.select(*by, F.when(F.col("i") >= len(LATENCY_BUCKETS), LATENCY_BUCKETS[-1]).otherwise(inside).alias("quantile"))


#: metric, comparison, level
OBJECTIVES = (("p95_chat_ms", "<=", 5000.0), ("p95_api_ms", "<=", 2000.0), ("p95_health_ms", "<=", 200.0), ("recall", ">=", 0.8), ("citation_correctness", ">=", 0.8), ("hallucination_rate", "<=", 0.0), ("error_rate", "<=", 0.01))


def slo_report(metrics: DataFrame, objectives: tuple = OBJECTIVES) -> DataFrame:
    """(metric, value, level, passed) of metrics (metric, value)."""
    from sparkrag.operators.evaluation import quality_gate

    return quality_gate(metrics, objectives)


def audit_counts(events: DataFrame, action: str | None = None, actor: str | None = None, watermark: str | None = None) -> DataFrame:
    """(day, workspace_id, action, n_events) of (ts, action, workspace_id, user_id)."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    rows = rows.where(F.col("action") == action) if action else rows
    rows = rows.where(F.col("user_id") == actor) if actor else rows
    return rows.groupBy(F.date_trunc("day", "ts").alias("day"), "workspace_id", "action").agg(F.count("*").alias("n_events"))
