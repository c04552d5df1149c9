"""Ingestion control: validation, content scan, de-duplication, idempotency, status changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.settings import DEFAULTS, EXECUTABLE_MAGICS, MIME_TYPES, TEXT_EXTENSIONS


def extension(filename: Column) -> Column:
    """Lower-case text from the last dot on; '' without a dot."""
    return F.when(F.contains(filename, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1)))).otherwise("")


def validate_files(files: DataFrame, max_bytes: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """Adds ext, mime_type and reject_reason (null if accepted) to rows (filename, size_bytes)."""
    ext = extension(F.col("filename"))
    types = reduce(lambda w, kv: w.when(ext == kv[0], kv[1]), list(MIME_TYPES.items())[1:], F.when(ext == next(iter(MIME_TYPES)), next(iter(MIME_TYPES.values()))))
    reason = F.when(types.isNull(), "extension").when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > max_bytes, "too_large")
    return files.withColumns({"ext": ext, "mime_type": types, "reject_reason": reason})


def scan_content(files: DataFrame) -> DataFrame:
    """Adds scan_reason to rows (filename, content: binary); null if nothing is wrong."""
    body, size = F.col("content"), F.octet_length("content")
    mark = "X5O!P%@AP[4\\PZX54(P^)7CC)7}$" + "EICAR-STANDARD-" + "ANTIVIRUS-TEST-FILE!$H+H*"
    sign = F.lit(mark).cast("binary")
    found = F.contains(F.substring(body, 1, 4096), sign) | F.contains(F.substring(body, F.greatest(size - 2047, F.lit(1)), F.lit(2048)), sign)
    reason = F.when(body.isNull() | (size == 0), "empty content").when(found, "malware test signature")
    for magic, label in EXECUTABLE_MAGICS:
        reason = reason.when(F.startswith(body, F.unhex(F.lit(magic))), f"binary content not allowed: {label}")
    nul = F.contains(F.substring(body, 1, 65536), F.unhex(F.lit("00")))
    return files.withColumn("scan_reason", reason.when(extension(F.col("filename")).isin(*TEXT_EXTENSIONS) & nul, "NUL byte in a text file"))


def checksum(body: Column) -> Column:
    return F.sha2(body, 256)


def dedup_uploads(incoming: DataFrame, files: DataFrame, order: str = "arrived_at", key: str = "file_id") -> DataFrame:
    """Rows of incoming (workspace_id, checksum, ...) whose content their workspace doesn't hold yet: the
    first by arrival of each. files: (workspace_id, checksum, is_deleted). Bodies needn't be carried; the
    earliest arrival is found with a partial aggregate, so a popular copy is no hot group."""
    live = files.where(~F.col("is_deleted")).select("workspace_id", "checksum").distinct()
    first = incoming.groupBy("workspace_id", "checksum").agg(F.min(F.struct(order, key)).alias("_first"))
    fresh = first.join(live, ["workspace_id", "checksum"], "left_anti")
    kept = incoming.join(fresh, ["workspace_id", "checksum"]).where(F.struct(order, key) == F.col("_first"))
    return kept.select(*incoming.columns)


def idempotent_replay(requests: DataFrame) -> DataFrame:
    """Adds replayed and answer to rows (user_id, endpoint, key, request_hash, response, ts): a repeated
    key gets the response of its first request; rows without a key pass."""
    by = ["user_id", "endpoint", "key"]
    first = requests.where("key is not null").groupBy(*by).agg(F.min_by(F.struct("ts", "response"), F.struct("ts", "request_hash", "response")).alias("_first"))
    joined = requests.join(first, by, "left")
    rank = (F.col("ts") > F.col("_first.ts")) & F.col("key").isNotNull()
    return joined.select(*requests.columns, F.coalesce(rank, F.lit(False)).alias("replayed"), F.when(rank, F.col("_first.response")).otherwise(F.col("response")).alias("answer"))


def conflicting_keys(requests: DataFrame) -> DataFrame:
    """Keys that came with more than one request hash."""
    by = ["user_id", "endpoint", "key"]
    return requests.where("key is not null").groupBy(*by).agg(F.count_distinct("request_hash").alias("n_hashes")).where("n_hashes > 1")


def current_versions(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Each file with the row of its current version."""
    own = versions.select("file_id", F.col("version").alias("current_version"), *[c for c in versions.columns if c not in ("file_id", "version", *files.columns)])
    return files.join(own, ["file_id", "current_version"])


def plan_ingest(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (job_id, file_id) with action run or cancelled: only queued and failed files run."""
    state = files.select("file_id", F.col("status").alias("file_status"))
    runs = F.coalesce(F.col("file_status").isin("queued", "failed"), F.lit(False))
    return jobs.join(state, "file_id", "left").withColumn("action", F.when(runs, "run").otherwise("cancelled"))


def finish_ingest(files: DataFrame, results: DataFrame) -> DataFrame:
    """files with the status that results (file_id, error) give: indexed, or failed with 500 characters of the error."""
    done = results.groupBy("file_id").agg(F.max("error").alias("_error"), F.lit(True).alias("_ran"))
    joined = files.join(done, "file_id", "left")
    status = F.when(F.col("_ran").isNull(), F.col("status")).when(F.col("_error").isNull(), "indexed").otherwise("failed")
    error = F.when(F.col("_ran").isNull(), F.col("error")).otherwise(F.substring("_error", 1, 500))
    return joined.withColumns({"status": status, "error": error}).select(*files.columns)


def _with_jobs(files: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    moved = files.withColumns({"error": F.when(chosen, F.lit(None).cast("string")).otherwise(F.col("error")), "status": F.when(chosen, "queued").otherwise(F.col("status"))})
    return moved, files.where(chosen).select("file_id", F.lit("reindex").alias("job_type"), F.lit("queued").alias("status"))


def requeue(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that hang or failed back to queued, and a reindex job for each."""
    return _with_jobs(files, F.col("status").isin("processing", "failed", "queued") & ~F.col("is_deleted"))


def reindex(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All files but queued and deleted ones to queued, and a reindex job for each."""
    return _with_jobs(files, (F.col("status") != "queued") & ~F.col("is_deleted"))


def cancel(files: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queued files among ids are deleted with an error, and their queued jobs cancelled."""
    gone = files.where("status = 'queued'").join(ids.select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.lit(True).alias("_gone"))
    hit = F.coalesce(F.col("_gone"), F.lit(False))
    marked = files.join(gone, "file_id", "left").withColumns({"status": F.when(hit, "deleted").otherwise(F.col("status")), "error": F.when(hit, "cancelled").otherwise(F.col("error"))})
    stopped = jobs.join(gone, "file_id", "left").withColumn("status", F.when(hit & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status")))
    return marked.select(*files.columns), stopped.select(*jobs.columns)


def soft_delete(files: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("file_id").distinct().withColumn("_gone", F.lit(True))
    return files.join(gone, "file_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).select(*files.columns)


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without those of ids (file_id[, version]), and how many went by file."""
    on = [c for c in ("file_id", "version") if c in ids.columns]
    keys = ids.select(*on).distinct()
    return chunks.join(keys, on, "left_anti").select(*chunks.columns), chunks.join(keys, on, "left_semi").groupBy("file_id").agg(F.count("*").alias("n_deleted"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
