"""Files, evaluation sets, audit lines, tables and reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_SCHEMA = (
    "name string, version string, documents array<struct<filename: string, content: string>>, "
    "queries array<struct<question: string, expected_filename: string, expected: string>>"
)
AUDIT_SCHEMA = "timestamp timestamp, action string, workspace_id string, user_id string, target string, metadata string"
#: Bytes of files that a task reads.
_TASK_BYTES = 64 << 20
_LAYOUT = r"workspaces/([^/]+)/files/([^/]+)/v(\d+)/([^/]+)$"


def _keyed(df: DataFrame, layout: str = _LAYOUT) -> DataFrame:
    part = lambda i: F.regexp_extract("path", layout, i)
    return df.select(
        part(1).alias("workspace_id"), part(2).alias("file_id"), part(3).try_cast("int").alias("version"), F.url_decode(part(4)).alias("filename"),
        F.col("modificationTime").alias("arrived_at"), F.col("length").alias("size_bytes"), "content",
    )


def _packed(bodies: DataFrame) -> DataFrame:
    """Many small files to few tasks: Spark counts each as 4 MB at least, so that a task has but a few of them."""
    n_bytes = int(bodies._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return bodies.coalesce(max(4 * bodies.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // _TASK_BYTES)))


def _choice(values: Iterable | None, prefix: str = "") -> str:
    """A path pattern of one of the values, or of any."""
    if values is None:
        return prefix + "*"
    quoted = [re.sub(r"([\\*?{}\[\],])", r"\\\1", str(v)) for v in values]
    return prefix + ("{" + ",".join(quoted) + "}" if len(quoted) != 1 else quoted[0])


def read_files(spark: SparkSession, root: str, layout: str = _LAYOUT, workspaces: Iterable[str] | None = None, files: Iterable[str] | None = None, versions: Iterable[int] | None = None) -> DataFrame:
    """Bodies laid out as workspaces/{workspace}/files/{file}/v{n}/{name}, with the parts of their path. layout: a
    pattern of paths laid out otherwise, with groups for workspace, file, version and name.

    workspaces, files, versions: those to read; no other folder is listed or opened. They need the standard
    layout, or one by partition columns named workspace, file and v.
    """
    source = spark.read.format("binaryFile")
    if workspaces is None and files is None and versions is None:
        return _keyed(_packed(source.option("recursiveFileLookup", True).load(root)), layout).where("workspace_id <> ''")
    if any(x is not None and not list(x) for x in (workspaces, files, versions)):
        empty = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
        return _keyed(empty, layout)
    if layout == _LAYOUT:
        path = f"{root}/workspaces/{_choice(workspaces)}/files/{_choice(files)}/{_choice(versions, 'v')}"
    else:
        path = f"{root}/{_choice(workspaces, 'workspace=')}/{_choice(files, 'file=')}/{_choice(versions, 'v=')}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path)
    if not found:
        return _keyed(spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary"), layout)
    return _keyed(_packed(source.option("recursiveFileLookup", True).load(path)), layout).where("workspace_id <> ''")


def stream_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    return _keyed(found).where("workspace_id <> ''")


def read_eval_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dataset, filename, content) and (dataset, query_id, question, expected_filename); null expected: no answer."""
    raw = spark.read.schema(EVAL_SCHEMA).json(path, multiLine=True)
    docs = raw.select(F.col("name").alias("dataset"), F.explode("documents").alias("d")).select("dataset", "d.filename", "d.content")
    asked = raw.select(F.col("name").alias("dataset"), F.posexplode("queries").alias("query_id", "q"))
    return docs, asked.select("dataset", "query_id", "q.question", F.coalesce("q.expected_filename", "q.expected").alias("expected_filename"))


def read_audit_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def write_audit_jsonl(events: DataFrame, path: str, mode: str = "append") -> None:
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """Parquet; with mode "overwrite" and partition columns only the partitions in df are replaced."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int = 32) -> DataFrame:
    """A database table, read in ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts)


def replace_by_file(index: DataFrame, fresh: DataFrame, key: str = "file_id") -> DataFrame:
    """The index without the rows of files that fresh has, and the rows of fresh. Doing it twice changes nothing."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))


def write_eval_report(metrics: DataFrame, per_query: DataFrame, path: str) -> None:
    """metrics/ and per_query/ as Parquet, and lines/ as a markdown table, one part per file. Line ends in a
    cell become <br>, so that a row is one line."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    per_query.write.mode("overwrite").parquet(f"{path}/per_query")
    cells = [F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>"), F.lit("")) for c in per_query.columns]
    per_query.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(f"{path}/lines")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see: spark.checkpoint.dir. Where none is set a temporary one is made if
    the executors run in the driver's process, as in tests; on a cluster that is an error, since rows written there would be lost."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkrag-")
        sc.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it comes from fewer files than there are. A table of many files isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """df computed once for several uses: a table in the shared folder, of which each use reads the columns it needs."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
