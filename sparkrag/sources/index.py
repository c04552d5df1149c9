"""An index table that is changed file by file: buckets of files, and generations within them.

Files are dealt to buckets by a hash of workspace and file. A write adds a generation to the buckets of its files and
touches no other; the rows of a file are those of its newest generation. `compact` merges the generations
of a bucket into one and drops the old ones. A write or a merge that runs again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.sources.io import settled

BUCKETS = 64
_FILE = ["workspace_id", "file_id"]


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*_FILE), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    # A bucket is one file, or as many as there are partitions for each bucket.
    share = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("file_id"), F.lit(share)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(path)


def write_generation(rows: DataFrame, path: str, number: int, buckets: int = BUCKETS) -> None:
    """Adds rows (workspace_id, file_id, ...) as generation `number`: the new rows of their files. Numbers rise from write
    to write; merges take the odd places between them."""
    _put(rows.withColumns({"bucket": bucket_of(buckets), "generation": F.lit(2 * number).cast("long")}), path, buckets)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("bucket", *_FILE).agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["bucket", *_FILE, "generation"], "left_semi")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each file's newest generation."""
    return _newest(read_generations(spark, path)).drop("bucket", "generation")


def _numbers(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The generations of each bucket, from the names of the folders."""
    jvm = spark._jvm.org.apache.hadoop.fs
    pattern = jvm.Path(f"{path}/bucket=*/generation=*")
    found: dict[int, list[int]] = {}
    for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        bucket, generation = (int(part.split("=")[1]) for part in status.getPath().toString().rsplit("/", 2)[1:])
        found.setdefault(bucket, []).append(generation)
    return found


def replace_files(rows: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Puts rows in the place of those of their files; returns the generation's number. Other buckets' files stay untouched."""
    number = max((g for own in _numbers(rows.sparkSession, path).values() for g in own), default=-2) // 2 + 1
    write_generation(rows, path, number, buckets)
    return number


def compact(spark: SparkSession, path: str, least: int = 2) -> int:
    """Merges the generations of each bucket that has `least` or more, and drops those merged; returns how many were
    dropped. The merged rows are written under a number of their own before anything is dropped, and readers take
    the newest, so a merge that breaks off leaves the same rows to read."""
    many = {b: sorted(g) for b, g in _numbers(spark, path).items() if len(g) >= least}
    if not many:
        return 0
    rows = _newest(read_generations(spark, path).where(F.col("bucket").isin(*many)))
    top = F.create_map(*[F.lit(x) for b, g in many.items() for x in (b, g[-1] | 1)])  # the odd place after the last write
    merged = settled(rows.withColumn("generation", top[F.col("bucket")].cast("long")), "merged")
    _put(merged, path)
    jvm, dropped = spark._jvm.org.apache.hadoop.fs, 0
    for bucket, generations in many.items():
        for g in generations:
            if g != generations[-1] | 1:
                old = jvm.Path(f"{path}/bucket={bucket}/generation={g}")
                dropped += bool(old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True))
    return dropped
