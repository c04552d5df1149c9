"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = np.uint64
#: Odd multiplier of the polynomial byte hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir. Where none is set a temporary one is made if the executors run
    in the driver's process, as in tests; on a cluster that is an error, since rows written there would be lost."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkrag-")
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkrag-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows and, but for a single longer row, `size` bytes of its text column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(total, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at, before = end, int(total[end - 1])


#: What operators remember in a worker from task to task, by name: how to forget it.
CACHES: dict[str, Callable[[], None]] = {}


def forget_others(uses: str | None) -> None:
    for name, forget in CACHES.items():
        if name != uses:
            forget()


def release() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str | None = None):
    """run, a task's work on its batches, that leaves a small worker behind: what other operators remember is
    forgotten first, and free memory is given back at the end. A worker lives as long as its executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(uses)
        yield from run(batches)
        release()

    return task


def kept_rows(docs: DataFrame, decide: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of docs whose texts `decide` says yes to, a bounded part of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [decide(part["text"].to_pylist()) for part in slices(batch, "text")]
            yield batch.filter(pa.array(np.concatenate(yes) if yes else np.zeros(0, bool)))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    """True for the documents kept from training: crc32 of the id as text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_ids(docs: DataFrame, labels: DataFrame, columns: dict[str, str], sample: int) -> DataFrame:
    """(doc_id, *columns) of at most `sample` labelled documents that have a text and aren't held out.

    columns: expressions over the labels, 0 or 1; as far as possible half of the rows have each value of the
    last. Ids are joined with the documents first and then drawn by a hash of the id, so no draw is lost.
    """
    last = list(columns)[-1]
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(e).cast("int").alias(c) for c, e in columns.items()]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    present = known.join(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lambda v: present.where(F.col(last) == v).orderBy(*order).limit(sample // 2)
    return pick(0).unionByName(pick(1))


def training_rows(docs: DataFrame, ids: DataFrame, sample: int) -> DataFrame:
    """The texts of the documents with these ids, at most `sample`: ids has at most that many rows of a few integers."""
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)


#: Most keys that count as hot: those with more than one row in HOT_KEYS of the table.
HOT_KEYS = 4000


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """(keys, _salts): the keys with more than total/HOT_KEYS of the `total` rows, at most HOT_KEYS of them by
    construction, and into how many shares of that size their rows go; all shares together are at most 2*HOT_KEYS."""
    share = max(1.0, total / HOT_KEYS)
    return counts.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("_salts"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, which has few rows a key: no task gets all rows of a hot key of left.

    The rows of a hot key are dealt to shares by a hash of their columns, and right's rows of that key go
    to every share. Without `hot` the keys of left, a stored table, are counted.
    """
    if hot is None:
        hot = hot_keys(left.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_n", left.count())
    hot = F.broadcast(hot)  # at most HOT_KEYS rows
    salt = F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt")
    mine = left.join(hot, keys, "left").select(*left.columns, salt)
    other = right.join(hot, keys, "left").select(*right.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    return mine.join(other, [*keys, "_salt"], how).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit values."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


#: Powers of the hash's base and of its inverse kept in a worker: enough for a piece of a text, 8 MB.
_KEPT = 1 << 19
_powers_kept: tuple[np.ndarray, np.ndarray] | None = None


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; beyond what a worker keeps they are made anew and dropped."""
    global _powers_kept
    if n > _KEPT:
        return _make_powers(n)
    if _powers_kept is None:
        _powers_kept = _make_powers(_KEPT)
    return _powers_kept[0][:n], _powers_kept[1][:n]


class ByteHasher:
    """Polynomial hashes of all windows or words of a byte buffer, from one prefix sum modulo 2**64."""

    def __init__(self, seed: int = 7):
        self.table = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
        return sums

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of data[i:i+width] for each i."""
        n = len(sums) - width
        return mix64((sums[width:] - sums[:n]) * powers(n)[1]) if n > 0 else np.zeros(0, np.uint64)

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for arrays of starts and ends; the length is part of it."""
        return mix64((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


#: 1 for the bytes of white space that end words: blank and tab to carriage return.
SPACE = np.zeros(256, np.uint8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't white space."""
    edge = np.diff(np.concatenate([[1], SPACE[data], [1]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
