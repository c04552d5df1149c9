"""Packing documents into sequences of at most `CAPACITY` tokens by minimum bin slack.

Each document's ids end with END_ID. What fills whole sequences is cut off first; the remainders of
a partition are packed group by group: for each sequence, a bitset subset-sum over the lengths that
are left finds the fullest reachable fill, and backtracking counts how many remainders of each length
it takes. A gap that no subset closes is filled by cutting one more remainder. At the end of a
partition what is left is split into sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled: a partition packs its own documents, and its number and a counter make the
sequence id. Memory is bounded by a group of remainders and one document.

Cases: a null or empty text has the end id alone; long texts are cut into as many sequences as they
take; repeated rows are packed once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import tidied

CAPACITY, END_ID, GROUP = 1024, 0, 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths and how many of each to take so that their sum is as close to capacity as counts allow.

    counts[n] is how many remainders have length n. Bit s of a bitset says that sum s is reachable;
    each length is offered in powers of two up to its count, largest lengths first. The bitset before
    each offer is kept, so the choice can be traced back.
    """
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for n in np.flatnonzero(counts[: capacity + 1])[::-1].tolist():
        left, power = min(int(counts[n]), capacity // n), 1
        while left and not reach >> capacity & 1:
            take = min(power, left)
            steps.append((n, take, reach))
            reach |= reach << (n * take) & full
            left -= take
            power *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] += take
            at -= n * take
    return chosen


class Packer:
    """Packs the documents of one partition; pieces are (doc, start, ids bytes, doc_tokens, sequence, offset)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, group: int = GROUP):
        self.next_id, self.capacity, self.group = first_id, capacity, group
        self.left: dict[int, list[tuple[int, int, bytes, int]]] = defaultdict(list)
        self.counts, self.held = np.zeros(capacity + 1, np.int64), 0

    def _sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id: int, ids: bytes) -> Iterator[tuple]:
        n, size = len(ids) // 4, self.capacity
        for at in range(0, n - n % size, size):
            yield doc_id, at, ids[4 * at : 4 * (at + size)], n, self._sequence(), 0
        if n % size:
            self._keep((doc_id, n - n % size, ids[4 * (n - n % size) :], n))
        if self.held >= self.group:
            yield from self.pack(self.group // 8)

    def _keep(self, piece: tuple[int, int, bytes, int]) -> None:
        n = len(piece[2]) // 4
        self.left[n].append(piece)
        self.counts[n] += 1
        self.held += 1

    def _take(self, n: int) -> tuple[int, int, bytes, int]:
        self.counts[n] -= 1
        self.held -= 1
        return self.left[n].pop()

    def _write(self, parts: list[tuple[int, int, bytes, int]]) -> Iterator[tuple]:
        sequence, offset = self._sequence(), 0
        for doc_id, start, ids, n in parts:
            yield doc_id, start, ids, n, sequence, offset
            offset += len(ids) // 4

    def pack(self, keep: int) -> Iterator[tuple]:
        """Full sequences until at most `keep` remainders, or less than a sequence, are left."""
        while self.held > keep and (self.counts * np.arange(self.capacity + 1)).sum() >= self.capacity:
            chosen = best_fill(self.counts, self.capacity)
            parts = [self._take(n) for n, k in sorted(chosen.items(), reverse=True) for _ in range(k)]
            slack = self.capacity - sum(len(p[2]) // 4 for p in parts)
            if slack:
                parts.append(self._cut(slack))
            yield from self._write(parts)

    def _cut(self, size: int) -> tuple[int, int, bytes, int]:
        """The first `size` ids of the longest remainder, which is longer than that; the rest stays."""
        doc_id, start, ids, n = self._take(int(np.flatnonzero(self.counts)[-1]))
        if len(ids) > 4 * size:
            self._keep((doc_id, start + size, ids[4 * size :], n))
        return doc_id, start, ids[: 4 * size], n

    def finish(self) -> Iterator[tuple]:
        yield from self.pack(0)
        total = int((self.counts * np.arange(self.capacity + 1)).sum())
        while total:
            size, parts = 1 << (total.bit_length() - 1), []
            total -= size
            while size:
                parts.append(self._cut(min(size, int(np.flatnonzero(self.counts)[-1]))))
                size -= len(parts[-1][2]) // 4
            yield from self._write(parts)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece of `docs` (doc_id, text); tokenizer: a tokenizers file, None for byte_bpe_50k.json."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkrag.llm.tokens import byte_bpe

        encode, packer, rows = byte_bpe(tokenizer).encode, Packer(TaskContext.get().partitionId() << 33, capacity, group), []
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for i in range(batch.num_rows):
                ids = encode(batch.column(1)[i].as_py() or "") + end
                rows += [(d, s, len(x) // 4, zlib.crc32(x), n, q, o) for d, s, x, n, q, o in packer.add(batch.column(0)[i].as_py(), ids)]
                if len(rows) >= 20_000:
                    yield _record(rows)
                    rows = []
        yield _record(rows + [(d, s, len(x) // 4, zlib.crc32(x), n, q, o) for d, s, x, n, q, o in packer.finish()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run, "tokens"), SCHEMA)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])
