"""Removing repeated passages by longest-previous-factor arrays.

Every string of WIDTH bytes holds a fingerprint of GRAM bytes that is the rightmost smallest of its
hashes, so equal strings have equal fingerprints at the same place. Neighbouring strings with one
fingerprint make a context: the bytes that they cover together. Only contexts whose fingerprint occurs
more than once can hold repeats. The different contexts of a fingerprint go to a task together, and the
suffixes of one that occurs more than once count twice, for its first copy and for a later one. The task
sorts the suffixes that start a string, takes the common prefixes of neighbours (up to WIDTH), and finds
for each the previous and the next smaller position in suffix order and so its longest previous factor
(and by larger positions its longest next factor): a factor of WIDTH bytes or more is a repeat. What
holds for one later copy of a context holds for all.

A fingerprint with more than CONTEXTS different contexts (a very common line in ever other
surroundings) would be a group without bound. It is split by the strings themselves: Spark groups equal
strings by a 128-bit hash, and each group keeps its first and last place. No case is dropped by that.

Cases: a null text is empty; texts shorter than WIDTH have no repeats; the first copy is the one with
the smallest id, then text hash, then place; rows that repeat id and text count as copies of each other,
but keep alike when the first is kept; null ids come first and stay null; long texts are hashed in
pieces; an empty table gives an empty result; other columns don't matter to the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import ByteHasher, hot_keys, slices, spread_join, stored, tidied

WIDTH, GRAM = 200, 64
#: Most different contexts of a fingerprint that one task sorts; bytes sorted at a time; piece of a long text.
CONTEXTS, BATCH, PIECE = 2048, 1 << 16, 1 << 18
NO_ID = -(1 << 63)
_HASH = ByteHasher(41)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def fingerprints(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each context: hash of its fingerprint, hash of its bytes and of the fingerprint's place in them, first string, and number of strings.

    A long text is worked through in pieces of strings; a context cut by a piece's end goes on in the
    next with the same fingerprint, and so is two contexts, which is the same for a copy cut alike or not:
    the strings are what counts, and their fingerprints don't depend on the cut.
    """
    parts, span = [], width - gram + 1
    for at in range(0, max(0, len(data) - width + 1), PIECE):
        piece = data[at : at + PIECE + width - 1]
        sums = _HASH.prefix(piece)
        grams = _HASH.windows(sums, gram)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 21) - 1)
        chosen = (low - (_sliding_min((grams & ~low) | (low - place), span) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        count = np.diff(np.append(first, len(chosen)))
        chosen = chosen[first]
        whole = _HASH.spans(sums, first, first + count + width - 1)
        parts.append((grams[chosen], whole ^ (chosen - first).astype(np.uint64), first + at, count))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in the order of their first `width` bytes, ties by their place in `starts`, and the
    common prefix of each with the one before: `width`, or 0 for all that is less.

    Ranks by a prefix's length come from the ranks of its parts; prefixes grow threefold each time
    while three ranks fit one key.
    """
    n, k = len(data), 1
    rank, bits = data.astype(np.int64), 8
    after = lambda d: np.concatenate([rank[d:], np.zeros(min(d, n), np.int64)])
    while k < 8 and 2 * k <= width:
        rank, k, bits = rank << 8 * k | after(k), 2 * k, 16 * k
    if bits > 16:
        rank, bits = _dense(rank), max(16, n.bit_length())
    ways = 3 if bits <= 21 else 2
    while ways * k < width:
        key = rank
        for i in range(1, ways):
            key = key << bits | after(i * k)
        rank, k = _dense(key), ways * k
    key = rank[starts]
    for i in range(1, ways):
        key = key << bits | rank[starts + i * (width - k) // (ways - 1)]
    block = _dense(key)
    order = np.argsort(block, kind="stable") if bits > 31 else np.sort(block << 32 | np.arange(len(block))) & 0xFFFFFFFF
    same = block[order[1:]] == block[order[:-1]]
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), np.where(same, width, 0)])


def _back(place: np.ndarray, common: np.ndarray, width: int) -> np.ndarray:
    """Common prefix, if it is `width`, with the nearest suffix before in suffix order whose place is smaller.

    All suffixes jump at once, each over those before it that have larger places; a jump ends early
    where the common prefix falls below `width`.
    """
    low, prev = common.copy(), np.arange(len(place)) - 1
    live = np.flatnonzero((low >= width) & (place[prev] > place))
    while len(live):
        j = prev[live]
        low[live], prev[live] = np.minimum(low[live], low[j]), prev[j]
        live = live[(low[live] >= width) & (place[prev[live]] > place[live])]
    return np.where(low >= width, low, 0)


def longest_factors(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factors of the suffixes at `starts`: what they have in common with one
    that stands earlier, or later, in `starts`. Lengths up to `width`; 0 stands for all that are shorter."""
    order, common = suffix_order(data, starts, width)
    reverse = np.concatenate([common[:1], common[:0:-1]])
    out = []
    for p in (order, -order):
        both = np.maximum(_back(p, common, width), _back(p[::-1], reverse, width)[::-1])
        found = np.empty_like(both)
        found[order] = both
        out.append(found)
    return out[0], out[1]


def runs_of(flags: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The runs [lo, hi) of true flags of each part; a part starts at each of `first`, and counts from there."""
    new = np.zeros(len(flags), bool)
    new[first] = True
    begin, end = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1] | new[1:]
    end[:-1] &= ~flags[1:] | new[1:]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
    owner = np.searchsorted(first, lo, side="right") - 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(lo - first[owner]), pa.array(hi - first[owner])], names=["lo", "hi"]))


def _anchors(with_hashes: bool, width: int, gram: int):
    names = ["a", "b", "h", "c", "start", "strings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fingerprints(np.frombuffer((t or "").encode(), np.uint8), width, gram) for t in part["text"].to_pylist()]
                if not with_hashes:
                    yield pa.record_batch([pa.array(np.concatenate([f[0] for f in found]).view(np.int64))], names=["h"])
                    continue
                n = [len(f[0]) for f in found]
                cols = [np.repeat(part[k].to_numpy(), n) for k in ("a", "b")] + [np.concatenate([f[i] for f in found]) for i in range(3)]
                cols.append(np.concatenate([f[3] for f in found]).astype(np.int32))
                yield pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=names)

    return run


def _cut(width: int):
    names = ["h", "c", "strings", "hot", "twice", "a", "b", "start", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch["a"][i].as_py(), batch["b"][i].as_py()
                if now == last:  # a row that repeats id and text
                    continue
                last, raw = now, batch["text"][i].as_py().encode()
                rows = pa.RecordBatch.from_struct_array(batch["places"][i].values)
                texts = [raw[s : s + n + width - 1] for s, n in zip(rows["start"].to_pylist(), rows["strings"].to_pylist(), strict=True)]
                ids = [pa.array([x] * len(texts), pa.int64()) for x in now]
                yield pa.record_batch([*(rows[c] for c in names[:5]), *ids, rows["start"], pa.array(texts, pa.binary())], names=names)

    return run


def _factors(width: int):
    """Streams contexts sorted by (h, a, b, start); yields (h, c, later, both, again) of those with repeats: which
    strings of the first copy occur earlier, which anywhere else, and which of a later copy occur earlier."""
    def solve(keys: list[tuple[int, int]], twice: list[bool], texts: list[bytes], strings: list[int]) -> pa.RecordBatch:
        base, count = np.cumsum([0, *map(len, texts)])[:-1], np.array(strings)
        first = np.cumsum(count) - count
        place = np.repeat(base - first, count) + np.arange(count.sum())
        # Where the later copy of a context stands after the first changes nothing, so they all come last.
        more = np.repeat(np.array(twice), count)
        previous, following = longest_factors(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([place, place[more]]), width)
        later, both = previous[: len(place)] >= width, np.maximum(previous, following)[: len(place)] >= width
        again = np.zeros(len(place), bool)
        again[more] = previous[len(place) :] >= width
        cols = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [runs_of(flags, first) for flags in (later, both, again)]
        return pa.record_batch(cols, names=["h", "c", "later", "both", "again"]).filter(pa.array(np.add.reduceat(both, first) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, twice, texts, strings, size, now, seen = [], [], [], [], 0, None, set()
        for batch in batches:
            for h, c, n, more, text in zip(*(batch[k].to_pylist() for k in ("h", "c", "strings", "twice", "bytes")), strict=True):
                if h != now:
                    now, seen = h, set()
                    if size > BATCH:
                        yield solve(keys, twice, texts, strings)
                        keys, twice, texts, strings, size = [], [], [], [], 0
                if c in seen:  # cut from a row that repeats id and text
                    continue
                seen.add(c)
                keys.append((h, c))
                twice.append(more)
                texts.append(text)
                strings.append(n)
                size += len(text)
        if keys:
            yield solve(keys, twice, texts, strings)

    return run


def _strings(width: int):
    """Each string of the contexts of hot fingerprints, by a 128-bit hash."""
    other = ByteHasher(43)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch["bytes"][i].as_py(), np.uint8)
                x, y = (k.windows(k.prefix(data), width).view(np.int64) for k in (_HASH, other))
                same = [pa.array([batch[k][i].as_py()] * len(x), batch[k].type) for k in ("h", "c", "twice", "a", "b", "start")]
                yield pa.record_batch([*same, pa.array(np.arange(len(x))), pa.array(x), pa.array(y)], names=["h", "c", "twice", "a", "b", "start", "at", "x", "y"])

    return run


_RUNS = "array<struct<lo: long, hi: long>>"


def _hot_factors(contexts: DataFrame, width: int) -> DataFrame:
    """What `_factors` yields, by counting: no task holds all contexts of a fingerprint."""
    rows = contexts.mapInArrow(tidied(_strings(width)), "h long, c long, twice boolean, a long, b long, start long, at long, x long, y long")
    here = F.struct("a", "b", (F.col("start") + F.col("at")).alias("p"))
    # A row that repeats id and text gives the same places again, which aren't other copies.
    firsts = rows.groupBy("h", "x", "y").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.max("twice").alias("more")).where("first <> last or more").select("h", "x", "y", "first")
    run, none = F.array(F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))), F.array().cast(_RUNS)
    found = rows.join(firsts, ["h", "x", "y"]).select("h", "c", F.when(here != F.col("first"), run).otherwise(none).alias("later"), run.alias("both"), F.when(F.col("twice"), run).otherwise(none).alias("again"))
    return found.groupBy("h", "c").agg(*[F.flatten(F.collect_list(k)).alias(k) for k in ("later", "both", "again")])


def keyed(docs: DataFrame) -> DataFrame:
    """(a, b, text): id and text hash stand for a row; neither is null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("a"), F.xxhash64(text).alias("b"), text.alias("text"))


def repeated_spans(docs: DataFrame, keep_first: bool = True, width: int = WIDTH, gram: int = GRAM, contexts: int = CONTEXTS) -> DataFrame:
    """(a, b, spans) of the rows of `keyed(docs)` that hold shared fingerprints: byte spans [lo, hi) of strings
    that occur earlier too (keep_first) or anywhere else; spans may overlap, and there may be none."""
    own = keyed(docs)
    long_ = own.where(F.octet_length("text") >= width)
    counts = stored(long_.mapInArrow(tidied(_anchors(False, width, gram)), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "fingerprints")
    total = counts.agg(F.sum("n")).first()[0] or 0
    anchors = long_.mapInArrow(tidied(_anchors(True, width, gram)), "a long, b long, h long, c long, start long, strings int")
    shared = stored(spread_join(anchors, counts.select("h"), ["h"], hot_keys(counts, ["h"], "n", total)), "contexts")

    here = F.struct("a", "b", "start")
    distinct = shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(here).alias("first"), F.max(here).alias("last"), F.first("strings").alias("strings"))
    distinct = stored(distinct, "distinct")
    many = distinct.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > contexts)
    hot = stored(many.withColumn("hot", F.lit(True)), "hot")  # at most a fingerprint for each `contexts` contexts
    marked = spread_join(distinct, hot.select("h", "hot"), ["h"], hot_keys(hot, ["h"], "m", distinct.count()), "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    one = F.struct("h", "c", "strings", "hot", (F.col("first") < F.col("last")).alias("twice"), F.col("first.start").alias("start"))
    places = marked.groupBy("first.a", "first.b").agg(F.collect_list(one).alias("places"))
    cut = own.join(places, ["a", "b"]).select("a", "b", "text", "places").mapInArrow(tidied(_cut(width)), "h long, c long, strings int, hot boolean, twice boolean, a long, b long, start long, bytes binary")
    found = cut.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h", "a", "b", "start").mapInArrow(tidied(_factors(width)), f"h long, c long, later {_RUNS}, both {_RUNS}, again {_RUNS}")
    if not hot.isEmpty():
        found = found.unionByName(_hot_factors(cut.where("hot").drop("hot"), width))

    # One plan from here to the result, so that the texts are shuffled once for the cut and for the removal.
    known = distinct.join(found, ["h", "c"], "left").select("h", "c", "n", "first", "later", "both", "again", (F.col("first") == F.col("last")).alias("same"))
    rows = spread_join(shared, known, ["h", "c"], hot_keys(distinct, ["h", "c"], "n", shared.count()), "left")  # every context gets its answer, none if it has no repeats
    nothing = F.array().cast(_RUNS)
    if keep_first:
        runs = F.when(here == F.col("first"), F.coalesce("later", nothing)).otherwise(F.coalesce("again", nothing))
    else:  # the rows of one place repeat id and text, and are copies of each other
        runs = F.when(F.col("same") & (F.col("n") > 1), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("strings").cast("long").alias("hi")))).otherwise(F.coalesce("both", nothing))
    spans = F.transform(runs, lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start") + (width - 1)).alias("hi")))
    return rows.select("a", "b", spans.alias("spans")).groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]])


def _spans_of(column: pa.Array, i: int) -> list[tuple[int, int]]:
    row = column[i]
    if not row.is_valid:
        return []
    cols = row.values.flatten()
    return merged(list(zip(cols[0].to_pylist(), cols[1].to_pylist(), strict=True)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            raw, spans = batch["text"][i].as_py().encode(), _spans_of(batch["spans"], i)
            rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest()))
        n, removed, runs, sha = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.record_batch([batch["a"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["a", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row with its repeats removed."""
    rows = keyed(docs).join(repeated_spans(docs, **how), ["a", "b"], "left").select("a", "text", "spans")
    return rows.mapInArrow(tidied(_digests), "a long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").select(_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _id() -> Column:
    return F.when(F.col("a") != NO_ID, F.col("a")).alias("doc_id")


def _texts(names: list[str]):
    at = names.index("text")

    def cut(text: str | None, spans: pa.Array, i: int) -> str | None:
        found = _spans_of(spans, i)
        return without(text.encode(), found).decode("utf-8", "ignore") if text and found else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                cols = part["row"].flatten()
                texts = [cut(t, part["spans"], i) for i, t in enumerate(cols[at].to_pylist())]
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.record_batch(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with the repeats cut out of `text`, other columns as they are. What a run's edge leaves of a
    character goes with it. Null texts stay null."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no name can clash
    text = F.col("row")["text"]
    rows = row.select("row", F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(NO_ID)).alias("a"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("b"))
    joined = rows.join(repeated_spans(docs, **how), ["a", "b"], "left")
    return joined.select("row", "spans").mapInArrow(tidied(_texts(docs.columns)), docs.schema)
