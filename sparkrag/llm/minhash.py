"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of WORDS words. Its sketch has COORDS coordinates: in
round i every shingle is thrown into a random bin with the value i plus a random fraction, in rounds
from COORDS on into the bin i-COORDS, and each bin keeps its smallest value, so that after 2*COORDS
rounds at the latest every coordinate is filled. Two sets agree in a coordinate with a chance equal to
their Jaccard similarity, closely concentrated. BANDS bands of ROWS coordinates find candidates: at
similarity 0.85 a pair shares no band with a chance of about 3e-7.

Documents with equal sets are one class from the start. Classes that share a band with the same
smallest class are candidates of each other, and the components of that relation are verified on full
sets: all pairs within, in blocks of bounded size, each block pair returning only a spanning forest
of the links it confirms. Components of the confirmed links are the result. A hot class is one row in
all of this; a large candidate component is spread over many block pairs, whose number grows with the
square of its blocks.

Cases: a null or empty text, or one of white space, has the empty set and is linked with nothing; a
text of fewer words than WORDS is one shingle; equal sets are linked whatever their ids; rows that
repeat an id count as one document for links and give a row each; rows with a null id are linked with
nothing else than equal sets; ties go to the smaller id; an empty table gives an empty result; other columns
are ignored; long texts are hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import LOWER, ByteHasher, hot_keys, mix64, slices, spread_join, stored, tidied, word_spans
from sparkrag.llm.components import connected_components

WORDS, ROWS, BANDS = 5, 6, 32
COORDS = ROWS * BANDS
#: Bytes of text hashed at a time, and shingles and documents of a verification block.
SPAN, BLOCK_SHINGLES, BLOCK_DOCS = 1 << 18, 1 << 18, 512
_HASH = ByteHasher(23)
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_STEP = np.cumprod(np.full(WORDS, 0xD1342543DE82EF95, np.uint64))


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of raw, A-Z lowered."""
    data = LOWER[np.frombuffer(raw, np.uint8)]
    start, end = word_spans(data)
    return _HASH.spans(_HASH.prefix(data), start, end), start


def word_hashes(raw: bytes) -> np.ndarray:
    """Hash of each word; a long text is cut at white space."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > SPAN:
            end = max(raw.rfind(c, at, at + SPAN) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            if end <= at:  # a word longer than a piece
                rest = np.flatnonzero(np.isin(np.frombuffer(raw, np.uint8, offset=at + SPAN), [9, 10, 11, 12, 13, 32]))
                end = at + SPAN + int(rest[0]) + 1 if len(rest) else len(raw)
        out.append(_hashed(raw[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set_of(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    n = len(words)
    k = min(n, WORDS)
    total = np.full(n - k + 1, _U(k))
    for i in range(k):
        total = total + words[i : n - k + 1 + i] * _STEP[i]
    return np.unique(mix64(total))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    group, size = [], 0
    for t in [*texts, None]:
        raw = (t or "").encode()
        if group and (len(out) + len(group) == len(texts) or size + len(raw) > SPAN):
            words, start = _hashed(b" ".join(group))
            first = np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])])
            cut = np.searchsorted(start, first)
            out += [_set_of(words[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            group, size = [], 0
        if len(out) == len(texts):
            break
        if len(raw) > SPAN:
            out.append(_set_of(word_hashes(raw)))
        else:
            group.append(raw)
            size += len(raw)
    return out


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """(sets, coords) values: the round in the upper bits, a random fraction below; empty sets stay at the maximum."""
    out = np.full((len(sets), coords), _MAX)
    sizes = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(sizes > 0)
    if not len(live):
        return out
    flat, owner = np.concatenate([sets[i] for i in live]), np.repeat(live, sizes[live])
    for i in range(2 * coords):
        h = mix64(flat + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = _U(i << 52) | (h >> _U(12))
        bins = ((h & _U(0xFFFFF)) * _U(coords) >> _U(20)).astype(np.int64) if i < coords else np.full(len(h), i - coords)
        np.minimum.at(out.reshape(-1), owner * coords + bins, value)
        open_ = (out[live] == _MAX).any(axis=1)
        if not open_.all():
            live = live[open_]
            if not len(live):
                break
            mine = np.isin(owner, live)
            flat, owner = flat[mine], owner[mine]
    return out


def band_hashes(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, coords = values.shape
    step = np.cumprod(np.full(rows, 0xA0761D6478BD642F, np.uint64))
    salt = np.arange(coords // rows, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return mix64((values.reshape(n, -1, rows) * step).sum(axis=2, dtype=np.uint64) + salt)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "class_a", "class_b", "bands"]
    for batch in batches:
        for part in slices(batch, "text", 512):
            sets = shingle_sets(part["text"].to_pylist())
            bands = band_hashes(sketches(sets)).view(np.int64)
            mixed = [mix64(s ^ _U(0x1234567)) for s in sets]
            a = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            b = np.array([int(s.sum(dtype=np.uint64)) for s in mixed], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1)))
            yield pa.record_batch([part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), lists], names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 512):
            sets = [s.view(np.int64) for s in shingle_sets(part["text"].to_pylist())]
            yield pa.record_batch([part["group"], part["node"], pa.array(sets, pa.list_(pa.int64())), part["blocks"]], names=["group", "node", "shingles", "blocks"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest position of the component of each set, by links 100*intersection >= percent*union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = (count > 1)[column]
    row, column, width = owner[keep], shared[column[keep]], int((count > 1).sum())
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((n, min(4096, width - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    u, v = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None] - common), 1))
    root = np.arange(n)
    while len(u):  # every node takes the smallest root next to it until none changes
        before = root.copy()
        np.minimum.at(root, u, root[v])
        np.minimum.at(root, v, root[u])
        root = root[root]
        if (root == before).all():
            break
    return root


def _confirmed(percent: int):
    """Streams rows sorted by (group, i, j); yields the links that hold each block pair's components together."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        root = linked(sets, percent)
        return [(nodes[i], nodes[r]) for i, r in enumerate(root.tolist()) if i != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        for batch in batches:
            cols, offsets, flat = [batch[c].to_pylist() for c in ("group", "i", "j", "node")], batch["shingles"].offsets.to_numpy(), batch["shingles"].values.to_numpy().view(np.uint64)
            out = []
            for at, (*now, node) in enumerate(zip(*cols, strict=True)):
                if now != key:
                    out += links(nodes, sets) if len(nodes) > 1 else []
                    key, nodes, sets = now, [], []
                nodes.append(node)
                sets.append(flat[offsets[at] : offsets[at + 1]].copy())
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["u", "v"])
        if len(nodes) > 1:
            out = links(nodes, sets)
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stored(own.mapInArrow(tidied(_sketch), "doc_id long, n_shingles long, class_a long, class_b long, bands array<long>"), "sketches")
    classes = stored(
        sketched.where("n_shingles > 0 and doc_id is not null").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")),
        "classes",
    )
    buckets = classes.select("node", F.explode("bands").alias("band"))
    bands = stored(buckets.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1"), "bands")
    hot = hot_keys(bands, ["band"], "n", classes.count() * BANDS)
    candidates = spread_join(buckets, bands.select("band", "u"), ["band"], hot).select("u", F.col("node").alias("v")).where("u <> v").distinct()
    groups = stored(connected_components(candidates), "groups")

    sizes = classes.select("node", "n_shingles").join(groups, "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = groups.join(sizes.select("component", blocks.alias("blocks")), "component").select("node", F.col("component").alias("group"), "blocks")
    texts = own.withColumnRenamed("doc_id", "node").join(members, "node")
    sets = texts.select("group", "node", "blocks", "text").mapInArrow(tidied(_sets), "group long, node long, shingles array<long>, blocks int")
    mine = sets.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "node", "shingles"
    )
    links = paired.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(tidied(_confirmed(percent)), "u long, v long")
    found = connected_components(links)

    by_class = stored(classes.select("class_a", "class_b", "node").join(found, "node", "left").select("class_a", "class_b", F.coalesce("component", "node").alias("component")), "by-class")
    key = ["class_a", "class_b"]
    rows = spread_join(sketched.select("doc_id", "n_shingles", *key), by_class, key, hot_keys(classes, key, "n", sketched.count()), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without those that aren't the smallest id of their component; columns as they are. Rows that repeat
    an id are one document and stay or go together; rows with a null id stay."""
    gone = near_duplicates(docs, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
