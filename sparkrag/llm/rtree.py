"""Hard-negative mining with R-trees packed by sort-tile-recursion (STR).

Vectors are quantised to whole numbers; rows of one label with equal vectors are merged, each keeping its
smallest ids, which is all that a search can need. The space of (label, components) is cut into tiles by
STR over a bounded sample: sorted by label and cut, then by one component after the other, those of the
widest spread first. A tile is dealt to blocks of bounded size; each block packs its rows, by STR again,
into leaves of one label and these into an R-tree of minimum bounding boxes. A box tells, coordinate by
coordinate, within which interval a product with an anchor can lie: sum of min and of max of q_i lo_i and
q_i hi_i.

Anchors are sent to the tiles that may matter by the boxes of the tiles, a bounded table. In a block a
best-first queue takes the boxes by their upper bounds: the search for positives takes boxes of the
anchor's label and ends strictly below the k-th best score; the search for negatives takes boxes of other
labels, and passes over those that lie outside all of the anchor's score windows or whose best possible score in a window
is strictly below that window's k-th. What the blocks find is ranked once more.

Cases: rows with a null id or label, a null or empty vector, or one with null or non-finite components
take no part; vectors of another length than the anchor's have no product with it and are neither; a
row that repeats id, label and vector counts once, and one id with several labels or vectors is several
anchors of that id; an anchor without others of its label has no positives, a window without rows no
negatives, and neither gives rows; ties go to the smaller id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.llm.common import stored, tidied
from sparkrag.llm.voronoi import by_length, inner_products, matrix, quantised, usable

#: Rows of a block, of a leaf and of a query block; boxes under one of the next level; tiles at most; rows of the sample.
BLOCK, LEAF, QUERY_BLOCK, FAN, MOST_TILES, SAMPLE = 8192, 128, 2048, 8, 512, 20_000


def str_groups(x: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Rows of x in groups of at most about `capacity` by sort-tile-recursion over its columns in turn."""

    def tile(rows: np.ndarray, column: int) -> Iterator[np.ndarray]:
        groups, rest = -(-len(rows) // capacity), x.shape[1] - column
        if groups <= 1 or rest == 0:
            for at in range(0, len(rows), capacity):
                yield rows[at : at + capacity]
            return
        slabs = int(np.ceil(groups ** (1 / rest) - 1e-9))
        rows = rows[np.argsort(x[rows, column], kind="stable")]
        for slab in np.array_split(rows, max(2, slabs)):
            yield from tile(slab, column + 1)

    return list(tile(np.arange(len(x)), 0))


class Tiles:
    """Where STR cuts the space: a tree of thresholds on label and components; the leaves are numbered tiles."""

    def __init__(self, labels: np.ndarray, x: np.ndarray, count: int, first: int = 0):
        spread = np.argsort(-x.astype(float).std(axis=0), kind="stable") if len(x) else np.arange(x.shape[1])
        self.order, self.count, self.first = spread, 0, first
        kinds = len(np.unique(labels)) if len(labels) else 1
        self.root = self._cut(labels, x, np.arange(len(x)), max(1, count), -1, min(kinds, count))

    def _cut(self, labels: np.ndarray, x: np.ndarray, rows: np.ndarray, count: int, level: int, slabs: int):
        if count <= 1 or level >= len(self.order) or len(rows) < 2:
            self.count += 1
            return self.first + self.count - 1
        key = labels[rows] if level < 0 else x[rows, self.order[level]]
        slabs = slabs if level < 0 else max(2, int(np.ceil(count ** (1 / (len(self.order) - level)) - 1e-9)))
        ranked = np.sort(key, kind="stable")
        cuts = np.unique(ranked[[i * len(ranked) // slabs for i in range(1, slabs)]])  # a slab holds keys below its cut
        slab = np.searchsorted(cuts, key, side="right")
        share = max(1, -(-count // (len(cuts) + 1)))
        return level, cuts, [self._cut(labels, x, rows[slab == i], share, level + 1, 0) for i in range(len(cuts) + 1)]

    def of(self, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)

        def walk(node, rows: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] = node
                return
            level, cuts, below = node
            slab = np.searchsorted(cuts, labels[rows] if level < 0 else x[rows, self.order[level]], side="right")
            for i, child in enumerate(below):
                if len(mine := rows[slab == i]):
                    walk(child, mine)

        walk(self.root, np.arange(len(x)))
        return out


class RTree:
    """Levels of boxes over the rows of a block; the leaves, at level 0, are of one label each."""

    def __init__(self, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        by_label = np.argsort(labels, kind="stable")
        groups = [mine[g] for mine in np.split(by_label, np.flatnonzero(np.diff(labels[by_label])) + 1) for g in str_groups(x[mine], leaf)]
        self.rows, starts = np.concatenate(groups), np.cumsum([0, *map(len, groups)])
        ordered, own = x[self.rows], labels[self.rows]
        box = lambda a, b, ends: (np.minimum.reduceat(a, ends[:-1]), np.maximum.reduceat(b, ends[:-1]))
        self.ordered, self.most = ordered, float(np.abs(ordered).max()) * x.shape[1]
        self.floats = ordered.astype(np.float64)
        self.levels = [(starts, *box(ordered, ordered, starts), *box(own, own, starts))]
        while len(self.levels[-1][0]) > 2:
            n = len(self.levels[-1][0]) - 1
            ends = np.append(np.arange(0, n, fan), n)
            _, lo, hi, first, last = self.levels[-1]
            self.levels.append((ends, *box(lo, hi, ends), *box(first, last, ends)))
        self.ends = [level[0].tolist() for level in self.levels]

    def products(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Of q with the rows from a to b in tree order; through doubles where no sum can pass 2**53."""
        return self.floats[a:b] @ q.astype(np.float64) if self.most * float(np.abs(q).max()) < 2.0**53 else self.ordered[a:b] @ q

    def intervals(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest possible products of each row of q with each box, by level."""
        return [intervals(q, lo, hi) for _, lo, hi, _, _ in self.levels]


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return inner_products(up, lo) + inner_products(down, hi), inner_products(up, hi) + inner_products(down, lo)


class Windows:
    """The k best (score, id) in each of an anchor's score windows [low, high], ties to the smaller id."""

    def __init__(self, k: int, low: list[float], high: list[float]):
        self.k, self.low, self.high = k, np.array(low, float), np.array(high, float)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
        self.least = self.low.copy()  # what a score must reach: the k-th once there are k, before that the window's low end
        self.ends = list(zip(self.least.tolist(), self.high.tolist(), strict=True))

    def open(self, most: float) -> bool:
        """Whether a box of that upper bound can still hold one of the best: not if it is strictly below."""
        return any(min(most, high) >= least for least, high in self.ends)

    def add(self, score: np.ndarray, rows: np.ndarray, ids: list[np.ndarray]) -> None:
        good = (score >= self.least[:, None]) & (score <= self.high[:, None])
        for w in np.flatnonzero(good.any(axis=1)).tolist():
            mine = np.flatnonzero(good[w])
            own = [ids[r] for r in rows[mine].tolist()]
            s = np.concatenate([self.found[w][0], np.repeat(score[mine], [len(i) for i in own]).astype(np.int64)])
            i = np.concatenate([self.found[w][1], *own])
            top = np.lexsort((i, -s))[: self.k]
            self.found[w] = s[top], i[top]
            if len(top) == self.k:
                self.least[w] = s[top[-1]]
        self.ends = list(zip(self.least.tolist(), self.high.tolist(), strict=True))


def search(tree: RTree, ids: list[np.ndarray], q: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], label: int, same: bool, windows: Windows) -> int:
    """Best-first search of one anchor q; fills its windows. bounds: of its products with the boxes, by level. Returns
    how many leaves it read."""
    able, most = [], []
    for (_, _, _, first, last), (low, high) in zip(tree.levels, bounds, strict=True):
        inside = (high >= windows.low[:, None]) & (low <= windows.high[:, None])
        kind = (first <= label) & (label <= last) if same else ~((first == label) & (last == label))
        able.append((inside.any(axis=0) & kind).tolist())
        most.append(high.tolist())
    top, read = len(tree.levels) - 1, 0
    queue = [(-most[top][b], top, b) for b, ok in enumerate(able[top]) if ok]
    heapq.heapify(queue)
    while queue:
        high, level, box = heapq.heappop(queue)
        if not windows.open(-high):
            if -high < min(least for least, _ in windows.ends):
                break  # and so are all boxes that are left
            continue
        a, b = tree.ends[level][box], tree.ends[level][box + 1]
        if level:
            for child in range(a, b):
                if able[level - 1][child] and windows.open(most[level - 1][child]):
                    heapq.heappush(queue, (-most[level - 1][child], level - 1, child))
            continue
        read += 1
        windows.add(tree.products(q, a, b), tree.rows[a:b], ids)
    return read


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    col = col.combine_chunks()
    ends, flat = col.offsets.to_numpy(), col.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_FOUND = pa.schema([("key", pa.string()), ("bound", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(k: int, same: bool, low: float, high: float):
    """bound: null, or the positive score of a window of negatives: [low*bound, high*bound] in percent."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        x, q = matrix(data["v"]), matrix(asked["v"])
        ids, labels = _lists(data["ids"]), data["label"].to_numpy()
        tree = RTree(labels, x)
        bounds = tree.intervals(q)
        keys, own, scores, out = asked["key"].to_pylist(), asked["label"].to_numpy(), _lists(asked["bounds"]), [[], [], [], []]
        for i, key in enumerate(keys):
            ranges = [(-np.inf, np.inf)] if same else [(-(-low * int(p) // 100), high * int(p) // 100) for p in scores[i]]
            windows = Windows(k, [a for a, _ in ranges], [b for _, b in ranges])
            search(tree, ids, q[i], [(a[i], b[i]) for a, b in bounds], own[i], same, windows)
            for n, (score, found) in enumerate(windows.found):
                for column, values in zip(out, ([key] * len(found), [None if same else int(scores[i][n])] * len(found), found.tolist(), score.tolist()), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def _tiled(cuts: dict[int, Tiles]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in by_length(batch):
                tile = cuts[x.shape[1]].of(part["label"].to_numpy(), x)
                yield pa.record_batch([*(part[c] for c in ("key", "label", "v", "ids")), pa.array(tile)], names=["key", "label", "v", "ids", "tile"])

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boxes of the tiles in a task's rows."""
    found: dict[int, list] = {}
    for batch in batches:
        for part, x in by_length(batch):
            tile, label = part["tile"].to_numpy(), part["label"].to_numpy()
            for t in np.unique(tile):
                mine = tile == t
                now = [x[mine].min(0), x[mine].max(0), int(label[mine].min()), int(label[mine].max()), int(mine.sum())]
                if t in found:
                    old = found[t]
                    now = [np.minimum(now[0], old[0]), np.maximum(now[1], old[1]), min(now[2], old[2]), max(now[3], old[3]), now[4] + old[4]]
                found[t] = now
    rows = list(found.items())
    lists = [pa.array([r[i].tolist() for _, r in rows], pa.list_(pa.int64())) for i in (0, 1)]
    yield pa.record_batch([pa.array([int(t) for t, _ in rows], pa.int64()), *lists, *[pa.array([r[i] for _, r in rows], pa.int64()) for i in (2, 3, 4)]], names=["tile", "lo", "hi", "first", "last", "n"])


class Directory:
    """The boxes of the tiles, MOST_TILES rows and one for each vector length: the upper level of the R-tree."""

    def __init__(self, rows: list):
        self.of = {}
        for n in {len(r["lo"]) for r in rows}:
            mine = sorted((r for r in rows if len(r["lo"]) == n), key=lambda r: r["tile"])
            self.of[n] = [np.array([r[c] for r in mine]) for c in ("tile", "lo", "hi", "first", "last", "n")]

    def needed(self, q: np.ndarray, label: np.ndarray, scores: list[np.ndarray] | None, keep: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of q and the tiles that may hold one of their best rows."""
        tile, lo, hi, first, last, n = self.of[q.shape[1]]
        least, most = intervals(q, lo, hi)
        inside = (first <= label[:, None]) & (label[:, None] <= last)
        alone = first == last
        if scores is None:  # at least `keep` rows of the label score no less than the level
            level = np.full(len(q), -np.inf)
            for i in range(len(q)):
                pure = np.flatnonzero(inside[i] & alone)
                order = pure[np.argsort(-least[i, pure], kind="stable")]
                enough = np.flatnonzero(np.cumsum(n[order]) >= keep)
                if len(enough):
                    level[i] = least[i, order[enough[0]]]
            row, at = np.nonzero(inside & (most >= level[:, None]))
        else:
            hit = np.zeros(least.shape, bool)
            for i, s in enumerate(scores):
                for p in s:
                    hit[i] |= (100 * most[i] >= low * int(p)) & (100 * least[i] <= high * int(p)) & (low * int(p) <= high * int(p))
            row, at = np.nonzero(hit & ~(inside & alone))
        return row, tile[at]


def _routed(directory: Directory, with_scores: bool, keep: int, low: float, high: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for part, q in by_length(batch.slice(at, 512)):
                    scores = _lists(pa.chunked_array([part["bounds"]])) if with_scores else None
                    row, tile = directory.needed(q, part["label"].to_numpy(), scores, keep, low, high)
                    yield pa.record_batch([*(part[c].take(pa.array(row)) for c in ("key", "label", "v", "bounds")), pa.array(tile)], names=["key", "label", "v", "bounds", "tile"])

    return run


class Forest:
    """The stored, tiled rows of all labels and the boxes of the tiles."""

    def __init__(self, rows: DataFrame, keep: int, block: int = BLOCK):
        """rows: (id, label, v, key), key standing for label and vector."""
        self.block = block
        first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        ids = rows.select("key", "id").distinct().withColumn("at", first).where(F.col("at") <= keep).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        merged = ids.join(rows.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v")), "key").select("key", "label", "v", "ids")
        size = F.size("v")
        lengths = {r["size"]: r["n"] for r in rows.groupBy(size.alias("size")).agg(F.approx_count_distinct("key").alias("n")).collect()}  # a row for each vector length
        total = max(1, sum(lengths.values()))
        cuts, at = {}, 0
        for n in sorted(lengths):
            share = max(1, round(SAMPLE * lengths[n] / total))
            picked = rows.where(size == n).select("key", "label", "v").distinct().orderBy(F.substring("key", 9, 16), "key").limit(share).toArrow()  # SAMPLE rows at most, and one for each length
            tiles = min(-(-MOST_TILES * lengths[n] // total), -(-lengths[n] // block))
            cuts[n] = Tiles(picked["label"].to_numpy(), matrix(picked["v"]), max(1, tiles), at)
            at += cuts[n].count
        self.tiles = at
        schema = "key string, label long, v array<long>, ids array<long>"
        self.rows = stored(merged.mapInArrow(tidied(_tiled(cuts)), f"{schema}, tile long"), "tiles")
        boxes = stored(self.rows.mapInArrow(tidied(_boxes), "tile long, lo array<long>, hi array<long>, first long, last long, n long"), "boxes")
        sides = boxes.select("tile", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "side")).groupBy("tile", "i").agg(F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi"))
        kinds = boxes.groupBy("tile").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        box: dict[int, list] = {}
        for r in sides.orderBy("tile", "i").collect():  # a row for each tile and component
            box.setdefault(r["tile"], []).append((r["lo"], r["hi"]))
        self.boxes = [r.asDict() | {"lo": [x for x, _ in box[r["tile"]]], "hi": [x for _, x in box[r["tile"]]]} for r in kinds.collect()]
        self.directory = Directory(self.boxes) if self.boxes else None

    def find(self, asked: DataFrame, k: int, same: bool, low: float = 0, high: float = 0) -> DataFrame:
        """(key, bound, vec_id, score): for each row of asked (key, label, v, bounds) its k best rows of the same label, or of other labels in each window."""
        sent = stored(asked.mapInArrow(tidied(_routed(self.directory, not same, k, low, high)), "key string, label long, v array<long>, bounds array<long>, tile long"), "routed")
        load = {r["tile"]: r["n"] for r in sent.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # a row for each tile
        held = {r["tile"]: r["n"] for r in self.boxes}
        blocks = lambda count, size: F.element_at(F.lit([max(1, -(-int(count.get(t, 0)) // size)) for t in range(self.tiles)]), F.col("tile").cast("int") + 1)
        data_blocks, query_blocks = blocks(held, self.block), blocks(load, QUERY_BLOCK)
        number = F.abs(F.xxhash64("key"))
        spread = lambda c: F.explode(F.sequence(F.lit(0), c.cast("int") - 1))
        left = self.rows.withColumn("d", (number % data_blocks).cast("int")).withColumn("q", spread(query_blocks))
        right = sent.withColumn("q", (number % query_blocks).cast("int")).withColumn("d", spread(data_blocks))
        where = ["tile", "d", "q"]
        found = left.select(*where, "v", "ids", "label").groupBy(*where).cogroup(right.select(*where, "key", "v", "label", "bounds").groupBy(*where))
        rows = found.applyInArrow(_searched(k, same, low, high), "key string, bound long, vec_id long, score long")
        at = F.row_number().over(Window.partitionBy("key", "bound").orderBy(F.desc("score"), F.asc("vec_id")))
        return rows.withColumn("at", at).where(F.col("at") <= k).drop("at")


def mine_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose id is divisible
    by `every`: of each anchor's first `positives` rows of its label, the first `negatives` rows of other labels
    whose scores are within [low, high] percent of the positive's."""
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vec_col))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vec_col)).alias("v"))
    rows = stored(rows.withColumn("key", F.sha2(F.to_json(F.struct("label", "v")), 256)), "labelled")
    forest = Forest(rows, max(positives + 1, negatives), block)
    if forest.directory is None:
        return rows.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    anchors = rows.where(F.col("id") % every == 0).select("key", F.col("id").alias("anchor_id")).distinct()
    asked = stored(anchors.select("key").distinct().join(forest.rows.select("key", "label", "v"), "key"), "anchors")

    near = forest.find(asked.withColumn("bounds", F.array().cast("array<long>")), positives + 1, True).drop("bound")
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    pairs = anchors.join(near.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), "key").where("positive_id <> anchor_id")
    pairs = stored(pairs.withColumn("at", order).where(F.col("at") <= positives).drop("at"), "positives")

    windows = pairs.groupBy("key").agg(F.array_sort(F.collect_set("positive_score")).alias("bounds"))
    hard = forest.find(asked.join(windows, "key"), negatives, False, low, high)
    place = F.row_number().over(Window.partitionBy("key", "bound").orderBy(F.desc("score"), "vec_id"))
    ranked = hard.withColumn("rank", place).select("key", F.col("bound").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(ranked, ["key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
