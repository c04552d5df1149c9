"""Toxicity by a classifier chain: one linear model a category, in order, each fed with the
probabilities of the categories before it.

The later models are trained on out-of-fold predictions of the earlier ones: the labelled sample is
split into folds, each fold is predicted by models fitted on the others, and only those predictions
enter the next model's training. When scoring, the earlier models fitted on the whole sample are used.

Features are hashed words and the hashed first bytes of words (PREFIXES), A-Z lowered. From the
sample each category keeps the KEEP features that are most strongly associated with it, by likelihood
ratio (LEAST at least), among those in at least MIN_DOCS documents; their presence enters a ridge logistic model.

The label table tells of one kind of toxicity beside quality, so the chain's default categories are junk
(not of quality) and then toxic; more label columns are more categories, in the order they are given.

The features of at most SAMPLE labelled documents, of their whole texts, go to the driver for training.
Scoring reads every whole document, a bounded part of a batch at a time.

Cases: a null or empty text has no features and gets the models' intercepts; equal texts get equal
scores; a category without both labels in the sample is predicted by its share; a null label counts
as unlabelled; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import LOWER, ByteHasher, kept_rows, slices, tidied, training_ids, training_rows, word_spans

SAMPLE, FOLDS = 6000, 5
BITS, PREFIXES, KEEP, MIN_DOCS = 22, (4, 5), 3000, 3
#: Least likelihood ratio of a kept feature; chance passes it once in 2000 features.
LEAST = 12.0
_TRIM = np.zeros(256, bool)
_TRIM[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_HASH = ByteHasher(11)
_PIECE = 1 << 18


def features(raw: bytes) -> np.ndarray:
    """Distinct feature numbers of a document, from pieces cut at white space."""
    found, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _PIECE else max(raw.rfind(b" ", at, at + _PIECE), raw.rfind(b"\n", at, at + _PIECE)) + 1 or at + _PIECE
        end = max(end, min(at + _PIECE, len(raw))) if end <= at else end
        found.append(_piece(np.frombuffer(raw[at:end], np.uint8)))
        at = end
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _piece(data: np.ndarray) -> np.ndarray:
    data = LOWER[data]
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.int32)
    trim = _TRIM[data]
    for _ in range(3):  # up to three marks at either end
        start = start + (trim[start] & (end - start > 1))
        end = end - (trim[end - 1] & (end - start > 1))
    sums = _HASH.prefix(data)
    heads = [_HASH.spans(sums, start, np.minimum(end, start + n)) ^ np.uint64(0x5555555555555555 + n) for n in PREFIXES]
    return np.unique(np.concatenate([_HASH.spans(sums, start, end), *heads]) >> np.uint64(64 - BITS)).astype(np.int32)


class Linear:
    """Logistic model over the presence of the kept features, an intercept and the earlier probabilities."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray | None, rest: np.ndarray | None, share: float):
        self.kept, self.weights, self.rest, self.share = kept, weights, rest, share

    def present(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and feature positions of the kept features, document by document."""
        if not docs or not len(self.kept):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, flat = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
        at = np.minimum(np.searchsorted(self.kept, flat), len(self.kept) - 1)
        found = self.kept[at] == flat
        return row[found], at[found]

    def predict(self, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(docs), self.share)
        row, at = self.present(docs)
        z = np.bincount(row, self.weights[at], minlength=len(docs)) + self.rest[0] + earlier @ self.rest[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, docs: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> Linear:
        n1, n = int(y.sum()), len(y)
        share = n1 / n if n else 0.0
        if n1 == 0 or n1 == n:
            return cls(np.zeros(0, np.int64), None, None, share)
        row, flat = np.repeat(np.arange(n), [len(d) for d in docs]), np.concatenate(docs)
        total = np.bincount(flat, minlength=1 << BITS)
        seen = np.flatnonzero(total >= MIN_DOCS)
        a, t = np.bincount(flat[y[row] > 0], minlength=1 << BITS)[seen], total[seen]
        strength = _association(a, t - a, n1, n - n1)
        best = np.argsort(-strength, kind="stable")[:KEEP]
        best = best[strength[best] >= LEAST]
        out = cls(np.sort(seen[best]), np.zeros(len(best)), np.zeros(1 + earlier.shape[1]), share)
        out.rest[0] = np.log(share / (1 - share))
        row, at = out.present(docs)
        w = np.concatenate([out.weights, out.rest])
        k, m, v = len(best), np.zeros(len(w)), np.zeros(len(w))
        for step in range(1, steps + 1):  # Adam on all rows
            z = np.bincount(row, w[at], minlength=n) + w[k] + earlier @ w[k + 1 :]
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            grad = np.concatenate([np.bincount(at, off[row], minlength=k) + ridge * w[:k], [off.sum()], earlier.T @ off])
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
        out.weights, out.rest = w[:k], w[k:]
        return out


def _association(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio (G squared) of a feature's presence in a of n1 and b of n0 documents."""
    part = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / expected), 0)
    share, t = n1 / (n1 + n0), a + b
    return 2 * (part(a, t * share) + part(b, t * (1 - share)) + part(n1 - a, (n1 + n0 - t) * share + 1e-9) + part(n0 - b, (n1 + n0 - t) * (1 - share) + 1e-9))


class Chain:
    """levels: the probability from which each category counts as predicted."""

    def __init__(self, categories: list[str], models: list[Linear], levels: list[float]):
        self.categories, self.models, self.levels = categories, models, levels

    def predict(self, docs: list[np.ndarray]) -> np.ndarray:
        """Probabilities, a column for each category in chain order."""
        got = np.zeros((len(docs), 0))
        for model in self.models:
            got = np.column_stack([got, model.predict(docs, got)])
        return got


def fit_chain(docs: list[np.ndarray], labels: pd.DataFrame, categories: list[str], folds: int = FOLDS) -> Chain:
    """labels: a 0/1 column for each category. Documents are dealt to the folds in turn."""
    fold, earlier, models, levels = np.arange(len(docs)) % folds, np.zeros((len(docs), 0)), [], []
    for category in categories:
        y = labels[category].to_numpy(float)
        models.append(Linear.fit(docs, earlier, y))
        unseen = np.zeros(len(docs))
        for f in range(folds):
            mine, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(mine) and len(rest):
                unseen[mine] = Linear.fit([docs[i] for i in rest], earlier[rest], y[rest]).predict([docs[i] for i in mine], earlier[mine])
        earlier = np.column_stack([earlier, unseen])
        levels.append(_level(unseen, y))
    return Chain(categories, models, levels)


def _level(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the levels at which the out-of-fold predictions have their best F1."""
    grid = np.arange(0.1, 0.91, 0.02)
    hits = np.array([((p >= g) & (y > 0)).sum() for g in grid])
    f1 = 2 * hits / np.maximum(1, np.array([(p >= g).sum() for g in grid]) + y.sum())
    return float(np.median(grid[f1 >= f1.max() - 1e-9])) if y.any() else 0.5


#: The chain's categories, in order, as expressions over the labels.
CATEGORIES = {"junk": "1 - quality", "toxic": "toxic"}


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [features((t or "").encode()) for t in part["text"].to_pylist()]
            yield pa.record_batch([*(part[c] for c in part.schema.names if c != "text"), pa.array(found, pa.list_(pa.int32()))], names=[*(c for c in part.schema.names if c != "text"), "features"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = SAMPLE) -> Chain:
    """Fits on at most `sample` labelled documents, half of them with the last category where possible."""
    categories = CATEGORIES if categories is None else categories
    rows = training_rows(docs, training_ids(docs, labels, categories, sample), sample)
    got = rows.mapInArrow(tidied(_featured), ", ".join(["doc_id long", *(f"{c} int" for c in categories), "features array<int>"])).toArrow()
    ends, flat = got["features"].combine_chunks().offsets.to_numpy(), got["features"].combine_chunks().values.to_numpy()
    found = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fit_chain(found, got.select(list(categories)).to_pandas(), list(categories))


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...) of each document."""
    names, flags = [f"p_{c}" for c in chain.categories], [f"is_{c}" for c in chain.categories]
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = sent.value.predict([features((t or "").encode()) for t in part["text"].to_pylist()])
                yes = [pa.array((got[:, i] >= level).astype(np.int32)) for i, level in enumerate(sent.value.levels)]
                yield pa.record_batch([part["doc_id"], *(pa.array(got[:, i]) for i in range(len(names))), *yes], names=["doc_id", *names, *flags])

    schema = ", ".join(["doc_id long", *(f"{n} double" for n in names), *(f"{n} int" for n in flags)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), schema)


def drop_flagged(docs: DataFrame, chain: Chain, category: str = "toxic") -> DataFrame:
    """The rows of docs whose text doesn't count as of the category; columns as they are."""
    sent, at = docs.sparkSession.sparkContext.broadcast(chain), chain.categories.index(category)
    return kept_rows(docs, lambda texts: sent.value.predict([features((t or "").encode()) for t in texts])[:, at] < sent.value.levels[at])
