"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes pass learned filters of WIDTH bytes. Beside the byte channel there is a second input
channel made by hand: how recently the same four bytes occurred before (a repeat code), so that the
filters can learn repetition. Responses are max-pooled over overlapping chunks that cover the whole
document; the chunks' pooled vectors are combined by their maximum and their mean, and a logistic
layer gives one probability.

Training takes a bounded sample of labelled documents (at most SAMPLE rows, whole texts, equal numbers
of either label where there are enough) to the driver; the fitted weights, a few hundred KB, go to
the tasks. Training and scoring work through every whole document in blocks of bounded size.

Cases: a null or empty text is scored as one empty chunk; equal texts get equal scores; long texts
are worked through block by block; with no labelled rows the model is the prior 0.5; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import kept_rows, slices, tidied, training_ids, training_rows

WIDTH, FILTERS = 7, 24
CHUNK, STRIDE = 512, 256
CODES = 256 + 6
SAMPLE, EPOCHS = 3000, 4
#: Bytes worked on at a time; a multiple of STRIDE.
SPAN = 1 << 16
#: Furthest distance, in bytes, at which a repeat counts.
NEAR = 512


def repeat_codes(data: np.ndarray) -> np.ndarray:
    """0 where the four bytes from here don't occur within NEAR before, else 1 to 5 by distance."""
    out = np.zeros(len(data), np.uint8)
    if len(data) < 8:
        return out
    wide = data.astype(np.uint64)
    gram = (wide[:-3] << np.uint64(24) | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(8) | wide[3:]) << np.uint64(32)
    order = np.sort(gram | np.arange(len(gram), dtype=np.uint64))
    at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = (order[1:] >> np.uint64(32)) == (order[:-1] >> np.uint64(32))
    gap = np.where(same, at[1:] - at[:-1], NEAR + 1)
    out[at[1:]] = np.searchsorted([-512, -128, -32, -12, -5], -gap, side="right")
    return out


class ByteCnn:
    """weights: (WIDTH, CODES, FILTERS) by offset and code; head: logistic layer over 2*FILTERS pooled values."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.conv = (rng.standard_normal((WIDTH, CODES, FILTERS)) * 0.1).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.head = np.zeros(2 * FILTERS, np.float32)
        self.head[:FILTERS] = rng.standard_normal(FILTERS) * 0.1
        self.head[FILTERS:] = rng.standard_normal(FILTERS) * 0.1
        self.shift = np.float32(0)

    def respond(self, data: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Filter responses at each position of data, which WIDTH-1 zero bytes follow."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(WIDTH - 1, data.dtype)])
        out = np.repeat(self.bias[None], n, axis=0)
        for k in range(WIDTH):
            out += self.conv[k].take(padded[k : k + n], axis=0)
        out += self.conv[0, 256:].take(codes, axis=0)
        return out

    def tops(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each chunk's largest response to each filter, its position and the repeat code there.

        Chunks of CHUNK positions start every STRIDE, so each is two neighbouring parts of STRIDE positions.
        """
        found = []
        for at in range(0, len(data), SPAN):
            lead = min(at, NEAR)
            block = data[at - lead : at + SPAN + WIDTH - 1]
            codes = repeat_codes(block)
            got, codes = self.respond(block, codes)[lead : lead + SPAN], codes[lead : lead + SPAN]
            n = -(-len(got) // STRIDE)
            got = np.concatenate([got, np.full((n * STRIDE - len(got), FILTERS), -np.inf, np.float32)])
            parts = got.reshape(n, STRIDE, FILTERS)
            most = parts.argmax(axis=1)
            place = most + STRIDE * np.arange(n)[:, None]
            found.append((np.take_along_axis(parts, most[:, None], axis=1)[:, 0], place + at, codes[place]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)]
        if len(parts[0]) == 1:
            return tuple(parts)
        later = parts[0][1:] > parts[0][:-1]
        return tuple(np.where(later, x[1:], x[:-1]) for x in parts)

    def pooled(self, raw: bytes) -> np.ndarray:
        """The chunks' maxima, at least 0."""
        return np.maximum(self.tops(np.frombuffer(raw or b"\0", np.uint8))[0], 0)

    def score(self, raw: bytes) -> float:
        chunks = self.pooled(raw)
        z = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)]) @ self.head + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 2) -> ByteCnn:
        """Adam on the log loss, a batch of 16 documents a step; gradients reach each chunk's maxima only."""
        if len(texts) == 0 or len(set(labels.tolist())) < 2:
            self.head[:] = 0
            return self
        rng = np.random.default_rng(seed)
        prepared = [np.frombuffer(t or b"\0", np.uint8) for t in texts]
        params = [self.conv, self.bias, self.head]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, total = 0, epochs * -(-len(texts) // 16)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(texts)), -(-len(texts) // 16)):
                grads = [np.zeros_like(p) for p in params]
                shift = 0.0
                for i in batch.tolist():
                    shift += self._backward(prepared[i], float(labels[i]), grads) / len(batch)
                step += 1
                lr = rate * (1 - step / (total + 1))
                self.shift -= np.float32(lr * shift)
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    g = g / len(batch) + 1e-5 * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self

    def _backward(self, data: np.ndarray, label: float, grads: list[np.ndarray]) -> float:
        top, where, codes = self.tops(data)
        chunks = np.maximum(top, 0)
        best = chunks.argmax(axis=0)
        features = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])
        p = 1 / (1 + np.exp(-np.clip(features @ self.head + self.shift, -30, 30)))
        delta = np.float32(p - label)
        grads[2] += delta * features
        back = np.repeat((delta * self.head[FILTERS:] / len(chunks))[None], len(chunks), axis=0)
        back[best, np.arange(FILTERS)] += delta * self.head[:FILTERS]
        back[top <= 0] = 0
        rows, filters = np.nonzero(back)
        value, at = back[rows, filters], where[rows, filters]
        padded = np.concatenate([data, np.zeros(WIDTH - 1, data.dtype)])
        for k in range(WIDTH):
            np.add.at(grads[0][k], (padded[at + k], filters), value)
        np.add.at(grads[0][0], (256 + codes[rows, filters].astype(np.int64), filters), value)
        np.add.at(grads[1], filters, value)
        return float(delta)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> ByteCnn:
    rows = training_rows(docs, training_ids(docs, labels, {"label": label}, sample), sample).orderBy("doc_id", "text").toPandas()
    return ByteCnn().fit([t.encode() for t in rows["text"]], rows["label"].to_numpy())


def keep_good(docs: DataFrame, model: ByteCnn, least: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores `least` or more; columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: np.array([sent.value.score((t or "").encode()) >= least for t in texts], bool))


def score_documents(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, score) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            scores = [net.score((t or "").encode()) for part in slices(batch, "text") for t in part["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, score double")
