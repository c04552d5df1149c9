"""Language of a text by multinomial naive Bayes over hashed character n-grams.

A text is folded: letters are lowered, combining marks stay, and each run of anything else is one blank;
a blank stands at either end. Its runs of 1 to GRAMS characters are hashed into buckets. The counts of
the buckets by language are summed in Spark; the driver gets one number for each language and bucket
seen, MATRIX_BYTES at most, and broadcasts their smoothed log shares. A batch is scored in numpy:
each n-gram looks its bucket up in a language's row, and the numbers of a document are added. Only the
n-grams that occur are touched.

The model learns from all languages alike: at most about SAMPLE documents of each are drawn by a hash
of the id, at a rate told by their number, whole texts; how common the languages are is counted over all
rows to learn from.

Cases: a text that is null or has no letter is `und` with score 0, and so is every text if there is
nothing to learn from; rows with a null id are predicted, but not learned from; equal texts get equal
results; ties go to the language that sorts first; long texts are folded and scored whole, in pieces;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import slices, tidied

GRAMS, BITS = 4, 16
#: Documents of a language to learn from, about; added to each count; bytes of the broadcast matrix; characters worked on at a time.
SAMPLE, SMOOTHING, MATRIX_BYTES, PIECE = 5000, 0.1, 1 << 26, 1 << 18
UNKNOWN = "und"
_BLANK, _MULTIPLY, _SPREAD = 32, np.uint32(0x01000193), np.uint32(0x9E3779B1)
_tables: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it is folded to, and whether it is a letter. Made once in a worker."""
    global _tables
    if _tables is None:
        fold, letter = np.full(0x110000, _BLANK, np.uint32), np.zeros(0x110000, bool)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            if kind in "LM":
                low = chr(i).lower()
                fold[i], letter[i] = ord(low) if len(low) == 1 else i, kind == "L"
        _tables = fold, letter
    return _tables


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded texts one after the other, the text that each character is of, and which texts have a letter."""
    fold, letter = tables()
    out, owners, has = [], [], np.zeros(len(texts), bool)
    group, first, size = [], 0, 0

    def flush(end: int) -> None:
        n = np.array([len(t) + 2 for t in group])
        raw = np.frombuffer((" " + "  ".join(group) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        owner, start = np.repeat(np.arange(first, end, dtype=np.int32), n), np.cumsum(n) - n
        has[owner[letter[raw]]] = True
        x = fold[raw]
        keep = np.concatenate([[True], (x[1:] != _BLANK) | (x[:-1] != _BLANK)])
        keep[start] = True
        out.append(x[keep])
        owners.append(owner[keep])

    for i, text in enumerate(texts):
        if len(text) > PIECE:  # a long text by itself, piece by piece
            if group:
                flush(i)
            group, size, first = [], 0, i + 1
            before = _BLANK
            parts = [np.array([_BLANK], np.uint32)]
            for at in range(0, len(text), PIECE):
                raw = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
                has[i] |= bool(letter[raw].any())
                x = fold[raw]
                keep = (x != _BLANK) | (np.concatenate([[before], x[:-1]]) != _BLANK)
                before = x[-1]
                parts.append(x[keep])
            parts.append(np.array([_BLANK] if before != _BLANK else [], np.uint32))
            out.append(np.concatenate(parts))
            owners.append(np.full(len(out[-1]), i, np.int32))
            continue
        group.append(text)
        size += len(text)
        if size > PIECE:
            flush(i + 1)
            group, size, first = [], 0, i + 1
    if group:
        flush(len(texts))
    none = np.zeros(0, np.int32)
    return np.concatenate([none.astype(np.uint32), *out]), np.concatenate([none, *owners]), has


def gram_buckets(chars: np.ndarray, owner: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams within each text, and the texts that they are of, in ascending order; a piece and a length at a time."""
    for at in range(0, len(chars), PIECE):
        piece, mine = chars[at : at + PIECE + GRAMS - 1], owner[at : at + PIECE + GRAMS - 1]
        h = np.zeros(len(piece) + 1, np.uint32)
        for n in range(1, GRAMS + 1):
            if len(piece) < n:
                break
            h = (h[:-1] ^ piece[n - 1 :]) * _MULTIPLY + np.uint32(n)
            own, last = mine[: len(h)][:PIECE], mine[n - 1 :][:PIECE]
            inside = own == last
            yield ((h[:PIECE] * _SPREAD) >> np.uint32(32 - bits))[inside], own[inside]


class LanguageModel:
    """shares: log share of each bucket, a row for each language; prior: log share of the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages, self.bits = languages, int(counts.shape[1]).bit_length() - 1
        total = counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]
        self.shares = np.log((counts + SMOOTHING) / total).astype(np.float32)
        self.prior = np.log(np.maximum(documents, 1) / max(1, documents.sum()))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text, and its probability."""
        chars, owner, has = folded([t or "" for t in texts])
        score = np.tile(self.prior, (len(texts), 1))
        for bucket, own in gram_buckets(chars, owner, self.bits) if self.languages else ():
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                for i, row in enumerate(self.shares):
                    score[own[first], i] += np.add.reduceat(row[bucket], first, dtype=np.float64)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = score.argmax(axis=1)
        sure = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, np.round(sure, 9), 0.0)


def held_out(doc_id: Column) -> Column:
    """True for the documents kept from training: crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                by: dict[str, list[str]] = {}
                for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    mine = total.setdefault(lang, np.zeros(1 << bits, np.int64))
                    chars, owner, _ = folded(texts)
                    for bucket, _ in gram_buckets(chars, owner, bits):
                        mine += np.bincount(bucket, minlength=1 << bits)
        for lang, mine in total.items():
            at = np.flatnonzero(mine)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])

    return run


def fit_language(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> LanguageModel:
    """Learns from text and lang of the rows of docs (doc_id, text, lang) that aren't held out."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    found = {r["lang"]: r["n"] for r in sizes.collect()}  # a row for each language
    languages = sorted(found)
    while bits > 1 and (len(languages) << bits) * 4 > MATRIX_BYTES:  # more than 256 languages share fewer buckets
        bits -= 1
    if not languages:
        return LanguageModel([], np.zeros((0, 1 << bits)), np.zeros(0))
    # The rate of a language is the share of the ids' hashes that is drawn; languages of SAMPLE documents or fewer are taken whole.
    rate = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, sample / n))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)).select("lang", "text")
    counted = drawn.mapInArrow(tidied(_counted(bits)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    row = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << bits))
    counts[[row[x] for x in counted["lang"].to_pylist()], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return LanguageModel(languages, counts, np.array([found[x] for x in languages], float))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MATRIX_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score = sent.value.predict(part["text"].to_pylist())
                yield pa.record_batch([part["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")
