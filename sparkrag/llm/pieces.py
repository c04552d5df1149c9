"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces of a model. It reads a text once; at each position it follows the
output links through all pieces that end there, longest first, and each relaxes the best score of
its end. So the segmentation with the largest sum of scores is found; ties go to the longer last
piece. A character in no piece scores UNKNOWN below the smallest score and is written as its bytes.

No piece spans two characters that follow each other in no piece, so a text falls into independent
units there. Equal units between word starts are solved once for all texts of a batch's part, and
units go through the automaton side by side, one character of each at a time. Decoding joins the
pieces and bytes and turns the word mark back into a blank.

Cases: a null or empty text has no pieces; a text that holds the word mark itself, or starts with
blanks, decodes to blanks in its place (so it is not restored) and to the same blanks; equal texts have equal ids; long texts
are worked through unit by unit, and what has too few others of its length beside it goes through the automaton alone; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import CACHES, slices, tidied

MARK = "▁"
UNKNOWN = 10.0
#: Units of more characters are cut where no piece holds two of them together.
LONG = 64
#: Units that go through the automaton side by side: at most so many, with so many characters, and at least so many on average.
GROUP, CELLS, ABREAST = 1 << 14, 1 << 20, 48
NORMAL, UNK, BYTE = 1, 2, 6


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id, from a model file's protocol buffer."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: BYTE if model.is_byte(i) else UNK if model.is_unknown(i) else 3 if model.is_control(i) else 5 if model.is_unused(i) else NORMAL
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Automaton:
    """Trie of the pieces with failure links; output links skip to the next state that ends a piece."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, float, int] | None] = [None]
        for i, (text, score, kind) in enumerate(pieces):
            if kind != NORMAL or not text:
                continue
            state = 0
            for c in text:
                to = self.next[state].get(c)
                if to is None:
                    to = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(None)
                state = to
            self.piece[state] = (len(text), score, i)
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for c, to in self.next[state].items():
                f = self.fail[state]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(c, 0)
                queue.append(to)
            f = self.fail[state]
            self.output[state] = f if self.piece[f] else self.output[f]
        #: What ends at each state, longest first, by the output links.
        self.ends: list[tuple[tuple[int, float, int], ...]] = []
        for state in range(len(self.next)):
            found, at = [], state if self.piece[state] else self.output[state]
            while at:
                found.append(self.piece[at])
                at = self.output[at]
            self.ends.append(tuple(found))

    def viterbi(self, text: str, unknown: float) -> Iterator[tuple[int, int, int]]:
        """(start, end, id) of the best segmentation; id -1 for a character in no piece. Three numbers are kept a character."""
        n, state = len(text), 0
        best, back, piece = array("d", bytes(8 * n + 8)), array("q", bytes(8 * n + 8)), array("q", bytes(8 * n + 8))
        for end in range(1, n + 1):
            c = text[end - 1]
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            top, single, start, found = None, False, 0, -1
            for size, score, i in self.ends[state]:
                total = best[end - size] + score
                single |= size == 1
                if top is None or total > top:
                    top, start, found = total, end - size, i
            if not single and (top is None or best[end - 1] + unknown > top):
                top, start, found = best[end - 1] + unknown, end - 1, -1
            best[end], back[end], piece[end] = top, start, found
        at = n  # the way back is turned round in place: piece[start] and back[start] come to tell of the piece from start on
        end, found = -1, -1
        while True:
            before, own = back[at], piece[at]
            back[at], piece[at] = end, found
            if at == 0:
                break
            end, found, at = at, own, before
        while (end := back[at]) >= 0:
            yield at, end, piece[at]
            at = end

    @cached_property
    def arrays(self) -> Arrays:
        return Arrays(self)


class Arrays:
    """The automaton's links as arrays, to follow for many units at once."""

    def __init__(self, automaton: Automaton):
        edges = [(state, ord(c), to) for state, nexts in enumerate(automaton.next) for c, to in nexts.items()]
        state, char, to = np.array(edges, np.int64).reshape(-1, 3).T
        chars = np.unique(char)
        #: A number for each character, 0 for those in no piece.
        self.column = np.zeros((int(chars[-1]) if len(chars) else 0) + 2, np.int32)
        self.column[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.root = np.zeros(self.width, np.int32)
        first = state == 0
        self.root[self.column[char[first]]] = to[first]
        keys = state * self.width + self.column[char]
        order = np.argsort(keys)
        #: Edges by state and character; the last is none.
        self.keys, self.to = np.append(keys[order], -1), np.append(to[order], 0).astype(np.int32)
        self.fail, self.output = np.array(automaton.fail, np.int32), np.array(automaton.output, np.int32)
        ends = [p or (1, 0.0, -1) for p in automaton.piece]
        #: Of the piece that ends at a state: its length, score and id; state 0 stands for a character in no piece.
        self.size, self.score, self.id = (np.array(x, t) for x, t in zip(zip(*ends, strict=True), (np.int32, np.float64, np.int64), strict=True))
        own = np.array([p is not None for p in automaton.piece])
        #: The longest piece that ends at a state, and whether one of a single character does.
        self.longest = np.where(own, np.arange(len(own), dtype=np.int32), self.output)
        self.single = np.array([any(size == 1 for size, _, _ in e) for e in automaton.ends])

    def columns(self, points: np.ndarray) -> np.ndarray:
        return self.column[np.minimum(points, len(self.column) - 1)]

    def _move(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = self.root[column]
        live = np.flatnonzero(state)
        at, c = state[live].astype(np.int64), column[live]
        while len(live):
            key = at * self.width + c
            edge = np.searchsorted(self.keys[:-1], key)
            hit = self.keys[edge] == key
            out[live[hit]] = self.to[edge[hit]]
            at = self.fail[at].astype(np.int64)
            on = ~hit & (at > 0)
            live, at, c = live[on], at[on], c[on]
        return out

    def viterbi(self, points: np.ndarray, n: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """The best segmentations, as `Automaton.viterbi` finds them, of units with n characters each, the longest first and none
        empty: ids one unit after the other, -1 - c for a character c in no piece, and how many each unit has."""
        begin = np.cumsum(n) - n
        columns = self.columns(points)
        longest, count = int(n[0]), len(n)
        best, found = np.zeros((longest + 1, count)), np.zeros((longest + 1, count), np.int32)
        state = np.zeros(count, np.int32)
        active = np.searchsorted(-n, -np.arange(longest + 1), side="right")  # units of at least so many characters
        for end in range(1, longest + 1):
            m = int(active[end])
            state = self._move(state[:m], columns[begin[:m] + end - 1])
            top = np.full(m, -np.inf)
            at = self.longest[state]
            live = np.flatnonzero(at)
            at = at[live]
            while len(live):  # along the output links
                total = best[end - self.size[at], live] + self.score[at]
                more = total > top[live]
                who = live[more]
                top[who], found[end, who] = total[more], at[more]
                at = self.output[at]
                on = np.flatnonzero(at)
                live, at = live[on], at[on]
            alone = np.flatnonzero(~self.single[state])
            total = best[end - 1, alone] + unknown
            more = total > top[alone]
            top[alone[more]], found[end, alone[more]] = total[more], 0
            best[end, :m] = top
        at, live, rounds, sizes = n.copy(), np.arange(count), [], np.zeros(count, np.int64)
        while len(live):
            piece = found[at[live], live]
            at[live] -= self.size[piece]
            sizes[live] += 1
            rounds.append((live, np.where(piece > 0, self.id[piece], -1 - points[begin[live] + at[live]])))
            live = live[at[live] > 0]
        out, last = np.zeros(int(sizes.sum()), np.int64), np.cumsum(sizes) - 1
        for back, (live, ids) in enumerate(rounds):
            out[last[live] - back] = ids
        return out, sizes


class PieceModel:
    def __init__(self, path: str | None = None, pieces: list[tuple[str, float, int]] | None = None, prefix: bool = True):
        if pieces is None:
            import public_tokenizers

            pieces = read_pieces(path or public_tokenizers.path("piece_bpe_32k.model"))
        self.pieces, self.prefix = pieces, prefix
        self.unknown = min(s for _, s, k in pieces if k == NORMAL) - UNKNOWN
        self.unk = next((i for i, (_, _, k) in enumerate(pieces) if k == UNK), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        texts = [p for p, _, k in pieces if k == NORMAL]
        #: Pairs of characters that some piece holds; elsewhere a text can be cut.
        self.pairs = {p[i : i + 2] for p in texts for i in range(len(p) - 1)}
        self.by_word = not any(p[1] == MARK and p[0] != MARK for p in self.pairs)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, _, k in pieces]

    @cached_property
    def automaton(self) -> Automaton:
        """Made when a text is first encoded: decoding goes without it."""
        return Automaton(self.pieces)

    def _solve(self, text: str) -> bytes:
        ids = array("I")
        for start, end, i in self.automaton.viterbi(text, self.unknown):
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in text[start:end].encode())
            else:
                ids.append(self.unk)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _abreast(self, units: pa.StringArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of n characters each, the longest first, one unit after the other, and how many each unit has."""
        ids, sizes = self.automaton.arrays.viterbi(_points(units), n, self.unknown)
        odd = np.flatnonzero(ids < 0)
        if len(odd) and self.bytes:
            chars, which = np.unique(-1 - ids[odd], return_inverse=True)
            spelt = [[self.bytes[b] for b in chr(c).encode()] for c in chars.tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = np.array(list(map(len, spelt)))[which]
            sizes = np.add.reduceat(times, np.cumsum(sizes) - sizes)
            ids = np.repeat(ids, times)
            ids[ids < 0] = [i for w in which.tolist() for i in spelt[w]]
        else:
            ids[odd] = self.unk
        return ids.astype(np.int32), sizes

    def _apart(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some different units, where each unit's begin among them, and how many it has."""
        n = pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        order, at = np.argsort(-n, kind="stable"), 0
        done, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        while at < len(order):
            group = order[at : at + max(1, min(GROUP, CELLS // int(n[order[at]])))]
            if n[group].sum() >= ABREAST * n[group[0]]:
                ids, size = self._abreast(units.take(pa.array(group)), n[group])
            else:
                group = group[:1]
                ids = np.frombuffer(self._solve(units[int(group[0])].as_py().replace(" ", MARK)), "<u4").astype(np.int32)
                size = np.array([len(ids)])
            done.append(ids)
            sizes.append(size)
            at += len(group)
        size, begin = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        size[order] = got = np.concatenate(sizes)
        begin[order] = np.cumsum(got) - got
        return np.concatenate(done), begin, size

    @cached_property
    def _held(self) -> np.ndarray:
        """`pairs` as numbers in order; the last is none."""
        arrays = self.automaton.arrays
        return np.array([*sorted(int(arrays.column[ord(a)]) * arrays.width + int(arrays.column[ord(b)]) for a, b in self.pairs), -1])

    def _cut(self, units: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The parts of units between characters that no piece holds together, and where each unit's begin among them."""
        arrays, data, points = self.automaton.arrays, _data(units)[0], _points(units)
        n = pc.utf8_length(units).to_numpy(zero_copy_only=False)
        columns = arrays.columns(points).astype(np.int64)
        pairs = columns[:-1] * arrays.width + columns[1:]
        starts = np.ones(len(points), bool)
        starts[1:] = self._held[np.searchsorted(self._held[:-1], pairs)] != pairs
        starts[np.cumsum(n) - n] = True
        at = np.flatnonzero(starts)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
        return _split(data, first[at]), np.searchsorted(at, np.cumsum(n) - n)

    def _solved(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `_apart`, with long units cut first."""
        far = pc.greater(pc.utf8_length(units), LONG).to_numpy(zero_copy_only=False)
        if not far.any():
            return self._apart(units)
        parts, of = self._cut(units.filter(pa.array(far)))
        late, sizes = _once(parts, self._apart)
        size, begin = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        ids, begin[~far], size[~far] = self._apart(units.filter(pa.array(~far)))
        size[far] = np.add.reduceat(sizes, of)
        begin[far] = len(ids) + np.cumsum(size[far]) - size[far]
        return np.concatenate([ids, late]), begin, size

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit values."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's end."""
        marked = pc.replace_substring(texts.filter(pc.greater(pc.binary_length(texts), 0)), MARK, " ")  # both stand for the mark
        if self.prefix:
            marked = pc.binary_join_element_wise(" ", marked, "")
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        data, offsets = _data(marked)
        starts = np.zeros(len(data), bool)
        if self.by_word and len(data):
            blank = data == ord(" ")
            starts[1:] = blank[1:] & ~blank[:-1]
        starts[offsets[:-1]] = True
        at = np.flatnonzero(starts)
        ids, n = _once(_split(data, at), self._solved)
        last = np.zeros(len(full), np.int64)  # of the units that a text has
        last[full] = np.diff(np.searchsorted(at, offsets))
        return ids, np.append(0, np.cumsum(n))[np.cumsum(last)]

    def decode(self, ids: bytes) -> str:
        values = array("I", ids)
        if sys.byteorder == "big":
            values.byteswap()
        text = b"".join(map(self.raw.__getitem__, values)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _data(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none of them null, and where each begins, with the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _points(texts: pa.StringArray) -> np.ndarray:
    """The characters of all texts, none of them null, with the mark for a blank."""
    points = np.frombuffer(_data(texts)[0].tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
    points[points == ord(" ")] = ord(MARK)
    return points


def _split(data: np.ndarray, at: np.ndarray) -> pa.StringArray:
    """The bytes of texts as strings that begin at the places `at`."""
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))


def _once(units: pa.StringArray, solve: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units one after the other, and how many each has; equal units are solved once."""
    coded = units.dictionary_encode()
    ids, begin, size = solve(coded.dictionary)
    unit = coded.indices.to_numpy()
    n = size[unit]
    taken = np.repeat(begin[unit] - np.cumsum(n) + n, n)
    taken += np.arange(len(taken))
    return ids[taken], n


@lru_cache(2)
def piece_model(path: str | None = None) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


CACHES["pieces"] = piece_model.cache_clear

COUNTS = "doc_id long, n_pieces long, ids_crc32 long, n_bytes long"
SCHEMA = COUNTS + ", restored boolean"
#: Bytes of text, or of ids, and rows in a part of a batch.
SIZE, ROWS = 1 << 20, 4096


def _encoded(path: str | None):
    """(doc_id, text) to COUNTS, the text itself, and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = piece_model(path), [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            for part in slices(batch, "text", ROWS, SIZE):
                texts = pc.fill_null(part["text"], "")
                ids, ends = model.encode_all(texts)
                places = np.append(0, ends).astype(np.int32)
                data = ids.astype("<i4", copy=False).view(np.uint8)
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                cols = [part["doc_id"], pa.array(np.diff(places).astype(np.int64)), pa.array(sums, pa.int64()), pc.binary_length(texts).cast(pa.int64()), texts]
                yield pa.record_batch([*cols, pa.ListArray.from_arrays(pa.array(places), pa.array(ids))], names=[*names, "given", "ids"])

    return run


def encode_pieces(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, n_bytes, restored[, ids]) of docs (doc_id, text); restored: `decode_pieces` gave the text back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = rows.mapInArrow(tidied(_encoded(model), "pieces"), COUNTS + ", given string, ids array<int>")
    names = [x.split()[0] for x in COUNTS.split(", ")]
    back = decode_pieces(encoded, model, keep=[*names[1:], "given", "ids"])
    return back.select(*names, (F.col("text") == F.col("given")).alias("restored"), *(["ids"] if with_ids else []))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SIZE bytes of ids, but for a single longer row."""
    total = 4 * np.cumsum(pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, before + SIZE, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(total[end - 1])


def decode_pieces(rows: DataFrame, model: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, *keep) of rows (doc_id, ids, *keep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = piece_model(model).decode
        for batch in (part for whole in batches for part in _parts(whole)):
            ids = batch["ids"]
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            texts = [decode(values[a:b].astype("<i4", copy=False).tobytes()) if known else None for a, b, known in zip(ends[:-1].tolist(), ends[1:].tolist(), ids.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string()), *(batch[c] for c in keep)], names=["doc_id", "text", *keep])

    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys(["ids", *keep])).mapInArrow(tidied(run, "pieces"), "doc_id long, text string" + kept)
