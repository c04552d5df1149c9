"""Byte-level BPE ids of whole texts, with a cache of the words seen.

The pretokeniser of the vocabulary starts a token at every blank that stands between two characters
that aren't white space, and makes a single line end between such characters a token of its own. So
a text splits there into words that are encoded one by one, and equal words have equal ids. Texts
with other white space, or with a special token's string, are encoded whole.
"""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache

from sparkrag.llm.common import CACHES

#: Words kept; the cache starts anew beyond that.
WORDS = 400_000


@lru_cache(2)
def byte_bpe(path: str | None = None) -> ByteBpe:
    """One encoder for each Python worker, so that its words stay known from task to task."""
    return ByteBpe(path)


CACHES["tokens"] = byte_bpe.cache_clear


class ByteBpe:
    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = None if path else _ranked()
        self.head: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.newline = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        if self.fast is not None and (text.isascii() or max(text) < "ɐ"):
            return _packed(self.fast(text))
        return _packed(self.model.encode(text, add_special_tokens=False).ids)

    def _whole(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return _packed(self.model.encode(text, add_special_tokens=False).ids)
        return self._ids(text)

    def _learn(self, word: str, cache: dict[str, bytes], prefix: str) -> bool:
        """False if the word isn't one that can be encoded on its own."""
        if not word or word[0].isspace() or word[-1].isspace():
            return False
        if len(cache) >= WORDS:
            cache.clear()
        cache[word] = self._ids(prefix + word)
        return True

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit values, no end id."""
        if any(s in text for s in self.special):
            return self._whole(text)
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            ids = self.head.get(first)
            if ids is None:
                if not self._learn(first, self.head, ""):
                    return self._whole(text)
                ids = self.head[first]
            got = list(map(self.inner.get, rest))
            if None in got:
                for i, x in enumerate(got):
                    if x is None:
                        if not (rest[i] in self.inner or self._learn(rest[i], self.inner, " ")):
                            return self._whole(text)
                        got[i] = self.inner[rest[i]]
            out.append(ids + b"".join(got))
        return self.newline.join(out)


def _ranked():
    """The same vocabulary as ranks, which a leaner encoder reads."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()
