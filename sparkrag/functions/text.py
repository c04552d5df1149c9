"""Text functions: cleaning, injection guard, tokens, snippets, query rewriting, small codecs.

White space means Unicode white space. Everything but entity decoding, NFKC and vector literals is built in.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrag.settings import INJECTION_PATTERNS, KEYWORD_STOPWORDS, META_PHRASES, QUERY_STOPWORDS, STOPWORDS, SYNONYMS

_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
_CONTROL_WIDE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u200B\\u200C\\u200D\\uFEFF]"


_ENDED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]+);")


def is_reference(text: str) -> bool:
    """Whether a text like &...; is a character reference, and not a longer name that starts like one."""
    return text[1] == "#" or text[1:] in html5


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def _unescape_ended(texts: pd.Series) -> pd.Series:
    one = lambda m: html.unescape(m[0]) if is_reference(m[0]) else m[0]
    return texts.map(lambda t: _ENDED.sub(one, t), na_action="ignore")


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def decode_entities(text: Column, unended: bool = True) -> Column:
    """Character references to characters; unended: also those that HTML reads without their semicolon, as in `&amp` at a cut.
    All texts go to Python, as a condition around a UDF doesn't keep rows from it."""
    return F.pandas_udf(_unescape if unended else _unescape_ended, "string")(text)


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cut(text: Column, most: int) -> Column:
    """At most `most` characters, with an ellipsis if some are gone."""
    head = F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+$", "")
    return F.when(F.length(text) > most, F.concat(head, F.lit("…"))).otherwise(text)


def sanitize_index_text(text: Column) -> Column:
    """NUL goes; other controls but tab and line ends become blanks; runs of blanks become one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\x00", ""), _CONTROL, " "), " {2,}", " ")


def sanitize_web_text(text: Column, most: int = 1200, unended: bool = True) -> Column:
    plain = decode_entities(F.regexp_replace(text, "<[^>]+>", " "), unended)
    return cut(collapse(F.regexp_replace(plain, _CONTROL_WIDE, "")), most)


def looks_like_injection(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in INJECTION_PATTERNS])


def sentences(text: Column) -> Column:
    """Stripped sentences that aren't blank."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def strip_injection(text: Column) -> Column:
    """struct(text, removed): without the sentences that address the model, and how many they were."""
    parts = sentences(text)
    kept = F.filter(parts, lambda s: ~looks_like_injection(s))
    return F.struct(F.array_join(kept, " ").alias("text"), (F.size(parts) - F.size(kept)).alias("removed"))


def harden_context(text: Column, most: int = 4000) -> Column:
    return cut(collapse(strip_injection(F.regexp_replace(text, _CONTROL_WIDE, " "))["text"]), most)


def html_to_text(page: Column, unended: bool = True) -> Column:
    bare = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return collapse(decode_entities(F.regexp_replace(bare, "<[^>]+>", " "), unended))


def extract_title(page: Column) -> Column:
    """Text of title, or of the first h1, or null."""
    found = lambda tag: F.nullif(strip(F.regexp_extract(page, rf"(?is)<{tag}[^>]*>([^<]+)</{tag}>", 1)), F.lit(""))
    return F.coalesce(found("title"), found("h1"))


def clean_inline_html(text: Column, unended: bool = True) -> Column:
    return collapse(decode_entities(F.regexp_replace(text, "<[^>]+>", ""), unended))


def normalize_query(text: Column, most: int = 300) -> Column:
    """NFKC; controls to blanks; no quotes or loose marks at the ends; repeated marks once; cut."""
    plain = collapse(F.regexp_replace(F.pandas_udf(_nfkc, "string")(text), _CONTROL_WIDE, " "))
    quotes = "[\"'“”‘’«»]"
    bare = strip(F.regexp_replace(plain, f"^{quotes}+|{quotes}+$", ""))
    once = F.regexp_replace(F.regexp_replace(bare, r"([!?.,;:])\1+", "$1"), "^[ ,;:!?.]+|[ ,;:!?.]+$", "")
    return F.when(F.length(once) > most, F.regexp_replace(F.substring(once, 1, most), r"(?U)\s+$", "")).otherwise(once)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _not_in(words: Column, banned: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*banned))


def tokens(text: Column) -> Column:
    """Runs of a-z and digits of two characters or more, lower-cased, in order, with repeats."""
    return F.filter(_words(text), lambda w: F.length(w) >= 2)


keywords = tokens


def content_tokens(text: Column) -> Column:
    return _not_in(tokens(text), STOPWORDS)


def query_terms(text: Column) -> Column:
    """Terms of a web query: words over two characters of the normalised text, repeats kept."""
    return _not_in(F.filter(_words(normalize_query(text)), lambda w: F.length(w) > 2), QUERY_STOPWORDS)


def snippet(text: Column, most: int = 280) -> Column:
    return cut(collapse(text), most)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def estimate_cost_usd(n_tokens: Column, price_per_1k: float = 0.00015) -> Column:
    return F.round(n_tokens / F.lit(1000.0) * F.lit(price_per_1k), 6)


def should_rewrite(text: Column) -> Column:
    """Ten characters at least, and a meta phrase or more than 50 characters."""
    meta = F.rlike(F.lower(text), F.lit("|".join(META_PHRASES)))
    return (F.length(text) >= 10) & (meta | (F.length(text) > 50))


def rewrite_query(text: Column) -> Column:
    """struct(cleaned, keyword): without meta phrases, and the important words with two synonyms each after them."""
    bare = collapse(reduce(lambda t, p: F.regexp_replace(t, p, " "), META_PHRASES, strip(F.lower(text))))
    cleaned = F.when(bare == "", strip(text)).otherwise(bare)
    words = _not_in(F.filter(_words(cleaned), lambda w: F.length(w) >= 4), KEYWORD_STOPWORDS)
    known = F.create_map(*[F.lit(x) for k, v in SYNONYMS.items() for x in (k, "\t".join(v))])
    more = F.flatten(F.transform(F.filter(words, lambda w: w.isin(*SYNONYMS)), lambda w: F.split(known[w], "\t")))
    keyword = F.array_join(F.concat(words, more), " ")
    return F.struct(cleaned.alias("cleaned"), F.when(F.size(words) == 0, cleaned).otherwise(keyword).alias("keyword"))


def is_no_answer(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?i)\bNO[_ ]?ANSWER\b"))


def file_stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def title_tokens(content: Column, filename: Column) -> Column:
    """Distinct content tokens of the file's stem and of the first line that starts with #."""
    heads = F.filter(F.transform(F.split(content, r"\r\n|\r|\n"), strip), lambda x: F.startswith(x, F.lit("#")))
    head = F.coalesce(F.regexp_replace(F.try_element_at(heads, F.lit(1)), "^#+", ""), F.lit(""))
    return F.array_distinct(content_tokens(F.concat_ws(" ", file_stem(filename), head)))


def markdown_title(text: Column) -> Column:
    """The first line that starts with '# ', without its marks, 500 characters at most; else null."""
    heads = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.startswith(x, F.lit("# ")))
    return F.substring(strip(F.regexp_replace(F.try_element_at(heads, F.lit(1)), "^[# ]+", "")), 1, 500)


def slugify(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 100)


def valid_slug(text: Column) -> Column:
    return F.rlike(text, F.lit("^[a-z0-9]+(-[a-z0-9]+)*$"))


def identity_key(authorization: Column, address: Column) -> Column:
    """A bearer token's hash, or the address."""
    token = F.regexp_extract(authorization, r"(?i)^bearer\s+(.+)$", 1)
    return F.when(F.coalesce(token, F.lit("")) != "", F.concat(F.lit("token:"), F.substring(F.sha2(token, 256), 1, 16))).otherwise(F.concat(F.lit("ip:"), F.coalesce(address, F.lit("unknown"))))


def _literals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if v is None else f"[{','.join(f'{x:.7f}' for x in v if x is not None)}]" for v in batch.to_pylist()], pa.string())


def vector_to_literal(vector: Column) -> Column:
    """[x,y,...] with seven decimals, exact at any size, halves to even; -0.0000000 of what is below zero and rounds to it. Null
    components are left out. Built-in formats round the shortest digits of a number instead, and decimals have no sign of zero."""
    return F.arrow_udf(_literals, "string")(vector.cast("array<double>"))


def literal_to_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def answer_meta_json(kind: Column, used_chunk_ids: Column, citation_count: Column, web_fallback: Column | None = None) -> Column:
    """An answer's metadata as JSON text: its kind, the chunks used, how many citations, and what a web fallback told (a map or struct)."""
    web = F.create_map().cast("map<string, string>") if web_fallback is None else web_fallback
    return F.to_json(F.struct(kind.alias("answer_kind"), used_chunk_ids.alias("used_chunk_ids"), citation_count.alias("citation_count"), web.alias("web_fallback")))


def web_log_json(entries: Column, error: Column | None = None) -> Column:
    """A web search's log as JSON text: an array of entries (title, url, score, fetched, used, rejected), null fields
    kept, and an error or null."""
    return F.to_json(F.struct(entries.alias("results"), (F.lit(None).cast("string") if error is None else error).alias("error")), {"ignoreNullFields": "false"})
