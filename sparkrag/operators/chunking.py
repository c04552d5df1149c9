"""Sections to token-sized overlapping chunks, and the rows of the index."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import sanitize_index_text
from sparkrag.settings import DEFAULTS

CHUNK = "array<struct<content: string, locator_type: string, locator_start: int, locator_end: int, char_start: int, char_end: int>>"


def _chunk(text: str, at: tuple) -> list[dict]:
    text = text.strip()
    return [{"content": text, "locator_type": at[0], "locator_start": at[1], "locator_end": at[2], "char_start": 0, "char_end": len(text)}] if text else []


def _lines(text: str, target: int, overlap: int) -> list[str]:
    """A long section cut at line ends; each part starts with the whole last lines of the one before
    that fit the overlap. A line is never split."""
    parts, held, size = [], [], 0
    for line in text.split("\n"):
        if held and size + len(line) + 1 > target:
            parts.append("\n".join(held))
            keep, size = len(held), 0
            while keep and size + len(held[keep - 1]) <= overlap:
                keep -= 1
                size += len(held[keep]) + 1
            held = held[keep:]
        held.append(line)
        size += len(line) + 1
    return [*parts, "\n".join(held)]


def pack_sections(sections: list[dict], target: int, overlap: int) -> list[dict]:
    """Small sections are gathered up to the target, long ones cut by lines. A chunk of several sections
    has the place of the section most frequent in it, the earliest of equals."""
    out: list[dict] = []
    held: list[dict] = []
    total = 0

    def place(s: dict) -> tuple:
        return s["locator_type"], s["locator_start"], s["locator_end"]

    def flush() -> None:
        if held:
            most = Counter((*place(s), s["text"]) for s in held).most_common(1)[0][0]
            out.extend(_chunk("\n\n".join(s["text"] for s in held), most[:3]))
            held.clear()

    for s in sections:
        size = 4 * max(1, len(s["text"]) // 4)
        if size > target:
            flush()
            total = 0
            for part in _lines(s["text"], target, overlap):
                out.extend(_chunk(part, place(s)))
            continue
        if held and total + size > target:
            flush()
            total = 0
        held.append(s)
        total += size
    flush()
    return out


def chunk_array(sections: Column, target_tokens: int = DEFAULTS.chunk_target_tokens, overlap_tokens: int = DEFAULTS.chunk_overlap_tokens) -> Column:
    """An array of sections to an array of chunks."""
    target, overlap = 4 * target_tokens, 4 * overlap_tokens

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: pack_sections(list(r), target, overlap), na_action="ignore")

    return F.pandas_udf(run, CHUNK)(sections)


def chunk_documents(docs: DataFrame, sections: Column, key: str = "doc_id", *keep: str, **how) -> DataFrame:
    """docs with an array of sections to rows (key, keep..., seq, content, locator_*, char_*); no shuffle."""
    made = docs.select(key, *keep, F.posexplode(chunk_array(sections, **how)).alias("seq", "c"))
    return made.select(key, *keep, "seq", "c.*")


def chunk_sections(sections: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """Exploded sections to chunks."""
    s = F.struct("sec_no", "text", "locator_type", "locator_start", "locator_end")
    gathered = sections.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("sections"))
    return chunk_documents(gathered, F.transform("sections", lambda x: x.dropFields("sec_no")), key, **how)


def index_rows(chunks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document rows, chunk rows) from chunks (file_id, seq, content, locator_*, char_*) and
    files (file_id, workspace_id, version, filename, title)."""
    facts = chunks.groupBy("file_id").agg(F.sum(F.length("content")).alias("char_count"), F.min_by("locator_type", "seq").alias("locator_type"), F.count("*").alias("n_chunks"))
    title = sanitize_index_text(F.coalesce(F.nullif("title", F.lit("")), "filename"))
    documents = files.join(facts, "file_id", "left").select(
        "file_id", "workspace_id", "version", title.alias("title"), F.coalesce("locator_type", F.lit("char")).alias("locator_type"), F.coalesce("char_count", F.lit(0)).alias("char_count"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )
    rows = chunks.join(files.select("file_id", "workspace_id", "version"), "file_id").withColumn("content", sanitize_index_text(F.col("content")))
    return documents, rows.withColumn("chunk_id", F.format_string("%s:%d:%06d", F.col("file_id").cast("string"), F.col("version").cast("int"), F.col("seq").cast("int")))


def renumbered(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """seq from 0 without gaps."""
    return chunks.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1)
