"""Bytes and texts to located sections: rows (doc_id, sec_no, text, locator_type, locator_start, locator_end)."""

from __future__ import annotations

import csv
import html.parser
import io
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import extract_title, html_to_text, is_reference, markdown_title, strip
from sparkrag.functions.urls import url_host
from sparkrag.operators.ingest import extension

SECTION = "array<struct<text: string, locator_type: string, locator_start: int, locator_end: int>>"
WINDOW, CSV_ROWS = 4000, 200


def _is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)\S"))


def char_section_array(text: Column, size: int = WINDOW) -> Column:
    """Windows of `size` characters that aren't blank, located by their first and last character."""
    text = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    parts = F.transform(starts, lambda s: F.struct(F.substring(text, s + 1, F.lit(size)).alias("text"), F.lit("char").alias("locator_type"), s.cast("int").alias("locator_start"), F.least(s + size, F.length(text)).cast("int").alias("locator_end")))
    return F.filter(parts, lambda p: ~_is_blank(p["text"]))


def exploded(df: DataFrame, sections: Column, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(sections).alias("sec_no", "s")).select(key, "sec_no", "s.*")


def char_sections(df: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    return exploded(df, char_section_array(F.col(text), size), key)


def md_title(text: Column) -> Column:
    return markdown_title(text)


#: Stands for a & that starts no reference with a semicolon; no decoded text has it.
_PLAIN = "\udc26"


class _Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.found.append(data.replace(_PLAIN, "&").strip())


def _kept_plain(page: str) -> str:
    return re.sub("&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z0-9]+;)?", lambda m: m[0] if len(m[0]) > 1 and is_reference(m[0]) else _PLAIN + m[0][1:], page)


def _visible(pages: pd.Series, unended: bool = True) -> pd.Series:
    def one(page):
        if page is None:
            return None
        try:
            reader = _Visible()
            reader.feed(page if unended else _kept_plain(page))
            reader.close()
            return " ".join(reader.found)
        except Exception:  # noqa: BLE001  a page that can't be parsed is kept as it is
            return page

    return pages.map(one, na_action="ignore")


def visible_text(page: Column, unended: bool = True) -> Column:
    """unended: as for `decode_entities`."""

    def run(pages: pd.Series) -> pd.Series:
        return _visible(pages, unended)

    return F.pandas_udf(run, "string")(page)


def html_sections(df: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", unended: bool = True) -> DataFrame:
    return char_sections(df.select(key, visible_text(F.col(text), unended).alias("_text")), size, key, "_text")


def _pretty(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        except ValueError:
            return text

    return texts.map(one, na_action="ignore")


def pretty_json(text: Column) -> Column:
    return F.pandas_udf(_pretty, "string")(text)


def json_sections(df: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    return char_sections(df.select(key, pretty_json(F.col(text)).alias("_text")), size, key, "_text")


def csv_section_array(text: Column, rows: int = CSV_ROWS) -> Column:
    """Records joined by tabs, `rows` to a section, located by their first and last record from 1."""

    def one(body: str) -> list[dict]:
        lines = ["\t".join(r) for r in csv.reader(io.StringIO(body.removeprefix("\ufeff")))]
        parts = ((at, lines[at : at + rows]) for at in range(0, len(lines), rows))
        return [{"text": "\n".join(p), "locator_type": "row", "locator_start": at + 1, "locator_end": at + len(p)} for at, p in parts if "".join(p).strip()]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, SECTION)(text)


def csv_sections(df: DataFrame, rows: int = CSV_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    return exploded(df, csv_section_array(F.col(text), rows), key)


def group_sections(units: DataFrame, locator_type: str, sep: str = "\n", key: str = "doc_id") -> DataFrame:
    """Units (key, locator, pos, text) to one section a locator; blank units are left out."""
    kept = units.withColumn("text", strip(F.col("text"))).where("text <> ''")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda u: u["text"]), sep)
    merged = kept.groupBy(key, "locator").agg(ordered.alias("text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("locator")) - 1
    return merged.select(key, number.alias("sec_no"), "text", F.lit(locator_type).alias("locator_type"), F.col("locator").cast("int").alias("locator_start"), F.col("locator").cast("int").alias("locator_end"))


def sheet_sections(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells (key, locator, row, pos, text) to a section a sheet: cells by tab, rows by line, blank rows left out."""
    rows = cells.withColumn("text", strip(F.coalesce("text", F.lit("")))).groupBy(key, "locator", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda u: u["text"]), "\t").alias("text"))
    return group_sections(rows.select(key, "locator", F.col("row").alias("pos"), "text"), "sheet", "\n", key)


def heading_sections(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs (key, pos, text, is_heading, is_table) to virtual pages: a heading opens one if the page
    has text already; tables go to the last page. Blank paragraphs are left out first."""
    kept = paragraphs.withColumn("text", strip(F.col("text"))).where("text <> ''")
    order = Window.partitionBy(key).orderBy("pos")
    body = kept.where(~F.col("is_table")).withColumn("_first", F.row_number().over(order) == 1)
    body = body.withColumn("locator", (1 + F.sum(F.when(F.col("is_heading") & ~F.col("_first"), 1).otherwise(0)).over(order)).cast("int"))
    last = body.groupBy(key).agg(F.max("locator").alias("locator"), F.max("pos").alias("_end"))
    tables = kept.where("is_table").join(last, key, "left").select(key, F.coalesce("locator", F.lit(1)).alias("locator"), (F.coalesce("_end", F.lit(0)) + 1 + F.col("pos")).alias("pos"), "text")
    return group_sections(body.select(key, "locator", "pos", "text").unionByName(tables), "page", "\n", key)


def file_format(filename: Column, body: Column) -> Column:
    """txt, md, csv, html, json, or pdf, docx, pptx, xlsx by extension; without one by the first bytes; else null."""
    ext = extension(filename)
    known = ["txt", "md", "csv", "html", "json", "pdf", "docx", "pptx", "xlsx"]
    has = lambda t: F.contains(body, F.lit(t).cast("binary"))
    archive = F.when(has("word/"), "docx").when(has("ppt/"), "pptx").when(has("xl/"), "xlsx").otherwise("txt")
    magic = F.when(F.startswith(body, F.lit("%PDF").cast("binary")), "pdf").when(F.startswith(body, F.lit("PK").cast("binary")), archive).otherwise("txt")
    return F.when(ext == "", magic).when(ext.isin(*[f".{k}" for k in known]), F.substring(ext, 2, 10))


def route_format(files: DataFrame, strict: bool = True, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Sections of files (key, filename, content: binary), and (key, error) of those with no sectioner here.

    strict reads html by its visible text and json re-indented; otherwise html is plain text and json is
    refused. Formats that need a codec come as units to `group_sections` instead.
    """
    kind = file_format(F.col("filename"), F.col("content"))
    rows = files.select(key, kind.alias("format"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    only = lambda f: F.when(F.col("format") == f, F.col("text"))
    body, taken = F.col("text"), ["txt", "md", "csv", "html"]
    if strict:
        body = F.when(F.col("format") == "html", visible_text(only("html"))).when(F.col("format") == "json", pretty_json(only("json"))).otherwise(body)
        taken.append("json")
    good = F.coalesce(F.col("format").isin(*taken), F.lit(False))
    failed = rows.where(~good).select(key, F.concat(F.lit("no sectioner: "), F.coalesce("format", F.lit("unknown extension"))).alias("error"))
    read = rows.where(good).select(key, "format", body.alias("body"), csv_section_array(only("csv")).alias("records"))
    return exploded(read, F.when(F.col("format") == "csv", F.col("records")).otherwise(char_section_array(F.col("body"))), key), failed


def sections(files: DataFrame, fn: Callable[[str, bytes], list[tuple[str, str, int, int]]], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Any sectioner: fn takes a filename and a body and returns (text, locator_type, locator_start, locator_end) in order.

    Returns the sections of files (key, filename, content: binary) and (key, error) of those that fn fails on: one
    bad file never stops the rest. Blank sections are left out; a null name or body is an empty one.
    """
    one = pa.struct([("text", pa.string()), ("locator_type", pa.string()), ("locator_start", pa.int32()), ("locator_end", pa.int32())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, bodies in batches:
            found, errors = [], []
            for name, body in zip(names.to_pylist(), bodies.to_pylist(), strict=True):
                try:
                    parts = [dict(zip(("text", "locator_type", "locator_start", "locator_end"), part, strict=True)) for part in fn(name or "", body or b"")]
                    pa.array(parts, one)  # parts of other types are an error of this file alone
                    found.append([part for part in parts if part["text"] and part["text"].strip()])
                    errors.append(None)
                except Exception as error:  # a caller's function may fail in any way
                    found.append([])
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            yield pa.StructArray.from_arrays([pa.array(found, pa.list_(one)), pa.array(errors, pa.string())], names=["sections", "error"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    read = files.select(key, F.arrow_udf(run, f"struct<sections: {SECTION}, error: string>")(F.col("filename"), F.col("content")).alias("r"))
    return exploded(read, F.col("r.sections"), key), read.where("r.error is not null").select(key, F.col("r.error").alias("error"))


def page_documents(pages: DataFrame, unended: bool = True) -> DataFrame:
    """Pages (url, html) to (url, title, content, domain, source_type, content_type). unended: as for `decode_entities`."""
    page = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("url", extract_title(page).alias("title"), html_to_text(page, unended).alias("content"), url_host(F.col("url")).alias("domain"), F.lit("web").alias("source_type"), F.lit("text/html").alias("content_type"))
