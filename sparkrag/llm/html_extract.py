"""Main text of web pages, with each site's template removed.

A page is cut into elements by a tolerant tokenizer. Element subtrees get a hash of their tags and
text, and Spark counts, per host, on how many pages with different main content each hash occurs.
Subtrees that recur on many of them (MIN_PAGES at least, and a share of the host's: MIN_SHARE outside the
main content, INNER_SHARE inside it) are the site's template and are deleted. What is left loses
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments by
tag, role and class, and its blocks are joined.

The main content is the page's `article` elements, or else `main`, or else the body. Outside it any
block with text may be template; inside it only containers (CONTAINERS) may be, so that a paragraph
or a heading which articles share stays. Pages that are copies of each other count once, so that they don't
make a template of what they hold.

Cases: a null or empty html gives the empty text; unclosed and stray tags end where their parents
end, unclosed quotes at the next `>`; nesting may be of any depth; a null or hostless url stands for the empty
host; repeated rows give rows of their own, and count once towards a template; an empty table gives
an empty result; other columns are ignored; long pages are worked through whole, in time that grows
with their length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import hot_keys, slices, spread_join, stored

MIN_PAGES, MIN_SHARE, INNER_SHARE = 5, 0.05, 0.25

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: So many tags of a page may miss their end for a quote that isn't closed; after that a tag ends at the next `>`.
_BAD_QUOTES = 8
#: How far up an element is looked for that a new one ends.
_LOOK_UP = 200
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROP = frozenset("script style head title nav header footer aside form button select option input textarea noscript iframe template svg canvas object embed dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class and id names of boilerplate, and words that such names are put together with: a name counts if all
#: its words are of either kind and one is of the first, so `ad-box` does and `ad-free` doesn't.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar "
    "aside widget related share sharing social cookie cookies consent notice notices popup modal newsletter subscribe signup login comment comments reply replies respond disqus pagination pager".split()
)
_GLUE = frozenset("site page main top bottom left right global post article entry user reader box bar block area section container wrapper wrap inner outer list links form content unit slot".split())
_P_ENDS = frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote figure hr main address details fieldset".split())
_SELF_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that end the search for an unclosed p or li.
_SCOPE = frozenset("div article section main body table ul ol blockquote aside nav header footer form td th".split())
#: Elements that may be template inside the main content.
CONTAINERS = frozenset("div section ul ol dl table details figure fieldset center".split())
_MAIN = {"article": 1, "main": 2, "body": 4}


class Element:
    """in_main: bits of the article, main and body elements around it; hidden: it or one around it is dropped."""

    __slots__ = ("tag", "dropped", "hidden", "in_main", "holds_main", "parent", "children", "digest", "text")

    def __init__(self, tag: str, dropped: bool, parent: Element | None):
        self.tag, self.dropped, self.parent, self.children, self.digest, self.text, self.holds_main = tag, dropped, parent, [], 0, False, False
        self.hidden = dropped or (parent is not None and parent.hidden)
        self.in_main = 0 if parent is None else parent.in_main | _MAIN.get(parent.tag, 0)


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in _DROP:
        return True
    if not attributes or tag in ("article", "main", "body", "html"):
        return False
    for name, a, b, c in _ATTR.findall(attributes):
        for token in (a or b or c).lower().split():
            if name.lower() == "role":
                if token in _ROLES:
                    return True
                continue
            words = set(re.split(r"[_-]+", token))
            if words & _WORDS and words <= _WORDS | _GLUE:
                return True
    return False


def _tokens(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, rest) of the tags, name with a leading slash at an end; empty for comments and declarations.
    The caller may send the place to go on from."""
    at, last, bad = 0, page.rfind(">"), 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            end = len(page) if end < 0 else end + 3
            name = rest = ""
        elif at > last:
            return
        elif page[at] in "!?":
            end, name, rest = page.find(">", at) + 1, "", ""
        else:
            m = _NAME.match(page, at)
            if m is None:
                continue
            close = _REST.match(page, m.end()) if bad < _BAD_QUOTES else None
            bad += close is None
            end = close.end() if close else page.find(">", m.end()) + 1
            if not end:
                return
            name, rest = m[0].lower(), page[m.end() : end - 1]
        at = (yield start, end, name, rest) or end


def parse(page: str) -> list[Element]:
    """The elements in page order, the root first; children are elements and strings of text as written."""
    root = Element("html", False, None)
    found, stack, opened, at = [root], [root], Counter(), 0

    def close(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    tokens = _tokens(page)
    token = next(tokens, None)
    while token is not None:
        start, end, tag, rest = token
        if start > at:
            stack[-1].children.append(page[at:start])
        at, go_on = end, None
        if tag.startswith("/"):
            if opened[tag[1:]] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag[1:]))
        elif tag and tag != "html":
            ends = _SELF_ENDS.get(tag, frozenset())
            if any(opened[t] > 0 for t in ends) or (tag in _P_ENDS and opened["p"] > 0):
                for i in range(len(stack) - 1, max(0, len(stack) - _LOOK_UP), -1):
                    if stack[i].tag in ends or (tag in _P_ENDS and stack[i].tag == "p"):
                        close(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
            element = Element(tag, _boilerplate(tag, rest), stack[-1])
            found.append(element)
            stack[-1].children.append(element)
            if tag in _RAW:
                stop = _RAW[tag].search(page, at)
                element.children.append(page[at : stop.start() if stop else len(page)])
                at = go_on = stop.end() if stop else len(page)
            elif tag not in _VOID and not rest.rstrip().endswith("/"):
                stack.append(element)
                opened[tag] += 1
        try:
            token = tokens.send(go_on)
        except StopIteration:
            token = None
    stack[-1].children.append(page[at:])
    return found


def digest(elements: list[Element]) -> None:
    """Hashes every subtree, text by its words. Elements come after their parents, so the last go first."""
    for element in reversed(elements):
        h = xxhash.xxh3_64(element.tag)
        for child in element.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                element.text |= bool(words)
                h.update(words)
            else:
                element.text |= child.text
                h.update(child.digest.to_bytes(8, "big"))
            h.update(b"\0")
        element.digest = h.intdigest()


def main_parts(elements: list[Element]) -> list[Element]:
    for tag, bit in _MAIN.items():
        if found := [e for e in elements if e.tag == tag and not e.hidden and not e.in_main & bit]:
            return found
    return elements[:1]


def template_candidates(elements: list[Element]) -> tuple[int, dict[int, bool]]:
    """A hash of the page's main content, and the hashes of the subtrees that may be a site's template, each with
    whether it is inside the main content. `digest` has been called."""
    parts = main_parts(elements)
    marked = parts[0].tag in ("article", "main")
    bit = _MAIN.get(parts[0].tag, 0) if marked else 0
    for part in parts:
        e = part
        while e is not None and not e.holds_main:
            e.holds_main, e = True, e.parent
    out: dict[int, bool] = {}
    for e in elements:
        if not e.text or e.holds_main or e.tag in _INLINE or e.tag in _VOID:
            continue
        inside = bool(e.in_main & bit)
        if not inside or e.tag in CONTAINERS:
            h = e.digest ^ (0x9E3779B97F4A7C15 if inside else 0)
            out[h] = inside
    return xxhash.xxh3_64_intdigest(b"".join(p.digest.to_bytes(8, "big") for p in parts)), out


def blocks(element: Element, template: frozenset[int] | set[int], inside: bool = False) -> list[str]:
    """Texts of the blocks of an element, in page order, without boilerplate and template subtrees."""
    out, line, todo = [], [], list(reversed(element.children))
    key = 0x9E3779B97F4A7C15 if inside else 0

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(entities.unescape(x))
        elif x.dropped or (x.digest ^ key in template and (not inside or x.tag in CONTAINERS)):
            continue
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in _INLINE:
            todo.extend(reversed(x.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str, template: frozenset[int] | set[int]) -> str:
    elements = parse(page)
    parts = main_parts(elements)
    if template:
        digest(elements)
    inside = parts[0].tag in ("article", "main")
    return " ".join(b for part in parts for b in blocks(part, template, inside))


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for i, page in enumerate(part["html"].to_pylist()):
                elements = parse(page)
                digest(elements)
                content, found = template_candidates(elements)
                rows += [(i, _signed(content), _signed(h), inside) for h, inside in found.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            index = pa.array(cols[0], pa.int64())
            yield pa.record_batch([part["host"].take(index), part["page"].take(index), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())], names=["host", "page", "content", "h", "inside"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            template = [frozenset(h & 0xFFFFFFFFFFFFFFFF for h in x or ()) for x in part["template"].to_pylist()]
            texts = [main_text(p, t) for p, t in zip(part["html"].to_pylist(), template, strict=True)]
            counts = [pa.array([len(x) for x in xs], pa.int64()) for xs in (texts, template)]
            yield pa.record_batch([part["page_id"], part["url"], pa.array(texts, pa.string()), *counts], names=["page_id", "url", "text", "n_chars", "n_template"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """(page, template) for rows (host, page, html), host a hash: the hashes of a page's subtrees that recur on its host."""
    found = stored(pages.select("host", "page", "html").mapInArrow(_candidates, "host long, page long, content long, h long, inside boolean").distinct(), "subtrees")
    total = found.groupBy("host").agg(F.count_distinct("content").alias("contents"))
    key = ["host", "h", "inside"]
    counts = found.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("content").alias("m")).where(F.col("m") >= min_pages)
    share = F.when(F.col("inside"), inner_share).otherwise(min_share)
    common = stored(counts.join(total, "host").where(F.col("m") >= share * F.col("contents")).select(*key, "n"), "template")
    mine = spread_join(found.select("page", *key), common.select(*key), key, hot_keys(common, key, "n", found.count()))
    return mine.groupBy("page").agg(F.collect_set("h").alias("template"))


def extract_main_text(pages: DataFrame, **how) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for each row of pages (page_id, url, html); n_template: how many
    subtrees of the page are the site's template. how: see `site_templates`."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host).alias("host"), F.xxhash64("page_id", "url", body).alias("page"), body.alias("html"))
    joined = rows.join(site_templates(rows, **how), "page", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long, n_template long")
