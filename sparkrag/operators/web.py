"""Web results: parsing stored payloads, relevance, providers, domain rules, evidence.

results: (query_id, query, provider, provider_order, rank, title, url, snippet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import clean_inline_html, decode_entities, normalize_query, query_terms, sanitize_web_text, strip, web_log_json
from sparkrag.functions.urls import domain_allowed
from sparkrag.settings import DEFAULTS

_ITEM = "array<struct<title: string, url: string, content: string>>"


def parse_result_payloads(raw: DataFrame, most: int = DEFAULTS.web_max_results, unended: bool = True) -> DataFrame:
    """Payloads (query_id, provider, format json|rss|html, body) to (query_id, provider, rank, title, url, snippet).

    Broken JSON or XML gives no rows; only http links count; results past `most` are left out. unended: as for `decode_entities`.
    """
    from_json = F.transform(F.from_json("body", f"results {_ITEM}")["results"], lambda x: F.struct(F.coalesce(x["title"], F.lit("")).alias("title"), F.coalesce(x["url"], F.lit("")).alias("url"), F.coalesce(x["content"], F.lit("")).alias("snippet")))
    tags = F.regexp_extract_all("body", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    cdata = lambda t: F.regexp_replace(t, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    field = lambda x, tag: strip(cdata(F.regexp_extract(x, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)))
    whole = F.from_xml("body", "channel string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    closed = whole.isNotNull() & F.rlike(F.col("body"), F.lit(r"(?s)</(rss|feed|RDF|channel)>\s*$"))
    from_rss = F.when(closed, F.transform(tags, lambda x: F.struct(field(x, "title").alias("title"), field(x, "link").alias("url"), field(x, "description").alias("snippet"))))
    link = r'(?s)<a[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
    hrefs, titles = (F.regexp_extract_all("body", F.lit(link), F.lit(i)) for i in (1, 2))
    notes = F.regexp_extract_all("body", F.lit(r'(?s)class="result__snippet"[^>]*>(.*?)</a>'), F.lit(1))
    from_html = F.transform(F.arrays_zip(hrefs.alias("h"), titles.alias("t")), lambda x, i: F.struct(x["t"].alias("title"), x["h"].alias("url"), F.coalesce(F.get(notes, i), F.lit("")).alias("snippet")))
    items = F.when(F.col("format") == "json", from_json).when(F.col("format") == "rss", from_rss).when(F.col("format") == "html", from_html)
    rows = raw.select("query_id", "provider", "format", F.posexplode(items).alias("at", "r")).select("query_id", "provider", "format", "at", "r.*")
    plain = F.col("format") == "html"
    url = decode_entities(F.col("url"), unended)
    inner = F.try_url_decode(F.regexp_extract(url, r"[?&]uddg=([^&]*)", 1))
    url = F.when(plain & F.contains(url, F.lit("uddg=")) & (inner != ""), inner).otherwise(url)
    url = F.when(plain & F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    text = lambda c: F.when(plain, clean_inline_html(F.col(c), unended)).when(F.col("format") == "rss", decode_entities(F.col(c), unended)).otherwise(F.col(c))
    done = rows.select("query_id", "provider", "at", text("title").alias("title"), url.alias("url"), text("snippet").alias("snippet")).where(F.startswith("url", F.lit("http")))
    rank = F.row_number().over(Window.partitionBy("query_id", "provider").orderBy("at"))
    return done.withColumn("rank", rank).where(F.col("rank") <= most).drop("at")


def relevance(terms: Column, title: Column, note: Column) -> Column:
    """The share of the query's terms, repeats counted, that occur in title and snippet."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(note, F.lit(""))))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(hay, t))) / F.nullif(F.size(terms), F.lit(0))).otherwise(0.0)


def with_relevance(results: DataFrame) -> DataFrame:
    return results.withColumn("relevance", relevance(query_terms(F.col("query")), F.col("title"), F.col("snippet")))


def rank_by_relevance(results: DataFrame) -> DataFrame:
    """rank anew: relevance first, then the old rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    return results.withColumn("_new", F.row_number().over(order)).withColumn("rank", F.col("_new")).drop("_new")


def filter_relevant(results: DataFrame, least: float = DEFAULTS.web_min_relevance) -> DataFrame:
    return results.where(F.col("relevance") >= least)


def evidence_gate(results: DataFrame, least: float = DEFAULTS.web_min_relevance, min_results: int = DEFAULTS.web_min_results, top: int = 3) -> DataFrame:
    """The first `top` relevant results of queries that have enough of them."""
    kept = filter_relevant(results, least)
    n = F.count("*").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumns({"_n": n, "_at": place}).where((F.col("_n") >= max(1, min_results)) & (F.col("_at") <= top)).drop("_n", "_at")


def pick_provider(results: DataFrame, least: float = DEFAULTS.web_min_relevance) -> DataFrame:
    """The results of one provider a query: the first whose best result is relevant, else the best of all."""
    tops = results.groupBy("query_id", "provider", "provider_order").agg(F.max("relevance").alias("top"))
    good = (F.col("top") >= least).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc("_good"), F.when(F.col("_good") == 1, F.col("provider_order")), F.desc("top"), "provider_order")
    best = tops.withColumn("_good", good).withColumn("_at", F.row_number().over(order)).where("_at = 1").select("query_id", "provider")
    return results.join(best, ["query_id", "provider"]).select(*results.columns)


def apply_domain_acl(results: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a reason)."""
    flagged = results.withColumn("_ok", domain_allowed(F.col("url"), allow, deny))
    return flagged.where("_ok").drop("_ok"), flagged.where("not _ok").drop("_ok").withColumn("rejected", F.lit("domain_acl"))


def web_search_log(results: DataFrame) -> DataFrame:
    """(query_id, results_count, log) of results with a column `rejected`, null if kept, and columns `fetched` and `used` where known."""
    told = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in results.columns else F.lit(False).alias(c) for c in ("fetched", "used")]
    entry = F.struct("rank", "title", "url", F.round("relevance", 3).alias("score"), *told, "rejected")
    rows = results.groupBy("query_id").agg(F.count_if(F.col("rejected").isNull()).alias("results_count"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select("query_id", "results_count", web_log_json(F.transform("entries", lambda e: e.dropFields("rank"))).alias("log"))


def web_evidence(queries: DataFrame, payloads: DataFrame, providers: dict[str, int], allow: list[str] | None = None, deny: list[str] | None = None, settings=DEFAULTS) -> DataFrame:
    """Gated evidence for queries (query_id, question) from stored payloads."""
    asked = queries.select("query_id", normalize_query(F.col("question")).alias("query")).where("query <> ''")
    order = F.create_map(*[F.lit(x) for kv in providers.items() for x in kv])
    found = parse_result_payloads(payloads, settings.web_max_results).join(asked, "query_id").withColumn("provider_order", order[F.col("provider")])
    kept, _ = apply_domain_acl(pick_provider(with_relevance(found), settings.web_min_relevance), allow, deny)
    clean = kept.withColumns({"title": sanitize_web_text(F.col("title"), 200), "snippet": sanitize_web_text(F.col("snippet"), 1200)})
    return evidence_gate(rank_by_relevance(with_relevance(clean)), settings.web_min_relevance, settings.web_min_results)


def web_contexts(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, rank, title, url, snippet, body, content): the page's text, or the snippet, under its source line.
    pages: (url, content). Results with neither are left out."""
    body = F.coalesce(F.nullif("_page", F.lit("")), F.nullif("snippet", F.lit("")))
    own = pages.groupBy("url").agg(F.max("content").alias("_page"))
    rows = evidence.join(own, "url", "left").withColumn("body", body).where("body is not null")
    return rows.select("query_id", "rank", "title", "url", "snippet", "body", F.concat(F.lit("Sumber web: "), "title", F.lit(" ("), "url", F.lit(")\n"), "body").alias("content"))
