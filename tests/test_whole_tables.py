"""Queries over whole tables against plain restatements of their rules, with the rows that SQL leaves out."""

import datetime as dt
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from sparkrag.operators import ann as N
from sparkrag.plans import registry
from sparkrag.plans import ops_queries, search_queries, text_queries  # noqa: F401  they register their queries
from sparkrag.settings import STOPWORDS

TEXTS = ["plain words only", "# Annual Leave\nbody", "intro\r\n  ## The Fee List \r\nmore # no", "#tag first\n# Second one", "a\nb # c", "x" * 70 + "\n# " + "T" * 600, "", "\n\n", "# \n# late", "  # Indented\rend", "no heading # here"]


def _rows(spark, name, folder):
    return registry.QUERIES[name](spark, str(folder)).collect()


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_headings_of_all_documents(spark, tmp_path):
    _write(spark, tmp_path, "documents", list(enumerate(TEXTS)), "doc_id long, text string")

    def tokens(i, text):
        heads = [x.strip() for x in re.split(r"\r\n|\r|\n", text) if x.strip().startswith("#")]
        head = re.sub("^#+", "", heads[0]) if heads else ""
        return sorted({w for w in re.findall("[a-z0-9]+", f"doc-{i} {head}".lower()) if len(w) >= 2 and w not in STOPWORDS})

    def title(text):
        heads = [x.strip() for x in text.split("\n") if x.strip().startswith("# ")]
        return re.sub("^[# ]+", "", heads[0]).strip()[:500] if heads else None

    assert {r["doc_id"]: r["tokens"] for r in _rows(spark, "t19_title_tokens", tmp_path)} == {i: tokens(i, t) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["title"] for r in _rows(spark, "p2_md_title", tmp_path)} == {i: title(t) for i, t in enumerate(TEXTS)}


def test_report_of_all_items(spark, tmp_path):
    items = [(1, "one | two"), (2, "a\nb\r\nc\rd"), (3, ""), (4, "\nx\n"), (5, None)]
    _write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    want = [f"| {i} | {re.sub(chr(13) + chr(10) + '|' + chr(13) + '|' + chr(10), '<br>', (t or '').replace('|', chr(92) + '|'))} |" for i, t in items]
    assert sorted(r["value"] for r in _rows(spark, "s7_eval_report", tmp_path)) == sorted(want)


def test_admins_of_all_users(spark, tmp_path):
    events = [(u, e) for u in range(2, 40) for e in ("a", "bb", "ccc")] + [(2, "dddd"), (5, "eeee"), (47, "eeee"), (5, "eeee"), (3, "fffff"), (7, "fffff")]
    _write(spark, tmp_path, "events", events, "user_id long, event_type string")
    admins = {e: {u for u, x in events if x == e and (u + len(e)) % 4 == 3} for _, e in events}
    want = {e: len(us) for e, us in admins.items() if len(us) <= 1}
    assert want == {"dddd": 0, "eeee": 1, "fffff": 0}
    assert {r["workspace_id"]: r["n_admins"] for r in _rows(spark, "j7_last_admin", tmp_path)} == want


def test_stand_in_ranking(spark, tmp_path):
    vectors = [(i, i % 3, [float(i), 1.0]) for i in range(400)]
    _write(spark, tmp_path, "embeddings", vectors, "vec_id long, label int, embedding array<float>")
    want = []
    for q, ws, _ in vectors:
        own = [c for c, label, _ in vectors if label == ws and (c + q) % 7 == 0][:12]
        want += [(q, c, 1 / (n + 1), n + 1) for n, c in enumerate(own)]
    keyed = search_queries._fused_inputs(spark, str(tmp_path))[1]
    assert sorted((r["query_id"], r["chunk_id"], float(r["keyword_score"]), r["rank"]) for r in keyed.collect()) == sorted(want)
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join") < plan.find("Window")  # ranked below the join, not after pairing a workspace


def test_recall_is_that_of_the_defaults(spark, tmp_path, monkeypatch):
    _write(spark, tmp_path, "embeddings", [(i, i % 3, [float(i % 11), float(i % 7), 1.0]) for i in range(300)], "vec_id long, label int, embedding array<float>")
    asked, search = [], N.ivf_knn
    monkeypatch.setattr(N, "ivf_knn", lambda q, c, *a, **how: asked.append((a, sorted(how))) or search(q, c, *a, **how))
    row = _rows(spark, "r3_ivf_knn", tmp_path)[0]
    assert 0.9 <= row["recall"] <= 1 and row["most_read"] == 48
    assert asked == [((), ["index"])]  # k and all else as they are by default


def test_vectors_of_one_workspace_made_anew(spark, tmp_path):
    """c6 against BLAKE2b buckets counted plainly."""
    texts = [(i, t, "src3" if i % 2 else "src4") for i, t in enumerate(["the fee is 40 fee", "", "other words", "Alpha beta ALPHA", None, "dan yang"])]
    _write(spark, tmp_path, "documents", texts, "doc_id long, text string, source string")

    def vector(text):
        out = [0.0] * 384
        for w in re.findall("[a-z0-9]{2,}", (text or "").lower()):
            if w not in STOPWORDS:
                out[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 384] += 1
        size = sum(x * x for x in out) ** 0.5
        return [x / size if size else 0.0 for x in out]

    got = {r["chunk_id"]: json.loads(r["embedding"]) if r["embedding"] else None for r in _rows(spark, "c6_reembed", tmp_path)}
    assert got.keys() == {i for i, _, _ in texts}
    for i, t, ws in texts:
        if ws == "src4":
            assert got[i] == [1.0]
        elif t is not None:
            assert got[i] == pytest.approx(vector(t), abs=1e-6)
    plain = {r["doc_id"]: r["norm"] for r in _rows(spark, "c3_hash_embed", tmp_path)}
    assert plain[0] == 1.0 and plain[1] == 0.0


def test_files_of_any_layout(spark, tmp_path):
    from sparkrag.sources import io

    _write(spark, tmp_path, "documents", [(1, "a\nb", "w1"), (2, "", "w2")], "doc_id long, text string, source string")
    got = {r["file_id"]: (r["workspace_id"], r["version"], r["checksum"]) for r in _rows(spark, "s1_read_files", tmp_path)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"1": ("w1", 2, sha(b"a\nb\n")), "2": ("w2", 3, sha(b"\n"))}
    body = tmp_path / "store" / "workspaces" / "w" / "files" / "f1" / "v3" / "a%20b.md"
    body.parent.mkdir(parents=True)
    body.write_bytes(b"# x")
    row = io.read_files(spark, str(tmp_path / "store")).first()
    assert (row["workspace_id"], row["file_id"], row["version"], row["filename"], bytes(row["content"])) == ("w", "f1", 3, "a b.md", b"# x")


def test_files_of_odd_places(spark, tmp_path):
    """Workspaces that no folder can be named like, ids that occur twice, and few tasks for many small files."""
    places = ["a b", "x/y", "p:q%2F*", "src=1", "Ümlaut~v9", None]
    docs = [(i, f"text {i}", places[i % 6]) for i in range(120)] + [(7, "again", "a b"), (7, "again", "a b")]
    _write(spark, tmp_path, "documents", docs, "doc_id long, text string, source string")
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "8m")  # a task for two files, as each counts as 4 MB
    try:
        found = registry.QUERIES["s1_read_files"](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        got = sorted((r["workspace_id"] or "", r["file_id"], r["version"], r["size_bytes"], r["checksum"]) for r in found.collect())
    finally:
        spark.conf.set(name, before)
    assert got == sorted((w or "", str(i), i % 3 + 1, len(t) + 1, hashlib.sha256(f"{t}\n".encode()).hexdigest()) for i, t, w in docs)


LITERALS = {0: ([-1e-9, 0.5], "[-0.0000000,0.5000000]"), 1: ([0.00390625, -0.01171875], "[0.0039062,-0.0117188]"), 3: ([1e20, -3.0], "[100000002004087734272.0000000,-3.0000000]"), 6: ([float("nan"), float("-inf")], "[nan,-inf]"), 9: ([], "[]")}


def test_upserted_literals_of_all_vectors(spark, tmp_path):
    """Signs of what rounds to zero, halves to even, large and odd numbers."""
    _write(spark, tmp_path, "embeddings", [(i, 0, v) for i, (v, _) in LITERALS.items()], "vec_id long, label int, embedding array<float>")
    got = {r["chunk_id"]: r["embedding"] for r in _rows(spark, "c5_upsert_embeddings", tmp_path)}
    assert got == {i: want if i % 3 == 0 else "[0.0000000]" for i, (_, want) in LITERALS.items()}


def test_literals_of_all_vectors(spark, tmp_path):
    rows = [(i, 0, v) for i, (v, _) in LITERALS.items()] + [(100, 0, None)]
    _write(spark, tmp_path, "embeddings", rows, "vec_id long, label int, embedding array<float>")
    assert {r["vec_id"]: r["literal"] for r in _rows(spark, "s5_vector_literal", tmp_path)} == {i: want for i, (_, want) in LITERALS.items()} | {100: None}


def test_replies_to_all_requests(spark, tmp_path, monkeypatch):
    """Buckets that come in several frames, and files whose requests are earlier than those of the files before."""
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(seconds=(i * 7919) % 400), i % 3, "ab"[i % 2]) for i in range(400)]
    for part in (events[:200], events[200:]):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(ops_queries, "BATCH_BYTES", 1)
    want, first = {}, {}
    for i, ts, user, kind in sorted(events, key=lambda e: (e[1], e[0])):
        key = (user, kind, i % 40) if i % 4 else None
        known = first.setdefault(key, i) if key else i
        want[i] = (known != i, f"r{known}", known != i and known % 3 != i % 3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        got = _rows(spark, "k3_dedup_requests", tmp_path)
    finally:
        spark.conf.set(name, before)
    assert len(got) == len(events) and {r["request_id"]: (r["replayed"], r["answer"], r["conflict"]) for r in got} == want


def test_deleted_chunks_of_blank_texts(spark, tmp_path):
    texts = ["a" * 4001, "", " \n\t\f\r", None, "\x0b", "\u00a0", " " * 4000 + "x", " " * 9000]
    _write(spark, tmp_path, "documents", [(3 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["file_id"]: r["n_deleted"] for r in _rows(spark, "g9_delete_chunks", tmp_path)} == {1: 2, 13: 1, 16: 1, 19: 2}


def test_addresses_of_many_pages(spark, tmp_path):
    """Every first group of the unique local kind, and that link-local stays blocked."""
    from sparkrag.functions import urls as U

    spark.range(8 * 800).select(F.col("id").alias("page_id")).write.parquet(f"{tmp_path}/pages.parquet")
    rows = _rows(spark, "t16_address_spellings", tmp_path)
    assert len(rows) == 4 * 8 * 800
    kinds = {1: lambda x: x % 768 < 512, 2: lambda x: x % 128 < 64}
    wrong = [r for r in rows if r["page_id"] % 8 in kinds and r["blocked"] != kinds[r["page_id"] % 8](r["page_id"] // 8)]
    assert wrong == []
    ends = spark.createDataFrame([("fdff::1", True), ("fe00::1", False), ("fe7f::1", False), ("fe80:280::1", True), ("febf:2bf::1", True), ("fec0::1", False)], "a string, want boolean")
    assert all(r["got"] == r["want"] for r in ends.select("want", U.url_static_check(F.concat(F.lit("http://["), "a", F.lit("]/"))).isNotNull().alias("got")).collect())


CUT = "<title>A &amp;&amp</title><p>x &lt;b&gt; &ampc; &am</p>&copy; y&copy"


def _cut_page(spark, folder, name):
    _write(spark, folder, "pages", [(1, "https://a.org/x", CUT)], "page_id long, url string, html string")
    return _rows(spark, name, folder)[0]


def test_web_text_of_cut_references(spark, tmp_path):
    """As SQL reads them; by default as HTML does."""
    from sparkrag.functions import text as T

    assert _cut_page(spark, tmp_path, "t2_sanitize_web_text")["clean"] == "A &&amp x <b> &ampc; &am © y&copy"
    assert spark.range(1).select(T.sanitize_web_text(F.lit(CUT)).alias("t")).first()["t"] == "A && x <b> &c; &am © y©"


def test_page_text_of_cut_references(spark, tmp_path):
    from sparkrag.functions import text as T

    assert _cut_page(spark, tmp_path, "t4_html_to_text")["content"] == "A &&amp x <b> &ampc; &am © y&copy"
    assert spark.range(1).select(T.html_to_text(F.lit(CUT)).alias("t")).first()["t"] == "A && x <b> &c; &am © y©"


def test_inline_text_of_cut_references(spark, tmp_path):
    from sparkrag.functions import text as T

    assert _cut_page(spark, tmp_path, "t6_clean_inline_html")["clean"] == "A &&ampx <b> &ampc; &am© y&copy"
    assert spark.range(1).select(T.clean_inline_html(F.lit(CUT)).alias("t")).first()["t"] == "A &&x <b> &c; &am© y©"


def test_results_with_cut_references(spark, tmp_path):
    from sparkrag.operators import web as W

    title = "A &amp;&amp &copy"
    _write(spark, tmp_path, "benchmark", [(i, f"words {i}") for i in range(3)], "item_id long, text string")
    _write(spark, tmp_path, "pages", [(i, f"https://a.org/?x={i}&copy=1", f"<title>{title}</title>") for i in range(3)], "page_id long, url string, html string")
    got = {r["query_id"]: (r["title"], r["url"]) for r in _rows(spark, "w1_parse_payloads", tmp_path)}
    assert got == {i: (t, f"https://a.org/?x={i}&copy=1") for i, t in enumerate((title, title, "A &&amp &copy"))}
    raw = spark.createDataFrame([(1, "a", "html", f'<a class="result__a" href="https://b.org">{title}</a>')], "query_id long, provider string, format string, body string")
    assert W.parse_result_payloads(raw).first()["title"] == "A && ©"


def test_sections_of_cut_references(spark, tmp_path):
    from sparkrag.operators import sections

    page = f"<html><head>{CUT[:26]}</head><body>{CUT[26:]}&#65;&#66 &&amp; <a href='?a=1&b'>Q&A</a><script>if (a && b) c()</script>&"
    _write(spark, tmp_path, "pages", [(1, page)], "page_id long, html string")
    assert [r["text"] for r in _rows(spark, "p3_html_sections", tmp_path)] == ["x <b> &ampc; &am © y&copyA&#66 && Q&A &"]
    assert spark.range(1).select(sections.visible_text(F.lit(page)).alias("t")).first()["t"] == "x <b> &c; &am © y©AB && Q&A &"


def test_documents_of_cut_references(spark, tmp_path):
    from sparkrag.operators import sections

    row = _cut_page(spark, tmp_path, "p9_page_documents")
    assert (row["title"], row["content"]) == ("A &amp;&amp", "A &&amp x <b> &ampc; &am © y&copy")
    assert sections.page_documents(spark.read.parquet(f"{tmp_path}/pages.parquet")).first()["content"] == "A && x <b> &c; &am © y©"


def test_vectors_by_md5_of_all_texts(spark):
    """The vectors that stay in a text's row against the built-in twin, which groups tokens over a shuffle."""
    from sparkrag.operators import embed as E

    texts = [(0, "the Fee is 40 fee fees"), (1, ""), (2, None), (3, "a the of"), (4, "Ünder İstanbul x1 y 22 fee"), (5, " ".join(f"w{i} w{i % 7}" for i in range(3000)))]
    rows = spark.createDataFrame(texts, "chunk_id long, content string")
    made = E.md5_embed(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = {i: [0.0] * 384 for i, _ in texts}
    for r in E.md5_sparse(rows).collect():
        want[r["chunk_id"]][r["bucket"]] = r["weight"]
    got = {r["chunk_id"]: r["embedding"] for r in made.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-15) for i in want)


def test_metadata_texts(spark):
    from sparkrag.functions import text as T

    used = F.array(F.lit("c1"), F.lit("c2"))
    row = spark.range(1).select(T.answer_meta_json(F.lit("grounded"), used, F.lit(2)).alias("a"), T.web_log_json(F.array(F.struct(F.lit("t").alias("title"), F.lit(None).cast("string").alias("rejected")))).alias("w")).first()
    assert json.loads(row["a"]) == {"answer_kind": "grounded", "used_chunk_ids": ["c1", "c2"], "citation_count": 2, "web_fallback": {}}
    assert json.loads(row["w"]) == {"results": [{"title": "t", "rejected": None}], "error": None}


def test_tables_of_a_database(spark):
    from sparkrag.sources import io

    url = "jdbc:derby:memory:sparkrag;create=true"
    rows = [(i, f"w{i % 3}") for i in range(50)]
    spark.createDataFrame(rows, "id long, workspace_id string").write.jdbc(url, "files", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = io.read_jdbc(spark, url, "files", "id", 0, 50, 4)
    assert got.rdd.getNumPartitions() == 4 and sorted((r[0], r[1]) for r in got.collect()) == rows
