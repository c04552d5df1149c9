"""Golden rows and plain restatements of the ingestion, retrieval, answer, web, evaluation and tenancy rules."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrag.operators import ann as N
from sparkrag.operators import answers as A
from sparkrag.operators import chunking as C
from sparkrag.operators import embed as E
from sparkrag.operators import evaluation as V
from sparkrag.operators import ingest as G
from sparkrag.operators import keyword as K
from sparkrag.operators import retrieval as R
from sparkrag.operators import sections as P
from sparkrag.operators import tenancy as J
from sparkrag.operators import web as W
from sparkrag.settings import DEFAULTS


def test_scan_content(spark):
    mark = ("X5O!P%@AP[4\\PZX54(P^)7CC)7}$" + "EICAR-STANDARD-" + "ANTIVIRUS-TEST-FILE!$H+H*").encode()
    rows = [("a.md", b"# fine"), ("b.pdf", b"%PDF-1.4 \x00"), ("c.txt", b""), ("d.txt", mark), ("e.txt", b"x" * 5000 + mark), ("f.pdf", b"MZ\x90"), ("g", b"\x7fELF"), ("h.txt", b"a\x00b"), ("i.md", None)]
    got = {r["filename"]: r["scan_reason"] for r in G.scan_content(spark.createDataFrame(rows, "filename string, content binary")).collect()}
    assert got["a.md"] is None and got["b.pdf"] is None
    assert got["c.txt"] == got["i.md"] == "empty content"
    assert got["d.txt"] == got["e.txt"] == "malware test signature"
    assert "MZ" in got["f.pdf"] and "ELF" in got["g"] and "NUL" in got["h.txt"]


def test_dedup_and_replay(spark):
    held = spark.createDataFrame([("w", "c1", False), ("w", "c2", True)], "workspace_id string, checksum string, is_deleted boolean")
    new = spark.createDataFrame([("w", "c1", 1, 1), ("w", "c2", 2, 2), ("w", "c2", 3, 3), ("v", "c1", 4, 4)], "workspace_id string, checksum string, file_id int, arrived_at int")
    assert sorted(r["file_id"] for r in G.dedup_uploads(new, held).collect()) == [2, 4]
    req = spark.createDataFrame([(1, "e", "k", "h1", "first", 1), (1, "e", "k", "h2", "second", 2), (1, "e", None, "h", "a", 3), (1, "e", None, "h", "b", 4)], "user_id int, endpoint string, key string, request_hash string, response string, ts int")
    assert [r["answer"] for r in G.idempotent_replay(req).orderBy("ts").collect()] == ["first", "first", "a", "b"]
    assert G.conflicting_keys(req).count() == 1


def test_sections(spark):
    docs = spark.createDataFrame([(1, "x" * 15000), (2, "  \n "), (3, None), (4, "")], "doc_id int, text string")
    got = P.char_sections(docs).orderBy("sec_no").collect()
    assert [(r["locator_start"], r["locator_end"]) for r in got] == [(0, 4000), (4000, 8000), (8000, 12000), (12000, 15000)]
    rows = P.csv_sections(spark.createDataFrame([(1, '﻿a,b\n1,"x, y"\n2,z'), (2, "")], "doc_id int, text string")).collect()
    assert [(r["text"], r["locator_start"], r["locator_end"]) for r in rows] == [("a\tb\n1\tx, y\n2\tz", 1, 3)]
    good, failed = P.route_format(spark.createDataFrame([(1, "a.md", b"hi"), (2, "b.exe", b"x"), (3, "c", b"%PDF-"), (4, "d.html", b"<p>Hi<script>no</script></p>"), (5, "e.json", b'{"a":1}')], "doc_id int, filename string, content binary"))
    assert {r["doc_id"]: r["text"] for r in good.collect()} == {1: "hi", 4: "Hi", 5: '{\n  "a": 1\n}'}
    assert {r["doc_id"] for r in failed.collect()} == {2, 3}
    para = spark.createDataFrame([(1, 1, "A", True, False), (1, 2, "x", False, False), (1, 3, "B", True, False), (1, 4, " ", False, False), (1, 5, "y", False, False), (1, 6, "t", False, True)], "doc_id int, pos int, text string, is_heading boolean, is_table boolean")
    assert [r["text"] for r in P.heading_sections(para).orderBy("locator_start").collect()] == ["A\nx", "B\ny\nt"]


def _section(text, kind="char", a=0, b=0):
    return {"text": text, "locator_type": kind, "locator_start": a, "locator_end": b}


def test_chunking():
    tiny = C.pack_sections([_section("one"), _section("two"), _section("three")], 2048, 256)
    assert [c["content"] for c in tiny] == ["one\n\ntwo\n\nthree"]
    lines = "\n".join(f"line {i} " + "x" * 80 for i in range(60))
    many = C.pack_sections([_section(lines, "slide", 3, 3)], 2048, 256)
    assert len(many) > 1 and all(c["locator_type"] == "slide" and c["locator_start"] == 3 for c in many)
    for a, b in zip(many, many[1:], strict=False):
        tail = b["content"].split("\n")[0]
        assert tail in a["content"]
    assert C.pack_sections([_section("  "), _section("\n")], 2048, 256) == []
    assert len(C.pack_sections([_section("y" * 9000)], 2048, 256)) == 1


def test_chunking_covers_every_line():
    rng = random.Random(3)
    for _ in range(200):
        parts = ["w" * rng.randint(0, 40) + str(i) for i in range(rng.randint(1, 30))]
        out = C.pack_sections([_section("\n".join(parts))], 60, rng.randint(0, 50))
        seen = "\n".join(c["content"] for c in out)
        assert all(p in seen for p in parts)


def test_hash_embed(spark):
    texts = ["berapa hari cuti tahunan", "jumlah hari cuti tahunan adalah 12 hari kerja", "harga tiket pesawat murah ke bali", "yang dan"]
    v = [np.array(r["embedding"]) for r in E.hash_embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")).orderBy("i").collect()]
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6 and len(v[0]) == 384 and not v[3].any()
    assert v[0] @ v[1] > 0.4 and v[0] @ v[2] < 0.25


def test_dense_knn_matches_brute_force_and_tenants(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"w{i % 2}", [float(x) for x in rng.standard_normal(8)]) for i in range(200)] + [(900, "w0", [0.0] * 8)]
    c = spark.createDataFrame(rows, "chunk_id long, workspace_id string, embedding array<float>")
    q = spark.createDataFrame([(1, "w0", rows[5][2]), (2, "w1", rows[8][2])], "query_id int, workspace_id string, embedding array<float>")
    got = {}
    for r in R.dense_knn(q, c, 5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for qid, ws, v in ((1, "w0", rows[5][2]), (2, "w1", rows[8][2])):
        score = lambda x: max(0, round(float(np.dot(np.float32(x), np.float32(v)) / (np.linalg.norm(x) * np.linalg.norm(v) or 1)), 9))  # noqa: B023, E731
        assert got[qid] == [i for i, w, x in sorted((r for r in rows if r[1] == ws), key=lambda r: (-score(r[2]), r[0]))][:5]


def _list(spark, ids, score):
    return spark.createDataFrame([(1, i, s, n + 1) for n, (i, s) in enumerate(ids)], f"query_id int, chunk_id string, {score} double, rank int")


def test_fuse(spark):
    d, k = _list(spark, [("a", 0.9), ("b", 0.6)], "dense_score"), _list(spark, [("b", 1.0), ("c", 0.5)], "keyword_score")
    got = {r["chunk_id"]: r["score"] for r in R.fuse(d, k, 0.0).collect()}
    assert got == pytest.approx({"a": 0.54, "b": 0.40, "c": 0.4 * 61 / 62})
    merged = {r["chunk_id"]: r["score"] for r in R.fuse(d, k, 0.0, "merge").collect()}
    assert merged["b"] == pytest.approx(0.76)
    few = _list(spark, [("s", 0.8), ("t", 0.01)], "dense_score")
    assert [r["chunk_id"] for r in R.fuse(few, k.limit(0), 0.05).collect()] == ["s"]
    weak = _list(spark, [("t", 0.01)], "dense_score")
    assert [r["chunk_id"] for r in R.fallback_best(R.fuse(weak, k.limit(0)), weak, k.limit(0)).collect()] == ["t"]


def _hits(spark, rows, question):
    return spark.createDataFrame([(1, question, i, f"{i}.md", c, s, n + 1) for n, (i, c, s) in enumerate(rows)], "query_id int, question string, chunk_id string, filename string, content string, score double, rank int")


def _order(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_rerank(spark):
    rows = [("d", "biaya kantor karyawan", 0.9), ("t", "biaya kesehatan karyawan ditanggung perusahaan jaminan", 0.5)]
    assert _order(R.bm25_rerank(_hits(spark, rows, "biaya kesehatan"))) == ["t", "d"]
    assert _order(R.bm25_rerank(_hits(spark, rows, "dan yang untuk"))) == ["d", "t"]
    tail = [*rows, ("tail-a", "biaya kesehatan", 0.1), ("tail-b", "x", 0.1)]
    assert _order(R.bm25_rerank(_hits(spark, tail, "biaya kesehatan"), top_n=2)) == ["t", "d", "tail-a", "tail-b"]
    same = [(c, "cuti tahunan", 0.5) for c in "abc"]
    assert _order(R.bm25_rerank(_hits(spark, same, "cuti"))) == ["a", "b", "c"]


def test_rerank_matches_plain_rule(spark):
    rng = random.Random(1)
    words = ["biaya", "cuti", "gaji", "rapat", "kantor", "mobil"]
    rows = [(f"c{i:02d}", " ".join(rng.choices(words, k=rng.randint(1, 12))), rng.random()) for i in range(12)]
    terms = ["biaya", "cuti"]
    docs = [c.split() for _, c, _ in rows]
    avg = sum(map(len, docs)) / len(docs)
    bm = []
    for d in docs:
        total = 0.0
        for t in terms:
            df = sum(t in x for x in docs)
            if d.count(t):
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg))
        bm.append(total)
    final = [0.7 * b / max(bm) + 0.3 * s / max(x for _, _, x in rows) for b, (_, _, s) in zip(bm, rows, strict=True)]
    want = [rows[i][0] for i in sorted(range(12), key=lambda i: (-round(final[i], 12), i))]
    assert _order(R.bm25_rerank(_hits(spark, rows, "biaya cuti"))) == want


def test_confidence_and_extractive(spark):
    rows = [("a", "biaya gaji karyawan", 0.9), ("b", "biaya kantor operasional", 0.8), ("c", "premi asuransi jiwa", 0.7)]
    got = {r["chunk_id"]: r for r in R.lexical_confidence(_hits(spark, rows, "biaya premi")).collect()}
    assert got["c"]["confidence"] > got["a"]["confidence"] and got["a"]["total_terms"] == 2
    assert {r["confidence"] for r in R.lexical_confidence(_hits(spark, rows, "dan yang")).collect()} == {0.0}
    sure = [("a", "biaya premi asuransi " + "x" * 100, 0.9), ("b", "lain", 0.1)]
    text = A.extractive_answer(_hits(spark, sure, "biaya premi"), max_chars=50).first()["text"]
    assert len(text) <= 51 and text.endswith("…")
    twins = [("a", "biaya premi", 0.9), ("b", "biaya premi", 0.8)]
    assert A.extractive_answer(_hits(spark, twins, "biaya premi")).count() == 0


def test_contexts_and_routes(spark):
    rows = [("a", "x" * 4000, 0.9), ("b", "y" * 3000, 0.8), ("c", "z", 0.7)]
    assert _order(A.select_contexts(_hits(spark, rows, "q"))) == ["a"]
    hits = _hits(spark, [("a", "cuti 12 hari", 0.9)], "berapa cuti")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r["query_id"]: r["answer_kind"] for r in A.route_answers(asked, hits).collect()}
    assert got == {1: "grounded", 2: "no_answer"}
    none = _hits(spark, [("a", "lain sekali", 0.9)], "berapa cuti")
    one = asked.where("query_id = 1")
    assert A.route_answers(one, none).first()["answer_kind"] == "extractive"
    assert A.route_answers(one, none, on_no_answer="no_answer").first()["answer_kind"] == "no_answer"
    web = spark.createDataFrame([(1, "dari web")], "query_id int, text string")
    assert A.route_answers(one, none, web=web).first()["answer_kind"] == "grounded_web"


def test_isolation(spark):
    c = spark.createDataFrame([("x", "a", "f", "f.md", "cuti tahunan dua belas hari", "char", 0, 9)], "chunk_id string, workspace_id string, file_id string, filename string, content string, locator_type string, locator_start int, locator_end int")
    q = spark.createDataFrame([(1, "a", "cuti tahunan"), (2, "b", "cuti tahunan")], "query_id int, workspace_id string, question string")
    assert [r["query_id"] for r in R.retrieve(q, E.hash_embed(c)).collect()] == [1]
    assert R.retrieve(q, E.hash_embed(c), rewrite=True).count() == 1


def test_web(spark):
    html = '<a class="result__a" href="//r/?uddg=https%3A%2F%2Fa.org%2Fx">A <b>b</b></a><a class="result__snippet">S &amp; t</a><a class="result__a" href="https://b.org">B</a>'
    rss = "<rss><channel><item><title>T1</title><link>http://x.org</link><description>d</description></item><item><title>T2</title><link></link></item><item><link>http://y.org</link></item></channel></rss>"
    raw = [(1, "p", "html", html), (2, "p", "rss", rss), (3, "p", "rss", "<rss><channel><item>"), (4, "p", "json", '{"results":[{"title":"t","url":"http://z.org","content":"c"},{"url":"ftp://no"}]}'), (5, "p", "json", "{")]
    rows = W.parse_result_payloads(spark.createDataFrame(raw, "query_id int, provider string, format string, body string")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["url"], r["title"], r["snippet"]) for r in rows] == [
        (1, 1, "https://a.org/x", "A b", "S & t"), (1, 2, "https://b.org", "B", ""), (2, 1, "http://x.org", "T1", "d"), (2, 2, "http://y.org", "", ""), (4, 1, "http://z.org", "t", "c"),
    ]
    res = spark.createDataFrame([(1, "cuti karyawan", "a", 1, 1, "lain", "http://a", ""), (1, "cuti karyawan", "b", 2, 1, "cuti karyawan", "http://b", "")], "query_id int, query string, provider string, provider_order int, rank int, title string, url string, snippet string")
    scored = W.with_relevance(res)
    assert sorted(r["relevance"] for r in scored.collect()) == [0.0, 1.0]
    assert W.pick_provider(scored).first()["provider"] == "b"
    assert W.evidence_gate(scored, min_results=2).count() == 0


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "y"), (2, 2, "x"), (3, 1, "c")], "query_id int, rank int, filename string")
    q = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "query_id int, expected string")
    assert V.recall_at_k(hits, q, 5).first()[0] == 1.0 and V.recall_at_k(hits, q, 1).first()[0] == 0.5
    assert V.recall_at_k(hits, q.where("expected is null"), 5).first()[0] == 0.0
    assert V.mrr(hits, q).first()[0] == 0.75
    kinds = spark.createDataFrame([(1, "grounded"), (2, "no_answer"), (3, "no_answer")], "query_id int, answer_kind string")
    assert tuple(V.answer_rates(kinds, q).first()) == (1.0, 0.0, 0.5)
    four = spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "v double")
    assert tuple(V.percentiles(four, "v", (0, 50, 100)).first()) == (1.0, 2.5, 4.0)
    assert V.percentiles(four.limit(0), "v", (50,)).first()[0] == 0.0
    assert V.percentile_nearest(four, "v", 95).first()[0] == 4.0


def test_tenancy(spark):
    m = spark.createDataFrame([(1, "w", "viewer"), (2, "w", "admin")], "user_id int, workspace_id string, role string")
    r = spark.createDataFrame([(1, "w", "editor"), (2, "w", "editor"), (3, "w", "viewer")], "user_id int, workspace_id string, min_role string")
    assert [x["decision"] for x in J.access_decisions(r, m).orderBy("user_id").collect()] == ["forbidden", "allow", "not_found"]
    assert J.last_admin(m).first()["n_admins"] == 1


def test_replace_by_file_twice(spark):
    from sparkrag.sources.io import replace_by_file

    index = spark.createDataFrame([(1, "old"), (2, "old")], "file_id int, t string")
    fresh = spark.createDataFrame([(2, "new"), (3, "new")], "file_id int, t string")
    once = replace_by_file(index, fresh)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, replace_by_file(once, fresh).collect())) == [(1, "old"), (2, "new"), (3, "new")]


def test_ivf_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"w{i % 2}", [float(x) for x in rng.standard_normal(16) + 3 * (i % 5)]) for i in range(1200)]
    rows += [(2000, "w0", [0.0] * 16), (2001, "w0", None), (2002, "w1", [1.0])]
    c = spark.createDataFrame(rows, "chunk_id long, workspace_id string, embedding array<float>")
    q = c.where("chunk_id % 20 = 0 and chunk_id < 1200").withColumnRenamed("chunk_id", "query_id")
    index = N.ivf_index(c, lists=8, parts=8)
    codes = index.codes.collect()
    assert {r["chunk_id"] for r in codes} >= set(range(1200)) and all(len(r["code"]) == 8 for r in codes)
    read = N.shortlist(q, index, 40, probes=6)
    assert read.groupBy("query_id").count().agg(F.max("count")).first()[0] == 40  # full vectors read, of 600 in scope
    found, exact = N.ivf_knn(q, c, 10, index, probes=6, most=40), R.dense_knn(q, c, 10)
    assert N.recall_of(found, exact).first()["recall"] >= 0.9
    scores = {(r["query_id"], r["chunk_id"]): r["dense_score"] for r in exact.collect()}
    assert all(scores.get((r["query_id"], r["chunk_id"]), r["dense_score"]) == pytest.approx(r["dense_score"], abs=1e-9) for r in found.collect())
    assert N.ivf_knn(q, c.where("false")).count() == 0
    assert DEFAULTS.candidates == 24


def test_books_tell_vectors_apart():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 12))
    books = np.stack([N.fitted(N._cut(x, 4)[:, p], 64) for p in range(4)])
    codes = N.encoded(x, books)
    back = np.concatenate([books[p][codes[:, p]] for p in range(4)], axis=1)
    assert ((back - x) ** 2).sum() < 0.25 * (x**2).sum()
    plain = np.array([[((books[p] - N._cut(x[i : i + 1], 4)[0, p]) ** 2).sum(1).argmin() for p in range(4)] for i in range(50)])
    assert (plain == codes[:50]).all()


def _plain_keyword(docs, text, k):
    tokens = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1]
    asked = tokens(text)
    weights = {}
    for i, body in docs:
        own = tokens(body)
        w = sum(round(sum(1 / (j * j) for j in range(1, own.count(t) + 1)), 9) for t in set(asked) if t in own)
        if w or any(asked[0] in t for t in own):
            weights[i] = round(w, 6)
    best = sorted((-w, i) for i, w in weights.items())[:k]
    top = max((-w for w, _ in best), default=0)
    return [(i, pytest.approx(-w / top if top else 0.0, abs=1e-6), n) for n, (w, i) in enumerate(best, 1)]


@pytest.mark.parametrize("head", [3, 256])
def test_keyword_search_is_that_of_all_pairs(spark, head):
    rng = random.Random(head)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    chunks = spark.createDataFrame([(i, f"ws{i % 2}", t) for i, t in docs] + [(900, "ws0", None)], "chunk_id long, workspace_id string, content string")
    asked = [(n, f"ws{n % 2}", " ".join(dict.fromkeys(rng.choices(words, k=rng.randint(1, 25))))) for n in range(30)] + [(50, "ws0", ""), (51, "ws1", "zzz"), (52, "ws0", "w1 w1 w2"), (53, "none", "w1"), (54, "ws1", None), (55, "ws0", "1")]
    queries = spark.createDataFrame(asked, "query_id long, workspace_id string, question string")
    index = K.keyword_index(chunks, head)
    for probe in (0, 6):
        got = {}
        for r in K.keyword_search(queries, index, 5, probe).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["keyword_score"], r["rank"]))
        for n, ws, text in asked:
            want = _plain_keyword([(i, t) for i, t in docs if f"ws{i % 2}" == ws], text, 5) if text and len(text) > 1 else []
            assert got.get(n, []) == want, (n, probe)


def test_keyword_search_joins_few_postings(spark):
    """Of a common token's postings none are joined if the rare tokens lead to enough chunks."""
    docs = [(i, "ws", "common words here " + ("rare thing seldom" if i < 10 else f"other{i}")) for i in range(500)]
    index = K.keyword_index(spark.createDataFrame(docs, "chunk_id long, workspace_id string, content string"))
    terms = spark.createDataFrame([(1, "ws", t) for t in ("common", "words", "rare", "thing", "seldom")], "query_id long, workspace_id string, token string")
    found = K.token_scores(terms, index, 5)
    assert {r["chunk_id"] for r in found.collect()} == set(range(10))


def test_percentiles_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(V, "BINS", 4)
    monkeypatch.setattr(V, "SORTED", 3)
    rng = random.Random(6)
    groups = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [5.0] * 50 + [1.0], "c": [2.0], "d": [], None: [10.0 ** rng.randrange(-8, 9) for _ in range(80)], "e": [1.0, 1.0, 1.0, 1.0, 1e300, -1e300]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None), ("c", math.nan)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in V.percentiles(df, "x", (0, 10, 50, 95, 100), ("g",)).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for p in (0, 10, 50, 95, 100):
            assert got[g][f"p{p}"] == pytest.approx(np.percentile(vs, p) if vs else 0.0, rel=1e-9, abs=1e-12), (g, p)
    near = {r["g"]: r["nearest_p90"] for r in V.percentile_nearest(df, "x", 90, ("g",)).collect()}
    assert near == {g: sorted(vs)[min(len(vs) * 90 // 100, len(vs) - 1)] for g, vs in groups.items() if vs}
    assert V.percentiles(df.where("g = 'a'"), "x").first()["p50"] == pytest.approx(np.percentile(groups["a"], 50))
    assert V.percentiles(df.where("false"), "x").collect()[0].asDict() == {"p50": 0.0, "p95": 0.0}
    assert V.percentile_nearest(df.where("g = 'b'"), "x", 50).first()[0] == 5.0


def test_settings_are_compared_on_the_same_candidates(spark):
    dense = spark.createDataFrame([(q, c, 1.0 / (c + 1), c + 1) for q in range(40) for c in range(4)], "query_id long, chunk_id long, dense_score double, rank int")
    words = spark.createDataFrame([(q, 3 + c, 1.0, c + 1) for q in range(40) for c in range(3)], "query_id long, chunk_id long, keyword_score double, rank int")
    settings = [("base", 0.6, 0.4, 60, 0.05, 3), ("words", 0.0, 1.0, 60, 0.05, 3), ("same", 0.6, 0.4, 60, 0.05, 3)]
    hits = V.fused_by_settings(dense, words, settings).withColumn("filename", F.concat(F.lit("f"), F.col("chunk_id").cast("string")))
    plain = R.fuse(dense, words).where("rank <= 3").select("query_id", "chunk_id", "rank")
    assert sorted(map(tuple, hits.where("setting = 'base'").select("query_id", "chunk_id", "rank").collect())) == sorted(map(tuple, plain.collect()))
    queries = spark.createDataFrame([(q, "f0" if q % 4 else "f3") for q in range(39)] + [(39, None)], "query_id long, expected string")
    out = {(r["setting"], r["metric"]): r for r in V.compare_settings(V.positions_by_settings(hits, queries, [s[0] for s in settings]), "base").collect()}
    assert len(out) == 9
    for metric in ("recall_at_k", "mrr", "citation_correctness"):
        same = out["same", metric]
        assert same["delta"] == same["low"] == same["high"] == 0 and same["value"] == out["base", metric]["value"]
    worse = out["words", "citation_correctness"]
    assert worse["value"] == pytest.approx(10 / 39) and worse["delta"] == pytest.approx(10 / 39 - 29 / 39) and worse["low"] < worse["delta"] < worse["high"] < 0


def test_own_sectioner(spark):
    def lines(name, body):
        if name == "types.md":
            return [("x", "line", "no number", 1)]
        return [(t, "line", i, i + 1) for i, t in enumerate(body.decode().split("\n"))]

    rows = [(1, "a.md", b"one\n \ntwo"), (2, "b.md", b"\xff"), (3, "types.md", b"x"), (4, None, None), (None, "c.md", b"z")]
    good, bad = P.sections(spark.createDataFrame(rows, "doc_id long, filename string, content binary"), lines)
    assert sorted(map(repr, (tuple(r) for r in good.collect()))) == sorted(map(repr, [(1, 0, "one", "line", 0, 1), (1, 1, "two", "line", 2, 3), (None, 0, "z", "line", 0, 1)]))
    errors = {r["doc_id"]: r["error"] for r in bad.collect()}
    assert set(errors) == {2, 3} and errors[2].startswith("UnicodeDecodeError")
