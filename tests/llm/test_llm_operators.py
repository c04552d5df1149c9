"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with the odd cases:
nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import html
import random
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrag.llm import byte_cnn, chat, common, components, html_extract, media, minhash, packing, pieces, suffix_dedup, toxicity, voronoi
from sparkrag.llm.tokens import ByteBpe

DOCS = "doc_id long, text string, score double, node long, bands string"


def documents(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, 0.5, 7, "x") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (None, "null id"), (5, "word " * 30_000)]


# 1 SentencePiece


def _best(text, scores, unknown):
    """Plain dynamic programming over all substrings."""
    best = [(0.0, [])] + [(-1e18, [])] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            s = scores.get(piece, unknown if end - start == 1 else None)
            if s is not None and best[start][0] + s > best[end][0]:
                best[end] = best[start][0] + s, [*best[start][1], piece]
    return best[-1]


def test_viterbi_is_optimal():
    rng = random.Random(1)
    model = [("<unk>", 0.0, pieces.UNK)] + [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    texts = {"".join(rng.choices("abc▁", k=rng.randint(1, 4))) for _ in range(60)} | {"a", "b", "▁"}
    model += [(t, -rng.random() * 10, pieces.NORMAL) for t in sorted(texts)]
    scores = {p: s for p, s, k in model if k == pieces.NORMAL}
    m = pieces.PieceModel(pieces=model, prefix=False)
    for _ in range(300):
        text = "".join(rng.choices("abcd é", k=rng.randint(0, 20)))
        ids = np.frombuffer(m.encode(text), "<u4").tolist()
        marked = text.replace(" ", "▁")
        total = sum(model[i][1] for i in ids if model[i][2] == pieces.NORMAL) + m.unknown * sum(c not in scores for c in marked)
        assert total == pytest.approx(_best(marked, scores, m.unknown)[0])
        assert m.decode(m.encode(text)) == text


def test_pieces_round_trip(spark):
    rows = [(10, "Hello  world\n\n日本 é "), (11, " lead"), (12, "x" * 5000), *ODD]
    done = pieces.encode_pieces(documents(spark, rows)).collect()
    assert len(done) == len(rows) and all(r["restored"] for r in done)
    assert {r["n_pieces"] for r in done if r["doc_id"] in (1, 2)} == {0}
    back = pieces.decode_pieces(pieces.encode_pieces(documents(spark, rows)))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(repr, ((i, t or "") for i, t in rows)))
    assert pieces.encode_pieces(documents(spark, []), with_ids=False).count() == 0


def test_piece_query_returns_ids(spark, tmp_path):
    from sparkrag.llm.queries import op1_sentencepiece

    rows = [(10, "Hello  world\n\n日本 é "), (11, " lead"), (12, "x" * 5000), *ODD]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    done = op1_sentencepiece(spark, str(tmp_path)).collect()
    model = pieces.piece_model()
    want = sorted(repr((i, np.frombuffer(model.encode(t or ""), "<u4").tolist())) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["ids"])) for r in done) == want
    assert all(r["restored"] and r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in done)


def test_long_run_without_a_cut():
    """One unit of 200,000 characters, against the same model in short parts that can be cut nowhere else."""
    model = pieces.PieceModel(pieces=[("<unk>", 0.0, pieces.UNK), ("a", -1.0, pieces.NORMAL), ("aa", -1.5, pieces.NORMAL), ("aaa", -3.0, pieces.NORMAL)], prefix=False)
    ids = np.frombuffer(model.encode("a" * 200_001), "<u4")
    assert len(ids) == 100_001 and sorted(np.bincount(ids).tolist()) == [0, 1, 100_000]


def _each(model, texts):
    ids, ends = model.encode_all(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True)]


@pytest.mark.parametrize("spelt", [True, False])
def test_units_side_by_side_are_segmented_as_alone(spelt):
    """Many units at once against the plain pass over each whole text; scores are eighths, so sums are exact and ties frequent."""
    rng = random.Random(2)
    model = [("<unk>", 0.0, pieces.UNK)] + [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256) if spelt]
    texts = {"▁" * rng.randint(0, 1) + "".join(rng.choices("abcé日", k=rng.randint(1, 4))) for _ in range(60)}
    m = pieces.PieceModel(pieces=model + [(t, -rng.randint(1, 60) / 8, pieces.NORMAL) for t in sorted(texts)])
    assert m.by_word
    rows = ["".join(rng.choices("abcé日é▁😀\n ", (9, 9, 9, 3, 3, 1, 1, 1, 1, rng.choice([0, 9])), k=rng.randint(0, 150))) for _ in range(600)]
    rows += [None, "", " ", "  a", "a" * 63, "a" * 64, "ab" * 100, "日\n" * 100]
    alone = [np.frombuffer(m._solve("▁" + t.replace(" ", "▁")), "<u4").tolist() if t else [] for t in rows]
    assert _each(m, rows) == alone and _each(m, []) == []
    assert [np.frombuffer(m.encode(t or ""), "<u4").tolist() for t in rows[:100]] == alone[:100]


def test_equal_units_of_many_texts_are_solved_once_and_together(monkeypatch):
    """5000 different words in 200 texts, each 20 times: no pass of its own for any, and no word twice."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("etaoinshr", k=rng.randint(3, 12))) for _ in range(5000)})
    texts = [" ".join(rng.sample(words, 500)) for _ in range(200)]
    model, plain, seen = pieces.PieceModel(), pieces.Arrays.viterbi, []
    want = [np.frombuffer(model.encode(t), "<u4").tolist() for t in texts]
    monkeypatch.setattr(pieces.Arrays, "viterbi", lambda self, points, n, unknown: seen.append(len(n)) or plain(self, points, n, unknown))
    monkeypatch.setattr(pieces.Automaton, "viterbi", lambda *a: pytest.fail("a short word went through alone"))
    assert _each(model, texts) == want
    assert sum(seen) <= len(words) and len(seen) <= 2


def test_a_text_with_the_mark_is_not_restored(spark):
    done = pieces.encode_pieces(documents(spark, [(1, "a b"), (2, "a▁b")])).collect()
    assert {r["doc_id"]: r["restored"] for r in done} == {1: True, 2: False}


def test_restored_is_told_from_the_ids(spark, monkeypatch):
    """With a decoder that spoils the ids, nothing but empty texts is restored."""
    plain = pieces.decode_pieces
    monkeypatch.setattr(pieces, "decode_pieces", lambda rows, *a, **k: plain(rows.withColumn("ids", F.slice("ids", 2, 1 << 30)), *a, **k))
    done = pieces.encode_pieces(documents(spark, [(1, "some words"), (2, "")])).collect()
    assert {r["doc_id"]: r["restored"] for r in done} == {1: False, 2: True}


# 2 top-k


def _brute_top(rows, every, k):
    clean = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    clean = list({(i, tuple(v)) for i, v in clean})
    out = []
    for i, q in clean:
        if i % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in clean if j != i))[:k]
            out += [(i, n + 1, j, -t) for n, (t, j) in enumerate(s)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    hot = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, [float(x) for x in rng.standard_normal(4) + 4 * (i % 3)]) for i in range(300)]
    rows += [(i, hot) for i in range(300, 420)]  # one vector shared by many
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan"), 0.0, 0.0, 0.0]), (503, [float("inf")] * 4), (None, hot), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    for how in ({}, {"pivots": 12, "block": 50}):
        got = sorted(tuple(r) for r in voronoi.top_k(df, every=10, **how).collect())
        assert got == _brute_top(rows, 10, 5)
    longer = [(600 + i, [float(x) for x in rng.standard_normal(6)]) for i in range(25)]
    mixed = df.unionByName(spark.createDataFrame([(i, v, 1) for i, v in longer], "vec_id long, embedding array<float>, score int"))
    want = sorted(_brute_top(rows, 10, 5) + _brute_top(longer, 10, 5))
    assert sorted(tuple(r) for r in voronoi.top_k(mixed, every=10, pivots=12, block=50).collect()) == want
    many = [(i, [float(x) for x in rng.standard_normal(i % (2 * voronoi.MOST_LENGTHS + 5) + 1)]) for i in range(700)]  # most lengths have no pivot
    want = sorted(t for n in range(1, 2 * voronoi.MOST_LENGTHS + 6) for t in _brute_top([r for r in many if len(r[1]) == n], 10, 5))
    assert sorted(tuple(r) for r in voronoi.top_k(spark.createDataFrame(many, "vec_id long, embedding array<float>"), every=10, block=3).collect()) == want
    few = df.where("vec_id in (10, 11, 12)")
    assert voronoi.top_k(few, every=10).count() == 2
    assert voronoi.top_k(df.limit(0)).count() == 0


# 3 and 6 classifiers


def _labelled(n=600):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("aeioutnshr", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        junk, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilemost", "vilewort", "grotsch", "grotlin"])
        text = " ".join(words)
        rows.append((i, (text.upper().replace(" ", "!! ") if junk else text), int(not junk), int(toxic)))
    return rows


def test_quality_classifier(spark):
    rows = _labelled()
    docs = documents(spark, [(i, t) for i, t, _, _ in rows] + [(9000 + i if i else None, t) for i, t in ODD])
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = byte_cnn.fit_quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in byte_cnn.score_documents(docs, model).collect()}
    held = [(i, q) for i, _, q, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, q in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert len(got) == len(rows) + len({i for i, _ in ODD}) and got[9001] == got[9002]
    kept = byte_cnn.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x >= 0.3}
    assert byte_cnn.score_documents(docs.limit(0), model).count() == 0 and byte_cnn.keep_good(docs.limit(0), model).count() == 0
    assert byte_cnn.fit_quality(docs, labels.limit(0)).score(b"x") == 0.5


def _plain_pooled(net, raw):
    """The convolution and the pooling written out: every response of every chunk, a position at a time."""
    n, out = max(1, len(raw)), []
    data = np.frombuffer(raw or b"\0", np.uint8)
    codes = byte_cnn.repeat_codes(data)
    for start in range(0, max(1, n - byte_cnn.STRIDE), byte_cnn.STRIDE):
        best = np.full(byte_cnn.FILTERS, -np.inf)
        for p in range(start, min(n, start + byte_cnn.CHUNK)):
            z = net.bias + net.conv[0, 256 + int(codes[p])].astype(float)
            for k in range(byte_cnn.WIDTH):
                z = z + net.conv[k, int(data[p + k]) if p + k < n else 0]
            best = np.maximum(best, z)
        out.append(np.maximum(best, 0))
    return np.array(out)


@pytest.mark.parametrize("n", [0, 1, 7, 255, 256, 257, 512, 513, 1500])
def test_pooling_matches_the_plain_convolution(n, monkeypatch):
    net, raw = byte_cnn.ByteCnn(), bytes(random.Random(n).choices(range(32, 60), k=n))
    want = _plain_pooled(net, raw)
    assert np.allclose(net.pooled(raw), want, atol=1e-4)
    monkeypatch.setattr(byte_cnn, "SPAN", 2 * byte_cnn.STRIDE)
    assert np.allclose(net.pooled(raw), want, atol=1e-4)
    z = np.concatenate([want.max(axis=0), want.mean(axis=0)]) @ net.head + net.shift
    assert net.score(raw) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_gradients_match_differences():
    net, raw, label = byte_cnn.ByteCnn(), bytes(random.Random(2).choices(range(32, 60), k=900)), 1.0
    net.bias += 0.3
    for name in ("conv", "bias", "head"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    loss = lambda: -np.log(net.score(raw))
    grads = [np.zeros_like(net.conv), np.zeros_like(net.bias), np.zeros_like(net.head)]
    net._backward(np.frombuffer(raw, np.uint8), label, grads)
    rng = np.random.default_rng(0)
    for weights, grad in zip((net.conv, net.bias, net.head), grads, strict=True):
        moved = np.argwhere(np.abs(grad) > 1e-4)
        for at in map(tuple, rng.permutation(moved)[:12]):
            old = weights[at]
            weights[at] = old + 1e-5
            up = loss()
            weights[at] = old - 1e-5
            down = loss()
            weights[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-5, rel=0.02, abs=1e-5)


def test_sample_takes_whole_long_texts(spark):
    """The draw comes after the join, so labels without a document cost nothing, and long texts count."""
    docs = documents(spark, [(i, "x" * (100_000 if i % 2 else 10)) for i in range(40)] + [(3, "x" * 100_000), (50, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)] + [(None, 1), (1, None), (50, 1)], "doc_id long, quality int")
    ids = common.training_ids(docs, labels, {"label": "quality"}, 20)
    rows = common.training_rows(docs, ids, 20).collect()
    assert len(rows) == 20 and sum(r["label"] for r in rows) >= 9
    assert all(len(r["text"]) == (100_000 if r["doc_id"] % 2 else 10) and zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_toxicity_chain(spark):
    rows = _labelled(900)
    docs = documents(spark, [(i, t) for i, t, _, _ in rows] + [(9000 + i if i else None, t) for i, t in ODD])
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_toxicity(docs, labels)
    assert chain.categories == ["junk", "toxic"] and len(chain.models[1].rest) == 2
    scored = toxicity.score_toxicity(docs, chain).collect()
    got = {r["doc_id"]: r["is_toxic"] for r in scored}
    held = [(i, t) for i, _, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] for i, t in held if t]) > 0.9 and np.mean([got[i] for i, t in held if not t]) < 0.05
    assert len(scored) == len(rows) + len(ODD)
    odd = [r for r in scored if r["doc_id"] is None or r["doc_id"] >= 9000]
    assert len(odd) == len(ODD) and all(0 <= r["p_toxic"] <= 1 and not r["is_toxic"] for r in odd)
    null, empty = (next(r for r in odd if r["doc_id"] == 9000 + i) for i in (1, 2))
    assert (null["p_junk"], null["p_toxic"]) == (empty["p_junk"], empty["p_toxic"])
    assert toxicity.score_toxicity(docs.limit(0), chain).count() == 0
    kept = toxicity.drop_flagged(docs, chain)
    assert kept.columns == docs.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, (r["doc_id"] for r in scored if not r["is_toxic"])))
    one_sided = toxicity.fit_toxicity(docs, labels.where("toxic = 0"))
    assert set(one_sided.predict([toxicity.features(b"any text")])[:, 1]) == {0.0}


def _plain_logistic(x, y, steps=4000, rate=1.0, ridge=1e-4):
    """Gradient descent on a dense matrix whose last columns aren't shrunk."""
    w, free = np.zeros(x.shape[1]), 1 + 2
    for _ in range(steps):
        off = (1 / (1 + np.exp(-x @ w)) - y) / len(y)
        shrink = ridge * w
        shrink[-free:] = 0
        w -= rate * (x.T @ off + shrink)
    return w


def test_chain_of_three_categories_is_the_plain_chain():
    """Insult, threat, toxic: each model sees the earlier categories' out-of-fold probabilities, and nothing else of them."""
    rng = random.Random(3)
    docs, marks = [], []
    for _ in range(400):
        insult, threat = rng.random() < 0.3, rng.random() < 0.2
        words = rng.choices([f"w{i}" for i in range(60)], k=20) + ["fool"] * (insult and rng.random() < 0.9) + ["beware"] * (threat and rng.random() < 0.9)
        docs.append(toxicity.features(" ".join(words).encode()))
        marks.append((int(insult), int(threat), int(insult or threat)))
    labels = pd.DataFrame(marks, columns=["insult", "threat", "toxic"])
    chain = toxicity.fit_chain(docs, labels, list(labels.columns))
    assert [len(m.rest) for m in chain.models] == [1, 2, 3]
    # the inputs of the last model, made again plainly: fold f is predicted by models that never saw it
    fold, earlier = np.arange(len(docs)) % toxicity.FOLDS, np.zeros((len(docs), 0))
    for category in ("insult", "threat"):
        y, unseen = labels[category].to_numpy(float), np.zeros(len(docs))
        for f in range(toxicity.FOLDS):
            rest = np.flatnonzero(fold != f)
            model = toxicity.Linear.fit([docs[i] for i in rest], earlier[rest], y[rest])
            for i in np.flatnonzero(fold == f):
                unseen[i] = model.predict([docs[i]], earlier[i : i + 1])[0]
        earlier = np.column_stack([earlier, unseen])
    last, y = chain.models[2], labels["toxic"].to_numpy(float)
    again = toxicity.Linear.fit(docs, earlier, y)
    assert np.allclose(last.rest, again.rest) and np.allclose(last.weights, again.weights)
    dense = np.zeros((len(docs), len(last.kept)))
    for i, d in enumerate(docs):
        dense[i, np.isin(last.kept, d)] = 1
    want = _plain_logistic(np.column_stack([dense, np.ones(len(docs)), earlier]), y)
    z = np.column_stack([dense, np.ones(len(docs)), earlier]) @ want
    assert np.corrcoef(z, np.log(last.predict(docs, earlier) / (1 - last.predict(docs, earlier))))[0, 1] > 0.98
    got = chain.predict(docs)
    assert got.shape == (400, 3) and np.mean((got[:, 2] >= chain.levels[2]) == y) > 0.9


# 4 suffix arrays


def _brute_repeats(rows, width, keep_first):
    first, count = {}, collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(raw, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p in range(len(b) - width + 1):
            count[b[p : p + width]] += 1
            first.setdefault(b[p : p + width], (i, p))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if first[w] != (i, p) if keep_first else count[w] > 1:
                gone[p : p + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(0, 250)))
    base, rows = [make() for _ in range(6)], []
    for i in range(60):
        t, k = make(), rng.random()
        if k < 0.4:
            b = rng.choice(base)
            a = rng.randint(0, max(0, len(b) - 1))
            t = t[:50] + b[a : a + rng.randint(10, 200)] + t[50:]
        elif k < 0.5:
            t = rng.choice(base)
        elif k < 0.6:
            t = "xyz " * rng.randint(1, 40) + t
        rows.append((i, t))
    return [*rows, (100, None), (101, ""), (None, base[0]), (102, base[1])]


@pytest.mark.parametrize(("contexts", "keep_first"), [(1000, False), (1000, True), (2, True)])
def test_repeats(spark, passages, contexts, keep_first):
    got = suffix_dedup.digests(documents(spark, passages), keep_first=keep_first, width=20, gram=8, contexts=contexts)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute_repeats(passages, 20, keep_first)


@pytest.mark.parametrize("contexts", [1000, 2])
def test_repeats_of_repeated_rows(spark, passages, contexts):
    """Rows that repeat id and text keep alike."""
    rows = [*passages, *passages[::2], *passages[-2:]]
    got = suffix_dedup.digests(documents(spark, rows), keep_first=True, width=20, gram=8, contexts=contexts)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute_repeats(rows, 20, True)


def test_cutting_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x" * 300, 1, [2], "s"), (2, "x" * 300 + "y", 3, None, "t")], "doc_id long, text string, a int, spans array<int>, row string")
    got = sorted(suffix_dedup.remove_repeats(docs).collect())
    assert [(r["doc_id"], r["a"], r["spans"], r["row"]) for r in got] == [(1, 1, [2], "s"), (2, 3, None, "t")] and got[1]["text"] == "y"


def test_repeats_odd_cases(spark):
    docs = documents(spark, ODD)
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(ODD)
    assert {r["text"] for r in got.where("doc_id = 1").collect()} == {None}
    assert suffix_dedup.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 6, 8, 20, 33])
def test_longest_factors_match_plain_lpf(width):
    """Plain longest previous and next factors, over all pairs of suffixes."""
    rng = random.Random(width)
    for trial in range(25):
        text = bytes(rng.choices(b"ab", k=90))
        at = [p for p in range(90 - width) if trial % 2 or rng.random() < 0.6]
        previous, following = suffix_dedup.longest_factors(np.frombuffer(text, np.uint8), np.array(at), width)
        common = lambda p, q: next((k for k in range(width) if text[p + k] != text[q + k]), width)
        for i, p in enumerate(at):
            before, after = (max((common(p, q) for q in part), default=0) for part in (at[:i], at[i + 1 :]))
            assert (previous[i], following[i]) == (before if before == width else 0, after if after == width else 0)


def test_runs_of_parts():
    rng = random.Random(11)
    for _ in range(40):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        flags = np.array([rng.random() < 0.6 for _ in range(sum(sizes))])
        first = np.cumsum([0, *sizes])[:-1]
        want = []
        for a, n in zip(first.tolist(), sizes, strict=True):
            part, runs = flags[a : a + n].tolist(), []
            for i, f in enumerate(part):
                if f and (i == 0 or not part[i - 1]):
                    runs.append({"lo": i, "hi": i + 1})
                elif f:
                    runs[-1]["hi"] = i + 1
            want.append(runs)
        assert suffix_dedup.runs_of(flags, first).to_pylist() == want


def test_factors_of_a_suffix_that_stands_twice():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    previous, following = suffix_dedup.longest_factors(data, np.array([0, 1, 2, 1]), 5)
    assert previous.tolist() == [0, 0, 0, 5] and following.tolist() == [0, 5, 0, 0]


def test_suffix_order_is_sorted():
    data = np.frombuffer(bytes(random.Random(4).choices(b"abc", k=3000)), np.uint8)
    at = np.arange(0, 2900)
    order, common = suffix_dedup.suffix_order(data, at, 50)
    cut = [data[p : p + 50].tobytes() for p in at[order]]
    assert cut == sorted(cut) and common.tolist() == [0, *(50 * (a == b) for a, b in zip(cut[:-1], cut[1:], strict=True))]


def test_fingerprints_in_pieces_find_the_same_strings():
    data = np.frombuffer(bytes(random.Random(3).choices(b"abcdef", k=5000)), np.uint8)
    old = suffix_dedup.PIECE
    flat = lambda f: {s + i: int(h) for h, s, n in zip(f[0], f[2].tolist(), f[3].tolist(), strict=True) for i in range(n)}
    whole = flat(suffix_dedup.fingerprints(data))
    try:
        suffix_dedup.PIECE = 700
        assert flat(suffix_dedup.fingerprints(data)) == whole and len(whole) == 4801
    finally:
        suffix_dedup.PIECE = old


# 5 pages


def test_main_text(spark):
    nav = "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav>"
    page = lambda body: f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{nav}<!-- c --><div class='ad'>Buy</div>{body}<footer>&copy;</footer></body></html>"
    rows = [
        (1, "http://a.org/1", page("<article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>Four</p><aside>no</aside><section class='comments'><p>reader</p></section><form>f</form></article>")),
        (2, "http://a.org/2", None), (3, None, ""), (4, "http://a.org/4", "plain &lt;text&gt;"), (5, "x", page("<main><p>m</p></main>")), (1, "http://a.org/1", page("<article><p>again</p></article>")),
    ]
    # a site without article tags, with a banner that recurs
    rows += [(10 + i, "http://b.org/p", f"<body><div><p>Same banner text</p></div><div><p>Story {i}</p></div></body>") for i in range(8)]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df).collect())
    want = [(1, "Head & more One two three Four"), (1, "again"), (2, ""), (3, ""), (4, "plain <text>"), (5, "m"), *((10 + i, f"Story {i}") for i in range(8))]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
    assert html.unescape("&copy;") == "©"


def test_template_alone_decides(spark):
    """Blocks without any listed tag, role or class: outside an article, inside one, and in pages without one.
    The counts are held against a plain dictionary over the hosts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    note, box, tail = "<div class=x><p>Read our terms</p></div>", "<div class=y><ul><li>Same links</li></ul></div>", "<section><p>All rights kept</p></section>"
    shared, pages = "<p>A passage that articles share</p>", []
    for host, n in (("one.org", 24), ("two.org", 6), ("few.org", 3)):
        for i in range(n):
            own = f"<p>{word()} {word()}</p>"
            some = box if i % 2 == 0 else "<div><p>" + word() + "</p></div>"
            body = f"<body>{note}<article><h1>{word()}</h1>{shared}{some}{own}{tail}</article></body>" if i % 3 else f"<body>{note}<div>{own}</div>{tail}</body>"
            pages.append((len(pages), f"http://{host}/{i}", body))
    # copies of one page don't make a template
    pages += [(1000 + i, "http://copy.org/a", "<article><div><p>Only once said</p></div><p>end</p></article>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}

    seen, contents, own = collections.defaultdict(set), collections.defaultdict(set), {}
    for i, url, body in pages:
        host, elements = url.split("/")[2], html_extract.parse(body)
        html_extract.digest(elements)
        content, own[i] = html_extract.template_candidates(elements)
        contents[host].add(content)
        for h, inside in own[i].items():
            seen[host, h, inside].add(content)
    for i, url, body in pages:
        host = url.split("/")[2]
        level = lambda inside: html_extract.INNER_SHARE if inside else html_extract.MIN_SHARE
        template = {h for h, inside in own[i].items() if len(seen[host, h, inside]) >= max(html_extract.MIN_PAGES, level(inside) * len(contents[host]))}  # noqa: B023
        assert got[i]["n_template"] == len(template) and got[i]["text"] == html_extract.main_text(body, template)
    text = lambda i: got[i]["text"]
    assert "terms" not in text(0) and "rights" not in text(0)  # no article: the body without its template
    assert "links" not in text(2) and "rights" not in text(2) and "A passage that articles share" in text(2)
    assert "rights" in text(31) and "A passage" in text(31)  # three pages make no template
    assert all(text(1000 + i) == "Only once said end" for i in range(12))
    changed = sum(got[i]["text"] != html_extract.main_text(body, set()) for i, _, body in pages)
    assert changed >= 24


def test_deep_and_unclosed_pages():
    n = 100_000
    assert html_extract.main_text("<div>" * n + "deep" + "</div>" * n, set()) == "deep"
    assert html_extract.main_text("<b>" * n + "deep</i>" * 3, set()) == "deepdeepdeep"
    began = time.time()
    for page in ("<a '" * n, "<a '" * n + ">", '<a "x>y" ' * n, "<!" * n, "<p><div>" + "<b>" * n + "<hr>" * n, "<x>" * n + "</y>" * n, "<!--" * n, "<script>" * n):
        elements = html_extract.parse(page)
        html_extract.digest(elements)
        html_extract.template_candidates(elements)
        html_extract.main_text(page, set())
    assert time.time() - began < 120  # quadratic time would be hours
    assert html_extract.main_text("<p title='a>b'>x</p><p title='>y</p><p>z</p>", set()) == "x y z"


def test_class_names_count_as_wholes():
    body = "<article><p class='ad-free lead'>a</p><div id='related-work'>b</div><div class=share-price>c</div><section class='comments-on-law'>d</section>{}<p>e</p></article>"
    for gone in ("<div class='ad'>x</div>", "<div class='post comments-list'>x</div>", "<div id=ad_box>x</div>", "<div role='navigation'>x</div>", "<div class='cookie-notice'>x</div>", "<aside>x</aside>"):
        assert html_extract.main_text(body.format(gone), set()) == "a b c d e"


# 7 media


def _plain_log_mel(samples):
    """Resampling, windows and the Fourier transform written out as sums."""
    x = (samples.astype(float) - 128) / 128
    total = (len(x) * media.UP + media.DOWN - 1) // media.DOWN
    taps = media._PHASES.astype(float)
    y = []
    for i in range(total):
        at, phase = i * media.DOWN // media.UP, i * media.DOWN % media.UP
        y.append(sum(taps[phase][k] * x[j] for k in range(media.TAPS) if 0 <= (j := at - media.TAPS + 1 + k) < len(x)))
    n = max(1, -(-(len(y) - media.FRAME) // media.HOP) + 1)
    y = np.concatenate([y, np.zeros(n * media.HOP + media.FRAME)])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FFT // 2 + 1), np.arange(media.FRAME)) / media.FFT)
    frames = np.array([y[i * media.HOP : i * media.HOP + media.FRAME] * np.hanning(media.FRAME) for i in range(n)])
    return np.log(np.abs(frames @ turn.T) ** 2 @ media._MEL.astype(float) + 1e-6)


@pytest.mark.parametrize("n", [576, 1152, 5760])
def test_features_match_a_plain_transform(n):
    samples = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    got, want = media.log_mel(samples), _plain_log_mel(samples)
    assert got.shape == want.shape and np.allclose(got, want, atol=2e-3)
    mel, start, end = media.read_tensors(media.tensor_ipc(got))
    assert np.array_equal(mel, got) and len(start) == -(-len(got) // media.FRAMES)
    assert start[0] == 0 and all(a < b for a, b in zip(start, end, strict=True))
    assert end[-1] == pytest.approx(((len(got) - 1) * media.HOP + media.FRAME) / media.RATE_OUT)


def test_segments_have_hysteresis():
    """A plain state machine: on from the upper level, off below the lower one."""
    rng = random.Random(12)
    for _ in range(50):
        energy = np.array([rng.gauss(0, 1) for _ in range(rng.randint(1, 60))])
        low, high = np.sort(energy)[[int(0.4 * (len(energy) - 1)), int(0.7 * (len(energy) - 1))]]
        want, start = [], None
        for i, e in enumerate(energy):
            if start is None and e >= high:
                start = i
            elif start is not None and e < low:
                want.append((start, i))
                start = None
        assert media.energy_segments(energy) == want + ([(start, len(energy))] if start is not None else [])


def test_media(spark):
    rows = [(10, "é" * 1000), (11, "é" * 1000), *ODD]
    stored = media.audio_features(documents(spark, rows))
    got = media.media_digests(stored).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "") for i, t in rows if i == r["doc_id"])
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    a, b = (next(r for r in got if r["doc_id"] == i) for i in (10, 11))
    assert a["feature"] == b["feature"] and a["media_sha256"] == b["media_sha256"]
    row = media.audio_features(documents(spark, [(1, "hello " * 3000)])).first()
    batch = pa.ipc.open_stream(row["features"]).read_all()
    assert batch.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (media.FRAMES, media.MELS))
    assert media.wav_payload(bytes(row["media"])).startswith(b"hello ") and all(s["start_s"] < s["end_s"] for s in row["segments"])
    # the digests follow the stored columns, not the text
    spoiled = stored.where("doc_id = 10").withColumns({"media": F.lit(media.wav_bytes(b"x" * 576)), "segments": F.expr("slice(segments, 1, 0)")})
    r = media.media_digests(spoiled).first()
    assert r["payload_sha256"] == hashlib.sha256(b"x" * 576).hexdigest() and "segments=0;first=-1.000" in r["feature"]
    assert media.media_digests(media.audio_features(documents(spark, []))).count() == 0


def test_resampling_in_blocks():
    samples = np.random.default_rng(0).integers(0, 256, 20_000, dtype=np.uint8)
    whole, old = media.log_mel(samples), media.SPAN
    try:
        media.SPAN = 3 * 256
        assert np.allclose(media.log_mel(samples), whole, atol=1e-4)
    finally:
        media.SPAN = old


# 8 near copies


def _components(rows):
    sets = {}
    for n, (i, t) in enumerate(rows):
        words = [bytes(w).lower() for w in (t or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
        sets[n] = (i, frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    root = {i: i for i, _ in sets.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, (i, a) in sets.items():
        for _, (j, b) in sets.items():
            if a and b and i != j and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.values())


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 60, 150]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "Two  WORDS"), (1005, rows[0][1])]
    want = _components(rows)
    assert sorted(tuple(r) for r in minhash.near_duplicates(documents(spark, rows)).collect()) == want
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)  # many block pairs
    assert sorted(tuple(r) for r in minhash.near_duplicates(documents(spark, rows)).collect()) == want
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    got = minhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got)
    kept = minhash.drop_near_duplicates(documents(spark, rows), 85)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, k in want if k] and kept.columns == documents(spark, []).columns


def test_dropping_near_duplicates_odd_rows(spark):
    text = [" ".join(f"{a}{i}" for i in range(40)) for a in "ab"]
    rows = [(1, text[0]), (7, text[0] + " end"), (8, text[1]), (8, text[1]), (9, None), (9, ""), (None, text[0])]
    kept = minhash.drop_near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, [r for r in rows if r[0] != 7]))
    assert minhash.drop_near_duplicates(documents(spark, [])).count() == 0


def test_sketches_miss_few_similar_pairs():
    """Pairs of similarity 0.8 share a band, as the formula says: a chance of 6e-5 to miss one."""
    rng, found = np.random.default_rng(1), 0
    for _ in range(150):
        a = np.unique(rng.integers(0, 2**63, 180, dtype=np.uint64))
        b = np.concatenate([a[:160], rng.integers(0, 2**63, 20, dtype=np.uint64)])  # 160 of 200
        x, y = minhash.band_hashes(minhash.sketches([np.unique(a), np.unique(b)]))
        found += bool((x == y).any())
    assert found >= 149


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(20):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.concatenate([a[:250], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        s = minhash.sketches([a, b, a[:1]])
        assert not (s == minhash._MAX).any()
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - 250 / 350) < 0.03


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    got = components.connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in root}


# 9 chats


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "a<\\\\|b<|", "line\nbreak", "", None, "\\n<|"]
    rows = [(1, i, ("user", "assistant", "sys\ntem<|", None)[i % 4], t) for i, t in enumerate(nasty)] + [(2, 0, "user", "q"), (2, 0, "user", "q"), (3, None, "assistant", "late"), (None, 0, "assistant", "none")]
    rows += [(4, i, "assistant", f"t{i}") for i in range(37)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, score int")
    done = {r["tree"]: r for r in chat.format_conversations(df).collect()}
    assert len(done) == 5
    for tree, r in done.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == tree))
        assert chat.parse_formatted(r["formatted"]) == [(role, text) for _, role, text in turns]
        learned = "".join(chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
        assert learned == "".join(text for _, role, text in turns if role == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0
    for t in nasty:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and "<|" not in chat.escape(t or "")


def test_reply_tree(spark):
    nodes = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5)], "tree long, node long, parent long, role string, text string, score double")
    paths = chat.root_paths(nodes)
    best = chat.rank_branches(paths, nodes, 1)
    assert [r["leaf"] for r in best.collect()] == [4] and best.first()["score"] == pytest.approx(1.4 / 3)
    got = {r["leaf"]: [t for _, t in chat.parse_formatted(r["formatted"])] for r in chat.format_paths(paths, nodes, chat.rank_branches(paths, nodes)).collect()}
    assert got == {2: ["q", "bad"], 4: ["q", "good", "more"]}


def test_cycles_and_repeated_nodes(spark):
    rows = [
        (1, 1, None, "user", "q"), (1, 2, 1, "assistant", "a"), (1, 2, 1, "assistant", "a"), (1, 2, 9, "assistant", "other"),  # node 2 repeats
        (2, 1, 2, "user", "x"), (2, 2, 3, "user", "y"), (2, 3, 1, "user", "z"), (2, 4, 1, "assistant", "leaf under a cycle"), (2, 5, None, "user", "root"), (2, 6, 5, "assistant", "fine"),
        (3, 1, 1, "user", "its own parent"),
    ]
    nodes = spark.createDataFrame([(*r, 0.0) for r in rows], "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): [t for _, t in chat.parse_formatted(r["formatted"])] for r in chat.format_trees(nodes).collect()}
    assert got == {(1, 2): ["q", "a"], (2, 6): ["root", "fine"]}
    assert chat.format_trees(nodes.where("tree = 3")).count() == 0


# 10 packing


def test_best_fill_is_optimal():
    rng = random.Random(7)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=41)
        got = packing.best_fill(counts, 40)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert all(counts[n] >= k for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= 40)


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abc def\n", k=rng.randint(0, 6000)))) for i in range(10, 60)] + ODD
    done = packing.pack_documents(documents(spark, rows)).collect()
    bpe, by_doc, by_seq = ByteBpe(), collections.defaultdict(list), collections.defaultdict(list)
    for r in done:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    for r in done:
        by_doc[r["doc_id"]].append(r)
    for i, t in {i: t for i, t in rows}.items():
        ids = bpe.model.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        times = sum(1 for j, _ in rows if j == i)
        assert sum(r["length"] for r in parts) == times * len(ids)
        for r in parts:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_byte_bpe_is_the_tokenizer():
    bpe = ByteBpe()
    for t in ("", " ", "a  b", "\n\n", "a \n b", "it's <|endoftext|> x", "\tfoo bar  baz", "日本 語", "x  y\x1c z", "\x85a b", "don't 's 're", "é à\nb"):
        for _ in range(2):
            assert np.frombuffer(bpe.encode(t), "<u4").tolist() == bpe.model.encode(t, add_special_tokens=False).ids


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = _labelled(400)
    copies = [(1000 + i, rows[1][1] + (" tail" if i else "")) for i in range(3)]
    shared = " ".join(f"passage{i}" for i in range(60))
    extra = [(2000 + i, f"{rows[5 + i][1]} {shared} {rows[9 + i][1]}") for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*((i, t) for i, t, _, _ in rows), *copies, *extra]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert sorted(now.columns) == sorted(docs.columns)
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    last = kept["suffix-array dedup"]
    assert not {1000, 1001, 1002} & last.keys() and sum(shared in t for t in last.values()) <= 1
    junk, toxic = {i for i, _, q, _ in rows if not q}, {i for i, _, _, t in rows if t}
    assert len(junk & kept["quality classifier"].keys()) < 0.05 * len(junk) and len(toxic & kept["toxicity"].keys()) < 0.1 * len(toxic)
    clean = {i for i, _, q, t in rows if q and not t and i != 1}
    assert len(clean & last.keys()) > 0.95 * len(clean)
    pieces_ = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in pieces_} == last.keys() and all(r["n"] == r["t"] for r in pieces_)
