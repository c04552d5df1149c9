"""Filter interaction audit, hard-negative mining and language identification against plain versions, with the odd cases."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrag.llm import audit, language, rtree

# 11 Filter interaction audit

WORD_SPACE = " \t\n\x0b\x0c\r"
AUDITED = "doc_id long, text string, lang string, part string, mask int, n long, id long, key string"


def _fails(text):
    words = [w for w in "".join("\n" if c in WORD_SPACE else c for c in text).split("\n") if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]


def _plain_audit(rows, labels):
    known = {}
    for i, quality, toxic in labels:
        old = known.get(i, (False, False))
        known[i] = old[0] or quality == 1, old[1] or toxic == 1
    docs = []
    for i, text, lang in rows:
        text = text or ""
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        docs.append((lang or "", {f for f, bad in zip("ABCDE", [*_fails(text), again], strict=True) if bad}, *(known.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        own, gone = [d for d in docs if d[0] == part], {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in own) - len(removed)
                gone[f] = gone.get(f, 0) + len(removed)
                out[part, order, step] = [len(left), len(removed), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(gone[order[step - 1]])
    return out


def _report(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def _texts(seed):
    rng = random.Random(seed)
    good = " ".join(f"word{i}" for i in range(220))
    pool = [good, good + " $", "a " * 300, "ABC " * 250, "", None, "short é", good.upper(), " ".join(f"w{i}" for i in range(250)), *(good + f" {i}" for i in range(3))]
    rows = [(rng.randrange(60), rng.choice(pool), rng.choice(["en", "de", None])) for _ in range(120)]
    rows += [(None, good, "en"), (None, good, None), rows[0], rows[0]]
    return rows, [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(50)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]


def test_audit_retracts_when_smaller_ids_arrive(spark, tmp_path):
    rows, labels = _texts(1)
    label_table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ordered = sorted(rows, key=lambda r: -1e9 if r[0] is None else r[0], reverse=True)  # the largest ids arrive first
    files = [ordered[i : i + 25] for i in range(0, len(ordered), 25)]

    def add(part):
        spark.createDataFrame([(*r, "p", 1, 2, 3, "k") for r in part], AUDITED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        docs = spark.readStream.schema(AUDITED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return _report(audit.filter_interactions(docs, label_table, str(tmp_path / "audit")))

    for part in files[:3]:
        add(part)
    assert run() == _plain_audit([r for f in files[:3] for r in f], labels)
    for part in files[3:]:  # the same folder goes on where it stopped
        add(part)
    whole = run()
    assert whole == _plain_audit(rows, labels)
    assert run() == whole
    # A batch that runs again replaces its own changes.
    counted = audit.counters(spark, str(tmp_path / "audit"))
    assert counted.agg(F.sum("n")).first()[0] == len(rows) and counted.where("n < 0").count() == 0


def test_audit_merges_states(spark):
    """The state and the changes of one text by batches: new, larger id, smaller id, the same id again, no id."""
    kind = "part string, good int, toxic int"
    state = spark.createDataFrame([], f"key binary, least long, held array<struct<{kind}, n: long>>")
    seen = {}
    for rows, least, held in [
        ([("en", 7), ("en", 7), ("en", 8), ("en", None)], 7, {("en", 2)}), ([("de", 9), ("de", 9)], None, None), ([("de", 5), ("en", 6)], 5, {("de", 1)}), ([("fr", 5)], 5, {("de", 1), ("fr", 1)}), ([("fr", None)], None, None),
    ]:
        df = spark.createDataFrame([(bytearray(b"k"), 1, part, 0, 0, i) for part, i in rows], "key binary, mask int, part string, good int, toxic int, id long")
        (got,) = audit.merged(audit.added_up(df), state).collect()
        assert got["least"] == least and (held is None) == (got["held"] is None)
        if held is not None:
            assert {(h["part"], h["n"]) for h in got["held"]} == held
            state = spark.createDataFrame([(got["key"], got["least"], [tuple(h) for h in got["held"]])], state.schema)
        for c in got["changes"]:
            seen[c["part"], c["mask"]] = seen.get((c["part"], c["mask"]), 0) + c["n"]
    assert {k: n for k, n in seen.items() if n} == {("en", 1): 1, ("en", 17): 4, ("de", 1): 1, ("de", 17): 2, ("fr", 1): 2}


def test_audit_batch_that_runs_again(spark, tmp_path):
    rows, labels = _texts(4)
    label_table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.createDataFrame([(*r, "p", 1, 2, 3, "k") for r in rows], AUDITED).repartition(4).write.parquet(str(tmp_path / "in"))

    def run():
        docs = spark.readStream.schema(AUDITED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return _report(audit.filter_interactions(docs, label_table, str(tmp_path / "audit")))

    whole = run()
    (tmp_path / "audit/progress/commits/3").unlink()  # as if the last batch had been lost after its writes
    (tmp_path / "audit/progress/commits/.3.crc").unlink(missing_ok=True)
    assert run() == whole == _plain_audit(rows, labels)


def test_audit_query_and_empty_table(spark, tmp_path):
    from sparkrag.llm.queries import op11_filter_audit

    rows, labels = _texts(2)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(*r, "p", 1, 2, 3, "k") for r in rows], AUDITED).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert _report(op11_filter_audit(spark, str(tmp_path))) == _plain_audit(rows, labels)
    empty = tmp_path / "empty"
    spark.createDataFrame([], AUDITED).coalesce(1).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(empty / "labels.parquet"))
    assert op11_filter_audit(spark, str(empty)).count() == 0


# 12 Hard-negative mining

VECTORS = "vec_id long, embedding array<float>, label int, key string, tile int, bound string"


def _plain_negatives(rows, positives=5, negatives=3, every=50):
    good = {(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    out = set()
    for a in good:
        if a[0] % every:
            continue
        peers = [b for b in good if len(b[2]) == len(a[2]) and b[0] != a[0]]
        near = sorted((-score(a, b), b[0]) for b in peers if b[1] == a[1])[:positives]
        for s, i in near:
            hard = sorted((-score(a, b), b[0]) for b in peers if b[1] != a[1] and 50 * -s <= 100 * score(a, b) <= 95 * -s)[:negatives]
            out |= {(a[0], i, n, j, -s, -t) for n, (t, j) in enumerate(hard, 1)}
    return out


def _mined(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, "k", 1, "b") for i, v, label in rows], VECTORS)
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rtree.mine_negatives(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [7, 8192])
def test_negatives_are_those_of_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(rtree, "LEAF", 4)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-6, 9, 6) / 4 + 0.1).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, 1.0, 0.5, 0.0, 0.5], i % 2) for i in range(60)]  # one vector again and again
    rows += [rows[0], rows[50], (300, None, 1), (301, [], 1), (302, [math.nan] * 6, 1), (303, [None] + [1.0] * 5, 1), (304, [math.inf] + [1.0] * 5, 0), (None, [1.0] * 6, 1), (350, [1.0] * 6, None), (400, [-1.0] * 6, 9)]
    rows += [(450 + i, [1.0 + i, 2.0], i % 2) for i in range(8)]  # another length
    assert _mined(spark, rows, block=block) == _plain_negatives(rows)


def test_negatives_of_odd_tables(spark):
    assert _mined(spark, []) == set()
    assert _mined(spark, [(0, [1.0, 2.0], 1)]) == set()
    assert _mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == {(0, 1, 1, 2, 65536, 58880)}


def test_tree_passes_over_boxes():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 8))
    x = np.repeat(centres, 64, axis=0) + rng.integers(-5, 6, (2560, 8))
    labels = np.arange(len(x)) % 2
    tree, ids = rtree.RTree(labels, x, leaf=32), [np.array([i]) for i in range(len(x))]
    q = x[0]
    bounds, scores = [(a[0], b[0]) for a, b in tree.intervals(x[:1])], x @ q
    pairs = lambda windows: [(-s, i) for s, i in zip(*(a.tolist() for a in windows.found[0]), strict=True)]
    best = rtree.Windows(5, [-np.inf], [np.inf])
    read = rtree.search(tree, ids, q, bounds, 0, True, best)
    assert pairs(best) == sorted((-s, i) for i, s in enumerate(scores.tolist()) if labels[i] == 0)[:5]
    assert read < (len(tree.levels[0][0]) - 1) // 4  # of all leaves
    top = int(scores.max())
    hard = rtree.Windows(3, [top // 2], [19 * top // 20])
    read = rtree.search(tree, ids, q, bounds, 0, False, hard)
    assert pairs(hard) == sorted((-s, i) for i, s in enumerate(scores.tolist()) if labels[i] == 1 and top // 2 <= s <= 19 * top // 20)[:3]
    assert read < (len(tree.levels[0][0]) - 1) // 4


def test_str_packs_all_rows_once():
    x = np.random.default_rng(1).integers(0, 50, (777, 3))
    groups = rtree.str_groups(x, 20)
    assert sorted(np.concatenate(groups).tolist()) == list(range(777)) and max(map(len, groups)) <= 21
    tiles = rtree.Tiles(x[:, 0] % 4, x, 16)
    found = tiles.of(x[:, 0] % 4, x)
    assert 8 <= len(np.unique(found)) <= tiles.count and np.bincount(found).max() < 777 / 4


# 13 Language identification


def _plain_model(rows, bits):
    grams = lambda text: [h for h in _plain_grams(text, bits)]
    counts, docs = {}, {}
    for i, text, lang in rows:
        if i is None or lang is None or text is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        docs[lang] = docs.get(lang, 0) + 1
        own = counts.setdefault(lang, [0] * (1 << bits))
        for h in grams(text):
            own[h] += 1
    return counts, docs


def _plain_grams(text, bits):
    import unicodedata

    out = [" "]
    for c in text + " ":
        kind = unicodedata.category(c)[0]
        c = (c.lower() if len(c.lower()) == 1 else c) if kind in "LM" else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    if out == [" "]:
        out.append(" ")
    for n in range(1, language.GRAMS + 1):
        for i in range(len(out) - n + 1):
            h = 0
            for k in range(n):
                h = ((h ^ ord(out[i + k])) * 0x01000193 + k + 1) & 0xFFFFFFFF
            yield (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)


SENTENCES = {"en": "the quick brown fox jumps over the lazy dog and the cat", "de": "der schnelle braune fuchs springt über den faulen hund und die katze", "fr": "le renard brun saute par-dessus le chien paresseux où ça", "ru": "Быстрая лиса прыгает через собаку"}


def _language_rows(seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.sample(SENTENCES[lang].split(), 5)), lang) for i, lang in enumerate(rng.choices(list(SENTENCES), k=120))]


DOCS = "doc_id long, text string, lang string, score double, bucket string"


def _df(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], DOCS)


def test_language_is_that_of_plain_bayes(spark):
    rows = _language_rows()
    odd = [(500, None, "en"), (501, "", "de"), (502, "123 !?", "fr"), (None, "the dog", "en"), (503, "the dog", None), (503, "the dog", None), (504, "Über DEN Hund, Fuchs!", "de"), (505, "x" * 9, "en")]
    model = language.fit_language(_df(spark, rows + odd), bits=10)
    counts, docs = _plain_model(rows + odd, 10)
    assert model.languages == sorted(counts)
    got = {(r["doc_id"], r["score"]): r["lang_pred"] for r in language.predict_language(_df(spark, rows + odd), model).collect()}
    want = {}
    for i, text, _ in rows + odd:
        if not any(c.isalpha() for c in text or ""):
            want[i] = "und", 0.0
            continue
        logs = []
        for lang in sorted(counts):
            total = sum(counts[lang]) + language.SMOOTHING * 1024
            logs.append(math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][h] + language.SMOOTHING) / total) for h in _plain_grams(text, 10)))
        want[i] = sorted(counts)[int(np.argmax(logs))], 1 / sum(math.exp(x - max(logs)) for x in logs)
    assert {(i, lang) for (i, _), lang in got.items()} == {(i, lang) for i, (lang, _) in want.items()}
    for (i, score), _ in got.items():
        assert score == pytest.approx(want[i][1], abs=2e-4)


def test_language_learns_and_handles_odd_tables(spark):
    rows = _language_rows(2)
    model = language.fit_language(_df(spark, rows))
    fresh = [(1000 + i, t, lang) for i, (_, t, lang) in enumerate(_language_rows(3))]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(_df(spark, fresh), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in fresh]) > 0.98
    assert language.predict_language(_df(spark, []), model).count() == 0
    none = language.fit_language(_df(spark, [(1, "a b", None)]))
    assert [tuple(r) for r in language.predict_language(_df(spark, fresh[:1]), none).collect()] == [(1000, "und", 0.0)]


def test_rate_of_the_sample(spark):
    rows = [(i, "der hund" if i % 4 else "the dog", "de" if i % 4 else "en") for i in range(4000)]
    few = language.fit_language(_df(spark, rows), sample=100)
    counted = np.exp(few.shares)  # shares of all buckets add up to one
    assert counted.sum(axis=1) == pytest.approx(1, abs=1e-3) and np.exp(few.prior) == pytest.approx([0.75, 0.25], abs=0.02)
    assert [t for t in few.predict(["the dog", "der hund"])[0]] == ["en", "de"]


def test_long_texts_are_scored_whole(monkeypatch):
    rng = random.Random(5)
    model = language.LanguageModel(["a", "b"], np.random.default_rng(1).integers(1, 9, (2, 1 << 10)), np.array([1, 1]))
    texts = ["".join(rng.choices("ab c1éÖ\n", k=n)) for n in (0, 1, 2, 37, 500, 3000)]
    want = [[(c, o) for c, o in zip(*map(list, language.folded([t])[:2]), strict=True)] for t in texts]
    whole = model.predict(texts)
    monkeypatch.setattr(language, "PIECE", 16)
    assert [[(c, o) for c, o in zip(*map(list, language.folded([t])[:2]), strict=True)] for t in texts] == want
    again = model.predict(texts)
    assert again[0] == whole[0] and again[1] == pytest.approx(whole[1], abs=1e-6)


def test_language_query(spark, tmp_path):
    from sparkrag.llm.queries import op13_language_id

    rows = [*_language_rows(), (None, "the dog", "en")]
    _df(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    done = op13_language_id(spark, str(tmp_path))
    assert dict(done.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert {(r["doc_id"], r["held_out"]) for r in done.collect()} == {(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows}


# The encoder that packing uses for most texts, against the tokenizer that the contract names


def test_encoder_is_the_tokenizer_over_a_whole_table():
    import os

    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from sparkrag.llm.tokens import ByteBpe

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the given tables aren't here")
    model, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ByteBpe()
    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    assert len(texts) >= 200
    for text in texts:
        assert np.frombuffer(mine.encode(text or ""), "<u4").tolist() == model.encode(text or "", add_special_tokens=False).ids
