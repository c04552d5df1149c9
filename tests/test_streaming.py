import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkrag.sources.index import compact, read_index, replace_files, write_generation
from sparkrag.streaming import jobs as K

T0 = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame([(i, who, T0 + dt.timedelta(seconds=s)) for i, (who, s) in enumerate(rows)], "event_id long, identity string, ts timestamp")


def test_rate_limit_rules(spark):
    rows = [("a", 0), ("a", 10), ("a", 60), ("a", 60.5), ("a", 120.6), ("b", 5)]
    got = {r["event_id"]: r["allowed"] for r in K.rate_limit(_events(spark, rows), 1).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: True, 5: True}
    assert all(r["allowed"] for r in K.rate_limit(_events(spark, rows), 0).collect())


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(w, s * 7) for s in range(40) for w in ("a", "b")]
    df = _events(spark, rows).orderBy("ts")
    for part in range(2):
        df.where(F.floor(F.col("event_id") / 40) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else it looks at the clock without end
    try:
        q = K.rate_limit_stream(stream, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert q.awaitTermination(120)
    got = {(r["event_id"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["event_id"], r["allowed"]) for r in K.rate_limit(df, 3).collect()}


def test_metrics_and_quantile(spark):
    rows = spark.createDataFrame([("GET", "r", 200, x) for x in (0.04, 0.2, 0.3, 20.0)], "method string, route string, status int, latency_s double")
    m = K.request_metrics(rows)
    assert m.first()["buckets"] == [1, 1, 2, 3, 3, 3, 3, 3, 4]
    assert K.histogram_quantile(m, 0.5, ["route"]).first()["quantile"] == 0.25
    assert K.histogram_quantile(m, 1.0, ["route"]).first()["quantile"] == 10.0


def _plain_limit(times, limit):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if t - k <= 60]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


@pytest.mark.parametrize("limit", [1, 3])
def test_one_identity_over_many_tasks(spark, limit):
    """A stretch without a gap over most of the parts, then gaps; ties in time; a second and a null identity."""
    rng = random.Random(limit)
    times = sorted([rng.randrange(0, 4000) for _ in range(600)] + [5000, 5060, 5061, 5200, 5200, 5200] + [9000 + 200 * i for i in range(40)])
    rows = [("hot", t) for t in times] + [("other", 3 * i) for i in range(30)] + [(None, 1)]
    df = _events(spark, rows).repartition(5)
    got = {r["event_id"]: r["allowed"] for r in K.rate_limit(df, limit, parts=9).collect()}
    want = dict(zip(range(len(times)), _plain_limit(times, limit), strict=True)) | dict(zip(range(len(times), len(times) + 30), _plain_limit([3 * i for i in range(30)], limit), strict=True))
    assert got == want
    assert {r["event_id"]: r["allowed"] for r in K.rate_limit(df, limit, parts=1).collect()} == want
    assert K.rate_limit(df.where("false"), limit).count() == 0


REQUESTS = "request_id long, user_id int, endpoint string, key string, request_hash string, response string, ts timestamp"


def test_replayed_responses_after_a_restart(spark, tmp_path):
    request = lambda i, key, h, s: (i, 1, "e", key, h, f"r{i}", T0 + dt.timedelta(seconds=s))
    first = [request(1, "k", "a", 5), request(2, "k", "b", 1), request(3, None, "a", 0), request(4, None, "a", 0), request(5, "old", "z", 9)]
    later = [request(6, "k", "b", 100), request(7, "k", "c", 101), request(8, "new", "a", 102), request(9, "new", "a", 102)]
    known = spark.createDataFrame([(1, "e", "old", "stored", "y"), (2, "e", "k", "of another user", "a"), (1, "e", None, "x", "x")], "user_id int, endpoint string, key string, answer string, request_hash string")

    def run(rows):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = K.dedup_stream(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), known=known, buckets=4)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(180)
        return {r["request_id"]: (r["replayed"], r["answer"], r["conflict"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    want = {1: (True, "r2", True), 2: (False, "r2", False), 3: (False, "r3", False), 4: (False, "r4", False), 5: (True, "stored", True)}
    assert run(first) == want
    # The same checkpoint knows the keys of the first run.
    assert run(later) == want | {6: (True, "r2", False), 7: (True, "r2", True), 8: (False, "r8", False), 9: (True, "r8", False)}


def test_sliding_windows_of_panes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(T0 + dt.timedelta(seconds=rng.randrange(0, 1800)), rng.choice([200, 500])) for _ in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, status int")
    batch = {r["window_start"]: (r["requests"], r["errors"]) for r in K.error_rate(df, "5 minutes", "1 minute").collect()}
    want = {}
    for ts, status in rows:
        for i in range(5):
            start = ts.replace(second=0) - dt.timedelta(minutes=i)
            n, bad = want.get(start, (0, 0))
            want[start] = n + 1, bad + (status >= 500)
    assert batch == want
    with pytest.raises(ValueError):
        K.error_rate(df, "5 minutes", "2 minutes")

    # As a stream: in order but for one event that is within the watermark and one that is later than it.
    ordered = sorted(rows)
    fine, late = (T0 + dt.timedelta(seconds=1795), 500), (T0 + dt.timedelta(seconds=5), 500)
    end = [(T0 + dt.timedelta(hours=3), 200)]
    for part in (ordered, [fine, late], end, end):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = K.error_rate(stream, "5 minutes", "1 minute", watermark="2 minutes")
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(180)
    got = {r["window_start"]: (r["requests"], r["errors"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {r["window_start"]: (r["requests"], r["errors"]) for r in K.error_rate(df.unionByName(spark.createDataFrame([fine], df.schema)), "5 minutes", "1 minute").collect()}
    assert {k: v for k, v in got.items() if k < T0 + dt.timedelta(hours=1)} == expected


def test_latest_samples(spark):
    rows = spark.createDataFrame([(i, "GET", "r" if i % 3 else "s", T0 + dt.timedelta(seconds=i // 2)) for i in range(500)], "event_id long, method string, route string, ts timestamp")
    got = {r["event_id"] for r in K.latest_samples(rows, 20).collect()}
    assert got == {i for own in ([i for i in range(500) if i % 3], [i for i in range(500) if not i % 3]) for i in own[-20:]}


def test_ingest_stream_is_idempotent(spark, tmp_path):
    for name, body in (("a.md", b"# Judul\ncuti tahunan"), ("b.exe", b"MZ"), ("c.txt", b"biaya kantor")):
        p = tmp_path / "root/workspaces/w/files" / name[0] / "v1"
        p.mkdir(parents=True)
        (p / name).write_bytes(body)
    from sparkrag.sources.io import read_files, stream_files

    assert read_files(spark, str(tmp_path / "root")).count() == 3
    for run in range(2):
        K.ingest_stream(stream_files(spark, str(tmp_path / "root")), str(tmp_path / "index"), str(tmp_path / f"ck{run}"), K.ingest_batch).awaitTermination(180)
        chunks = read_index(spark, str(tmp_path / "index/chunks"))
        assert sorted(r["content"] for r in chunks.collect()) == ["# Judul\ncuti tahunan", "biaya kantor"]
    assert {r["file_id"] for r in spark.read.parquet(str(tmp_path / "index/failures")).collect()} == {"b"}


def _files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_replacing_a_file_writes_its_bucket_alone(spark, tmp_path):
    path = tmp_path / "index"
    row = lambda f, text, n=2: [(f"w{f % 3}", f, i, f"{text} {i}") for i in range(n)]
    schema = "workspace_id string, file_id long, seq int, content string"
    df = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(tuple(r) for r in read_index(spark, str(path)).select("workspace_id", "file_id", "seq", "content").collect())
    first = [r for f in range(40) for r in row(f, "old")]
    assert replace_files(df(first), str(path), buckets=8) == 0
    before = _files(path)
    assert len({p.split("/")[0] for p in before}) == 8
    assert replace_files(df(row(7, "new", 1)), str(path), buckets=8) == 1
    after = _files(path)
    assert all(after[p] == t for p, t in before.items()) and len(after) - len(before) == 1
    want = sorted([r for r in first if r[1] != 7] + row(7, "new", 1))
    assert read() == want
    write_generation(df(row(7, "new", 1)), str(path), 1, buckets=8)  # the same write again
    assert read() == want and len(_files(path)) == len(after)

    assert compact(spark, str(path)) == 2  # the two generations of one bucket
    assert read() == want and compact(spark, str(path)) == 0
    untouched = [p for p in before if p.split("/")[0] != next(iter(set(after) - set(before))).split("/")[0]]
    assert all(_files(path)[p] == before[p] for p in untouched)
    assert replace_files(df(row(7, "newer", 3)), str(path), buckets=8) == 2
    assert read() == sorted([r for r in first if r[1] != 7] + row(7, "newer", 3))


def test_a_merge_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    from sparkrag.sources import index

    path, schema = str(tmp_path / "index"), "workspace_id string, file_id long, content string"
    for n in range(3):
        replace_files(spark.createDataFrame([("w", i, f"{n}") for i in range(5 - n)], schema), path, buckets=1)
    want = sorted(map(tuple, read_index(spark, path).collect()))
    put = index._put

    def broken(rows, where, *more):
        put(rows, where, *more)
        raise RuntimeError

    monkeypatch.setattr(index, "_put", broken)
    with pytest.raises(RuntimeError):
        compact(spark, path)
    monkeypatch.setattr(index, "_put", put)
    assert sorted(map(tuple, read_index(spark, path).collect())) == want
    assert compact(spark, path) >= 3 and sorted(map(tuple, read_index(spark, path).collect())) == want


def test_reading_one_workspace_opens_its_files_only(spark, tmp_path):
    from sparkrag.sources.io import read_files

    for w in ("a", "b", "c{x}"):
        for f in range(4):
            for v in (1, 2):
                p = tmp_path / f"workspaces/{w}/files/f{f}/v{v}"
                p.mkdir(parents=True)
                (p / "n.md").write_bytes(f"{w}{f}{v}".encode())
    root = str(tmp_path)
    assert read_files(spark, root).count() == 24
    some = read_files(spark, root, workspaces=["a"])
    assert len(some.inputFiles()) == 8 and {r["workspace_id"] for r in some.collect()} == {"a"}
    assert [r["content"] for r in read_files(spark, root, workspaces=["c{x}"], files=["f1"], versions=[2]).collect()] == [b"c{x}12"]
    assert len(read_files(spark, root, workspaces=["a", "b"], versions=[1]).inputFiles()) == 8
    assert read_files(spark, root, workspaces=["none"]).count() == 0 and read_files(spark, root, workspaces=[]).count() == 0
