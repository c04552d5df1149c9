"""Quality of retrieval and answers.

queries: (query_id, expected) with null where no answer is right; hits: (query_id, rank, filename);
answers: (query_id, answer_kind). A query may stand in several rows of queries, one for each right file."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import estimate_cost_usd, estimate_tokens
from sparkrag.sources.io import settled

#: name, comparison, level
GATES = (("recall_at_k", ">=", 0.8), ("mrr", ">=", 0.6), ("citation_correctness", ">=", 0.8), ("no_answer_accuracy", ">=", 1.0), ("hallucination_rate", "<=", 0.0), ("false_no_answer_rate", "<=", 0.2))


def first_match(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, position) for each query with an expected file: its first matching rank or null."""
    wanted = queries.where("expected is not null").select("query_id", "expected").distinct()
    found = wanted.join(hits.select("query_id", "rank", F.col("filename").alias("expected")), ["query_id", "expected"], "left")
    return found.groupBy("query_id").agg(F.min("rank").alias("position"))


def recall_at_k(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    inside = F.when(F.col("position") <= k, 1.0).otherwise(0.0)
    return first_match(hits, queries).agg(F.coalesce(F.avg(inside), F.lit(0.0)).alias("recall_at_k"))


def mrr(hits: DataFrame, queries: DataFrame) -> DataFrame:
    return first_match(hits, queries).agg(F.coalesce(F.avg(F.coalesce(1.0 / F.col("position"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def citation_correctness(top: DataFrame, queries: DataFrame) -> DataFrame:
    """top: (query_id, filename), the first citation of each query."""
    wanted = queries.where("expected is not null").select("query_id", "expected").distinct()
    hit = wanted.join(top.select("query_id", F.col("filename").alias("expected"), F.lit(1.0).alias("hit")), ["query_id", "expected"], "left")
    return hit.groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0.0))).alias("hit")).agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("citation_correctness"))


def answer_rates(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: no_answer_accuracy, hallucination_rate, false_no_answer_rate."""
    asked = queries.groupBy("query_id").agg((F.count("expected") > 0).alias("answerable"))
    none = F.when(F.col("answer_kind") == "no_answer", 1.0).otherwise(0.0)
    rows = asked.join(answers.select("query_id", "answer_kind"), "query_id")
    rate = lambda keep, x, empty: F.coalesce(F.avg(F.when(keep, x)), F.lit(empty))
    no, yes = ~F.col("answerable"), F.col("answerable")
    return rows.agg(rate(no, none, 1.0).alias("no_answer_accuracy"), rate(no, 1.0 - none, 0.0).alias("hallucination_rate"), rate(yes, none, 0.0).alias("false_no_answer_rate"))


#: Ranges that the values of a group are counted in, and values that are sorted at last.
BINS, SORTED = 1024, 4096


def at_ranks(df: DataFrame, value: str, ranks: Column, by: list[str]) -> DataFrame:
    """(by, rank, value): the values at 0-based ranks in sorted order. ranks: an array expression over n, the number of a
    group's values. Null and NaN values are left out.

    Nothing is sorted whole: values are counted in BINS ranges between the least and the largest of a group, and
    the range that holds the rank is counted again in finer ranges until it holds SORTED values at most,
    or one value only. These are sorted. Counts are added up before they are shuffled.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same = [F.col(c) for c in by]
    sizes = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0")
    wanted = settled(sizes.select(*by, F.explode(F.array_distinct(ranks)).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("under"), F.col("n").alias("inside")), "ranks")
    join = lambda left, right: _null_safe(left, right, by)
    while wanted.where((F.col("inside") > SORTED) & (F.col("lo") < F.col("hi"))).count():
        open_ = wanted.where((F.col("inside") > SORTED) & (F.col("lo") < F.col("hi")))
        ranges = open_.select(*by, "lo", "hi").distinct()  # ranks that share a range count it once
        bin_ = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("bin")
        counts = join(rows, ranges).where(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*same, "lo", "hi", bin_).agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*same, "lo", "hi").orderBy("bin")))
        upto = upto.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
        hit = join(open_, upto).where((F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("rank") - F.col("under") < F.col("upto")) & (F.col("rank") - F.col("under") >= F.col("upto") - F.col("c")))
        finer = hit.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("under") + F.col("upto") - F.col("c")).alias("under"), F.col("c").alias("inside"))
        wanted = settled(wanted.where((F.col("inside") <= SORTED) | (F.col("lo") == F.col("hi"))).unionByName(finer), "ranks")
    alone = wanted.where(F.col("lo") == F.col("hi")).select(*by, "rank", F.col("lo").alias("value"))
    few = wanted.where(F.col("lo") < F.col("hi"))
    listed = join(rows, few).where(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*same, "rank", "under").agg(F.array_sort(F.collect_list("_v")).alias("vs"))
    return alone.unionByName(listed.select(*by, "rank", F.get("vs", (F.col("rank") - F.col("under")).cast("int")).alias("value")))


def _null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by the columns `by`, null being a value; without any, with the few rows of right."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)  # as many rows as there are ranks
    named = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return left.join(named, reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_by_{c}"]) for c in by]), how).drop(*[f"_by_{c}" for c in by])


def percentiles(df: DataFrame, value: str, ps: tuple[float, ...] = (50, 95), by: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """pNN columns by linear interpolation, exact by `at_ranks`; exact=False is approximate and takes one pass. Empty: 0."""
    by = list(by)
    if not exact:
        return df.groupBy(*by).agg(*[F.coalesce(F.percentile_approx(value, p / 100).cast("double"), F.lit(0.0)).alias(f"p{p:g}") for p in ps])
    place = lambda p: p / 100 * (F.col("n") - 1)
    ranks = F.array(*[f(place(p)).cast("long") for p in ps for f in (F.floor, F.ceil)])
    found = at_ranks(df, value, ranks, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    groups = df.groupBy(*by).agg(F.count_if(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("n"))

    def one(p: float) -> Column:
        low, high = (F.try_element_at("_at", f(place(p)).cast("long")) for f in (F.floor, F.ceil))
        return F.coalesce(low + (high - low) * (place(p) - F.floor(place(p))), F.lit(0.0)).alias(f"p{p:g}")

    return _null_safe(groups, found, by, "left").select(*by, *[one(p) for p in ps])


def percentile_nearest(df: DataFrame, value: str, p: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The sorted value at min(n * p div 100, n - 1)."""
    rank = F.array(F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1))
    return at_ranks(df, value, rank, list(by)).select(*by, F.col("value").alias(f"nearest_p{p}"))


def token_cost(rows: DataFrame, *texts: str, price_per_1k: float = 0.00015) -> DataFrame:
    """One row: tokens and cost of the given text columns."""
    n = sum((estimate_tokens(F.coalesce(F.col(t), F.lit(""))) for t in texts), F.lit(0))
    total = F.coalesce(F.sum(n), F.lit(0))
    return rows.agg(total.alias("tokens"), estimate_cost_usd(total, price_per_1k).alias("cost_usd"))


def metrics_table(hits: DataFrame, answers: DataFrame, top: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(metric, value) rows of all of the above."""
    one = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*")
    parts = [recall_at_k(hits, queries, k), mrr(hits, queries), citation_correctness(top, queries), answer_rates(answers, queries)]
    out = one(parts[0])
    for p in parts[1:]:
        out = out.unionByName(one(p))
    return out


def eval_run(queries: DataFrame, chunks: DataFrame, k: int = 5, mode: str = "generative", on_no_answer: str = "retrieval", **how) -> tuple[DataFrame, DataFrame]:
    """(metrics, per query) of queries (query_id, workspace_id, question, expected[, embedding]) on chunks."""
    from sparkrag.operators.answers import citations, route_answers, select_contexts
    from sparkrag.operators.retrieval import retrieve
    from sparkrag.sources.io import settled

    queries = settled(queries)
    given = ["embedding"] if "embedding" in queries.columns else []
    asked = queries.select("query_id", "workspace_id", "question", *given).dropDuplicates(["query_id"])
    hits = settled(retrieve(asked, settled(chunks), k=k, **how))
    contexts = select_contexts(hits)
    answers = settled(route_answers(asked, contexts, mode=mode, on_no_answer=on_no_answer))
    top = citations(contexts).where("idx = 1").join(answers.where("answer_kind <> 'no_answer'").select("query_id"), "query_id", "left_semi").select("query_id", "filename")
    place = first_match(hits, queries)
    per = asked.join(answers, "query_id", "left").join(place, "query_id", "left").join(top.withColumnRenamed("filename", "top_citation"), "query_id", "left")
    return metrics_table(hits, answers, top, queries, k), per


#: The knobs of a setting, besides its name, and Poisson samples of the queries for the intervals.
SETTING = "setting string, dense_weight double, keyword_weight double, rrf_k int, min_score double, k int"
SAMPLES = 200


def fused_by_settings(dense: DataFrame, keyword: DataFrame, settings: list[tuple], overlap: str = "keyword_wins") -> DataFrame:
    """(setting, query_id, chunk_id, score, rank): the hits that each setting makes of candidates found once, as `fuse` does.

    dense: (query_id, chunk_id, dense_score, rank); keyword: (query_id, chunk_id, keyword_score, rank); settings: rows
    of SETTING. A query's candidates are few, so a setting is one more number for each of them.
    """
    d = dense.select("query_id", "chunk_id", "dense_score")
    w = keyword.select("query_id", "chunk_id", F.col("rank").alias("_k"))
    both = d.join(w, ["query_id", "chunk_id"], "full_outer")
    dense_score = F.coalesce("dense_score", F.lit(0.0))
    if overlap == "keyword_wins":
        dense_score = F.when(F.col("_k").isNotNull(), 0.0).otherwise(dense_score)
    names = [c.split()[0] for c in SETTING.split(", ")]
    kinds = [c.split()[1] for c in SETTING.split(", ")]
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, kinds, strict=True)]) for row in settings])
    rows = both.select("query_id", "chunk_id", dense_score.alias("dense_score"), "_k", F.explode(table).alias("s"))
    score = F.col("s.dense_weight") * F.col("dense_score") + F.col("s.keyword_weight") * F.coalesce((F.col("s.rrf_k") + 1) / (F.col("s.rrf_k") + F.col("_k")), F.lit(0.0))
    kept = rows.select(F.col("s.setting").alias("setting"), "query_id", "chunk_id", score.alias("score"), F.col("s.k").alias("k"), F.col("s.min_score").alias("least")).where(F.col("score") >= F.col("least"))
    rank = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= F.col("k")).drop("k", "least")


def positions_by_settings(hits: DataFrame, queries: DataFrame, settings: list[str]) -> DataFrame:
    """(setting, query_id, position) of each setting and each query with an expected file; null if no hit matches.
    hits: (setting, query_id, filename, rank)."""
    wanted = queries.where("expected is not null").select("query_id", "expected").distinct().withColumn("setting", F.explode(F.array(*[F.lit(s) for s in settings])))
    found = wanted.join(hits.select("setting", "query_id", F.col("filename").alias("expected"), "rank"), ["setting", "query_id", "expected"], "left")
    return found.groupBy("setting", "query_id").agg(F.min("rank").alias("position"))


def _measures() -> dict[str, Column]:
    place = F.col("position")
    return {"recall_at_k": F.when(place.isNotNull(), 1.0).otherwise(0.0), "mrr": F.coalesce(1.0 / place, F.lit(0.0)), "citation_correctness": F.coalesce((place == 1).cast("double"), F.lit(0.0))}


def compare_settings(positions: DataFrame, baseline: str, samples: int = SAMPLES, level: float = 0.95) -> DataFrame:
    """(setting, metric, value, delta, low, high): each setting's metrics, their differences from the baseline's and an
    interval of these by Poisson bootstrap.

    In each of `samples` samples a query counts as often as a Poisson number of mean 1 that a hash of query and sample
    gives, the same for all settings. All samples are sums of one aggregate.
    """
    measures = _measures()
    own = positions.select("setting", "query_id", *[m.alias(n) for n, m in measures.items()])
    base = own.where(F.col("setting") == baseline).select("query_id", *[F.col(n).alias(f"_{n}") for n in measures])
    rows = own.join(base, "query_id")
    uniform = (F.pmod(F.xxhash64("query_id", "b"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(12)]
    times = F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda x: x < uniform))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("w", times)
    sums = drawn.groupBy("setting", "b").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * (F.col(n) - F.col(f"_{n}"))).alias(n) for n in measures])
    edge = (1 - level) / 2
    ends = sums.groupBy("setting").agg(*[F.percentile(F.col(n) / F.nullif("w", F.lit(0)), F.array(F.lit(edge), F.lit(1 - edge))).alias(n) for n in measures])  # `samples` values each
    whole = rows.groupBy("setting").agg(*[F.avg(n).alias(f"_v_{n}") for n in measures], *[F.avg(F.col(n) - F.col(f"_{n}")).alias(f"_d_{n}") for n in measures])
    cells = [F.struct(F.lit(n).alias("metric"), F.col(f"_v_{n}").alias("value"), F.col(f"_d_{n}").alias("delta"), F.get(n, F.lit(0)).alias("low"), F.get(n, F.lit(1)).alias("high")) for n in measures]
    return whole.join(ends, "setting").select("setting", F.explode(F.array(*cells)).alias("c")).select("setting", "c.*")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, before, after, delta)."""
    x, y = a.select("metric", F.col("value").alias("before")), b.select("metric", F.col("value").alias("after"))
    return x.join(y, "metric", "full_outer").withColumn("delta", F.col("after") - F.col("before"))


def compare_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, before, after, moved) of per-query positions."""
    x, y = a.select("query_id", F.col("position").alias("before")), b.select("query_id", F.col("position").alias("after"))
    move = F.when(F.col("before").eqNullSafe(F.col("after")), "same").when(F.col("before").isNull(), "found").when(F.col("after").isNull(), "lost").when(F.col("after") < F.col("before"), "up").otherwise("down")
    return x.join(y, "query_id", "full_outer").withColumn("moved", move)


def _passes(value: Column, how: Column, level: Column) -> Column:
    return F.when(how == ">=", value >= level).otherwise(value <= level)


def quality_gate(metrics: DataFrame, gates: tuple = GATES) -> DataFrame:
    """(metric, value, level, passed); a missing metric fails."""
    table = metrics.sparkSession.createDataFrame(list(gates), "metric string, how string, level double")
    joined = F.broadcast(table).join(metrics, "metric", "left")  # one row a gate
    return joined.select("metric", "value", "level", F.coalesce(_passes(F.col("value"), F.col("how"), F.col("level")), F.lit(False)).alias("passed"))


def dataset_check(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of flags: enough documents and queries, some without an answer, every expected file there."""
    d = docs.agg((F.count("*") >= 5).alias("enough_docs"))
    q = queries.agg((F.count("*") >= 10).alias("enough_queries"), (F.count_if(F.col("expected").isNull()) > 0).alias("has_unanswerable"))
    missing = queries.where("expected is not null").join(docs.select(F.col("filename").alias("expected")), "expected", "left_anti").agg((F.count("*") == 0).alias("all_expected_exist"))
    return d.crossJoin(q).crossJoin(missing)  # one row each
