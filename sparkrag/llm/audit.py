"""How filters of a corpus interact, kept up to date by a stream.

Each document fails some of the filters FILTERS; which ones is its mask. Four filters look at a text alone.
The fifth, E, looks for the same text under a smaller id, so a document that arrives later can change
the mask of one that was counted before. The stream reads the files as available-now micro-batches. Texts
stay where they are read: a document goes on as the hash of its text, its mask, its part and its labels,
and rows of one text and kind are added up before the shuffle. The state has for each text the
smallest id so far and how many rows of which kind have it. When a smaller id arrives the state
retracts the earlier rows' masks (minus one without E, plus one with E) and takes the new id. The counters
(part, mask, good, toxic) are the sums of all batches' changes, and the report of all orders is made from them.

State and changes are tables: each micro-batch writes the new state of the texts that it touched, and
its changes, under its own number, and reads the state of the batches before it. So a batch that runs again
replaces what it wrote, and nothing counts twice. The state has a small row for each different text; as
every batch joins it, batches should be large (a batch of a hundredth of the files reads each row a hundred
times, some percent of the texts' own size each). The counters are at most 128 for each part.

Cases: a null text is an empty one; a null lang is the part ''; a null id is not smaller than any id nor
any smaller than it, so it never fails E nor makes others fail; rows that repeat the smallest id of a text all pass E;
labels of a document that has several are joined (1 if any is), and null or missing labels count as 0; long texts are
read whole; an empty table gives an empty report; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.llm.common import shared_folder

FILTERS = "ABCDE"
_COUNTERS = "part string, mask int, good int, toxic int, n long"


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, mask, part, good, toxic, id) of each document; key: the hash of its text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumns({"key": F.unhex(F.sha2("text", 256)), "_words": words})
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    tests = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length("text"), F.rlike("text", F.lit("[#$%&*|]"))]
    mask = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))
    rows = rows.select("id", "part", "key", mask.alias("mask"))
    kinds = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(kinds, "id", "left").select("key", "mask", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "id")


_HELD = "array<struct<part: string, good: int, toxic: int, n: long>>"
_CHANGES = "array<struct<part: string, mask: int, good: int, toxic: int, n: long>>"
_STEP = f"key binary, least long, held {_HELD}, changes {_CHANGES}"


def added_up(rows: DataFrame) -> DataFrame:
    """(key, mask, least, kinds) of rows of `masked`, one for each text: the smallest id, and for each kind how many
    rows have no id, how many have one, the smallest of these, and how many have that. A text of many rows
    is added up before it is shuffled, and has as many kinds as there are parts and labels at most."""
    kind = ["key", "mask", "part", "good", "toxic"]
    ids = rows.groupBy(*kind, "id").agg(F.count("*").alias("c"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("first")
    kinds = ids.groupBy(*kind).agg(F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("c"))), F.lit(0)).alias("n_null"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("c"))), F.lit(0)).alias("n"), least)
    one = F.struct("part", "good", "toxic", "n_null", "n", F.col("first.id").alias("least"), F.coalesce("first.c", F.lit(0)).alias("n_least"))
    return kinds.groupBy("key").agg(F.first("mask").alias("mask"), F.min("first.id").alias("least"), F.collect_list(one).alias("kinds"))


def merged(added: DataFrame, state: DataFrame) -> DataFrame:
    """(key, least, held, changes) of the texts of `added_up`, given the state (key, least, held): the new state of each
    text, null where it stays as it was, and the changes of the counters."""
    rows = added.join(state.select("key", F.col("least").alias("before"), "held"), "key", "left")
    retracted = F.coalesce(F.col("least") < F.col("before"), F.lit(False))
    now = F.least("least", "before")  # of the two the one that isn't null
    none = F.array()
    held = F.coalesce("held", none.cast(_HELD))
    change = lambda k, e, n: F.struct(k["part"].alias("part"), (F.col("mask") + 16 * e).cast("int").alias("mask"), k["good"].alias("good"), k["toxic"].alias("toxic"), n.cast("long").alias("n"))
    first = lambda k: F.when(k["least"] == F.col("_now"), k["n_least"]).otherwise(0)
    # A smaller id: what passed E so far now fails it.
    undone = F.when(F.col("_retracted"), F.concat(F.transform(held, lambda k: change(k, 0, -k["n"])), F.transform(held, lambda k: change(k, 1, k["n"])))).otherwise(none.cast(_CHANGES))
    passed, failed = F.transform("kinds", lambda k: change(k, 0, k["n_null"] + first(k))), F.transform("kinds", lambda k: change(k, 1, k["n"] - first(k)))
    fresh = F.transform(F.filter("kinds", lambda k: k["least"] == F.col("_now")), lambda k: F.struct(k["part"].alias("part"), k["good"].alias("good"), k["toxic"].alias("toxic"), k["n_least"].cast("long").alias("n")))
    rows = rows.withColumns({"_retracted": retracted, "_now": now}).withColumn("_fresh", fresh)
    touched = F.size("_fresh") > 0
    kept = F.concat(F.when(F.col("_retracted"), none.cast(_HELD)).otherwise(held), "_fresh")
    changes = F.filter(F.concat(undone, passed, failed), lambda c: c["n"] != 0)
    return rows.select("key", F.when(touched, F.col("_now")).alias("least"), F.when(touched, kept).alias("held"), changes.alias("changes"))


def _state(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """(key, least, held) of all texts that batches before this one have seen."""
    rows = spark.read.schema(f"{_STEP}, batch long").parquet(f"{folder}/steps").where((F.col("batch") < before) & F.col("least").isNotNull())
    return rows.groupBy("key").agg(F.max_by(F.struct("least", "held"), "batch").alias("s")).select("key", "s.least", "s.held")


def audit_stream(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Runs the stream docs (doc_id, text, lang) to its present end; returns the counters (part, mask, good, toxic, n).

    labels: (doc_id, quality, toxic), a table. folder: progress, state and changes, in a place that all
    executors share; the same folder goes on where it stopped, also after a failure.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], _STEP).write.mode("overwrite").parquet(f"{folder}/steps/batch=-1")  # so that there is a table

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        keys = added_up(masked(batch, labels))
        merged(keys, _state(session, folder, number)).write.mode("overwrite").parquet(f"{folder}/steps/batch={number}")
        done = session.read.schema(_STEP).parquet(f"{folder}/steps/batch={number}")
        sums = done.select(F.inline("changes")).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")
        sums.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    docs.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return counters(spark, folder)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of all changes written under the folder."""
    path = f"{folder}/changes"
    spark.createDataFrame([], _COUNTERS).write.mode("overwrite").parquet(f"{path}/batch=-1")  # there may be no batch
    rows = spark.read.schema(f"{_COUNTERS}, batch long").parquet(path)
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def _orders(filters: str) -> list[dict]:
    """A row for each order and step: the step's filter and those before it, as bits."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        name = "".join(filters[i] for i in order)
        out += [{"filter_order": name, "step": k + 1, "bit": 1 << i, "before": sum(1 << j for j in order[:k])} for k, i in enumerate(order)]
    return out


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all
    orders of the filters, from counters. The masks of a part, two to the number of filters, are a row of it."""
    masks = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.from_json(F.lit(json.dumps(_orders(filters))), F.lit("array<struct<filter_order: string, step: int, bit: int, before: int>>"))
    rows = parts.select("part", "masks", F.explode(orders).alias("o")).select("part", "masks", "o.*")
    bit, before = F.col("bit"), F.col("before")

    def total(where, what: str = "n") -> Column:
        one = lambda s, m: s + F.when(where(m["mask"]), m[what]).otherwise(0)
        return F.aggregate("masks", F.lit(0).cast("long"), one)

    fails, free = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & free(m)
    # A document that fails k filters is removed by each of them in one of k orders.
    n_orders = len(list(itertools.permutations(filters)))
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(fails(m["mask"]), (m["n"] * n_orders / F.bit_count(m["mask"])).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", total(lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total(here).alias("removed"), total(lambda m: fails(m) & ~free(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """The report of `interactions` over the stream docs."""
    return interactions(audit_stream(docs, labels, folder or f"{shared_folder(docs.sparkSession)}/sparkrag-audit-{uuid.uuid4().hex}"))
