"""A corpus cleaned and packed for training: quality, toxicity, near copies, repeated passages, packing.

Every stage works on what the one before kept and returns its rows with the columns of documents; the
last returns the pieces of the packed sequences. Both classifiers learn from a bounded sample of the
labelled documents of the table that the pipeline starts from, so that the toxicity chain still meets
the documents of low quality which are gone by then.

Cases, in all stages: an empty table gives an empty result; extra columns, whatever their names, pass
through unchanged; a repeated row is kept or dropped like its twin by the classifiers and gives
pieces of its own when packed. What a stage does with nulls and with empty and long texts is said
at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.llm import byte_cnn, minhash, packing, suffix_dedup, toxicity
from sparkrag.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below 0.3. A null text scores like an empty one; long texts are scored whole."""
    model = byte_cnn.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return byte_cnn.keep_good(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the chain calls toxic. A null or empty text has no features and stays unless
    the chain's intercepts alone say otherwise; long texts are scored whole."""
    chain = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_flagged(docs, chain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts that share 80 percent of their
    shingles. Null and empty texts, and rows with a null id, stay; rows that repeat an id stay or go together."""
    return minhash.drop_near_duplicates(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeats of at least 200 bytes out of the texts, all but the first copy. Null texts stay null; rows
    that repeat id and text keep alike; n_chars, where there is one, is counted anew."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens. A null or empty text is its end id alone;
    a null id stays null; long texts are cut freely."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
