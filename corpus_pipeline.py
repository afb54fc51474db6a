"""A corpus from the table documents: languages, near copies, benchmark passages, mixture and shards, a stage each.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the last adds
its shard's columns. No rows give no rows in every stage; columns called like a stage's own are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import cube, fmindex, langid, minhash, shards
from weftline.llm.common import delete, materialize, n_words, scratch, shared_dir, sift, small_batches, table

#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20


def apart(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that are called like a result renamed, and how to rename them back."""
    own = {c: f"__w_own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(own), {v: k for k, v in own.items()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognized. What was learned comes from the table's own rows that aren't held out.

    A null text and one without a letter go; rows are judged one by one, so repeated rows and rows without an id stay or go alike. Where they teach nothing (none has a language), no document can be told from another and all that have a letter stay.
    """
    small_batches(spark)
    model = langid.fit(docs)
    if model is None:
        return langid.with_letters(docs)
    own, back = apart(docs, ["lang_pred", "score"])
    found = langid.predict(own, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= langid.LEAST_SCORE)).select(*own.columns).withColumnsRenamed(back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one that the table lists first.

    Rows are numbered, so copies under one id, without an id or as repeated rows go too. A text without words has no copies and stays.
    """
    rows = materialize(docs.withColumn("__w_row", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows.select(F.col("__w_row").alias("doc_id"), "text"), percent=80)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("__w_gone")), "gone")
    may, rest = sift(rows, "__w_row", gone)
    return may.join(gone.hint("merge"), F.col("__w_row") == F.col("__w_gone"), "left_anti").unionByName(rest).drop("__w_row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the benchmark's passages. A document of which no word is left goes; n_chars is counted anew where the text changed.

    Rows are treated one by one, whatever their ids; a null text stays null.
    """
    own, back = apart(docs, ["n_words", "spans", "items"])
    found = fmindex.contamination(own, table(spark, sf_dir, "benchmark"))
    left = fmindex.clean(found, [*own.columns, "spans"], least_items=1)
    cut = F.size("spans") > 0
    left = left.where(~cut | (n_words(F.col("text")) > 0))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*own.columns).withColumnsRenamed(back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all.

    A null source is a source; texts without words are drawn as documents of size 0; repeated rows are taken together.
    """
    return cube.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard. Rows that repeat an id share one; without an id the text decides; a null text has no bytes."""
    return shards.shard(docs, SHARD_BYTES)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mixture", mixture), ("sharding", sharding)]

#: SQL can't express the language model or the balanced sample.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage needed is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
