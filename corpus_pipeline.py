"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import mixing, packing, queries, simhash, suffix, toxicity
from tidegraph.storage import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: sets of five-word shingles of Jaccard similarity 4/5 or more.
WORDS, SIMILARITY = 5, (4, 5)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null doc_id is judged by its text like others, null and empty texts stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the least doc_id (of equal ids by its text's hash).

    Rows with equal doc_ids are judged by their texts: both stay where these are
    in different groups.  A row without a doc_id goes by a hash of its text, after all others.
    """
    rows = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))).alias("_id"), *simhash.text_keys(F.col("text")))
    found = simhash.near_texts(rows.select("t0", "t1", "text"), WORDS, *SIMILARITY)
    # a group keeps the text that holds its least id, and of this text's rows the one of that id
    lows = rows.groupBy("t0", "t1").agg(F.min("_id").alias("_id")).withColumn("vertex", simhash.hexed("t0", "t1"))
    group = F.coalesce("component", "vertex")
    keep = lows.join(found, "vertex", "left").groupBy(group.alias("_group")).agg(F.min(F.struct("_id", "t0", "t1")).alias("_least")).select("_least.*")
    row = F.struct("text", "source", "lang", "n_chars", "doc_id")
    best = rows.join(keep, ["_id", "t0", "t1"], "left_semi").groupBy("_id", "t0", "t1").agg(F.min(row).alias("_row"))
    return best.select("_row.*").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at two places are taken out of the texts; code points they cut are dropped."""
    return suffix.cut_texts(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more in part where the sample ends in it; a null source is one of its own."""
    return mixing.mixed_rows(docs.select(*COLUMNS), queries.quality_weights(spark, sf_dir))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row per piece; null and empty texts are their end token, repeated rows are packed as often."""
    return packing.pack(docs, queries.default_encoder())


STAGES = [("toxicity", toxic), ("near copies", near_copies), ("repeats", repeats), ("mixing", mixed), ("packing", packed)]
#: No SQL: the stages hold trained weights, hashes and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table, each staged but the last; an empty table goes through all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(spark, docs, "pipeline")
    return docs
