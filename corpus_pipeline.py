"""Training-data pipeline: toxicity, line dedup, near-duplicate dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents; other columns are left out.

Null and empty texts aren't toxic, repeated or contaminated: they stay, with no tokens (line_dedup turns a null text into an empty one). Rows that repeat
doc_id and text are judged alike, and stay or go together; a null doc_id is a value. Null lang and source stay null. Texts of any length
are read whole. An empty table gives an empty one at each stage, with its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import among, stored, table
from lodestar.llm.decontam import decontaminate
from lodestar.llm.line_dedup import dedup_lines
from lodestar.llm.neardup import near_duplicates
from lodestar.llm.sentencepiece_codec import encode_documents
from lodestar.llm.toxicity import fit, reject

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The tokenizer's file; a parameter of the environment.
TOKENIZER = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    docs = docs.select(*COLUMNS)
    return reject(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; a text of which nothing is left stays as an empty one."""
    left = dedup_lines(docs.select(*COLUMNS), keep=["lang", "source"])
    return left.select("doc_id", F.col("kept").alias("text"), F.col("keep_lang").alias("lang"), F.col("keep_source").alias("source"), F.char_length("kept").cast("long").alias("n_chars"))


def _without(docs: DataFrame, judged: DataFrame, name: str) -> DataFrame:
    """docs without the rows that judged (doc_id, _tk) tells; equal rows are judged alike."""
    keys = stored(judged.select(F.col("doc_id").alias("d"), F.col("_tk").alias("t")).distinct(), name)
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_tk"))
    return among(keyed, keys, anti=True).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (0.8 of their shingles of five words or more), the document with the smallest doc_id stays."""
    return _without(docs, near_duplicates(docs, similarity=80).where(~F.col("kept")), "near-duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole window of a benchmark passage go, however long they are, and those of which at least one word in
    twenty belongs to shorter items."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("whole or contaminated"), "contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of their decoding."""
    return encode_documents(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: The toxicity model and the tokenizer can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
