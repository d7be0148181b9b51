"""From raw documents to token ids in five stages: language, near copies, repeated passages, benchmark leaks, encoding.

Every stage gets a stored table, keeps rows with null or repeated ids as rows of their own, and gives no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import bpe, decontaminate, language, neardup, substrings
from isobar.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Least share of the predicted language; below it, and without any letter, a document is rejected.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose language is not clear; without any learned label, the first only."""
    docs = docs.select(*COLUMNS)
    net = language.fit(docs.filter(~language.held_out("doc_id")))
    rows = language.predict(docs, net)
    clear = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) if net.labels else F.col("text").rlike(r"\p{L}")
    return rows.filter(clear).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the first with the smallest doc_id: five-word shingles, similarity 0.8 or more."""
    return neardup.one_per_group(docs.select(*COLUMNS), shingle=5, percent=80, stored=True).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of repeated 35-word windows out of texts; a text without any stays as it is."""
    rows = substrings.kept_words(substrings.removal_intervals(docs.select(*COLUMNS), stored=True))
    rows = rows.withColumn("text", F.when(F.size("removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies inside benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the decoded text."""
    rows = bpe.encode(docs.select("doc_id", "text"), bpe.word_vocabulary(), keep_ids=True)
    return rows.select("doc_id", "n_tokens", F.split("ids_text", " ").alias("_ids"), "ids_text", "decoded").select(
        "doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("_ids").cast("array<int>")).otherwise(F.array().cast("array<int>")).alias("ids"),
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode_texts),
]
# A trained network and a tokenizer decide the rows, so there is no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
