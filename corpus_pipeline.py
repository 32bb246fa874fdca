"""Documents to token ids: language, toxicity, near-duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All stages but the last return the columns of the documents,
extra ones included; names that a stage needs for itself start with "_p_".

Defined results: texts without a letter are rejected, so null and empty texts
go in the first stage; a text with a letter stays, however short. Of each group
of near-duplicates one row stays: with the smallest id, and the smallest text
hash if the id is repeated; of a group without any id, one row. A document that the mix takes twice is two rows. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm import bpe, language, mixing, simhash, toxicity
from voltloom.llm.base import crc_fold, table
from voltloom.llm.registry import VOCABULARY


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in like.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter."""
    training = docs.where(crc_fold("doc_id", 5) != 0).select("text", "lang")
    seen = language.predict(docs, language.learn(training), out=("_p_lang", "_p_score"))
    return _columns(seen.where(F.col("_p_lang") != language.UNKNOWN), docs)


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _columns(toxicity.score(docs, model, out=("_p_score", "_p_toxic")).where("_p_toxic = 0"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group."""
    marked = docs.withColumn("_p_text", F.xxhash64("text"))
    found = simhash.grouped(marked, ["doc_id", "_p_text"])
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("_p_text").alias("hash")))
    kept = found.groupBy("root").agg(first.alias("first")).select(
        F.col("first.doc_id").alias("_p_id"), F.col("first.hash").alias("_p_hash"))
    rows = marked.join(kept, marked["doc_id"].eqNullSafe(kept["_p_id"]) & (F.col("_p_text") == F.col("_p_hash")), "left_semi")
    return _columns(rows.dropDuplicates(["doc_id", "_p_text"]), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row."""
    return bpe.encode_decode(docs.select("doc_id", "text"), VOCABULARY,
                             outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("toxicity", toxic_text), ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mix), ("bpe", encoded)]

#: Learned models and fingerprints are not for SQL; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
