"""Corpus preparation in stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import packed, read_table, stored, unpacked
from millrace.llm.minhash import LEAST_ID, near_duplicates, text_sha
from millrace.llm.packing import pack
from millrace.llm.pii import masked
from millrace.llm.substring_dedup import remove_repeats
from millrace.llm.toxicity import score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels outside one fold."""
    model = train(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return unpacked(score(packed(docs, "doc_id", "text"), model).where("score < 0.5"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles.

    Rows are told apart by id and text; of rows that share both, one stays, all if they have no word.
    """
    found = near_duplicates(docs.select("doc_id", "text"), percent=80, shingle=5, sha=True)
    kept = found.groupBy(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("_id"), F.col("sha").alias("_sha")).agg(F.count(F.lit(1)).alias("_held"), F.count_if("kept").alias("_kept"))
    kept = stored(kept.where("_kept > 0"))
    rows = packed(docs, "doc_id", "text").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))).withColumn("_sha", text_sha(F.col("text")))
    one_of, key = kept.where("_held > _kept"), ["_id", "_sha"]
    if one_of.limit(1).count():
        rows = rows.join(kept.where("_held = _kept"), key, "left_semi").unionByName(rows.join(one_of, key, "left_semi").dropDuplicates(key))
    else:
        rows = rows.join(kept, key, "left_semi")
    return unpacked(rows, docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words in windows of 20 that also start earlier; a text of nothing else goes."""
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # no name of theirs can clash
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(to) for c, to in place.items()])
    found = remove_repeats(plain, window=20, texts=True).where("n_removed < n_words or n_words = 0")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[(new[c] if c in new else F.col(place[c])).alias(c) for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, length=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
#: A trained model and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
