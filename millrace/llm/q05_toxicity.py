"""Query op5: toxicity of documents, learnt from the labels outside one fold."""

from pyspark.sql import functions as F

from .common import read_table
from .toxicity import held_out, score, train

NAME = "op5_toxicity"
SQL = None  # a trained model


def query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
