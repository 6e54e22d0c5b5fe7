"""A corpus pipeline of the training-data operators: each stage works on all that the one before it kept.

Cases: null and empty texts pass the first three stages (they are not toxic, similar to nothing and hold no repeats) and are never
drawn by the mix; rows without a doc_id stay apart from each other; repeated rows, and rows of one doc_id with different texts, leave
the Jaccard stage as one row per doc_id; very long texts are read whole in every stage; nulls in other columns and columns of any
name are carried along; an empty table gives an empty result. The last stage numbers the rows that it reads (``row``), so the pieces of a
document that the mix drew several times can be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard_join, mixing, packing, substring_dedup, toxicity
from lectern.llm.common import Scratch, table, tidied


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the input's labelled rows, doesn't mark as toxic."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets connect."""
    return jaccard_join.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that occur more than once."""
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix draws a document, shard by shard in the shard's local order; cut documents keep their first words."""
    out = mixing.mix(docs).drop("_shard", "_order")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_copies_out),
    ("suffix-array dedup", repeats_out),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can't express the learned and the tokenising stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with tidied():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
