"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

Every stage gets all rows that its predecessor kept and returns the columns of documents; the last returns the packed pieces.
Rows with null texts or ids pass through the filters; an empty table passes through as it is. Repeated rows count as copies of
each other, very long texts go whole through every stage, and further columns of documents stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import decontamination, jaccard, packing, suffixes, toxicity
from annalist.llm.common import read, written


#: The fewest words of a passage that is not to be repeated, however few bytes they have.
WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, scores below 0.5."""
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of rows repeated under one id with one text, one.

    Different texts under one id all stay if any of them is the first of its group: none is lost that has no copy. Of rows
    without an id, one of each text stays that no row with an id has, and all without words. A repeat that stays would be cut
    from all its rows by the next stage.
    """
    first = jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    bare = docs.where("doc_id is null")
    said = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    digest = F.sha1(F.col("text").cast("binary"))
    known = docs.where("doc_id is not null").select(digest.alias("__digest"))
    single = bare.where(said).dropDuplicates(["text"]).withColumn("__digest", digest).join(known, "__digest", "left_anti").drop("__digest")
    return kept.unionByName(single).unionByName(bare.where(~said)).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, and the strings of 400 bytes, that occur more than once; n_chars follows the text."""
    return counted(suffixes.remove(docs, words=WORDS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), how="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard join", one_of_each_group),
    ("suffix dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
