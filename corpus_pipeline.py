"""A corpus pipeline over documents: every stage calls one of the training-data operators on all rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm import decontaminate, line_dedup, packing, simhash, toxicity
from cadentia.llm.common import cut, free_name, path_of, remove, scratch, table

#: Least Jaccard similarity of five-word shingles of documents of which one stays.
SIMILARITY = 0.8
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, lexicon)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents left without a line go with them."""
    lines, removed = free_name(docs, "_n_lines"), free_name(docs, "_n_removed")
    out = line_dedup.dedup_lines(docs, n_lines=lines, n_removed=removed)
    kept = out.where(~((F.col(removed) > 0) & (F.col(removed) == F.col(lines))))
    if "n_chars" in docs.columns:
        chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays.

    Near are fingerprints within 3 bits, and sets of five-word shingles with a Jaccard similarity of SIMILARITY or more.
    """
    return simhash.keep_one(docs, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed token sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_near),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: No SQL: hashing, learned weights and the packing search are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and what it was made from goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            made = cut(stage(spark, docs, sf_dir), name)
            kept.add(path_of(made))
        remove(spark, docs)
        docs = made
    return docs
