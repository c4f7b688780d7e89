"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, BPE. Part of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import bpe, line_dedup, mixing, ngram_join, quality_model
from pricewright.llm.tables import named, vocabulary, written
from pricewright.sources.staging import clear_staged, forget, staged_so_far


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, finds good and harmless with probability 0.5 at least.

    Judged by the text alone: null and empty ones as texts without words, very long ones whole, repeated rows and null
    ids each for themselves. Ties of probability 0.5 stay. Without labels all stay; an empty table stays empty. All columns pass.
    """
    forget(spark)
    return quality_model.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated runs of lines; n_chars, where there is one, counts anew.

    Null texts stay null, with null n_chars; empty ones stay. Long texts are split into rows of lines. The smallest id,
    then the upper place, keeps a run; equal rows of one id count as one document and all stay. Null ids stand
    first. An empty table stays empty. Other columns pass, whatever their names.
    """
    forget(spark)
    names = [named(c) for c in docs.columns]
    found = line_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*names)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 0.8 Jaccard similarity of five-word shingles.

    Texts without words, null or empty, link with nothing and stay, once for each id. Long texts are whole sets. One of
    repeated rows stays; rows without id go where their text is in a group of ids, else one of each text stays. An empty
    table stays empty. Other columns pass.
    """
    forget(spark)
    return ngram_join.without_similar(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are one source. Documents without words, null or empty, are never taken and go; long ones span blocks,
    and one of each source may be taken in part. Order is by a hash of the id; equal rows of one id share evenly what is
    taken of them. An empty table stays empty. Other columns pass.
    """
    forget(spark)
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix.

    Null and empty texts have no tokens; long ones are encoded whole; each row, repeated or without id, gives one. An
    empty table gives no rows. Other columns are left out.
    """
    forget(spark)
    return bpe.encode_decode(docs, vocabulary())


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("ngram_jaccard", dedup_near), ("mixing", mix_sources), ("bpe", tokenize)]

#: Fitting a classifier is not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written and read again, and then what it and those before staged is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = staged_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        clear_staged(spark, begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
