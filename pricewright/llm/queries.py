"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, fim, hard_negatives, licenses, line_dedup, mixing, ngram_join, quality_model, quality_rules, toxicity, urls
from .tables import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_gone", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.formatted(chat.parts_of_messages(table(spark, sf_dir, "conversations"), turns=True), chat.REPLY)
    return found.select("conv_id", "turn", "kind", "call_id", "linked_turn", "at", "problem", F.md5("json").alias("json_md5"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "n_slots")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, label = table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    wrong = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mined(vectors.withColumn("label", wrong))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(table(spark, sf_dir, "documents")).drop("output")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat": op2_chat,
    "op3_mixing": op3_mixing,
    "op4_licences": op4_licences,
    "op5_bpe": op5_bpe,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_rules": op7_quality_rules,
    "quality_ablations": quality_ablations,
    "op8_urls": op8_urls,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fim": op12_fim,
    "op13_toxicity": op13_toxicity,
}
#: Queries that SQL can express. Not here: mixing (a hash order and a schedule), BPE, nearest neighbours and fitted models; tests hold these against brute force.
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.DEDUP_SQL,
    "op2_chat": chat.TURNS_SQL,
    "op4_licences": licenses.scan_sql(),
    "op6_ngram_jaccard": ngram_join.GROUPS_SQL,
    "op7_quality_rules": quality_rules.RULES_SQL,
    "quality_ablations": quality_rules.ABLATIONS_SQL,
    "op8_urls": urls.judged_sql(),
    "op11_hard_negatives": hard_negatives.HARD_NEGATIVES_SQL,
    "op12_fim": fim.FIM_SQL,
}
