"""Chat sessions: the last turns of a history (W6), and anchors that a turn leaves to the next (W7), in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANCHOR = "product_name string, candidates array<string>, last_variants array<string>"


def history(turns: DataFrame, k: int = 6, *keys: str) -> DataFrame:
    """Adds ``history``: the texts of the last ``k`` turns before each one, oldest first."""
    by = Window.partitionBy(*keys).orderBy("turn").rowsBetween(-k, -1)
    return turns.withColumn("history", F.collect_list("text").over(by))


def left_by(results: DataFrame) -> DataFrame:
    """What a turn's result (status, product_name, candidates, variants) leaves: its product, and no candidates; the candidates of a choice, and no product; else nothing.

    The variant is one if there is one or all share a short code, else the list. No earlier turn matters, so no fold is needed.
    """
    from ..functions import text as X

    codes = F.array_distinct(F.transform("variants", X.short_code))
    shared = (F.size(codes) == 1) & F.get(codes, F.lit(0)).isNotNull()
    product = F.when(F.col("status") != "clarify_product", F.col("product_name"))
    candidates = F.when(F.col("status") == "clarify_product", F.col("candidates"))
    variants = F.when(product.isNotNull(), F.when(shared, F.slice("variants", 1, 1)).otherwise(F.col("variants")))
    return results.withColumn("anchor", F.struct(product.alias("product_name"), candidates.alias("candidates"), variants.alias("last_variants")))


def anchors(results: DataFrame, *keys: str) -> DataFrame:
    """W7 in batch: the anchor before each turn of a session."""
    before = F.lag("anchor").over(Window.partitionBy(*keys).orderBy("turn"))
    return left_by(results).withColumn("anchor", before)


def results_of(questions: DataFrame, answered: DataFrame, *keys: str) -> DataFrame:
    """What ``answer.answers`` found, as a turn's result: keys, status, product_name (null for several), candidates, variants; one row for each question (qid, keys)."""
    shown = F.when(F.col("row_ord").isNotNull(), F.col("model_variant"))
    clarify = F.col("status") == "clarify_product"
    one = F.min("product_name") == F.max("product_name")
    g = answered.groupBy("qid").agg(
        F.min("status").alias("status"), F.when(one & ~F.bool_or(clarify), F.min("product_name")).alias("product_name"),
        F.array_sort(F.collect_set(F.when(clarify, F.col("product_name")))).alias("candidates"), F.array_sort(F.collect_set(shown)).alias("variants"),
    )
    return questions.select("qid", *keys).join(g, "qid").drop("qid")


def asked_next(questions: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Questions (keys, turn) with what the turn before left in their session: last_product, last_candidates, last_variants, from results (keys, turn, status ...) of that turn."""
    left = left_by(results).select(*keys, (F.col("turn") + 1).alias("turn"), F.col("anchor.product_name").alias("last_product"), F.col("anchor.candidates").alias("last_candidates"), F.col("anchor.last_variants").alias("last_variants"))
    none = F.array().cast("array<string>")
    return questions.join(left, [*keys, "turn"], "left").withColumn("last_variants", F.coalesce("last_variants", none))


def stream_anchors(results: DataFrame, key: str = "session", idle: int | None = None) -> DataFrame:
    """W7 as a stream: (key, turn, anchor before it) from a streaming table (key, turn, status, product_name, candidates, variants).

    Only a session's last anchor is kept as state; with ``idle`` none of a session that was idle for so many milliseconds, and its
    next turn has no anchor. For streams that run on: queries that end when all is read (``availableNow``) wait for timeouts. Turns of one batch are put in order; a turn that comes after a later one was seen is answered from the
    state as it stands.
    """
    kind = dict(results.dtypes)[key]
    schema = f"{key} {kind}, turn long, anchor struct<{ANCHOR.replace(' ', ':').replace(',:', ',')}>"
    prepared = left_by(results).select(key, F.col("turn").cast("long").alias("turn"), "anchor.*")

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for row in rows.itertuples(index=False):
            out.append({key: group[0], "turn": row.turn, "anchor": {"product_name": now[0], "candidates": now[1], "last_variants": now[2]}})
            lists = [None if x is None else list(x) for x in (row.candidates, row.last_variants)]
            now = (row.product_name, *lists)
        state.update(now)
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out)

    return prepared.groupBy(key).applyInPandasWithState(step, schema, ANCHOR, "append", "ProcessingTimeTimeout" if idle else "NoTimeout")
