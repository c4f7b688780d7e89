"""Quality rules: a ledger of failure bits and measurements, versioned policies over it, ablations by bits. Built-in functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rules, one bit each in this order: a name and a condition over the measurements. Only whole numbers are compared.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "10 * word_chars < 22 * n_words"),
    ("long_words", "10 * word_chars > 140 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("many_words", "n_words > 1000000"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: no rule of ``hard`` fails, and at most ``allowed`` of ``soft``."""

    name: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (BASE, Policy("v1", ("few_words", "repeated_words", "symbols", "capitals"), ("short_words", "long_words", "repeated_lines", "many_words"), 1))


def mask(names: tuple[str, ...], rules=RULES) -> int:
    order = [name for name, _ in rules]
    return sum(1 << order.index(n) for n in names)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (longs).

    Five-word windows are compared by 64-bit hashes. Texts whose windows all differ, most of them, stop there; in
    the others the windows are sorted, those with an equal neighbour mark their places, and marks add up to words.
    Characters are counted in what one pass leaves of a text, without ``translate``, which looks up every character.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.ltrim(x, F.lit(SPACE)) != "")
    counted = F.regexp_replace("t", f"[^A-Z{re.escape(SYMBOLS)}]+", "")  # capitals and symbols
    d = d.select("doc_id", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"), lines.alias("l"), F.length(F.array_join("w", "")).alias("word_chars"), counted.alias("c"))
    d = d.withColumn("n_symbols", F.length(F.regexp_replace("c", "[A-Z]+", "")))
    d = d.select("doc_id", "n", "h", "word_chars", "n_symbols", (F.length("c") - F.col("n_symbols")).alias("n_capitals"), F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"))
    after = lambda c, k: F.slice(c, F.lit(k + 1), F.col("n"))
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    d = d.withColumn("g", pair("h", after("h", 1)))
    d = d.withColumn("g", pair("g", after("g", 2)))
    d = d.withColumn("g", F.slice(pair("g", after("h", 4)), F.lit(1), F.greatest(F.col("n") - 4, F.lit(0)))).drop("h")  # the last four are no whole windows
    d = d.withColumn("g", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.col("g")))
    d = d.withColumn("s", F.when(F.col("g").isNotNull(), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("g")
    d = d.withColumn("e", F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: a["h"] == b["h"]))
    same = lambda x, j: F.coalesce(F.get("e", j), F.lit(False)) | F.coalesce(F.get("e", j - 1), F.lit(False))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"]))).drop("s", "e")
    steps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    words = F.when(F.size("p") > 0, F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x)).otherwise(F.lit(0))
    longs = ["word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals"]
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"), *(F.col(c).cast("long").alias(c) for c in longs), words.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measurements and ``failed``, a long with the bit of every rule that fails: each rule is evaluated once, policies read the bits.

    Null and empty texts have no words and fail the rule on few words. Very long texts are measured whole.
    Repeated rows and null ids: a row for each. Empty table: no rows. Other columns are ignored.
    """
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed)


def verdict(policy: Policy, rules=RULES) -> Column:
    """Column: whether a row of the ledger passes a policy."""
    hard = F.col("failed").bitwiseAND(mask(policy.hard, rules)) == 0
    return hard & (F.bit_count(F.col("failed").bitwiseAND(mask(policy.soft, rules))) <= policy.allowed)


def ablations(found: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """policy, rule, failed, alone: documents that fail a rule of a policy, and those that only this rule rejects.

    Documents are first counted by their bits (2**rules rows at most), so that policies cost nothing more.
    """
    counts = found.groupBy("failed").agg(F.count("*").alias("c"))
    out = []
    for p in policies:
        for name in (*p.hard, *p.soft):
            bit = mask((name,), rules)
            without = Policy(p.name, tuple(x for x in p.hard if x != name), tuple(x for x in p.soft if x != name), p.allowed)
            alone = F.sum(F.when(~verdict(p, rules) & verdict(without, rules), F.col("c")).otherwise(0))
            failed = F.sum(F.when(F.col("failed").bitwiseAND(bit) != 0, F.col("c")).otherwise(0))
            out.append(F.struct(F.lit(p.name).alias("policy"), F.lit(name).alias("rule"), F.coalesce(failed, F.lit(0)).alias("failed"), F.coalesce(alone, F.lit(0)).alias("alone")))
    return counts.agg(F.array(*out).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def judged(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The ledger with base_failed and kept: what the base policy rejects is not kept, the rest by ``policy``."""
    return ledger(docs).withColumn("base_failed", ~verdict(BASE)).withColumn("kept", ~F.col("base_failed") & verdict(policy))


LEDGER_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, range(0, 5) AS k(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
  + 8 * (10 * word_chars < 22 * n_words)::BIGINT + 16 * (10 * word_chars > 140 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
  + 64 * (100 * n_capitals > 40 * word_chars)::BIGINT + 128 * (n_words > 1000000)::BIGINT AS failed FROM m)
"""

RULES_SQL = f"""{LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, failed & 3 <> 0 AS base_failed,
       failed & 71 = 0 AND bit_count(failed & 184) <= 1 AS kept FROM b
"""

#: For each rule of the two policies: what fails it, and what passes once it is left out.
ABLATIONS_SQL = f"""{LEDGER_SQL},
rules(policy, rule, bit, hard, soft) AS (VALUES ('base', 'few_words', 1, 3, 0), ('base', 'repeated_words', 2, 3, 0),
  ('v1', 'few_words', 1, 71, 184), ('v1', 'repeated_words', 2, 71, 184), ('v1', 'symbols', 4, 71, 184), ('v1', 'capitals', 64, 71, 184),
  ('v1', 'short_words', 8, 71, 184), ('v1', 'long_words', 16, 71, 184), ('v1', 'repeated_lines', 32, 71, 184), ('v1', 'many_words', 128, 71, 184)),
p AS (SELECT policy, rule, failed & bit <> 0 AS fails, failed & hard = 0 AND bit_count(failed & soft) <= CASE policy WHEN 'v1' THEN 1 ELSE 0 END AS passes,
  failed & hard & ~bit = 0 AND bit_count(failed & soft & ~bit) <= CASE policy WHEN 'v1' THEN 1 ELSE 0 END AS would FROM b, rules)
SELECT policy, rule, count(*) FILTER (fails) AS failed, count(*) FILTER (would AND NOT passes) AS alone FROM p GROUP BY policy, rule
"""
