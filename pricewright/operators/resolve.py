"""From questions to products: mentions, codes, scores, typing errors, shortlists, families, phrases.

Tables of questions (qid, brand, message) meet tables of names (brand, product_name, ...) by equi-joins on the brand
and a token, so that the cost follows the tokens shared, not questions times names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Qid, product_name, claim: the names that a message holds word for word.

    Longer names claim their words first; a name is found if any occurrence is free of claimed words, and claims all
    such. Grams of the message as long as some name join the names; the claims run over a question's occurrences.
    """
    n = names.select("brand", "product_name", F.length(X.normalize("product_name")).alias("size"), X.mention_tokens("product_name").alias("t")).where(F.size("t") > 0)
    n = n.select("brand", "product_name", "size", F.size("t").alias("len"), F.array_join("t", " ").alias("gram"))
    lengths = n.select("brand", "len").distinct()
    q = questions.select("qid", "brand", X.mention_tokens("message").alias("t")).join(lengths, "brand").where(F.size("t") >= F.col("len"))
    grams = q.select("qid", "brand", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("len") + 1), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("t", i, F.col("len")), " ").alias("gram")))).alias("g"))
    found = grams.select("qid", "brand", "len", "g.*").join(n, ["brand", "gram", "len"])
    order = F.struct((-F.col("size")).alias("size"), "product_name", "at", "len")
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(order)).alias("o"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("names"))

    def claim(a: Column, o: Column) -> Column:
        span = F.sequence(o["at"], o["at"] + o["len"] - 1)
        free = ~F.arrays_overlap(a["used"], span)
        used = F.when(free, F.concat(a["used"], span)).otherwise(a["used"])
        return F.struct(used.alias("used"), F.when(free, F.array_union(a["names"], F.array(o["product_name"]))).otherwise(a["names"]).alias("names"))

    return lists.select("qid", F.posexplode(F.aggregate("o", start, claim, lambda a: a["names"])).alias("claim", "product_name"))


def codes_of(names: DataFrame, prices: DataFrame) -> DataFrame:
    """Brand, product_name, code, context, priced: the codes of price rows and the art codes of the index; ``priced`` tells whether a product has rows."""
    of_rows = prices.select("brand", "product_name", "code", F.col("variant_context").alias("context"), F.lit(True).alias("priced"))
    if "art_code" not in names.columns:
        return of_rows
    known = prices.select("brand", "product_name").distinct().withColumn("priced", F.lit(True))
    of_index = names.where("art_code is not null").join(known, ["brand", "product_name"], "left")
    none = F.lit(None).cast("string").alias("context")
    return of_rows.unionByName(of_index.select("brand", "product_name", F.col("art_code").alias("code"), none, F.coalesce("priced", F.lit(False)).alias("priced")))


def by_code(questions: DataFrame, codes: DataFrame) -> DataFrame:
    """R2: qid, product_name, shared: products whose code (``codes_of``; ``priced`` may be absent) is a word of the message.

    Of several products those sharing most words of name or context with the message stay, if any share; of these
    those with prices, if some, not all, have any.
    """
    if "priced" not in codes.columns:
        codes = codes.withColumn("priced", F.lit(True))
    # a code of ASCII letters and digits alone is plain in small letters
    plain = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z0-9]*\z"), F.lower(c)).otherwise(F.regexp_replace(X.normalize(c), "[^a-z0-9]+", ""))
    words = X.tokenize_loose(F.concat_ws(" ", "product_name", "context"))
    q = questions.select("qid", "brand", X.tokenize_loose("message").alias("t"))
    # only codes that a message holds are grouped and get their words
    asked = q.select("brand", F.explode("t").alias("token")).distinct()
    c = codes.where("code is not null").withColumn("token", plain("code")).join(asked, ["brand", "token"], "left_semi")
    c = c.groupBy("brand", "product_name", "token", "context").agg(F.max("priced").alias("priced"))
    hits = q.select("qid", "brand", "t", F.explode(F.array_distinct("t")).alias("token")).join(c, ["brand", "token"])
    hits = hits.withColumn("w", words).groupBy("qid", "product_name", "token").agg(F.first("t").alias("t"), F.array_distinct(F.flatten(F.collect_set("w"))).alias("w"), F.max("priced").alias("priced"))
    hits = hits.groupBy("qid", "product_name").agg(F.max(F.size(F.array_intersect("t", "w"))).alias("shared"), F.max("priced").alias("priced"))
    by = Window.partitionBy("qid")
    hits = hits.withColumn("most", F.max("shared").over(by)).where("most = 0 or shared = most")
    return hits.withColumn("any", F.max("priced").over(by)).where("priced or not any").select("qid", "product_name", "shared")


def scored_names(names: DataFrame) -> DataFrame:
    n = names.withColumn("c", X.normalize("product_name"))
    return n.withColumn("ct", X.score_tokens("c"))


def scores(questions: DataFrame, names: DataFrame) -> DataFrame:
    """R3 (J2): qid, product_name, collection, score of every name that scores above 0.

    A pair can score by a common token, by one's tokens joined being a word of the other, or by being equal; each is
    an equi-join with the brand. Names and questions with other characters than words and separators could hold a
    joined token across them, so these few join by brand alone.
    """
    q = questions.select("qid", "brand", X.normalize("message").alias("q")).withColumn("qt", X.score_tokens("q"))
    q = q.withColumn("strong", X.strong_tokens("qt")).withColumn("content", X.content_tokens("qt"))
    n = scored_names(names).select("brand", "product_name", "collection", "c", "ct")
    word = lambda t: X.not_empty(F.split(t, r"\W+"))
    odd = lambda t: F.array_join(t, "").rlike(r"\W")
    keys = lambda t, text, equal: F.array_distinct(F.concat(F.transform(t, lambda x: F.concat(F.lit("t "), x)), equal))
    q_keys = keys(F.col("qt"), "q", F.concat(F.transform(word(F.col("q")), lambda x: F.concat(F.lit("c "), x)), F.array(F.concat(F.lit("q "), F.array_join("qt", "")), F.concat(F.lit("e "), F.col("q")))))
    n_keys = keys(F.col("ct"), "c", F.concat(F.transform(word(F.col("c")), lambda x: F.concat(F.lit("q "), x)), F.array(F.concat(F.lit("c "), F.array_join("ct", "")), F.concat(F.lit("e "), F.col("c")))))
    by_key = q.select("qid", "brand", F.explode(q_keys).alias("k")).join(n.select("brand", "product_name", F.explode(n_keys).alias("k")), ["brand", "k"]).select("qid", "brand", "product_name")
    odd_names = n.where(odd(F.col("ct")) & (F.size("ct") > 1)).select("brand", "product_name", F.array_join("ct", "").alias("whole")).join(q.select("qid", "brand", "q"), "brand").where(X.contains_word("q", "whole")).select("qid", "brand", "product_name")
    odd_questions = q.where(odd(F.col("qt")) & (F.size("qt") > 1)).select("qid", "brand", "qt").join(n.select("brand", "product_name", "c"), "brand").where(X.contains_word("c", F.array_join("qt", ""))).select("qid", "brand", "product_name")
    pairs = by_key.unionByName(odd_names).unionByName(odd_questions).distinct()
    joined = pairs.join(q, ["qid", "brand"]).join(n, ["brand", "product_name"])
    return joined.select("qid", "product_name", "collection", "ct", X.similarity("q", "c", "qt", "ct", "strong", "content").alias("score")).where("score > 0")


def matches(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Scores with siblings promoted: qid, product_name, score, rank.

    Where the top score is below 80, names of the collection of a top name of two tokens, the second with a digit,
    rise to it if they have more tokens and the same first one.
    """
    s = scores(questions, names).withColumn("top", F.max("score").over(Window.partitionBy("qid")))
    tops = s.where((F.col("score") == F.col("top")) & (F.col("top") < 80) & (F.size("ct") == 2) & F.element_at("ct", 2).rlike(r"\d")).select("qid", "collection", F.element_at("ct", 1).alias("head")).distinct()
    s = s.withColumn("head", F.get("ct", F.lit(0)))
    s = s.join(tops.withColumn("lifted", F.lit(True)), ["qid", "collection", "head"], "left")
    score = F.when(F.col("lifted") & (F.size("ct") > 2), F.col("top")).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "product_name"))
    return s.withColumn("score", score).withColumn("rank", rank).select("qid", "product_name", "score", "rank")


def tied(found: DataFrame, band: float = 5.0) -> DataFrame:
    """The matches within ``band`` of a question's best."""
    return found.withColumn("top", F.max("score").over(Window.partitionBy("qid"))).where(F.col("score") >= F.col("top") - band).drop("top")


def without_letters(c) -> Column:
    """A word and what is left of it without any one or two letters: words within two edits have one of these in common."""
    word = F.col(c) if isinstance(c, str) else c
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.array_distinct(cut(word))
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(F.filter(once, lambda w: w != ""), cut))))


def fuzzy(questions: DataFrame, names: DataFrame) -> DataFrame:
    """R4 (J4): qid, product_name, distance: names a word of which is within an edit (two for more than four letters) of a word of the message.

    Distinct words of questions meet distinct words of names, by what is left of them without up to two letters; the
    pairs that are close enough go back to questions and names by brand and word.
    """
    q = questions.select("qid", "brand", F.explode(F.array_distinct(X.tokenize_loose("message"))).alias("w")).where((F.length("w") >= 3) & ~F.col("w").isin(*X.RISKY))
    n = names.select("brand", "product_name", F.explode(F.array_distinct(X.tokenize_loose("product_name"))).alias("v")).where(F.length("v") >= 3)
    asked = q.select("w").distinct().select("w", F.explode(without_letters("w")).alias("part"))
    held = n.select("v").distinct().select("v", F.explode(without_letters("v")).alias("part"))
    close = asked.join(held, "part").select("w", "v").distinct().withColumn("distance", F.levenshtein("w", "v"))
    close = close.where(F.col("distance") <= F.when(F.length("w") <= 4, 1).otherwise(2))
    hits = q.join(close, "w").join(n, ["brand", "v"])
    return hits.groupBy("qid", "product_name").agg(F.min("distance").alias("distance"))


def shortlist(questions: DataFrame, names: DataFrame, codes: DataFrame, limit: int = 20) -> DataFrame:
    """R5 (L3): the first ``limit`` names of each question: by code, then mention, score and typing errors; qid, rank, product_name, way."""
    ways = [
        by_code(questions, codes).select("qid", "product_name", F.lit(1).alias("way"), F.lit(0.0).alias("k")),
        mentions(questions, names).select("qid", "product_name", F.lit(2).alias("way"), F.col("claim").cast("double").alias("k")),
        matches(questions, names).select("qid", "product_name", F.lit(3).alias("way"), (-F.col("score")).alias("k")),
        fuzzy(questions, names).select("qid", "product_name", F.lit(4).alias("way"), F.col("distance").cast("double").alias("k")),
    ]
    found = ways[0]
    for w in ways[1:]:
        found = found.unionByName(w)
    best = found.groupBy("qid", "product_name").agg(F.min(F.struct("way", "k")).alias("b")).select("qid", "product_name", "b.*")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("way", "k", "product_name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "rank", "product_name", "way")


def validated(guesses: DataFrame, names: DataFrame) -> DataFrame:
    """Qid, product_name: guessed names (qid, brand, guess) that are names as they are, else the first that is equal when normalised."""
    exact = guesses.join(names.select("brand", F.col("product_name").alias("guess")), ["brand", "guess"], "left_semi").select("qid", F.col("guess").alias("product_name"))
    rest = guesses.join(names.select("brand", F.col("product_name").alias("guess")), ["brand", "guess"], "left_anti").withColumn("k", X.normalize("guess"))
    near = names.groupBy("brand", X.normalize("product_name").alias("k")).agg(F.min("product_name").alias("product_name"))
    return exact.unionByName(rest.join(near, ["brand", "k"]).select("qid", "product_name")).distinct()


def prefixes(names: DataFrame) -> DataFrame:
    """brand, product_name, shared, family: every run of leading tokens of a name, by their number."""
    n = names.select("brand", "product_name", X.tokenize_loose("product_name").alias("t")).where(F.size("t") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.size("t")), lambda k: F.struct(k.alias("shared"), F.array_join(F.slice("t", F.lit(1), k), " ").alias("family")))
    return n.select("brand", "product_name", F.explode(runs).alias("p")).select("brand", "product_name", "p.*")


def families(names: DataFrame) -> DataFrame:
    """R7 (J13): brand, product_name, shared, family: the longest leading tokens that a name shares with another of its brand, by prefixes as keys."""
    p = prefixes(names)
    common = p.groupBy("brand", "family").agg(F.count("*").alias("c")).where("c > 1")
    return p.join(common, ["brand", "family"]).groupBy("brand", "product_name").agg(F.max("shared").alias("shared"), F.max_by("family", "shared").alias("family"))


def relatives(names: DataFrame) -> DataFrame:
    """Brand, product_name, member, shared: the names of each name's family, itself included.

    A family shares the longest leading tokens that the name shares with any other. One token alone is a family only of names
    that share no more with any other name either (each other's best); names alone in their family have no row.
    """
    best = families(names)
    own = best.select("brand", F.col("product_name").alias("member"), F.col("shared").alias("deepest"))
    members = prefixes(names).select("brand", "family", F.col("product_name").alias("member")).join(own, ["brand", "member"])
    r = best.join(members, ["brand", "family"]).where("shared > 1 or deepest = 1")
    return r.withColumn("_n", F.count("*").over(Window.partitionBy("brand", "product_name"))).where("_n > 1").select("brand", "product_name", "member", "shared")


def family_ambiguity(questions: DataFrame, chosen: DataFrame, names: DataFrame, coded: DataFrame | None = None) -> DataFrame:
    """R7 (U4): qid, product_name: the members of a chosen name's family that a message may mean, where it doesn't settle on one.

    A member is satisfied if the message names its code (``coded``: qid, product_name) or has, among words that aren't filler, all
    its tokens beyond the family's. No member satisfied: all may be meant. Members whose tokens are a part of another
    satisfied member's are dropped; one left is no ambiguity, and neither is a message that holds the chosen name, whole, and no other member's.
    """
    words = F.array_except(X.tokenize_loose("message"), X.words_literal(X.FILLER))
    q = chosen.select("qid", "product_name").distinct().join(questions, "qid").select("qid", "brand", "product_name", X.normalize("message").alias("q"), words.alias("t"))
    c = q.join(relatives(names), ["brand", "product_name"]).withColumn("mt", X.tokenize_loose("member"))
    c = c.withColumn("rest", F.array_distinct(F.slice("mt", F.col("shared") + 1, F.size("mt"))))
    by_code = F.lit(False)
    if coded is not None:
        c = c.join(coded.select("qid", F.col("product_name").alias("member"), F.lit(True).alias("_code")).distinct(), ["qid", "member"], "left")
        by_code = F.coalesce("_code", F.lit(False))
    c = c.withColumn("ok", by_code | (F.size(F.array_except("rest", "t")) == 0)).withColumn("exact", X.contains_word("q", X.normalize("member")))
    by = Window.partitionBy("qid", "product_name")
    only = (F.count_if("exact").over(by) == 1) & F.max(F.col("exact") & (F.col("member") == F.col("product_name"))).over(by)
    c = c.withColumn("_only", only).withColumn("_oks", F.count_if("ok").over(by)).where("not _only and (_oks = 0 or (_oks > 1 and ok))")
    wider = c.where("ok").select("qid", "product_name", F.col("rest").alias("w"))
    narrower = (F.size(c.rest) < F.size(wider.w)) & (F.size(F.array_except(c.rest, wider.w)) == 0)
    top = c.join(wider, (c.qid == wider.qid) & (c.product_name == wider.product_name) & narrower, "left_anti")
    return top.withColumn("_n", F.count("*").over(by)).where("_n > 1").select("qid", F.col("member").alias("product_name")).distinct()


def maximal(found: DataFrame) -> DataFrame:
    """Qid, product_name: the one tied name that has all the tokens of every other, if there is one."""
    t = found.select("qid", "product_name", X.tokenize_loose("product_name").alias("t"))
    everything = F.array_distinct(F.flatten(F.collect_set("t").over(Window.partitionBy("qid"))))
    full = t.withColumn("all", everything).where(F.size(F.array_except("all", "t")) == 0)
    return full.withColumn("c", F.count("*").over(Window.partitionBy("qid"))).where("c = 1").select("qid", "product_name")


def without_fragments(validated_names: DataFrame, literal: DataFrame) -> DataFrame:
    """The union of validated and literal names (qid, product_name); literal ones whose tokens are part of a validated, not literal, name go."""
    only = validated_names.join(literal, ["qid", "product_name"], "left_anti").select("qid", X.tokenize_loose("product_name").alias("w"))
    lit = literal.withColumn("t", X.tokenize_loose("product_name"))
    kept = lit.join(only, (lit.qid == only.qid) & (F.size(F.array_except(lit.t, only.w)) == 0), "left_anti").select("qid", "product_name")
    return validated_names.select("qid", "product_name").unionByName(kept).distinct()


def majority_group(found: DataFrame, names: DataFrame) -> DataFrame:
    """Qid, family, products: the largest group of tied candidates, by collection, else by name."""
    g = found.join(names.select("brand", "product_name", "collection"), ["brand", "product_name"])
    key = F.coalesce("collection", F.concat(F.lit("__ungrouped__:"), "product_name"))
    sizes = g.groupBy("qid", key.alias("family")).agg(F.count("*").alias("products"), F.min("product_name").alias("first"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("products"), "first"))
    return sizes.withColumn("r", rank).where("r = 1").select("qid", "family", "products")


def indexable(c) -> Column:
    """A phrase of three words or more, two of them content words, not starting with a digit, balanced, without repeated columns."""
    t = X.tokenize_loose(c)
    content = F.filter(t, lambda w: ~w.isin(*{*X.RISKY, *X.FILLER}) & ~w.rlike(r"^\d+$"))
    text = F.col(c) if isinstance(c, str) else c
    return text.isNotNull() & ~text.rlike(r"^\s*\d") & X.balanced(text).isNotNull() & (F.size(t) >= 3) & (F.size(F.array_distinct(content)) >= 2) & ~text.rlike(r"\S\s{3,}\S")


def phrase_index(prices: DataFrame) -> DataFrame:
    """Brand, product_name, phrase, n: indexable contexts and variants with their rows (``prices`` may be kinds of rows, with ``n`` of each)."""
    rows = F.sum("n") if "n" in prices.columns else F.count("*")
    p = prices.groupBy("brand", "product_name", "variant_context", "model_variant").agg(rows.alias("n"))
    p = p.select("brand", "product_name", "n", F.explode(F.array("variant_context", "model_variant")).alias("phrase")).where("phrase is not null")
    # the test names the count so that it stays above the grouping: each phrase is tested once, not each row
    return p.groupBy("brand", "product_name", "phrase").agg(F.sum("n").alias("n")).where(F.when(F.col("n") > 0, indexable("phrase")))


def by_phrase(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """R10 (J3): qid, product_name, phrase: phrases that score 80 or more, the best ones."""
    p = phrases.select("brand", F.col("phrase").alias("product_name"), F.lit(None).cast("string").alias("collection")).distinct()
    s = scores(questions, p).where("score >= 80").withColumn("top", F.max("score").over(Window.partitionBy("qid"))).where("score = top")
    return s.select("qid", F.col("product_name").alias("phrase")).join(questions.select("qid", "brand"), "qid").join(phrases, ["brand", "phrase"]).select("qid", "product_name", "phrase")


def clauses(questions: DataFrame) -> DataFrame:
    """Qid, at, clause, words: the parts of a message between commas, ``and`` and ``&``."""
    q = questions.select("qid", F.posexplode(F.split(X.normalize("message"), r",|\band\b|&")).alias("at", "clause")).withColumn("clause", F.trim("clause")).where("clause <> ''")
    return q.withColumn("words", X.tokenize_loose("clause"))


def scoped(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Qid, product_name, clause, at: for each named product the first clause with its name that no earlier product took, else the nearest by a word within two edits, else the whole message."""
    c = clauses(questions).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "clause"))).alias("c"))
    n = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("claim", "product_name"))).alias("n"))
    start = F.array().cast("array<struct<product_name:string,at:int>>")

    def take(a: Column, x: Column) -> Column:
        used = F.transform(a, lambda y: y["at"])
        name = X.normalize(x["product_name"])
        words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
        free = F.filter("c", lambda s: ~F.array_contains(used, s["at"]))
        holds = F.filter(free, lambda s: F.contains(s["clause"], name))
        near = F.filter(free, lambda s: F.exists(F.split(s["clause"], "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & F.exists(words, lambda v: F.levenshtein(w, v) <= 2)))
        at = F.coalesce(F.get(holds, F.lit(0))["at"], F.get(near, F.lit(0))["at"], F.lit(-1))
        return F.concat(a, F.array(F.struct(x["product_name"].alias("product_name"), at.alias("at"))))

    d = n.join(c, "qid").withColumn("s", F.explode(F.aggregate("n", start, take)))
    d = d.join(questions.select("qid", X.normalize("message").alias("whole")), "qid")
    return d.select("qid", "s.product_name", F.coalesce(F.get(F.filter("c", lambda x: x["at"] == F.col("s.at")), F.lit(0))["clause"], F.col("whole")).alias("clause"), "s.at")


def related_clauses(questions: DataFrame, chosen: DataFrame, prices: DataFrame) -> DataFrame:
    """Qid, scoped, excluded: a message without clauses that have nothing to do with the chosen product.

    A clause stays that names the product, is a size with weak words only, is a tier of the product with weak words only, or
    starts a variant's digits. Only a part of the clauses, not all and not none, may go; the excluded text is told, never used.
    """
    known = prices.select("brand", "product_name", "fabric_tier", "model_variant").distinct()
    facts = known.groupBy("brand", "product_name").agg(F.collect_set(X.normalize("fabric_tier")).alias("tiers"), F.collect_set(X.leading_digits("model_variant")).alias("digits"))
    c = clauses(questions).where("size(words) > 0").join(chosen, "qid").join(questions.select("qid", "brand"), "qid").join(facts, ["brand", "product_name"], "left")
    weak = lambda w: w.isin(*{*X.RISKY, *X.FILLER, *X.TIER_FILLER, *X.UNITS, "x"})
    name = F.size(F.array_intersect("words", X.tokenize_loose("product_name"))) > 0
    size = F.exists("words", lambda w: w.rlike(r"^\d{2,3}(x\d+)*$")) & F.forall("words", lambda w: weak(w) | w.rlike(r"^[\dx]+$"))
    tier = F.exists("tiers", lambda t: (t != "") & X.contains_word("clause", t)) & F.forall("words", lambda w: weak(w) | F.exists("tiers", lambda t: X.contains_word(t, w)))
    digits = F.exists("words", lambda w: F.array_contains("digits", F.regexp_extract(w, r"^(\d+)", 1)))
    c = c.withColumn("keep", F.coalesce(name | size | tier | digits, F.lit(False)))
    g = c.groupBy("qid").agg(F.count_if("keep").alias("k"), F.count("*").alias("n"), *(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("at", "clause")))), lambda s: s["clause"]), " and ").alias(a) for a, cond in (("in", F.col("keep")), ("out", ~F.col("keep")))))
    part = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    d = questions.select("qid", X.normalize("message").alias("whole")).join(g, "qid", "left")
    return d.select("qid", F.when(part, F.col("in")).otherwise(F.col("whole")).alias("scoped"), F.when(part, F.col("out")).alias("excluded"))


def content_free(c) -> Column:
    """Whether all words are weak ones."""
    t = X.tokenize_loose(c)
    return F.forall(t, lambda w: w.isin(*X.RISKY))


def full_list(c) -> Column:
    """Whether a message asks for everything."""
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")).rlike(r"(?i)\b(all|full|complete|every)\b")


def leftover(message, name) -> Column:
    """Words of a message beyond the name, weak words, known tiers and numbers."""
    words = F.array_except(X.tokenize_loose(message), X.tokenize_loose(name))
    known = {*X.RISKY, *X.FILLER, *X.TIER_FILLER, *(w for t in X.KNOWN_TIERS for w in t.replace(",", " ").split())}
    return F.filter(words, lambda w: ~w.isin(*known) & ~w.rlike(r"^\d+(x\d+)*$"))


def anchor_explains(questions: DataFrame, prices: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Qid, explained: whether every word left of a message is known of its last product: its variants, contexts, tier labels, their leading digits (3er by
    3-er), or within an edit or two of such a word (four letters at least), or a word of its page's title block (``titles``: brand, product_name, title_block), if given."""
    p = prices.select("brand", F.col("product_name").alias("last_product"), F.explode(F.array("model_variant", "variant_context", "tier_label", "fabric_tier", "size")).alias("v")).where("v is not null")
    asked = questions.where("last_product is not null").select("brand", "last_product").distinct()
    p = p.join(asked, ["brand", "last_product"], "left_semi").distinct()
    vocab = p.select("brand", "last_product", F.explode(X.tokenize_loose("v")).alias("v")).groupBy("brand", "last_product").agg(F.collect_set("v").alias("vocab"))
    q = questions.where("last_product is not null").select("qid", "brand", "last_product", leftover("message", "last_product").alias("w")).join(vocab, ["brand", "last_product"], "left")
    if titles is None:
        q = q.withColumn("block", F.lit(None).cast("string"))
    else:
        first = titles.groupBy("brand", F.col("product_name").alias("last_product")).agg(F.min("title_block").alias("block"))
        q = q.join(first, ["brand", "last_product"], "left")
    digits = lambda x: F.regexp_extract(x, r"^(\d+)", 1)
    close = lambda w, v: (F.length(w) >= 4) & (F.length(v) >= 4) & (F.levenshtein(w, v) <= F.when(F.length(w) == 4, 1).otherwise(2))
    near = lambda w: F.exists("vocab", lambda v: (v == w) | (digits(v) == w) | ((digits(w) != "") & (digits(w) == digits(v))) | close(w, v))
    titled = lambda w: F.coalesce(X.contains_word(F.lower("block"), w), F.lit(False))
    return q.select("qid", F.forall("w", lambda w: F.coalesce(near(w), F.lit(False)) | titled(w)).alias("explained"))
