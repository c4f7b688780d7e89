"""Data-quality gates as operators (A7 to A12, J7 to J14, Q1 to Q16): anti-joins, checksums, coverage, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import staged
from .narrow import rows_in

KEY = ["brand", "product_name", "model_variant", "size", "fabric_tier", "price_eur"]


def ambiguity(prices: DataFrame, key: tuple[str, ...] = ("brand", "product_name", "code", "fabric_tier")) -> DataFrame:
    """Adds ``conflict``: several prices under one key."""
    by = Window.partitionBy(*key)
    return prices.withColumn("conflict", F.min("price_eur").over(by) != F.max("price_eur").over(by))


def collisions(prices: DataFrame) -> DataFrame:
    """Groups of (product, variant, context, tier, size) with several codes and several prices."""
    g = prices.groupBy("brand", "product_name", "model_variant", "variant_context", "fabric_tier", "size").agg(F.count_distinct("code").alias("codes"), F.count_distinct("price_eur").alias("prices"))
    return g.where("codes > 1 and prices > 1")


def duplicate_keys(prices: DataFrame) -> DataFrame:
    """Keys (product, variant, size, tier, label, code) of several rows."""
    return prices.groupBy("brand", "product_name", "model_variant", "size", "fabric_tier", "tier_label", "code").agg(F.count("*").alias("n")).where("n > 1")


def fabricated(results: DataFrame, prices: DataFrame, strict: bool = False) -> DataFrame:
    """Result rows that no source row has, nulls being equal to nulls only; ``strict`` also holds context and code."""
    keys = KEY + (["variant_context", "code"] if strict else [])
    p = prices.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return results.join(p, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def zero_row_products(index: DataFrame, prices: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Products of the index without rows, but those that the ledger explains."""
    keys = ["brand", "product_name"]
    d = index.join(prices, keys, "left_anti")
    return d.join(ledger, keys, "left_anti") if ledger is not None else d


def coverage(prices: DataFrame, results: DataFrame) -> DataFrame:
    """Brand, product_name, expected, returned: clean rows (all, if none is clean) against the rows of an answer; both may be kinds of rows (``narrow.kinds``)."""
    clean = F.coalesce(F.sum(F.when(~F.col("ambiguous"), rows_in(prices))), F.lit(0))
    want = prices.groupBy("brand", "product_name").agg(F.when(clean > 0, clean).otherwise(F.sum(rows_in(prices))).alias("expected"))
    got = results.groupBy("brand", "product_name").agg(F.sum(rows_in(results)).alias("returned"))
    return want.join(got, ["brand", "product_name"], "left").na.fill(0, ["returned"])


def priced_counts(prices: DataFrame) -> DataFrame:
    """A4: brand, priced, unpriced rows and products."""
    return prices.groupBy("brand").agg(F.count_if(F.col("price_eur").rlike("[0-9]")).alias("priced"), F.count_if(~F.col("price_eur").rlike("[0-9]")).alias("unpriced"), F.count_distinct("product_name").alias("products"))


def orphan_flags(flags: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rejects whose product is not in the ledger."""
    return flags.join(ledger, ["brand", "product_name"], "left_anti")


def claimed_missing(ledger: DataFrame, manual: DataFrame) -> DataFrame:
    """Products said to be repaired by hand (real_gap, partial) that have no manual row."""
    return ledger.where(F.col("status").isin("real_gap", "partial")).join(manual, ["brand", "product_name"], "left_anti")


def orphan_files(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files that nothing refers to."""
    return files.join(referenced, "file", "left_anti")


def checksums(spark, path: str) -> DataFrame:
    """A10: file and md5 of binary files; the content doesn't leave the scan."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.md5("content").alias("md5"))


def checksum_groups(files: DataFrame) -> DataFrame:
    """A10: md5, n, first: groups of equal files."""
    return files.groupBy("md5").agg(F.count("*").alias("n"), F.min("file").alias("first")).where("n > 1")


#: Letters of a name by which it meets texts; the rest is compared afterwards.
MEET_BY = 16
#: First letters of a name by which places of a text are chosen before any key is made there.
HEAD = 4
#: Beginnings of names that are broadcast at most; beyond it the same join is a shuffled one.
BROADCAST_HEADS = 50_000
#: Letters of a text that are gone through at once.
BLOCK = 256


def held_names(texts: DataFrame) -> DataFrame:
    """brand, product_name, other: the text of one product holds the other's name or, if ``texts`` has it, code (both in plain letters).

    Names meet texts by as many letters as they have (``MEET_BY`` at most). A text makes such a key only where a name of its brand
    begins like that place (``HEAD`` letters) and, at its length, ends with the letter found there, so few places move;
    ids alone move there, and texts join what is left to be compared. Empty names and codes are held by none.
    """
    plain = lambda c: F.regexp_replace(X.normalize(c), "[\u2010-\u2015-]", "-")
    labels = [plain(c) for c in ("product_name", "code") if c in texts.columns]
    n = texts.select("brand", F.col("product_name").alias("other"), F.explode(F.array_distinct(F.array(*labels))).alias("label")).where("label <> ''").distinct()
    n = n.withColumn("key", F.left("label", F.lit(MEET_BY)))
    end = F.struct(F.length("key").alias("length"), F.right("key", F.lit(1)).alias("last"))
    heads = staged(n.groupBy("brand", F.left("key", F.lit(HEAD)).alias("head")).agg(F.collect_set(end).alias("ends")), "image-heads")
    sizes = sorted(r[0] for r in heads.select(F.length("head")).distinct().collect())  # HEAD at most
    few = heads.limit(BROADCAST_HEADS + 1).count() <= BROADCAST_HEADS
    t = texts.select("brand", "product_name", plain("text").alias("text")).where("text <> ''")
    cut = F.transform(F.expr(f"sequence(0, (length(text) - 1) div {BLOCK})"), lambda b: F.substring("text", b.cast("int") * BLOCK + 1, F.lit(BLOCK + MEET_BY - 1)))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.length("block"), F.lit(BLOCK))), lambda i: F.substring("block", i, F.lit(MEET_BY)))
    places = t.select("brand", "product_name", F.explode(cut).alias("block")).select("brand", "product_name", F.explode(F.array_distinct(runs)).alias("run"))
    begun = F.array(*(F.left("run", F.lit(k)) for k in sizes)).cast("array<string>")
    places = places.select("*", F.explode(F.array_distinct(begun)).alias("head")).join(F.broadcast(heads) if few else heads, ["brand", "head"])
    fit = F.filter("ends", lambda e: F.substring("run", e["length"], F.lit(1)) == e["last"])
    keys = places.select("brand", "product_name", F.explode(F.transform(fit, lambda e: F.left("run", e["length"]))).alias("key")).distinct()
    met = keys.join(n, ["brand", "key"]).select("brand", "product_name", "other", "label", (F.length("label") <= MEET_BY).alias("whole")).distinct()
    longer = met.where("not whole").join(t, ["brand", "product_name"]).where(F.contains("text", F.col("label")))
    return met.where("whole").select("brand", "product_name", "other").unionByName(longer.select("brand", "product_name", "other")).distinct()


def image_conflicts(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Products that share an image by checksum with others of their brand though the texts don't tell of each other.

    brand, md5, product_name, n_conflicts, first (the least of the others in conflict). Others are excused if both
    have the image on one page, or if each one's text holds the other's name or, where ``texts`` (brand, product_name,
    text) has a ``code``, its code, dashes and case apart. A group whose pages are all blank (``images`` may have a
    ``page_text``) is no conflict. Rows without brand, checksum or name take no part; of several texts of a product any may hold a name.

    Pairs in conflict are never made: they are counted as the group without the excused. Products with the same pages
    are a class, whose excused by page are listed once, not for each member; excuses by text are found by ``held_names``. The
    least other is looked for among as many of the group's first names as are excused, and one more.
    """
    blank = F.trim("page_text") == "" if "page_text" in images.columns else F.lit(False)
    group = ["brand", "md5"]
    i = images.where("brand is not null and md5 is not null and product_name is not null")
    i = i.select(*group, "product_name", "page", F.coalesce(blank, F.lit(False)).alias("blank"))
    m = i.groupBy(*group, "product_name").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.every("blank").alias("blank"))
    shared = m.groupBy(*group).agg(F.count("*").alias("n"), F.every("blank").alias("b")).where("n > 1 and not b").select(*group, "n")
    m = m.join(shared, group).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("product_name")))
    kind = F.when(F.size("pages") > 0, F.to_json(F.struct("pages"))).otherwise(F.concat(F.lit("-"), "product_name"))
    m = staged(m.withColumn("kind", kind).drop("blank"), "image-members")
    kinds = m.groupBy(*group, "kind").agg(F.first("pages").alias("pages"))
    at = kinds.select(*group, "kind", F.explode("pages").alias("page"))
    met = at.join(at.withColumnRenamed("kind", "other_kind"), [*group, "page"]).select(*group, "kind", "other_kind")
    met = staged(met.unionByName(kinds.select(*group, "kind", F.col("kind").alias("other_kind"))).distinct(), "image-pages")
    known = texts.join(m.select("brand", "product_name").distinct(), ["brand", "product_name"], "left_semi")
    holds = staged(held_names(known).where("product_name <> other"), "image-texts")
    mutual = holds.join(holds.select("brand", F.col("other").alias("product_name"), F.col("product_name").alias("other")), ["brand", "product_name", "other"])
    theirs = m.select(*group, F.col("product_name").alias("other"), F.col("kind").alias("other_kind"))
    excused = mutual.join(m.select(*group, "product_name", "kind"), ["brand", "product_name"]).join(theirs, [*group, "other"])
    excused = staged(excused.join(met, [*group, "kind", "other_kind"], "left_anti").select(*group, "product_name", "other"), "image-excused")
    beside = staged(met.join(m.select(*group, F.col("kind").alias("other_kind"), "rank"), [*group, "other_kind"]).select(*group, "kind", "rank"), "image-beside")
    own = m.join(excused.groupBy(*group, "product_name").agg(F.count("*").alias("told")), [*group, "product_name"], "left").na.fill(0, ["told"])
    own = own.join(beside.groupBy(*group, "kind").agg(F.count("*").alias("beside")), [*group, "kind"])
    own = own.withColumn("n_conflicts", F.col("n") - F.col("beside") - F.col("told")).where("n_conflicts > 0")
    # of each class the first names that aren't excused by page, as many as a member may need
    need = own.groupBy(*group, "kind").agg((F.max("told") + 1).alias("need"), F.first("n").alias("n"), F.first("beside").alias("beside"))
    looked = need.select(*group, "kind", "need", F.explode(F.sequence(F.lit(1), F.least("n", F.col("need") + F.col("beside")).cast("int"))).alias("rank"))
    others = looked.join(beside, [*group, "kind", "rank"], "left_anti").join(m.select(*group, "rank", F.col("product_name").alias("other")), [*group, "rank"])
    others = others.withColumn("place", F.row_number().over(Window.partitionBy(*group, "kind").orderBy("rank"))).where("place <= need").select(*group, "kind", "place", "other")
    tries = own.select(*group, "kind", "product_name", "n_conflicts", F.explode(F.sequence(F.lit(1), (F.col("told") + 1).cast("int"))).alias("place"))
    tries = tries.join(others, [*group, "kind", "place"]).join(excused, [*group, "product_name", "other"], "left_anti")
    return tries.groupBy(*group, "product_name").agg(F.first("n_conflicts").alias("n_conflicts"), F.min("other").alias("first"))


def page_gap_ranges(index: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """Keys, first, last: the runs of pages within a product's ranges (start, stop) that no row (keys, page) has.

    Ranges and pages of a product stand in one order; a run lies between one place and the next, so work follows ranges and
    rows, not the pages of a range. Ranges that overlap count once.
    """
    by = Window.partitionBy(*keys)
    before = F.max("stop").over(by.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    ranges = index.select(*keys, "start", "stop").where("start <= stop").withColumn("at", F.greatest("start", before + 1)).where("at <= stop")
    have = pages.select(*keys, F.col("page").alias("at")).dropna().distinct()
    places = ranges.select(*keys, "at", "stop", F.lit(0).alias("page")).unionByName(have.withColumn("page", F.lit(1)), allowMissingColumns=True)
    order = by.orderBy("at", "page")
    until = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, 0))
    places = places.withColumns({"first": F.col("at") + F.col("page"), "last": F.least(until, F.lead("at").over(order) - 1), "_until": until})
    return places.where("_until is not null and first <= last").select(*keys, "first", "last")


def page_gaps(index: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """Keys, page: pages within a product's range (start, stop) that no row (keys, page) has."""
    return page_gap_ranges(index, pages, *keys).select(*keys, F.explode(F.sequence("first", "last")).alias("page"))


def worst(found: DataFrame, key: str, limit: int = 5, rows: Column | None = None) -> DataFrame:
    """The keys with most rows; ``rows`` tells how many a row stands for."""
    return found.groupBy(key).agg((F.count("*") if rows is None else F.sum(rows)).alias("n")).orderBy(F.desc("n"), key).limit(limit)


def name_collisions(names: DataFrame) -> DataFrame:
    """Q13: names that several files hold: brand, name, files."""
    return names.groupBy("brand", "name").agg(F.count_distinct("file").alias("files")).where("files > 1")


def unmatched_candidates(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidate names (brand, name) that neither hold nor are held by a name of the index of their brand.

    A text that another holds has its first three letters among the other's runs of letters; texts meet by these.
    """
    run = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))
    runs = lambda c: F.array_distinct(F.concat(F.array(F.lit("")), run(F.col(c), 1), run(F.col(c), 2), run(F.col(c), 3)))
    i = index.select("brand", X.normalize("product_name").alias("n")).distinct()
    c = candidates.withColumn("_c", X.normalize("name"))
    names = c.select("brand", "_c").distinct()
    start = lambda d, x: d.withColumn("part", F.substring(F.col(x), 1, 3))
    inside = lambda d, x: d.withColumn("part", F.explode(runs(x)))
    held = start(names, "_c").join(inside(i, "n"), ["brand", "part"]).where(F.contains("n", F.col("_c")))
    holds = inside(names, "_c").join(start(i, "n"), ["brand", "part"]).where(F.contains("_c", F.col("n")))
    matched = held.select("brand", "_c").unionByName(holds.select("brand", "_c")).distinct()
    return c.join(matched, ["brand", "_c"], "left_anti").select(*candidates.columns)


def image_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Qid, image, side: images only expected (missing) or only shown (extra)."""
    keys = ["qid", "image"]
    a = expected.select(*keys).distinct().join(actual, keys, "left_anti").withColumn("side", F.lit("missing"))
    return a.unionByName(actual.select(*keys).distinct().join(expected, keys, "left_anti").withColumn("side", F.lit("extra")))


def soft_totals(results: DataFrame) -> DataFrame:
    """Passes, failures and cases without expectation by brand and category, with totals: results have brand, cat and ``soft`` (true, false or null)."""
    return results.rollup("brand", "cat").agg(F.count_if("soft").alias("passed"), F.count_if(~F.col("soft")).alias("failed"), F.count_if(F.col("soft").isNull()).alias("open"))


def isolation_failures(required: DataFrame, results: DataFrame) -> DataFrame:
    """Q5, Q6: required (qid, product_name, fabric_tier, price_eur) that an answer lacks; null tiers or prices ask for any."""
    r = results.select(*(F.col(c).alias(f"_{c}") for c in ("qid", "product_name", "fabric_tier", "price_eur")))
    on = (F.col("qid") == F.col("_qid")) & (F.col("product_name") == F.col("_product_name")) & (F.col("fabric_tier").isNull() | (F.col("fabric_tier") == F.col("_fabric_tier"))) & (F.col("price_eur").isNull() | (F.col("price_eur") == F.col("_price_eur")))
    return required.join(r, on, "left_anti")


def case_failures(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Q7, Q11, Q16: cases (qid, status, product_name, n_rows; null asks for any) against answers of the same columns: those that differ."""
    a = answers.select("qid", *(F.col(c).alias(f"got_{c}") for c in ("status", "product_name", "n_rows")))
    d = cases.join(a, "qid", "left")
    differs = [F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"got_{c}")) for c in ("status", "product_name", "n_rows")]
    return d.where(differs[0] | differs[1] | differs[2])


def prompt_tokens(questions: DataFrame, names: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Q15: qid, full, short: words of a prompt with all names of the brand, and with the short list."""
    size = lambda c: F.size(X.not_empty(F.split(F.col(c), r"\s+")))
    full = names.groupBy("brand").agg(F.sum(size("product_name")).alias("full"))
    short = shortlist.groupBy("qid").agg(F.sum(size("product_name")).alias("short"))
    words = size("message")
    return questions.join(full, "brand").join(short, "qid", "left").select("qid", (F.col("full") + words).alias("full"), (F.coalesce("short", F.lit(0)) + words).alias("short"))


def price_range(prices: DataFrame, *keys: str) -> DataFrame:
    """A3: keys, low, high, low_main, high_main: the range of prices, with and without add-ons; texts without a number are left out."""
    n = X.price_number("price_eur")
    main = F.when(~F.col("price_eur").startswith("+"), n)
    return prices.groupBy(*keys).agg(F.min(n).alias("low"), F.max(n).alias("high"), F.min(main).alias("low_main"), F.max(main).alias("high_main"))


