import random

from pyspark.sql import functions as F

from pricewright.operators import gates, narrow, resolve
from pricewright.plans import answer

PRICES = "brand string, product_name string, model_variant string, variant_context string, size string, fabric_tier string, tier_label string, code string, price_eur string, ambiguous boolean, source_pdf_page int, row_ord long"
MESSAGES = ("give me all prices for {}", "{} 100x80", "{} h.7", "{} pelle", "{} seat 3er", "{} 2-er base", "{}", "{} 999x999", "price of P1", "{} and other")


def repeated_rows(spark, copies):
    """Rows of few kinds, many of each, with nulls, conflicts, add-ons and rows without a price."""
    random.seed(11)
    pick = lambda *x: random.choice(x)
    facts = [("B", pick("Alpha", "Beta Two"), pick(None, "h.7", "h.27", "2-er base"), pick(None, "long seat 3er"), pick(None, "100x80"), pick(None, "cat. Pelle", "Stoffa"), None, pick("P1", "P2", None), pick("100", "+5", "900", None), pick(True, False, False)) for _ in range(60)]
    rows = [(*f, i % 3, n * 100 + i) for n in range(copies) for i, f in enumerate(facts)]
    names = spark.createDataFrame([("B", n, None) for n in ("Alpha", "Beta Two", "Empty")], "brand string, product_name string, collection string")
    asked = [(i, "B", m.format(p.lower()), p) for i, (p, m) in enumerate((p, m) for p in ("Alpha", "Beta Two", "Empty") for m in MESSAGES)]
    return spark.createDataFrame(rows, PRICES), names, spark.createDataFrame(asked, "qid long, brand string, message string, product_name string")


def test_narrowing_by_kinds(spark):
    """Kinds of rows go through the chain as their rows do, and there are no more of them in twice as many rows."""
    prices, _, q = repeated_rows(spark, 4)
    kinds = narrow.kinds(prices)
    assert kinds.count() == narrow.kinds(prices.where("row_ord < 200")).count() < 60
    assert kinds.agg(F.sum("n")).first()[0] == prices.count()
    tasks = narrow.task_table(q.drop("product_name"), q.select("qid", "product_name"))
    told = ("qid", "product_name", *narrow.KIND[2:], "kept", "tier_filtered", "by_rule", "status", "n_rows")
    by_rows, by_kinds = ({tuple(r) for r in narrow.narrowed(tasks, p).select(*told).collect()} for p in (prices, kinds))
    assert by_rows == by_kinds and len({r[-2] for r in by_rows}) > 3
    expand = lambda p: sorted(tuple(r) for r in gates.coverage(p, narrow.narrowed(tasks.where("qid = 0"), p).where("kept")).collect())
    assert expand(prices) == expand(kinds)
    add_ons = lambda p: {tuple(r) for r in narrow.add_on_rows(p).collect()}
    assert add_ons(prices) == add_ons(kinds)
    phrases = lambda p: sorted(tuple(r) for r in resolve.phrase_index(p).collect())
    assert phrases(prices) == phrases(kinds) != []


def test_answers_stand_for_kinds(spark):
    """What is kept of answers before their rows are asked for doesn't grow with rows of the same kinds, and stands for all of them."""
    (few, names, q), (many, _, _) = repeated_rows(spark, 2), repeated_rows(spark, 4)
    q = q.drop("product_name")
    one, two = (answer.answered(q, names, p) for p in (few, many))
    assert one.count() == two.count()
    rows = answer.answers(q, names, many)
    n = {(r.qid, r.product_name): r.n for r in two.groupBy("qid", "product_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()}
    assert n == {(r.qid, r.product_name): r.n for r in rows.groupBy("qid", "product_name").agg(F.count("row_ord").alias("n")).collect()} and max(n.values()) > 8


def test_codes_of_letters_and_signs(spark):
    """Codes are found in messages plain, whatever signs, accents or white space they have."""
    codes = spark.createDataFrame([("B", str(i), c, None) for i, c in enumerate(("A1", "a-1", "Á1", "A1\n", "A11", None, ""))], "brand string, product_name string, code string, context string")
    q = spark.createDataFrame([(1, "B", "price of a1")], "qid long, brand string, message string")
    assert sorted(r.product_name for r in resolve.by_code(q, codes).collect()) == ["0", "1", "2", "3"]


def test_lists_of_images_are_not_sorted(spark):
    """Products are put in the join's order before their lists of images are made: nothing sorts or holds the lists of many."""
    index = spark.range(50).select(F.lit("B").alias("brand"), F.col("id").cast("string").alias("product_name"), F.lit(1).alias("start"), (F.col("id") + 3).cast("int").alias("stop"))
    rows = index.select("brand", "product_name", F.lit(2).alias("source_pdf_page"))
    images = F.transform(F.sequence("start", "stop"), lambda p: F.concat(F.lit("page-"), p.cast("string")))
    found = narrow.page_images(rows, index, images, F.lit(None).cast("string"))
    assert {r.product_name: len(r.shown) for r in found.collect()} == {str(i): i + 3 for i in range(50)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    at = next(i for i, x in enumerate(plan) if "transform(sequence" in x)
    above = [x for x in plan[:at] if "Sort [" in x and x.index("Sort") <= plan[at].index("Project")]
    assert not [x for x in above if not x.lstrip().startswith(":")]
