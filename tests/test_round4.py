import random

from pyspark.sql import functions as F

from pricewright.operators import gates, narrow


def test_page_gaps_by_runs(spark):
    """Against brute force: overlapping ranges, pages outside them, nulls; runs, not pages, are what is made before the end."""
    random.seed(4)
    ranges = [(random.choice("ab"), f"p{random.randrange(6)}", a, a + random.randrange(-2, 12)) for a in (random.randrange(60) for _ in range(40))] + [(None, "p1", 1, 3), ("a", "p1", None, 3)]
    pages = [(random.choice("ab"), f"p{random.randrange(6)}", random.randrange(70)) for _ in range(90)] + [(None, "p1", 2), ("a", "p1", None)]
    index = spark.createDataFrame(ranges, "brand string, product_name string, start int, stop int")
    have = spark.createDataFrame(pages, "brand string, product_name string, page int")
    want = {(b, n, p) for b, n, s, e in ranges if s is not None for p in range(s, e + 1)} - {p for p in pages if p[0] is not None}
    got = [tuple(r) for r in gates.page_gaps(index, have, "brand", "product_name").collect()]
    assert len(got) == len(want) and set(got) == want
    wide = spark.createDataFrame([("a", "x", 1, 2_000_000_000), ("b", "y", 1, 10)], "brand string, product_name string, start int, stop int")
    runs = gates.page_gap_ranges(wide, spark.createDataFrame([("a", "x", 5)], "brand string, product_name string, page int"), "brand", "product_name")
    assert sorted(tuple(r) for r in runs.collect()) == [("a", "x", 1, 4), ("a", "x", 6, 2_000_000_000), ("b", "y", 1, 10)]
    assert [tuple(r) for r in gates.worst(runs, "brand", rows=F.col("last").cast("long") - F.col("first") + 1).collect()] == [("a", 1_999_999_999), ("b", 10)]


def test_page_images_by_expression(spark):
    rows = spark.createDataFrame([("b", "x", 1, "c1"), ("b", "x", 2, "c2"), ("b", "z", 2, "c3")], "brand string, product_name string, source_pdf_page int, code string")
    index = spark.createDataFrame([("b", "x", 1, 3, ["i1", "i2", "i3"], {"2": "i2"})], "brand string, product_name string, start int, stop int, images array<string>, page_images map<string,string>")
    page = F.col("source_pdf_page")
    images = F.transform(F.sequence("start", "stop"), lambda p: F.concat(F.lit("i"), p.cast("string")))
    lazy = narrow.page_images(rows, index.drop("images", "page_images"), images, F.when((page % 2 == 0) & page.between(F.col("start"), F.col("stop")), F.concat(F.lit("i"), page.cast("string"))))
    want = [("c1", ["i1", "i2", "i3"]), ("c2", ["i2"]), ("c3", [])]
    for found in (lazy, narrow.page_images(rows, index)):
        assert sorted((r.code, list(r.shown)) for r in found.collect()) == want and found.columns == [*rows.columns, "shown"]
