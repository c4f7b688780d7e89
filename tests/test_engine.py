import json
import os

from pyspark.sql import functions as F

from pricewright.operators import extract, gates, grid, narrow, resolve
from pricewright.plans import answer
from pricewright.sources import readers
from pricewright.streaming import sessions

PRICES = "brand string, product_name string, model_variant string, variant_context string, size string, fabric_tier string, tier_label string, code string, price_eur string, ambiguous boolean, source_pdf_page int, row_ord long"


def price_rows(spark):
    rows = []

    def add(product, price, variant=None, size=None, tier=None, code=None, context=None, ambiguous=False):
        rows.append(("B", product, variant, context, size, tier, None, code, price, ambiguous, 1, len(rows)))

    for tier, price in (("Pelle", "1.456"), ("Stoffa", "1.000")):
        add("GRETA Wood", price, tier=tier, code="G1")
    for tier, price in (("Pelle", "900"), ("Pelle Glove", "985")):
        add("WILMA", price, tier=tier, code="W1")
    add("ITALIA", "100", code="I1", size="100x80")
    add("ITALIA", "200", code="I2", size="120x90")
    add("ITALIA COUTURE", "300", code="C1")
    add("TWIN", "10", code="T1", ambiguous=True)
    add("TWIN", "20", code="T1", ambiguous=True)
    add("LAMP", "50", variant="h.7", code="L1")
    add("LAMP", "60", variant="h.27", code="L2")
    return spark.createDataFrame(rows, PRICES)


def name_rows(prices):
    return prices.groupBy("brand", "product_name").agg(F.lit(None).cast("string").alias("collection"), F.min("row_ord").alias("first"))


def ask(spark, messages, **more):
    p = price_rows(spark)
    q = spark.createDataFrame([(i, "B", m, more.get("last_product")) for i, m in enumerate(messages)], "qid long, brand string, message string, last_product string")
    return answer.answers(q, name_rows(p), p).collect()


def test_answers(spark):
    messages = ["greta wood pelle", "wilma pelle glove", "italia 80x100", "give me all italia", "italia couture", "twin", "lamp h.27", "nonsense words", "price of W1", "greta wood and wilma"]
    rows = ask(spark, messages)
    of = lambda i: [r for r in rows if r.qid == i]
    assert [(r.status, r.price_eur) for r in of(0)] == [("ok", "1.456")]
    assert [(r.status, r.price_eur) for r in of(1)] == [("ok", "985")]
    assert [(r.status, r.price_eur) for r in of(2)] == [("ok", "100")]
    assert {(r.status, r.price_eur) for r in of(3)} == {("full_price_grid", "100"), ("full_price_grid", "200")}
    assert [(r.product_name, r.price_eur) for r in of(4)] == [("ITALIA COUTURE", "300")]
    assert {(r.status, r.price_eur) for r in of(5)} == {("ambiguous_price", "10"), ("ambiguous_price", "20")}
    assert [(r.status, r.price_eur) for r in of(6)] == [("ok", "60")]
    assert [r.status for r in of(7)] == ["no_product_match"]
    assert {(r.product_name, r.rule) for r in of(8)} == {("WILMA", "code")}
    assert {(r.status, r.product_name) for r in of(9)} == {("multi_product", "GRETA Wood"), ("multi_product", "WILMA")}


def test_nothing_is_made_up(spark):
    p = price_rows(spark)
    told = [r for r in ask(spark, ["greta wood", "give me every italia", "lamp", "wilma"]) if r.price_eur]
    shown = spark.createDataFrame([(r.brand, r.product_name, r.model_variant, r.size, r.fabric_tier, r.price_eur) for r in told], "brand string, product_name string, model_variant string, size string, fabric_tier string, price_eur string")
    assert told and gates.fabricated(shown, p).count() == 0
    assert gates.fabricated(shown.withColumn("price_eur", F.lit("1")), p).count() == len(told)


def test_no_size_is_not_a_guess(spark):
    assert [r.status for r in ask(spark, ["italia 333x444"])] == ["no_matching_variant"]


def test_mentions(spark):
    names = spark.createDataFrame([("B", n) for n in ("ITALIA", "ITALIA COUTURE", "eliot keramik", "eliot keramik drive")], "brand string, product_name string")
    q = spark.createDataFrame([(1, "B", "italia pelle and italia couture pelle"), (2, "B", "eliot keramik drive")], "qid long, brand string, message string")
    got = {(r.qid, r.product_name) for r in resolve.mentions(q, names).collect()}
    assert got == {(1, "ITALIA"), (1, "ITALIA COUTURE"), (2, "eliot keramik drive")}


def test_all_is_not_and(spark):
    names = spark.createDataFrame([("B", "and"), ("B", "Agatha")], "brand string, product_name string")
    q = spark.createDataFrame([(1, "B", "all agata")], "qid long, brand string, message string")
    assert {(r.product_name, r.distance) for r in resolve.fuzzy(q, names).collect()} == {("Agatha", 1)}


def test_grid_keeps_every_row(spark):
    rows = [("B", "p", None, None, size, tier, None, code, price, False, 1, i) for i, (size, tier, code, price) in enumerate([("10x20", "c", "A", "1"), (None, "c", "A", "2"), (None, "c", "B", "3"), (None, "c", None, "4")])]
    p = spark.createDataFrame(rows, PRICES)
    assert grid.lost_rows(p).count() == 0
    assert {r.column_key for r in grid.cells(grid.grouped(p)).collect()} == {"10x20", "__flat__::A", "__flat__::B", "__flat__::"}
    single = p.where("row_ord = 1")
    assert [r.column_key for r in grid.cells(grid.grouped(single)).collect()] == ["__flat__"]


def test_ranges(spark):
    e = spark.createDataFrame([("B", "A", 14), ("B", "B", 14), ("B", "C", 30)], "brand string, product_name string, start int")
    assert [(r.product_name, r.end) for r in extract.tied_ranges(e, "start", F.lit(40), "brand").orderBy("product_name").collect()] == [("A", 29), ("B", 29), ("C", 40)]
    assert [(r.product_name, r.end) for r in extract.ranges(e, "start", F.lit(40), "brand").orderBy("product_name").collect()] == [("A", 14), ("B", 29), ("C", 40)]


def test_footer_gaps(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "p 1", "b", "p ", "c", "p 3", "d", "p ", "e", "p 9"])], "doc int, line int, text string")
    got = [r.page for r in extract.pages_by_footer(lines, r"^p (\d*)$", "doc").orderBy("line").collect()]
    assert got == [1, 1, 2, 2, 3, 3, None, None, 9, 9]


def test_row_clustering_is_by_first_word(spark):
    words = spark.createDataFrame([(1, t, 0.0, str(t)) for t in (0.0, 2.0, 4.0, 6.5, 8.0)], "page int, top double, left double, text string")
    assert [r.row for r in extract.rows_of_words(words).orderBy("top").collect()] == [0, 0, 1, 1, 2]


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([("B", "x", "old"), ("B", "y", "old"), ("B", "z", "old")], "brand string, product_name string, v string")
    new = spark.createDataFrame([("B", "x", "new"), ("B", "z", "new"), ("B", "w", "new")], "brand string, product_name string, v string")
    held = spark.createDataFrame([("B", "z")], "brand string, product_name string")
    once = extract.merged_index(old, new, held)
    assert {(r.product_name, r.v) for r in once.collect()} == {("x", "new"), ("y", "old"), ("z", "old"), ("w", "new")}
    assert sorted(map(tuple, extract.merged_index(once, new, held).collect())) == sorted(map(tuple, once.collect()))
    manual = extract.merged_manual(old, new)
    assert sorted(map(tuple, extract.merged_manual(manual, new).collect())) == sorted(map(tuple, manual.collect()))


def test_tier_table_declines(spark):
    lines = spark.createDataFrame([(1, 0, "c   d"), (1, 1, "120x40   1.000   +200"), (1, 2, "130x40   9.000")], "doc int, line int, text string")
    rows, rejects = extract.tier_tables(lines, "doc")
    assert {(r.fabric_tier, r.price_eur) for r in rows.collect()} == {("c", "1.000"), ("d", "+200")}
    assert [r.line for r in rejects.collect()] == [2]


def test_scores_lose_no_pair(spark):
    names = spark.createDataFrame([("B", n, None) for n in ("On Line", "jack-e fabric", "Greta", "øst lamp", "a b c", "Sofa (big)")], "brand string, product_name string, collection string")
    q = spark.createDataFrame([(i, "B", m) for i, m in enumerate(("online", "jack-efabric", "greta wood", "ab c", "the sofa", "øst", "on line"))], "qid long, brand string, message string")
    got = {(r.qid, r.product_name): r.score for r in resolve.scores(q, names).collect()}
    from tests.test_text import plain_score

    want = {(a.qid, b.product_name): plain_score(a.message, b.product_name) for a in q.collect() for b in names.collect()}
    assert got == {k: v for k, v in want.items() if v > 0}


def test_json_tables_keep_order(spark, tmp_path):
    (tmp_path / "prices.json").write_text(json.dumps([{"brand": "B", "product_name": n, "price_eur": "1"} for n in "cab"]))
    rows = readers.prices(spark, str(tmp_path / "prices.json")).orderBy("row_ord").collect()
    assert [r.product_name for r in rows] == ["c", "a", "b"] and rows[0].code is None
    (tmp_path / "pages.txt").write_text("<<<PDFPAGE:3>>>\r\nx\r\ny\n\n<<<PDFPAGE:4>>>\nz")
    assert [(r.page, r.text.split()) for r in readers.page_texts(spark, str(tmp_path / "pages.txt")).orderBy("page").collect()] == [(3, ["x", "y"]), (4, ["z"])]
    (tmp_path / "ledger.json").write_text(json.dumps({"B": {"p": {"status": "real_gap", "note": "n"}}}))
    assert [tuple(r) for r in readers.ledger(spark, str(tmp_path / "ledger.json")).collect()] == [("B", "p", "real_gap", "n")]
    readers.write_brand_table(spark.createDataFrame([("B", 1), ("C", 2)], "brand string, n int"), str(tmp_path / "out"))
    assert readers.reload(spark, str(tmp_path / "out")).where("brand = 'C'").count() == 1


def test_sessions_stream_like_batch(spark, tmp_path):
    rows = [(s, t, ["ok", "clarify_product", "no_product_match"][(s + t) % 3], f"p{s}{t}", ["x", "y"], ["h.7", "h.7 b"]) for s in range(3) for t in range(5)]
    schema = "session int, turn long, status string, product_name string, candidates array<string>, variants array<string>"
    d = spark.createDataFrame(rows, schema)
    d.where("turn < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.stream_anchors(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("anchors").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    d.where("turn >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    plain = lambda a: None if a is None or a.product_name is None and a.candidates is None else (a.product_name, a.candidates)
    got = {(r.session, r.turn): plain(r.anchor) for r in spark.sql("select * from anchors").collect()}
    want = {(r.session, r.turn): plain(r.anchor) for r in sessions.anchors(d, "session").collect()}
    assert got == want


def test_staged_tables_are_cleared(spark):
    from pricewright.sources import staging

    d = staging.staged(spark.range(3).toDF("id"), "three")
    where = d.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert d.count() == 3 and os.path.isdir(where)
    assert staging.clear_staged(spark) > 0 and not os.path.isdir(where)


def test_empty_inputs(spark):
    p = price_rows(spark)
    q = spark.createDataFrame([], "qid long, brand string, message string")
    assert answer.answers(q, name_rows(p), p).count() == 0
    assert narrow.add_on_totals(p.limit(0)).count() == 0
    assert grid.layout(p.limit(0)).count() == 0


def test_image_conflicts_by_pairs(spark):
    from pricewright.operators import gates

    images = spark.createDataFrame([("x", p, "m1", i) for i, p in enumerate("abc")] + [("x", "d", "m2", 1), ("x", "e", "m2", 1), ("x", "f", "m3", 1), ("x", "g", "m3", 2), ("x", "f", "m4", 1)], "brand string, product_name string, md5 string, page int")
    texts = spark.createDataFrame([("x", "a", "with b and c", None), ("x", "b", "see a", None), ("x", "c", "see a", None), ("x", "f", "see G‑7", "F-1"), ("x", "g", "f here", "g-7")], "brand string, product_name string, text string, code string")
    got = {(r.md5, r.product_name): (r.n_conflicts, r["first"]) for r in gates.image_conflicts(images, texts).collect()}
    assert got == {("m1", "b"): (1, "c"), ("m1", "c"): (1, "b")}  # b and c don't name each other, though a names both
    blank = images.withColumn("page_text", F.when(F.col("md5") == "m1", " ").otherwise("x"))
    assert gates.image_conflicts(blank, texts).count() == 0


def test_image_conflicts_by_brute_force(spark):
    import random

    from pricewright.operators import gates

    random.seed(11)
    names = [f"model {i} of the long family" if i % 2 else f"m{i}." for i in range(40)]
    images = [("x", random.choice(names), random.choice("123"), random.choice([1, 2, 3, 4, 5, None])) for _ in range(160)] + [(None, "m1", "1", 1), ("x", None, "1", 1), ("x", "m0.", None, 2)]
    texts = [("x", n, " ".join(random.sample(names, 25)) if i % 5 else None, f"c-{i};" if i % 3 else "") for i, n in enumerate(names)]
    texts += [("x", "m0.", "see C‑1;", "c-0;"), ("y", "m2.", "m4.", None)]
    i = spark.createDataFrame(images, "brand string, product_name string, md5 string, page int")
    t = spark.createDataFrame(texts, "brand string, product_name string, text string, code string")
    held = lambda p, o: any(a[2] and any(x and x in a[2].lower().replace("‑", "-") for b in texts if b[:2] == ("x", o) for x in (b[1], b[3])) for a in texts if a[:2] == ("x", p))
    want = {}
    rows = {r[1:] for r in images if None not in r[:3]}
    for md5 in "123":
        group = sorted({n for n, m, _ in rows if m == md5})
        pages = {n: {p for a, m, p in rows if a == n and m == md5 and p} for n in group}
        for a in group:
            bad = [b for b in group if b != a and not pages[a] & pages[b] and not (held(a, b) and held(b, a))]
            if bad:
                want[md5, a] = (len(bad), min(bad))
    got = {(r.md5, r.product_name): (r.n_conflicts, r["first"]) for r in gates.image_conflicts(i, t).collect()}
    assert got == want and len(want) > 30
    assert gates.image_conflicts(i.limit(0), t).count() == 0
    assert {(r.md5, r.product_name) for r in gates.image_conflicts(i, t.limit(0)).collect()} >= set(want)


def test_image_of_many_products(spark):
    from pricewright.operators import gates

    one = spark.range(10000).selectExpr("'x' AS brand", "concat('p', id) AS product_name", "'m' AS md5", "id % 5000 AS page")
    got = gates.image_conflicts(one, one.selectExpr("brand", "product_name", "'nothing' AS text")).groupBy("n_conflicts").count().collect()
    assert [tuple(r) for r in got] == [(9998, 10000)]


def test_close_words_by_brute_force(spark):
    import itertools
    import random

    from pricewright.operators import resolve

    random.seed(4)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(3, 7))) for _ in range(60)]
    q = spark.createDataFrame([(i, "x" if i % 2 else "y", w) for i, w in enumerate(words[:30])], "qid long, brand string, message string")
    n = spark.createDataFrame([("x" if i % 3 else "y", w) for i, w in enumerate(words[30:])], "brand string, product_name string").distinct()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = list(itertools.accumulate(zip(row, row[1:], b), lambda left, t: min(left + 1, t[1] + 1, t[0] + (x != t[2])), initial=i + 1))
        return row[-1]

    want = {(a.qid, b.product_name): distance(a.message, b.product_name) for a in q.collect() for b in n.collect() if a.brand == b.brand and distance(a.message, b.product_name) <= (1 if len(a.message) <= 4 else 2)}
    got = {(r.qid, r.product_name): r.distance for r in resolve.fuzzy(q, n).collect()}
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if q.where(f"qid = {k[0]}").first().message not in resolve.X.RISKY}


def test_codes_of_the_index(spark):
    from pricewright.operators import resolve

    names = spark.createDataFrame([("x", "Alpha", "Z9"), ("x", "Beta", "Z9"), ("x", "Gamma", "Y1")], "brand string, product_name string, art_code string")
    prices = spark.createDataFrame([("x", "Alpha", "A1", None), ("x", "Beta", "A1", "round top")], "brand string, product_name string, code string, variant_context string")
    q = spark.createDataFrame([(1, "x", "price of z9"), (2, "x", "price of a1 round"), (3, "x", "y1"), (4, "x", "price of a1")], "qid long, brand string, message string")
    got = sorted((r.qid, r.product_name) for r in resolve.by_code(q, resolve.codes_of(names, prices)).collect())
    assert got == [(1, "Alpha"), (1, "Beta"), (2, "Beta"), (3, "Gamma"), (4, "Alpha"), (4, "Beta")]
    got = sorted((r.qid, r.product_name) for r in resolve.by_code(q, resolve.codes_of(names, prices.where("product_name = 'Alpha'"))).collect())
    assert got == [(1, "Alpha"), (3, "Gamma"), (4, "Alpha")] or got == [(1, "Alpha"), (2, "Alpha"), (3, "Gamma"), (4, "Alpha")]


def test_families_of_one_token_are_each_others_best(spark):
    from pricewright.operators import resolve

    names = ["Puppet (Armchairs)", "Puppet (Night)", "Big In&Out", "Big Light 1", "Big Light 2", "Chloè luxury", "Chloe' Luxury", "Innesti table", "Innesti coffee table", "Magda", "Magda ML", "Magda ML couture", "Lone"]
    n = spark.createDataFrame([("x", v) for v in names] + [("y", "Lone star")], "brand string, product_name string")
    related = {}
    for r in resolve.relatives(n).collect():
        related.setdefault(r.product_name, set()).add(r.member)
    assert related["Puppet (Night)"] == {"Puppet (Night)", "Puppet (Armchairs)"} and related["Innesti table"] == {"Innesti table", "Innesti coffee table"}
    assert not {"Big In&Out", "Lone", "Lone star"} & set(related)  # Big Light has a deeper family of its own
    assert related["Big Light 1"] == {"Big Light 1", "Big Light 2"} and related["Chloè luxury"] == {"Chloè luxury", "Chloe' Luxury"}
    assert "Magda" not in related and related["Magda ML"] == {"Magda ML", "Magda ML couture"}
    cases = [
        ("give puppet all price", "Puppet (Night)", {"Puppet (Night)", "Puppet (Armchairs)"}), ("puppet night", "Puppet (Night)", set()), ("innesti coffee table", "Innesti table", set()),
        ("price of big light", "Big Light 1", {"Big Light 1", "Big Light 2"}), ("price of c2", "Big Light 1", set()), ("c1 and c2", "Big Light 1", {"Big Light 1", "Big Light 2"}),
        ("magda ml couture price", "Magda ML", set()), ("magda ml price", "Magda ML", set()), ("the big in&out", "Big In&Out", set()), ("lone", "Lone", set()), ("chloe luxury", "Chloè luxury", set()), ("luxury", "Chloè luxury", {"Chloè luxury", "Chloe' Luxury"}),
    ]
    q = spark.createDataFrame([(i, "x", c[0], c[1]) for i, c in enumerate(cases)], "qid long, brand string, message string, target string")
    codes = spark.createDataFrame([("x", "Big Light 1", "c1", None), ("x", "Big Light 2", "c2", None)], "brand string, product_name string, code string, context string")
    chosen = q.selectExpr("qid", "target AS product_name")
    found = {}
    for r in resolve.family_ambiguity(q, chosen, n, resolve.by_code(q, codes)).collect():
        found.setdefault(r.qid, set()).add(r.product_name)
    assert {i: found.get(i, set()) for i in range(len(cases))} == {i: c[2] for i, c in enumerate(cases)}
