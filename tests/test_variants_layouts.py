"""Variant families, compound questions and index layouts, on planted rows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.operators import extract, layouts, narrow, resolve, shapes
from pricewright.plans import answer
from pricewright.sources import readers
from pricewright.streaming import loading

PRICES = "brand string, product_name string, model_variant string, variant_context string, size string, fabric_tier string, tier_label string, code string, price_eur string, ambiguous boolean, source_pdf_page int, row_ord long"
LINE = [("2-er sofa", "ONLID2000"), ("3-er sofa", "ONLID3000"), ("3-er maxi sofa", "ONLID300M"), ("3-er extra sofa", "ONLID300E"), ("3-er central element", "ONLIC300"), ("2-er central element", "ONLIC200"), ("Island", "ONLII100"), ("Square corner", "ONLIQ100")]
BED = [("Face - h.8", "F08"), ("Face - h.27 base", "F27"), ("Struttura h.8", "S08"), ("Struttura h.27", "S27"), ("Struttura rete", "SR1")]
CHAIR = [("Armchair", "K100"), ("Armchair mix", "K10X"), ("Armchair low", "K20L"), ("Armchair mix low", "K30Z")]


@pytest.fixture(scope="module")
def prices(spark):
    rows = [("D", name, v, None, None, None, None, c, str(100 + i), False, 1, 100 * k + i) for k, (name, of) in enumerate((("On Line", LINE), ("Face", BED), ("Krisby (Armchairs)", CHAIR))) for i, (v, c) in enumerate(of)]
    return spark.createDataFrame(rows, PRICES).cache()


def chosen(spark, prices, asked):
    """by_rule and variants that stay for each (product, message, variants of the turn before)."""
    q = spark.createDataFrame([(i, "D", m, last) for i, (_, m, last) in enumerate(asked)], "qid long, brand string, message string, last_variants array<string>")
    of = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(asked)], "qid long, product_name string")
    rows = narrow.narrowed(narrow.task_table(q, of), prices).where("kept").groupBy("qid", "by_rule").agg(F.array_sort(F.collect_set("model_variant")).alias("v")).orderBy("qid").collect()
    return [(r.by_rule, r.v) for r in rows]


def test_variant_rules(spark, prices):
    threes = ["3-er central element", "3-er sofa"]
    sofas = ["2-er sofa", "3-er extra sofa", "3-er maxi sofa", "3-er sofa"]
    want = [
        ("On Line", "give on line 3er price", [], ("tie", threes)),  # maxi and extra need words of their own
        ("On Line", "give on line 3-er category u", ["2-er sofa"], ("tie", threes)),  # what the turn before named doesn't count against it
        ("On Line", "give on line sofa price", [], ("tie", sofas)),  # a word of the name asks for the family
        ("On Line", "give on line 3er maxi price", [], ("words", ["3-er maxi sofa"])),
        ("On Line", "give on line 3 er sofa", [], ("suffix", ["3-er sofa"])),
        ("On Line", "give on line price", ["Island"], ("last", ["Island"])),
        ("On Line", "give all on line price", ["Island"], ("none", sorted(v for v, _ in LINE))),  # the product by name and all of it
        ("On Line", "give all price", ["Island"], ("last", ["Island"])),
        ("Face", "price struttura", ["Face - h.27 base"], ("height", ["Struttura h.27"])),
        ("Face", "price struttura", [], ("tie", ["Struttura h.27", "Struttura h.8", "Struttura rete"])),
        ("Face", "give price", ["Face - h.8"], ("last", ["Face - h.8", "Struttura h.8"])),  # all of its height
        ("Face", "price h.8", [], ("code", ["Face - h.8", "Struttura h.8"])),
        ("Face", "price struttura h.8", [], ("code", ["Face - h.8", "Struttura h.8"])),  # the digit of the height is shared by both
        ("Krisby (Armchairs)", "armchair price", [], ("tie", ["Armchair", "Armchair low", "Armchair mix", "Armchair mix low"])),  # the one without a name of its own too
    ]
    assert chosen(spark, prices, [w[:3] for w in want]) == [w[3] for w in want]


def test_compound_questions(spark, prices):
    asked = [
        ("On Line", "give on line 2er and 3er sofa price", {(1, "2-er sofa", False), (1, "3-er sofa", False)}),
        ("On Line", "give on line 3er and 3er maxi all price", {(2, "3-er sofa", True), (2, "3-er maxi sofa", False)}),
        ("On Line", "give on line 3er maxi and 3er all price", {(2, "3-er sofa", True), (2, "3-er maxi sofa", False)}),
        ("On Line", "give on line 2er and 2er central element price", {(2, "2-er sofa", True), (2, "2-er central element", False)}),
        ("On Line", "give on line island and square corner", {(3, "Island", False), (3, "Square corner", False)}),
        ("On Line", "give on line island and island", set()),
        ("On Line", "give on line island", set()),
        ("On Line", "give on line sofa and price", set()),
    ]
    q = spark.createDataFrame([(i, "D", m) for i, (_, m, _) in enumerate(asked)], "qid long, brand string, message string")
    of = spark.createDataFrame([(i, p, m) for i, (p, m, _) in enumerate(asked)], "qid long, product_name string, clause string")
    rows = answer.compound(q, of, prices).collect()
    got = {i: {(r.reading, r.variant, r.guessed) for r in rows if r.qid == i} for i in range(len(asked))}
    assert got == {i: w for i, (_, _, w) in enumerate(asked)}
    assert all(r.model_variant == r.variant for r in rows)


def test_answers_hold_both_parts(spark, prices):
    names = prices.groupBy("brand", "product_name").agg(F.lit(None).cast("string").alias("collection"), F.min("row_ord").alias("first"))
    q = spark.createDataFrame([(1, "D", "give on line 2er and 3er sofa price"), (2, "D", "on line island")], "qid long, brand string, message string")
    got = answer.answers(q, names, prices).collect()
    assert sorted((r.qid, r.status, r.n_rows, r.model_variant) for r in got) == [(1, "multi_product", 2, "2-er sofa"), (1, "multi_product", 2, "3-er sofa"), (2, "ok", 1, "Island")]


WORDS = "page int, top double, left double, text string"


def page(lines, n=1):
    return [(n, float(top), float(left), text) for top, left, text in lines]


def test_numbered_index(spark):
    lines = [
        (10, 60, "SOFA"), (20, 40, "008"), (21, 70, "Ada"), (20, 300, "086"), (22.6, 331, "Boxy"), (22.6, 365, "-"), (22.6, 380, "Eric"), (22.6, 400, "-"),
        (35, 331, "Primopiano"), (50, 40, "010"), (50, 70, "356"), (50, 300, "090"), (50, 331, "Configuration"), (65, 71, "luxury"), (80, 40, "012"),
        (95, 70, "lost"), (110, 40, "014"), (110, 70, "Chloe"), (110, 300, "092"), (110, 331, "Monolith"), (125, 300, "This"), (125, 330, "cancels"), (140, 300, "more"),
    ]
    got = layouts.numbered_index(spark.createDataFrame(page(lines), WORDS), labels=("Configuration",), stops="cancels").collect()
    assert sorted((r.column, r.printed, r.name) for r in got) == [(0, 8, "Ada"), (0, 10, "356 luxury"), (0, 14, "Chloe"), (1, 86, "Boxy - Eric - Primopiano"), (1, 92, "Monolith")]
    assert layouts.numbered_index(spark.createDataFrame([], WORDS)).count() == 0


def test_category_index(spark):
    grid = [(40, 50, "Lost"), (40, 250, "too"), (55, 50, "p."), (55, 65, "1"), (70, 50, "Low"), (70, 70, "Tables"), (100, 49, "Levante"), (100, 80, "Out"), (100, 250, "Peonia"), (115, 50, "p."), (115, 65, "12"), (115, 250, "p."), (115, 265, "14"), (760, 50, "p.")]
    view = [(10, 50, "INDICE"), (20, 410, "Early"), (20, 540, "3"), (30, 50, "Sofas"), (31, 410, "Levante"), (31, 440, "Out"), (32, 540, "8"), (45, 410, "Lina"), (45, 540, "9"), (60, 410, "Palu"), (75, 410, "Nove"), (75, 540, "9a"), (90, 540, "OUTDOOR_9")]
    words = spark.createDataFrame([("f", *w) for w in [*page(grid, 1), *page(view, 2), *page(view, 3)]], "file string, " + WORDS)
    got = sorted((r.name, r.printed) for r in layouts.category_index(words, "file", noise=r"^\w+_\d+$").collect())
    assert got == [("Levante Out (Low Tables)", 12), ("Levante Out (Sofas)", 8), ("Lina", 9), ("Peonia", 14)]
    assert layouts.category_index(words.limit(0), "file").count() == 0


LINES = "page int, line int, text string"


def text_lines(spark, text, n=1):
    return spark.createDataFrame([(n, i, t) for i, t in enumerate(text.split("\n"))], LINES)


def test_articles(spark):
    text = """Plan art. 2214 Sofa  - art. 3899K2 part   art. 9466C  system
art.

258 - LIST EXPORT
1820L  Chaise  longue
running text
1 pz - art. 2726 (60x40)
cover art. 9456C
note
23656 Bergere
art.
text in small letters
7777 never
plain words
art. 2300 A B 16 white
end"""
    got = [(r.line, r.code, r.name) for r in extract.articles(text_lines(spark, text), "page", footer="LIST EXPORT").orderBy("line", "code").collect()]
    assert got == [(0, "2214", "Sofa"), (0, "9466C", "system"), (1, "1820L", "Chaise longue"), (10, "23656", "Bergere"), (14, "2300", "")]


def test_price_tables_by_spans(spark):
    text = """             Extra        Plus         Super
SEAT         1.000                     +300
ARM                       -            40
FOOT              20                   30
LEG          10  11
WORD         about
prose without price"""
    rows, rejects = shapes.price_tables(text_lines(spark, text), "page")
    assert [(r.line, r.label, r.column, r.price_eur) for r in rows.orderBy("line", "column").collect()] == [(1, "SEAT", "Extra", "1.000"), (1, "SEAT", "Super", "+300"), (2, "ARM", "Super", "40")]
    assert [r.line for r in rejects.orderBy("line").collect()] == [3, 4]
    assert shapes.price_tables(text_lines(spark, "SEAT  100  200"), "page")[0].count() == 0  # no heading, no guess


def test_articles_options_need_one(spark):
    text = "ARTICOLO  SPECIFICHE  €\n- Noce 100\n15.08\n- Noce 200\nARTICOLO  SPECIFICHE  €\n- Noce 300"
    rows, rejects = shapes.price_tables(text_lines(spark, text), "page")
    assert [(r.line, r.article, r.price_eur) for r in rows.collect()] == [(3, "15.08", "200")]
    assert sorted(r.line for r in rejects.collect()) == [1, 5]


def test_page_texts_of_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"<<<PDFPAGE:1>>>\nPerch\xe9 no\r\n<<<PDFPAGE:2>>>\nok\xe2\x82")
    got = sorted((r.page, r.text) for r in readers.page_texts(spark, str(tmp_path)).collect())
    assert got == [(1, "Perch� no\n"), (2, "ok�")]


def decided(spark, prices, asked):
    names = prices.groupBy("brand", "product_name").agg(F.lit("One").alias("collection"), F.min("row_ord").alias("first"))
    rows = [(i, "D", m, last, offers, (guess,) if guess else None) for i, (m, last, offers, guess) in enumerate(asked)]
    q = spark.createDataFrame(rows, "qid long, brand string, message string, last_product string, last_candidates array<string>, intent struct<product_names:array<string>>")
    return q, names


def test_decisions_of_sessions(spark, prices):
    asked = [
        ("give me prices", None, ["On Line", "Face", "Gone"], None), ("give me all prices", None, ["On Line", "Face", "Gone"], None), ("all prices", None, ["Face"], None), ("prices", None, ["Gone"], None),
        ("price F27", None, None, ["On Line"]), ("price of face", None, None, ["FACE", "Nowhere"]), ("zzqx price", "On Line", None, ["On Line"]), ("island price", "On Line", None, ["On Line"]),
    ]
    q, names = decided(spark, prices, asked)
    got = {}
    for r in answer.decisions(q, names, prices).collect():
        got.setdefault(r.qid, set()).add((r.product_name, r.rule, r.outcome))
    assert got[0] == {("On Line", "offered", "clarify"), ("Face", "offered", "clarify")} and got[1] == {("On Line", "offered", "multi"), ("Face", "offered", "multi")}
    assert got[2] == {("Face", "offered", "lookup")} and 3 not in got
    assert got[4] == {("Face", "code_override", "lookup")} and got[5] == {("Face", "named", "multi")}
    assert 6 not in got  # a fresh attempt at another product
    assert got[7] == {("On Line", "named", "lookup")}
    told = {r.qid: r for r in answer.answers(q, names, prices).collect()}
    assert told[5].unresolved == ["Nowhere"] and told[3].status == told[6].status == "no_product_match"
    assert told[7].shown_name == "On Line (Island)" and told[7].n_variants == 1 and told[7].total is None


def test_add_on_totals_and_summaries(spark):
    row = lambda p, v, size, price, n: ("D", p, v, None, size, None, None, f"C{n}", price, False, 1, n)
    rows = [row("Face", "Face", "160x200", "1.200", 1), row("Face", "Lift", "160x200", "+300", 2), row("Face", "Lift", "180x200", "+350", 3)]
    rows += [row(f"Lamp {c}", None, None, "10", 10 + i) for i, c in enumerate("abcdefghijklmnopqrstuvw")]
    p = spark.createDataFrame(rows, PRICES)
    names = p.groupBy("brand", "product_name").agg(F.lit("Set").alias("collection"), F.min("row_ord").alias("first"))
    every = ", ".join(f"lamp {c}" for c in "abcdefghijklmnopqrstuvw")
    q = spark.createDataFrame([(1, "D", "face lift 160x200"), (2, "D", "face lift"), (3, "D", every)], "qid long, brand string, message string")
    out = answer.answers(q, names, p)
    got = {r.qid: r for r in out.where("qid < 3").collect()}
    assert (got[1].shown_name, got[1].add_on, got[1].total) == ("Face (Lift)", True, "1.500") and (got[2].add_on, got[2].total) == (True, None)
    assert [tuple(r) for r in answer.summaries(out, names).collect()] == [(3, 23, 23, 0, "Set")]


def test_brand_files_replace_their_brand_only(spark, tmp_path):
    kind = T.StructType([T.StructField("brand", T.StringType()), T.StructField("product_name", T.StringType()), T.StructField("price_eur", T.StringType())])
    source, table, marks = (str(tmp_path / x) for x in ("in", "table", "marks"))
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text(json.dumps([dict(zip(("brand", "product_name", "price_eur"), r)) for r in rows]))
    manual = spark.createDataFrame([("A", "Manual", "5")], kind)

    def merge(rows):
        return rows.unionByName(manual.join(rows.select("brand").distinct(), "brand", "left_semi").select(*rows.columns)).distinct()

    def load():
        loading.stream_brands(spark, source, kind, table, marks, merge).awaitTermination(120)
        return sorted(tuple(r) for r in readers.reload(spark, table).select("brand", "product_name", "price_eur").collect())

    put("a1.json", [("A", "Ada", "100"), ("A", "Bo", "200")])
    put("b1.json", [("B", "Cy", "300")])
    assert load() == [("A", "Ada", "100"), ("A", "Bo", "200"), ("A", "Manual", "5"), ("B", "Cy", "300")]
    other = sorted(f.name for f in (tmp_path / "table" / "brand=B").glob("*.parquet"))
    put("a2.json", [("A", "Ada", "110")])
    first = load()
    assert first == [("A", "Ada", "110"), ("A", "Manual", "5"), ("B", "Cy", "300")]
    assert sorted(f.name for f in (tmp_path / "table" / "brand=B").glob("*.parquet")) == other  # untouched
    assert load() == first  # nothing new
    again = spark.createDataFrame([("A", "Ada", "110")], kind)
    loading.replace_brands(again, table, merge)  # the batch once more
    assert sorted(tuple(r) for r in readers.reload(spark, table).select("brand", "product_name", "price_eur").collect()) == first


def test_newest_file_of_a_brand(spark):
    rows = spark.createDataFrame([("A", 1, "x", 5), ("A", 2, "y", 7), ("A", 3, "y", 7), ("B", 4, "x", 5)], "brand string, n int, file string, modified int")
    assert sorted(tuple(r) for r in loading.newest(rows).collect()) == [("A", 2), ("A", 3), ("B", 4)]


#: Literal questions of the sizes-and-variants gate, on planted rows: message, product of the turn before, variants that must be shown.
CASES = [
    ("give on line 2er and 3er sofa price", None, {"2-er sofa", "3-er sofa"}), ("give online 3er and 3er maxi all price", "On Line", {"3-er sofa", "3-er maxi sofa"}),
    ("give online 3er maxi and 3er all price", "On Line", {"3-er maxi sofa", "3-er sofa"}), ("give 2er and 2er central element price", "On Line", {"2-er sofa", "2-er central element"}),
    ("give on line 3er price", None, {"3-er sofa", "3-er central element"}), ("give me krisby (armchairs) armchair price", None, {"Armchair", "Armchair mix", "Armchair low", "Armchair mix low"}),
]


def test_cases_through_answers(spark, prices):
    names = prices.groupBy("brand", "product_name").agg(F.lit(None).cast("string").alias("collection"), F.min("row_ord").alias("first"))
    q = spark.createDataFrame([(i, "D", m, last) for i, (m, last, _) in enumerate(CASES)], "qid long, brand string, message string, last_product string")
    shown = {}
    for r in answer.answers(q, names, prices).where("row_ord is not null").collect():
        shown.setdefault(r.qid, set()).add(r.model_variant)
    assert [shown.get(i) for i in range(len(CASES))] == [v for _, _, v in CASES]


def test_title_block_explains_a_follow_up(spark, prices):
    q = spark.createDataFrame([(1, "D", "the modular one", "On Line"), (2, "D", "the modular lamp", "On Line"), (3, "D", "3er maxi", "On Line")], "qid long, brand string, message string, last_product string")
    titles = spark.createDataFrame([("D", "On Line", "ON LINE\nModular system\nDesign")], "brand string, product_name string, title_block string")
    got = lambda t: {r.qid: r.explained for r in resolve.anchor_explains(q, prices, t).collect()}
    assert got(titles)[1] is True and got(None)[1] is False and got(titles)[3] is True
