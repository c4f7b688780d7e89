"""Queries of index layouts: words laid out from the parts table by a rule of printing, read back by the operators; the SQL names the parts directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import query
from .operators import extract, layouts, shapes
from .sources import readers
from .sources.adapter import table


def _word(left, top, text):
    return F.struct(F.round(left, 2).cast("double").alias("left"), F.round(top, 2).cast("double").alias("top"), text.cast("string").alias("text"))


def _words(parts, words, *keys):
    """(keys, page, left, top, text) of arrays of words; null texts are left out."""
    d = parts.select(*keys, "page", F.explode(words).alias("w")).where("w.text is not null and w.text <> ''")
    return d.select(*keys, "page", "w.left", "w.top", "w.text")


def _numbered_page(spark, d):
    """An index of two columns, 24 parts a page, in rows of two; every fourth name is wrapped, every eleventh begins with a number, tops of one row differ by up to 2.4."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.expr("p_partkey div 24").alias("page"), (F.col("p_partkey") % 24).alias("slot"))
    p = p.withColumn("column", F.col("slot") % 2).withColumn("top", 60 + 24.0 * F.expr("slot div 2")).withColumn("x", 40 + 260.0 * F.col("column"))
    title = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("356 "), "p_name")).otherwise(F.col("p_name"))
    p = p.withColumn("names", F.split(title, " ")).withColumn("wraps", F.col("p_partkey") % 4 == 0)
    number = _word(F.col("x") + F.col("p_partkey") % 3, F.col("top"), F.col("p_partkey") % 900 + 1)
    below = F.col("wraps") & (F.size("names") > 1)
    names = F.transform("names", lambda w, i: _word(
        F.col("x") + 30 + 34.0 * F.when(below & (i == F.size("names") - 1), 0).otherwise(i), F.col("top") + 0.8 * (F.col("p_partkey") % 4) + F.when(below & (i == F.size("names") - 1), 10.0).otherwise(0.0), w,
    ))
    label = F.when((F.col("slot") == 12) & (F.col("page") % 2 == 0), F.array(_word(F.lit(40.0), F.col("top") - 9, F.lit("SECTION")), _word(F.lit(75.0), F.col("top") - 9, F.lit("B"))))
    note = F.when((F.col("slot") == 23) & (F.col("page") % 3 == 0), F.transform(F.array(*map(F.lit, ("This", "list", "cancels", "all"))), lambda w, i: _word(300 + 30.0 * i, F.lit(400.0), w)))
    more = F.when((F.col("slot") == 23) & (F.col("page") % 3 == 0), F.array(_word(F.lit(305.0), F.lit(412.0), F.lit("others"))))
    title = F.when(F.col("slot") == 0, F.array(_word(F.lit(60.0), F.lit(20.0), F.lit("Products")), _word(F.lit(95.0), F.lit(20.0), F.lit("Index"))))
    nothing = F.array().cast("array<struct<left:double,top:double,text:string>>")
    return _words(p, F.concat(F.array(number), names, *(F.coalesce(x, nothing) for x in (label, note, more, title))))


@query("""SELECT p_partkey // 24 AS page, (p_partkey % 24 % 2)::INT AS "column", CASE WHEN p_partkey % 11 = 0 THEN '356 ' ELSE '' END || p_name AS name, (p_partkey % 900 + 1)::INT AS printed FROM part""")
def index_numbered(spark, d):
    return layouts.numbered_index(_numbered_page(spark, d), labels=("SECTION B",), stops="(?i)cancels").select("page", "column", "name", "printed")


KINDS = ("Sofas", "Low Tables", "Lamps")


def _category_pages(spark, d):
    """Files of ten pages of 18 parts in three blocks; every other page is a card grid of three columns, the others lists whose category stands in the block's first row only."""
    p = table(spark, d, "part").select("p_name", (F.col("p_partkey") % 900 + 1).alias("number"), F.expr("p_partkey div 180").alias("file"), F.expr("p_partkey div 18").alias("page"), (F.col("p_partkey") % 18).alias("slot"))
    p = p.withColumn("block", F.expr("slot div 6")).withColumn("in_block", F.col("slot") % 6).withColumn("names", F.split("p_name", " "))
    p = p.withColumn("kind", F.split(F.element_at(F.array(*map(F.lit, KINDS)), (F.expr("slot div 6") + 1).cast("int")), " "))
    line = 80 + 20.0 * F.col("slot")
    listed = F.concat(
        F.transform("names", lambda w, i: _word(400 + 30.0 * i, line + 0.5 * i, w)), F.array(_word(F.lit(541.0), line + 1.5, F.col("number"))),
        F.transform("kind", lambda w, i: _word(50 + 40.0 * i, line + 2.5, F.when(F.col("in_block") == 0, w))),
    )
    x, top = 40 + 180.0 * (F.col("in_block") % 3), 100 + 180.0 * F.col("block") + 60.0 * F.expr("in_block div 3")
    card = F.concat(
        F.transform("names", lambda w, i: _word(x - 1.5 + 36.0 * i, top, w)), F.array(_word(x, top + 15, F.lit("p.")), _word(x + 14, top + 15, F.col("number"))),
        F.transform("kind", lambda w, i: _word(300 + 40.0 * i, 70 + 180.0 * F.col("block"), F.when(F.col("in_block") == 0, w))),
    )
    around = F.array(
        _word(F.lit(50.0), F.lit(30.0), F.when(F.col("slot") == 0, "INDICE")), _word(F.lit(545.0), F.lit(770.0), F.when(F.col("slot") == 0, F.lit("77"))),
        _word(F.lit(420.0), F.lit(700.0), F.when(F.col("slot") == 0, F.concat(F.lit("OUTDOOR_"), F.col("page").cast("string")))),
    )
    return _words(p, F.concat(F.when(F.col("page") % 2 == 0, listed).otherwise(card), around), "file")


@query(f"""WITH e AS (SELECT p_partkey // 180 AS file, p_name, {list(KINDS)}[p_partkey % 18 // 6 + 1] AS kind, (p_partkey % 900 + 1)::INT AS printed FROM part)
SELECT DISTINCT file, CASE WHEN (SELECT count(DISTINCT kind) FROM e o WHERE o.file = e.file AND o.p_name = e.p_name) > 1 THEN p_name || ' (' || kind || ')' ELSE p_name END AS name, printed FROM e""")
def index_categories(spark, d):
    return layouts.category_index(_category_pages(spark, d), "file", noise=r"^[A-Z]+_\d+$")


#: Arrangements in which a part's code and name are printed, by its number: c is the code, n the name, and the articles found in them (as SQL).
ARRANGED = (
    ("art. {c}   {n}", "(c, n)"),
    ("Plan B art. {c} {n} - art. 9999  art. {c}X set {n}", "(c, n), (c || 'X', 'set ' || n)"),
    ("art.\n\n7 - LIST EXPORT\n{c}  {n}", "(c, n)"),
    ("{c} {n}\nart. \nlower text", "(c, n)"),
    ("{n} cover, art. {c} {n}", ""),
    ("1 pz - art. {c} (60x40)", ""),
    ("Art. {c}  A B  16 white", "(c, '')"),
    ("art.\nsmall letters first\n{c} {n}", ""),
    ("ART {c} - {n}  -", "(c, n)"),
    ("art.\nText\nMore\nText\nText\nText\n{c} {n}", ""),
)


def _article_lines(spark, d):
    """Pages of twelve parts, each in one of the arrangements, with running text after it."""
    p = table(spark, d, "part").select("p_partkey", F.expr("p_partkey div 12").alias("page"), F.concat((F.col("p_partkey") + 1000).cast("string"), F.lit("A")).alias("c"), F.col("p_name").alias("n"))
    forms = F.element_at(F.array(*(F.lit(form) for form, _ in ARRANGED)), (F.col("p_partkey") % len(ARRANGED) + 1).cast("int"))
    printed = F.concat(F.replace(F.replace(forms, F.lit("{c}"), F.col("c")), F.lit("{n}"), F.col("n")), F.lit("\nnote of the article"))
    pages = p.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", printed.alias("x")))), lambda y: y["x"]), "\n").alias("text"))
    return extract.lines_of(pages, "page")


@query("WITH p AS (SELECT p_partkey, p_partkey // 12 AS page, (p_partkey + 1000) || 'A' AS c, p_name AS n FROM part) " + " UNION ALL ".join(
    f"SELECT page, v.code, v.name FROM p, LATERAL (VALUES {rows}) v(code, name) WHERE p_partkey % {len(ARRANGED)} = {i}" for i, (_, rows) in enumerate(ARRANGED) if rows
))
def article_discovery(spark, d):
    return extract.articles(_article_lines(spark, d), "page", footer="LIST EXPORT").select("page", "code", "name")


@query("""SELECT doc_id, chr(65533) || 'p. ' || doc_id || ' ' || chr(65533) AS head, md5(chr(65533) || 'p. ' || doc_id || ' ' || chr(65533) || coalesce(text, '') || chr(65533)) AS text_md5 FROM documents""")
def texts_of_bytes(spark, d):
    """Bytes that are no UTF-8 (a Latin-1 letter, a cut sequence) around every document's."""
    docs = table(spark, d, "documents")
    raw = F.concat(F.unhex(F.lit("E9")), F.encode(F.concat(F.lit("p. "), F.col("doc_id").cast("string"), F.lit(" ")), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("E282")))
    text = readers.valid_text(raw)
    head = F.substring(text, F.lit(1), F.length(F.col("doc_id").cast("string")) + 6)
    return docs.select("doc_id", head.alias("head"), F.md5(text).alias("text_md5"))


#: Blocks of lines in which a part's prices are printed, by its number, ten to a page: {c} is its number in five digits, {n} its name, {a} and {b} prices;
#: then the rows found, as SQL (shape, article, label, size, column, code, price), and how many lines are rejected.
BLOCKS = (
    ("{n}\n                         Pelle        Stoffa        Cat. C\nSEAT                     {a}                         {b}\nBACK  LOW                             {b}", [("grid", None, "SEAT", None, "Pelle", None, "a"), ("grid", None, "SEAT", None, "Cat. C", None, "b"), ("grid", None, "BACK LOW", None, "Stoffa", None, "b")], 0),
    ("                  Pelle   Stoffa\nSEAT             {a}        /\nARM                   {b}\nFOOT       {a}  {b}", [("grid", None, "SEAT", None, "Pelle", None, "a")], 2),
    ("{n}          Standard padding      Wool padding\n             Standard padding      Wool padding\n             0{c}ST              0{c}WL\nPelle              {a}                 {b}\nStoffa             {b}", [("codes", None, "Pelle", None, "Standard padding", "0{c}ST", "a"), ("codes", None, "Pelle", None, "Wool padding", "0{c}WL", "b"), ("codes", None, "Stoffa", None, "Standard padding", "0{c}ST", "b")], 0),
    ("{n}   Prezzo 1 €   Prezzo 2 €\nTessuto Gourmet {a}\nPelle Ecologica {a} - {b}\nTessuto  {a} - ", [("dual", None, "Tessuto Gourmet", None, None, None, "a"), ("dual", None, "Pelle Ecologica", None, "1", None, "a"), ("dual", None, "Pelle Ecologica", None, "2", None, "b")], 1),
    ("ARTICOLO  SPECIFICHE  VERSIONI   €\n15.08  L200 P106\n- Cristallo lucido M326{c} {a}\n- Noce {b}\nMaggiorazione per struttura in oro {a}\nSOLO {b}", [("options", "15.08", "Cristallo lucido", "L200 P106", None, "M326{c}", "a"), ("options", "15.08", "Noce", "L200 P106", None, None, "b"), ("options", "15.08", "Maggiorazione per struttura in oro", None, None, None, "+a")], 1),
    ("{n} MOLLE H13 100x200cm € {a}\n{n} MOLLE H18 90x190 € {b}", [("sizes", None, "{n} MOLLE H13", "100x200", None, None, "a"), ("sizes", None, "{n} MOLLE H18", "90x190", None, None, "b")], 0),
)


def _blocks(spark, d):
    """Pages of ten parts, each as one of the blocks."""
    p = table(spark, d, "part").select("p_partkey", F.expr("p_partkey div 10").alias("page"), "p_name")
    form = F.element_at(F.array(*(F.lit(b) for b, _, _ in BLOCKS)), (F.col("p_partkey") % len(BLOCKS) + 1).cast("int"))
    number = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    facts = {"{c}": number, "{n}": F.col("p_name"), "{a}": (F.col("p_partkey") % 900 + 100).cast("string"), "{b}": F.concat(F.lit("1."), (F.col("p_partkey") % 899 + 100).cast("string"))}
    for mark, value in facts.items():
        form = F.replace(form, F.lit(mark), value)
    pages = p.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", form.alias("x")))), lambda y: y["x"]), "\n").alias("text"))
    return extract.lines_of(pages, "page")


def _block_sql():
    """SELECTs of what each block holds, from the parts alone."""
    prices = {"a": "(p_partkey % 900 + 100)::VARCHAR", "b": "'1.' || (p_partkey % 899 + 100)", "+a": "'+' || (p_partkey % 900 + 100)"}
    text = lambda v: "NULL::VARCHAR" if v is None else "replace(replace('" + v + "', '{c}', lpad(p_partkey::VARCHAR, 5, '0')), '{n}', p_name)"
    out = []
    for i, (_, rows, _) in enumerate(BLOCKS):
        for shape, article, label, size, column, code, price in rows:
            out.append(f"""SELECT p_partkey // 10 AS page, '{shape}' AS shape, {text(article)} AS article, {text(label)} AS label, {text(size)} AS size, {text(column)} AS "column", {text(code)} AS code, {prices[price]} AS price_eur FROM part WHERE p_partkey % {len(BLOCKS)} = {i}""")
    return " UNION ALL ".join(out)


@query(_block_sql())
def table_shapes(spark, d):
    return shapes.price_tables(_blocks(spark, d), "page", tiers=("pelle", "stoffa"))[0].drop("line")


@query("SELECT p_partkey // 10 AS page, sum([" + ", ".join(str(n) for _, _, n in BLOCKS) + f"][p_partkey % {len(BLOCKS)} + 1])::BIGINT AS n_rejects FROM part GROUP BY 1 HAVING n_rejects > 0")
def table_rejects(spark, d):
    return shapes.price_tables(_blocks(spark, d), "page", tiers=("pelle", "stoffa"))[1].groupBy("page").agg(F.count("*").alias("n_rejects"))
