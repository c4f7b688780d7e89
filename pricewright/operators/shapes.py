"""Price tables in page text by their shape (S14g): tier grids by spans, codes by column, two prices of a collection, options of a finish, sizes.

A heading holds for the lines below it, up to the next one; lines with prices that don't fit it become rejects, never guesses.
All is by line, with one window over a page that carries the heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

PRICE = r"\+?\d{1,3}(?:\.\d{3})*(?:,\d+)?"
#: What stands in a cell without a price.
NOTHING = ("-", "/", "—")
ROW = "shape string, article string, label string, size string, column string, code string, price_eur string"


def spans(c: Column) -> Column:
    """The chunks of a line between two spaces or more: an array of (start, end, text), places from 0, the end not included."""
    pieces = F.regexp_extract_all(F.rtrim(c), F.lit(r"(\s*\S+(?:\s\S+)*)"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = (a["at"] + F.length(p)).cast("int")
        word = F.ltrim(p)
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct((end - F.length(word)).cast("int").alias("start"), end.alias("end"), word.alias("text")))).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def texts(s: Column) -> Column:
    return F.transform(s, lambda x: x["text"])


def overlapped(cells: Column, columns: Column) -> Column:
    """For each cell the number of the one column whose span it overlaps, -1 if it overlaps none or several."""

    def one(x: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(columns) - 1), lambda i: (x["start"] < F.get(columns, i)["end"]) & (F.get(columns, i)["start"] < x["end"]))
        return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(-1)

    return F.transform(cells, one)


def headed(lines: DataFrame, code: str, tiers: tuple[str, ...], *keys: str) -> DataFrame:
    """Adds s (the line's spans) and head: kind, columns, codes and article of the heading above.

    Kinds: ``grid``, two of ``tiers`` (or ``Cat. X``) or more; ``codes``, two codes or more under a line of as many names; ``dual``, a line that ends in ``Prezzo 1`` and
    ``Prezzo 2``; ``options``, one that begins with ``ARTICOLO`` and ends in a euro sign. Under these a line that begins with an
    article's number (``15.08``) names the article of the lines below it.
    """
    by = Window.partitionBy(*keys).orderBy("line")
    d = lines.withColumn("s", spans(F.col("text"))).withColumn("above", F.lag("s").over(by))
    tier = F.forall(texts(F.col("s")), lambda x: X.normalize(x).isin(*tiers) | x.rlike(r"(?i)^cat\.? "))
    several = F.size("s") >= 2
    codes = several & F.forall(texts(F.col("s")), lambda x: x.rlike(f"^(?:{code})$")) & (F.size("above") == F.size("s"))
    kind = F.when(several & tier, "grid").when(codes, "codes").when(F.col("text").rlike(r"(?i)prezzo 1\b.*prezzo 2\b\W*$"), "dual").when(F.col("text").rlike(r"^\s*ARTICOLO\b.*€\s*$"), "options")
    columns = F.when(kind == "codes", F.transform(F.arrays_zip("s", "above"), lambda x: F.struct(F.least(x["s"]["start"], x["above"]["start"]).alias("start"), F.greatest(x["s"]["end"], x["above"]["end"]).alias("end"), x["above"]["text"].alias("text")))).otherwise(F.col("s"))
    here = F.when(kind.isNotNull(), F.struct("line", kind.alias("kind"), columns.alias("columns"), texts(F.col("s")).alias("codes")))
    up_to = by.rowsBetween(Window.unboundedPreceding, 0)
    article = F.nullif(F.regexp_extract("text", r"^\s*(\d{2}\.\d{2})\b", 1), F.lit(""))
    d = d.withColumn("head", F.last(here, ignorenulls=True).over(up_to)).withColumn("is_head", kind.isNotNull())
    named = F.last(F.when(article.isNotNull(), F.struct("line", article.alias("article"), F.nullif(F.trim(F.regexp_replace("text", r"^\s*\d{2}\.\d{2}", "")), F.lit("")).alias("spec"))), ignorenulls=True).over(up_to)
    return d.withColumn("named", F.when(named["line"] > F.col("head.line"), named)).withColumn("is_article", article.isNotNull())


def row(shape: str, label: Column, price: Column, article=None, size=None, column=None, code=None) -> Column:
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c.cast("string")
    return F.struct(F.lit(shape).alias("shape"), pick(article).alias("article"), label.alias("label"), pick(size).alias("size"), pick(column).alias("column"), pick(code).alias("code"), price.alias("price_eur"))


def price_tables(lines: DataFrame, *keys: str, code: str = r"[0-9A-Z]*\d[0-9A-Z]{3,}", tiers: tuple[str, ...] = X.KNOWN_TIERS) -> tuple[DataFrame, DataFrame]:
    """S14g: rows (keys, line, shape, article, label, size, column, code, price_eur) and rejects (keys, line, reason) of lines (keys, line, text).

    ``grid``: each cell belongs to the column whose span it overlaps, so rows may leave columns out; a cell between columns, or two in
    one, reject the line. ``codes``: as a grid, each column with a code of its own. ``dual``: a collection has one price, or ``334 - 386``, the first
    and second. ``options``: ``- label CODE price`` of the article above, the code being optional, and surcharges
    (``Maggiorazione ...``), whose prices get a plus. ``sizes``, needs no heading: ``label 100x200cm € 498``.
    """
    d = headed(lines, code, tiers, *keys).where("not is_head")
    kind, t = F.col("head.kind"), F.trim("text")
    value = lambda x: x.rlike(f"^{PRICE}$")
    cell = lambda x: value(x) | x.isin(*NOTHING)
    cells = F.filter("s", lambda x: cell(x["text"]))
    label = F.array_join(texts(F.filter("s", lambda x: ~cell(x["text"]))), " ")
    d = d.withColumn("cells", cells).withColumn("to", F.when(kind.isin("grid", "codes"), overlapped(F.col("cells"), F.col("head.columns")))).withColumn("label", label)
    fits = ~F.array_contains("to", F.lit(-1)) & (F.size(F.array_distinct("to")) == F.size("to"))
    at = lambda x: F.get(F.col("head.columns"), x["to"])["text"]
    own = lambda x: F.when(kind == "codes", F.get(F.col("head.codes"), x["to"]))
    zipped = F.filter(F.arrays_zip("cells", "to"), lambda x: value(x["cells"]["text"]))
    grid = F.transform(zipped, lambda x: row("grid", F.col("label"), x["cells"]["text"], column=at(x), code=own(x)))
    grid = F.transform(grid, lambda r: r.withField("shape", kind))
    pair, single = rf"^(.+?)\s+({PRICE}) - ({PRICE})$", rf"^(.+?)\s+({PRICE})$"
    part = lambda p, n: F.regexp_extract(t, p, n)
    dual = F.when(t.rlike(pair), F.array(*(row("dual", part(pair, 1), part(pair, n + 1), column=F.lit(str(n))) for n in (1, 2)))).when(t.rlike(single), F.array(row("dual", part(single, 1), part(single, 2))))
    option = rf"^- (.+?)(?:\s+({code}))?\s+({PRICE})$"
    more = rf"^(Maggiorazione\b.+?)(?:\s+({code}))?\s+\+?({PRICE})$"
    of = lambda p: F.nullif(part(p, 2), F.lit(""))
    options = F.when(t.rlike(option), F.array(row("options", part(option, 1), part(option, 3), article=F.col("named.article"), size=F.col("named.spec"), code=of(option))))
    options = options.when(t.rlike(more), F.array(row("options", part(more, 1), F.concat(F.lit("+"), F.regexp_replace(part(more, 3), r"^\+", "")), article=F.col("named.article"), code=of(more))))
    size = rf"^(.+?)\s+(\d+x\d+)\s*(?:cm)?\s+€\s*({PRICE})$"
    sizes = F.array(row("sizes", part(size, 1), part(size, 3), size=part(size, 2)))
    found = F.when(t.rlike(size), sizes).when(kind.isin("grid", "codes") & (F.size("cells") > 0) & fits & (F.col("label") != ""), grid).when(kind == "dual", dual).when((kind == "options") & F.col("named.article").isNotNull(), options)
    d = d.withColumn("found", found)
    rows = d.select(*keys, "line", F.explode("found").alias("r")).select(*keys, "line", "r.*")
    priced = F.exists(F.split(t, r"\s+"), value) & ~F.col("is_article")
    misfit = F.when(kind.isin("grid", "codes") & ~fits, "a price stands under no column or beside another").otherwise("no form of the heading's table")
    return rows, d.where(F.col("found").isNull() & kind.isNotNull() & priced).select(*keys, "line", misfit.alias("reason"))
