"""Extraction: page texts and word lists to index entries, page maps, ranges, names, slugs, articles, and merged tables.

Windows are by file, brand or page, which are bounded by a document; nothing runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def lines_of(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, text): the lines of texts, CR and CRLF being line ends too."""
    return texts.select(*keys, F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line", "text"))


def pages_by_footer(lines: DataFrame, footer: str, *keys: str) -> DataFrame:
    """S3: adds ``page`` to lines (keys, line, text): the number in the footer (a pattern with one group) at or after it.

    A footer without number takes the one between its neighbours if these differ by exactly 2, else its page is unknown (null).
    """
    by = Window.partitionBy(*keys).orderBy("line")
    foot = F.col("text").rlike(footer)
    marks = lines.where(foot).withColumn("n", F.regexp_extract("text", footer, 1).try_cast("int"))
    before, after = F.lag("n").over(by), F.lead("n").over(by)
    marks = marks.withColumn("number", F.coalesce("n", F.when(after - before == 2, before + 1)))
    marks = marks.select(*keys, "line", F.struct("number").alias("mark"))
    down = Window.partitionBy(*keys).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("mark", ignorenulls=True).over(down)
    return lines.join(marks, [*keys, "line"], "left").withColumn("page", found["number"]).drop("mark")


def page_text(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines put together again by page."""
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return lines.groupBy(*keys, "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def index_dot_leader(lines: DataFrame, sections: tuple[str, ...] = ()) -> DataFrame:
    """Name and printed page of lines ``NAME .... 12``; section headings are left out."""
    pattern = r"^\s*(.+?)\s*\.{2,}\s*(\d+)\s*$"
    d = lines.withColumn("name", F.regexp_extract("text", pattern, 1)).where("name <> ''").withColumn("printed", F.regexp_extract("text", pattern, 2).cast("int"))
    return d.where(~F.upper("name").isin(*sections)) if sections else d


def index_grid(lines: DataFrame, *keys: str) -> DataFrame:
    """Names on one line paired with the ``p.N`` tokens on the next, by place (columns apart by two spaces or more)."""
    d = lines.withColumn("above", F.lag("text").over(Window.partitionBy(*keys).orderBy("line")))
    d = d.withColumn("pages", F.regexp_extract_all("text", F.lit(r"p\.\s*(\d+)"))).where(F.size("pages") > 0)
    names = X.not_empty(F.transform(F.split("above", r"\s{2,}"), lambda x: F.trim(x)))
    pairs = F.arrays_zip(names.alias("name"), F.col("pages"))
    d = d.select(*keys, "line", F.posexplode(pairs).alias("at", "p"))
    return d.select(*keys, "line", "at", F.col("p.name").alias("name"), F.col("p.pages").cast("int").alias("printed")).where("name is not null and printed is not null")


def repeated_headers(lines: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """S6h: the first page of each name that a heading (a pattern with one group) shows; lines have ``page``."""
    d = lines.select(*keys, "page", F.explode(F.regexp_extract_all("text", F.lit(pattern))).alias("name"))
    return d.groupBy(*keys, "name").agg(F.min("page").alias("printed"))


def category_headers(lines: DataFrame, categories: tuple[str, ...] | Column, *keys: str) -> DataFrame:
    """S6g: lines that are a known category (one of some words, or where a condition holds), with the last line before that is not blank as the product's name (30 characters at most, no colon, a capital first)."""
    by = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    name = F.last(F.when(F.trim("text") != "", F.trim("text")), ignorenulls=True).over(by)
    d = lines.withColumn("name", name).where(categories if isinstance(categories, Column) else F.lower(F.trim("text")).isin(*categories))
    return d.where((F.length("name") <= 30) & ~F.contains("name", F.lit(":")) & F.col("name").rlike("^[A-ZÀ-Þ]")).withColumn("category", F.lower(F.trim("text")))


def runs(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """S6f, W4: (keys, run, value, first, last, n) of consecutive rows of one value."""
    by = Window.partitionBy(*keys).orderBy(order)
    d = rows.withColumn("_c", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int"), F.lit(1)))
    d = d.withColumn("_c", F.when(F.row_number().over(by) == 1, 1).otherwise(F.col("_c"))).withColumn("run", F.sum("_c").over(by))
    return d.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def page_islands(pages: DataFrame, page: str, *keys: str) -> DataFrame:
    """(keys, first, last, n) of consecutive page numbers."""
    d = pages.select(*keys, page).distinct()
    d = d.withColumn("_i", F.col(page) - F.row_number().over(Window.partitionBy(*keys).orderBy(page)))
    return d.groupBy(*keys, "_i").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("n")).drop("_i")


def index_columns(words: DataFrame, middle: float) -> DataFrame:
    """Name and printed page of a two-column index by coordinates: words of one side and one rounded top are a row, its last word is the page."""
    w = words.withColumn("side", F.when(F.col("left") < middle, "L").otherwise("R")).withColumn("row", F.round("top").cast("int"))
    rows = w.groupBy("page", "side", "row").agg(F.array_sort(F.collect_list(F.struct("left", "text"))).alias("w")).withColumn("t", F.transform("w", lambda x: x["text"]))
    last = F.element_at("t", -1)
    rows = rows.where((F.size("t") > 1) & last.rlike(r"^\d+$"))
    return rows.select("page", "side", "row", F.array_join(F.slice("t", F.lit(1), F.size("t") - 1), " ").alias("name"), last.cast("int").alias("printed"))


def carried(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """S6e, W3: fills a missing ``value`` with the last one before it."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(by))


def resolved_entries(entries: DataFrame, page_map: DataFrame, headings: DataFrame, ahead: int, *keys: str) -> DataFrame:
    """S6i: literal entries (keys, name, printed) on their page: by the page map, else ``ahead`` pages on; ``confirmed`` if the page's heading (keys, pdf, heading) holds the name. Misses stay, unconfirmed."""
    d = entries.join(page_map.select(*keys, "printed", F.col("pdf").alias("_m")), [*keys, "printed"], "left").withColumn("pdf", F.coalesce("_m", F.col("printed") + ahead)).drop("_m")
    d = d.join(headings.select(*keys, "pdf", "heading"), [*keys, "pdf"], "left")
    return d.withColumn("confirmed", F.coalesce(F.contains(X.normalize("heading"), X.normalize("name")), F.lit(False)))


def without_listed(entries: DataFrame, drops: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """Entries without those in ``drops`` (keys), and with ``product_name`` replaced where ``names`` (keys, new) has another."""
    d = entries.join(drops.select(*keys).distinct(), [*keys], "left_anti").join(names.select(*keys, F.col("new").alias("_new")), [*keys], "left")
    return d.withColumn("product_name", F.coalesce("_new", "product_name")).drop("_new")


def codes_by_place(words: DataFrame, code: str, edge: float = 50.0, down: float = 3.0, right: float = 40.0) -> DataFrame:
    """S14d: code and first page of codes in the left column (left of ``edge``); a lone letter merges with the next word within ``down`` points below or above and ``right`` to its right."""
    by = Window.partitionBy("page").orderBy(F.round("top"), "left")
    near = (F.abs(F.lead("top").over(by) - F.col("top")) <= down) & (F.lead("left").over(by) - F.col("left") <= right)
    lone = F.col("text").rlike("^[A-Z]$")
    whole = F.when(lone & near, F.concat("text", F.lead("text").over(by))).otherwise(F.col("text"))
    d = words.withColumn("code", whole).where((F.col("left") < edge) & F.col("code").rlike(f"^(?:{code})$"))
    return d.groupBy("code").agg(F.min("page").alias("page"))


def _row_lists(words: DataFrame, tolerance: float, keys: tuple[str, ...]) -> DataFrame:
    """keys, w, r: the words of a page in order, and the row of each."""
    lists = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("top", "left", "text"))).alias("w"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, w: Column) -> Column:
        new = a["top"].isNull() | (F.abs(w["top"] - a["top"]) > tolerance)
        row = F.when(new, a["row"] + 1).otherwise(a["row"])
        return F.struct(F.when(new, w["top"]).otherwise(a["top"]).alias("top"), row.alias("row"), F.concat(a["rows"], F.array(row)).alias("rows"))

    return lists.select(*keys, "w", F.aggregate("w", start, step, lambda a: a["rows"]).alias("r"))


def rows_of_words(words: DataFrame, tolerance: float = 3.0, *keys: str) -> DataFrame:
    """S6d: adds ``row`` to words (keys, top, left, text): a row begins where a word's top is more than ``tolerance`` from the top of the row's first word.

    The fold runs inside a page's own list of words, so only a page (``keys``, the page alone if none are given) is gathered.
    """
    keys = keys or ("page",)
    d = _row_lists(words, tolerance, keys)
    return d.select(*keys, F.explode(F.arrays_zip("w", "r")).alias("x")).select(*keys, "x.w.top", "x.w.left", "x.w.text", F.col("x.r").alias("row"))


def columns_of_words(words: DataFrame, tolerance: float = 3.0, gap: float = 80.0, *keys: str) -> DataFrame:
    """S6d: ``rows_of_words`` and ``split_at_gap`` in one: both folds run inside a page's list, so that no rows are sorted again to be split."""
    keys = keys or ("page",)
    d = _row_lists(words, tolerance, keys)
    placed = F.array_sort(F.transform(F.arrays_zip("w", "r"), lambda x: F.struct(x["r"].alias("row"), x["w"]["left"].alias("left"), x["w"]["top"].alias("top"), x["w"]["text"].alias("text"))))
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("left"), F.lit(0).alias("column"), F.array().cast("array<int>").alias("columns"))

    def step(a: Column, w: Column) -> Column:
        same = a["row"] == w["row"]
        column = F.when(same & ((a["column"] == 1) | F.coalesce(w["left"] - a["left"] > gap, F.lit(False))), 1).otherwise(0)
        return F.struct(w["row"].alias("row"), w["left"].cast("double").alias("left"), column.alias("column"), F.concat(a["columns"], F.array(column)).alias("columns"))

    d = d.select(*keys, placed.alias("w")).select(*keys, "w", F.aggregate("w", start, step, lambda a: a["columns"]).alias("c"))
    return d.select(*keys, F.explode(F.arrays_zip("w", "c")).alias("x")).select(*keys, "x.w.top", "x.w.left", "x.w.text", "x.w.row", F.col("x.c").alias("column"))


def split_at_gap(rows: DataFrame, gap: float = 80.0) -> DataFrame:
    """S6d: adds ``column``, 1 for the words of a row from its first gap over ``gap`` on."""
    by = Window.partitionBy("page", "row").orderBy("left")
    wide = F.coalesce(F.col("left") - F.lag("left").over(by) > gap, F.lit(False))
    return rows.withColumn("_w", wide.cast("int")).withColumn("column", F.max("_w").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_w")


def number_band(rows: DataFrame, width: float = 3.0) -> DataFrame:
    """S6d, A5: words that are numbers within ``width`` of the most frequent rounded place of numbers on their page (of equals the left one)."""
    n = rows.where(F.col("text").rlike(r"^\d+$")).withColumn("x", F.round("left").cast("int"))
    mode = n.groupBy("page", "x").agg(F.count("*").alias("c")).groupBy("page").agg(F.min_by("x", F.struct(-F.col("c"), "x")).alias("band"))
    return n.join(mode, "page").where(F.abs(F.col("left") - F.col("band")) <= width).drop("x")


def nearest_column(words: DataFrame, starts: DataFrame, slack: float = 2.0) -> DataFrame:
    """Adds to words the greatest column start (page, start) that is at most ``slack`` right of them; starts of a page are few, so they come as a list."""
    s = starts.groupBy("page").agg(F.array_sort(F.collect_set("start")).alias("s"))
    return words.join(s, "page", "left").withColumn("start", F.array_max(F.filter("s", lambda x: x <= F.col("left") + slack))).drop("s")


def split_place(words: DataFrame, width: float) -> DataFrame:
    """page, place: the middle of the gap between neighbouring words that is closest to half the width."""
    by = Window.partitionBy("page").orderBy("left")
    d = words.select("page", "left").distinct().withColumn("next", F.lead("left").over(by)).where("next is not null").withColumn("mid", (F.col("left") + F.col("next")) / 2)
    return d.groupBy("page").agg(F.min_by("mid", F.struct(F.abs(F.col("mid") - width / 2), "mid")).alias("place"))


def footer_map(pages: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """Keys, printed, pdf: the printed numbers that a footer pattern's groups find on each page; the last page with a number counts."""
    groups = [F.regexp_extract("text", pattern, i + 1).try_cast("int") for i in range(pattern.count("(") - pattern.count("(?:"))]
    d = pages.where(F.col("text").rlike(pattern)).select(*keys, F.col("page").alias("pdf"), F.explode(F.array(*groups)).alias("printed")).where("printed is not null")
    return d.groupBy(*keys, "printed").agg(F.max("pdf").alias("pdf"))


def look_back_footer(lines: DataFrame, pattern: str, depth: int, *keys: str) -> DataFrame:
    """Keys, printed: the first match of a pattern among the last ``depth`` lines of a page that are not blank, from below."""
    full = lines.where(F.trim("text") != "")
    full = full.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("line")))).where(F.col("_k") <= depth).where(F.col("text").rlike(pattern))
    return full.groupBy(*keys).agg(F.min_by(F.regexp_extract("text", pattern, 1).cast("int"), "_k").alias("printed"))


def mode_offset(page_map: DataFrame, *keys: str) -> DataFrame:
    """Keys, offset: the most frequent difference of PDF and printed page; of equals the one seen at the smallest printed page."""
    d = page_map.groupBy(*keys, (F.col("pdf") - F.col("printed")).alias("offset")).agg(F.count("*").alias("c"), F.min("printed").alias("p"))
    return d.groupBy(*keys).agg(F.min_by("offset", F.struct(-F.col("c"), "p")).alias("offset"))


def parity_page(printed: Column, add: int = 1) -> Column:
    """The spread of a printed page by parity."""
    return F.floor((printed + add) / 2).cast("int")


def ranges(entries: DataFrame, start: str, last: str | Column, *keys: str) -> DataFrame:
    """Adds ``end``: the page before the next entry's start, not before its own; the last one ends with the document."""
    by = Window.partitionBy(*keys).orderBy(start, "product_name")
    last = F.col(last) if isinstance(last, str) else last
    return entries.withColumn("end", F.greatest(F.col(start), F.coalesce(F.lead(start).over(by) - 1, last)))


def tied_ranges(entries: DataFrame, start: str, last: str | Column, *keys: str, less: int = 0) -> DataFrame:
    """As above, but entries of one start share an end, that before the next different start; the last group ends ``less`` pages before the document does."""
    last = (F.col(last) if isinstance(last, str) else last) - less
    by = Window.partitionBy(*keys).orderBy(start)
    ends = entries.select(*keys, start).distinct().withColumn("_n", F.lead(start).over(by) - 1)
    return entries.join(ends, [*keys, start]).withColumn("end", F.greatest(F.col(start), F.coalesce("_n", last))).drop("_n")


def pdf_ranges(entries: DataFrame, page_map: DataFrame, offsets: DataFrame, overrides: DataFrame, total: Column, *keys: str) -> DataFrame:
    """Adds pdf_start and pdf_end: both ends through the page map, else by the offset, in order, within 1 to ``total``; an override (keys, product_name, pdf_start, pdf_end) wins."""
    d = entries
    for end in ("start", "end"):
        d = d.join(page_map.select(*keys, F.col("printed").alias(end), F.col("pdf").alias(f"_{end}")), [*keys, end], "left")
    d = d.join(offsets, [*keys], "left")
    a, b = (F.coalesce(f"_{e}", F.col(e) + F.coalesce("offset", F.lit(0))) for e in ("start", "end"))
    clamp = lambda c: F.greatest(F.lit(1), F.least(c, total))
    d = d.withColumn("_a", clamp(F.least(a, b))).withColumn("_b", clamp(F.greatest(a, b)))
    o = overrides.select(*keys, "product_name", F.col("pdf_start").alias("_oa"), F.col("pdf_end").alias("_ob"))
    d = d.join(o, [*keys, "product_name"], "left").withColumn("pdf_start", F.coalesce("_oa", "_a")).withColumn("pdf_end", F.coalesce("_ob", "_b"))
    return d.drop("_start", "_end", "_a", "_b", "_oa", "_ob", "offset")


def disambiguated(entries: DataFrame, name: str, category: str, *keys: str) -> DataFrame:
    """A name under several categories gets its category: adds ``product_name``."""
    by = Window.partitionBy(*keys, name)
    return entries.withColumn("product_name", F.when(F.min(category).over(by) != F.max(category).over(by), F.concat(F.col(name), F.lit(" ("), F.col(category), F.lit(")"))).otherwise(F.col(name)))


def renamed(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (file, name, page or null, new or null): a rule for the page wins over one for the name; a null new name drops the entry."""
    by_page = rules.where("page is not null").select("file", "name", "page", F.struct("new").alias("_p"))
    by_name = rules.where("page is null").select("file", "name", F.struct("new").alias("_n"))
    d = entries.join(by_page, ["file", "name", "page"], "left").join(by_name, ["file", "name"], "left").withColumn("_r", F.coalesce("_p", "_n"))
    return d.withColumn("name", F.when(F.col("_r").isNull(), F.col("name")).otherwise(F.col("_r.new"))).where("name is not null").drop("_p", "_n", "_r")


def slugs(entries: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Adds ``slug`` from product_name, with _2, _3 ... for later entries (by ``ord``) of one brand and base; (brand, slug, owner) of other source files are skipped."""
    d = entries.withColumn("_b", X.slug("product_name"))
    if owned is None:
        d = d.withColumn("_k", F.row_number().over(Window.partitionBy("brand", "_b").orderBy("ord")))
    else:
        taken = owned.withColumn("_b", F.regexp_replace("slug", r"_\d+$", "")).groupBy("brand", "_b", "owner").agg(F.max(F.coalesce(F.regexp_extract("slug", r"_(\d+)$", 1).try_cast("int"), F.lit(1))).alias("_t"))
        others = d.join(taken, ["brand", "_b"], "left").where("owner is null or owner <> source_file").groupBy("brand", "_b", "ord").agg(F.coalesce(F.max("_t"), F.lit(0)).alias("_t"))
        d = d.join(others, ["brand", "_b", "ord"], "left").withColumn("_k", F.row_number().over(Window.partitionBy("brand", "_b").orderBy("ord")) + F.coalesce("_t", F.lit(0)))
    return d.withColumn("slug", F.when(F.col("_k") > 1, F.concat("_b", F.lit("_"), F.col("_k"))).otherwise(F.col("_b"))).drop("_b", "_k", "_t")


#: The forms of an article's code after ``art.``, and of a code that begins a line.
ART_CODE, LINE_CODE = r"[0-9]{3,6}[0-9A-Z]{0,6}", r"^[0-9]{3,6}[A-Z]{0,3}[0-9]{0,2}[A-Z]{0,2}$"
#: Words of the legend of finishes, which no name is made of alone.
FINISHES = (
    "bianco", "white", "grigio", "seta", "silk", "grey", "gray", "denim", "ruggine", "rust", "bronzo", "metal", "bronze", "verde", "green", "moka", "dark", "brown", "nero", "black",
)
#: Stands before each mention while a line is cut.
CUT = "\ue0f1"


def diagram_noise(c: Column, finishes: tuple[str, ...] = FINISHES) -> Column:
    """S14f: whether a text is a diagram's scattered marks: every word a single letter, a size or a finish, or any letter Cyrillic; not for an empty text."""
    tokens = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    marks = F.forall(tokens, lambda w: w.rlike(r"^(?:[a-z]|ø?\d+(?:[.,]\d+)?)$") | w.isin(*finishes))
    return c.rlike(r"[\u0400-\u04ff]") | ((F.size(tokens) > 0) & marks)


def article_name(c: Column) -> Column:
    """S14f: the name in what follows a code: single spaces, no dashes around, 60 characters at most; empty for prices, numbers alone and diagram noise."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), r"^[ -]+|[ -]+$", ""), "^[\b\ufeff]+", ""))
    return F.when(name.rlike(r"^€|^[\d.,€\s]*$") | diagram_noise(name), "").otherwise(F.substring(name, 1, 60))


def articles(lines: DataFrame, *keys: str, footer: str = "(?!)", code: str = ART_CODE, token: str = LINE_CODE, ahead: int = 5, back: int = 2) -> DataFrame:
    """Keys, line, code, name of the articles that ``art.`` stands for, in three arrangements; ``keys`` name a page.

    On the line itself, a mention is ``art. CODE``, and its name runs to the next mention or the line's end; mentions after
    ``cover``, ``pz -`` or a dash refer to another article's parts and count for none. A line that begins with ``art.``
    also takes the first of the next ``ahead`` lines that begins with a code, unless a line in small letters (running text) stands before it;
    where none does, the last of the ``back`` lines above that isn't empty, if it begins with a code. The name is the rest of that line.
    Empty lines and lines that match ``footer`` are passed over. Windows see seven lines at most besides each line.
    """
    by = Window.partitionBy(*keys).orderBy("line")
    t = F.trim("text")
    d = lines.withColumn("t", t)
    mention = rf"(?i)\bart\.?\s+({code})\b"
    pieces = F.split(F.regexp_replace("t", mention, rf"{CUT}$0"), CUT)
    before = lambda i: F.lower(F.right(F.array_join(F.slice("pieces", F.lit(1), i), ""), F.lit(15)))
    guard = r"cover|\bpz\b\s*-\s*$|-\s*$"
    parts = F.transform("pieces", lambda x, i: F.struct(
        F.upper(F.regexp_extract(x, mention, 1)).alias("code"), F.regexp_replace(x, rf"(?i)^art\.?\s+{code}\b", "").alias("rest"), F.when(i > 0, before(i).rlike(guard)).otherwise(F.lit(True)).alias("skip"),
    ))
    own = F.filter(parts, lambda m: ~m["skip"] & (m["code"] != ""))
    look = lambda ts: F.array(*(F.coalesce(F.trim(x), F.lit("")) for x in ts))
    d = d.withColumn("pieces", pieces).withColumn("down", look([F.lead("text", k).over(by) for k in range(1, ahead + 1)])).withColumn("up", look([F.lag("text", k).over(by) for k in range(1, back + 1)]))
    first = lambda x: F.regexp_extract(x, r"^\S+", 0)
    seen = lambda c: F.filter(c, lambda x: (x != "") & ~x.rlike(footer))
    # the first line below that settles it: a code, or running text
    settles = F.get(F.filter(seen("down"), lambda x: first(x).rlike(token) | ((F.length(x) > 3) & x.rlike(r"^\p{Ll}"))), F.lit(0))
    below = F.when(first(settles).rlike(token), settles)
    above = F.get(seen("up"), F.lit(0))
    found = F.coalesce(below, F.when(first(above).rlike(token), above))
    near = F.when(F.col("t").rlike(r"(?i)^art\.?(\s|$)") & found.isNotNull(), F.array(F.struct(F.upper(first(found)).alias("code"), F.regexp_replace(found, r"^\S+\s*", "").alias("rest"))))
    inline = F.transform(own, lambda m: F.struct(m["code"].alias("code"), m["rest"].alias("rest")))
    d = d.select(*keys, "line", F.explode(F.concat(inline, F.coalesce(near, F.array().cast("array<struct<code:string,rest:string>>")))).alias("a"))
    return d.select(*keys, "line", F.col("a.code").alias("code"), article_name(F.trim("a.rest")).alias("name"))


def code_chunks(lines: DataFrame, code: str, *keys: str) -> DataFrame:
    """(keys, line, at, code, name): chunks between two spaces or more that begin with a code, a euro sign standing within three lines; the name is the rest of the chunk and the chunks to the next code.

    A line is cut by itself; the window carries what was found there and whether it has the sign, no texts.
    """
    by = Window.partitionBy(*keys).orderBy("line")
    chunks = X.not_empty(F.transform(F.split("text", r"\s{2,}"), lambda x: F.trim(x)))
    d = lines.select(*keys, "line", F.coalesce(F.contains("text", F.lit("€")), F.lit(False)).alias("_e"), chunks.alias("_t"))
    d = d.withColumn("_c", F.transform("_t", lambda x: F.regexp_extract(x, rf"^({code})(?:\s|$)", 1)))
    d = d.withColumn("_s", F.filter(F.transform("_c", lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull()))
    rest = lambda i: F.trim(F.substr(F.get("_t", i), F.length(F.get("_c", i)) + 1))
    more = lambda i, k: F.slice("_t", i + 2, F.coalesce(F.get("_s", k + 1), F.size("_t")) - i - 1)
    name = lambda i, k: F.array_join(X.not_empty(F.concat(F.array(rest(i)), more(i, k))), " ")
    found = F.transform("_s", lambda i, k: F.struct(i.alias("at"), F.get("_c", i).alias("code"), name(i, k).alias("name")))
    d = d.select(*keys, "line", "_e", F.when(F.size("_s") > 0, found).alias("_f"))
    near = F.col("_e") | F.coalesce(F.lead("_e", 1).over(by), F.lit(False)) | F.coalesce(F.lead("_e", 2).over(by), F.lit(False))
    return d.withColumn("_p", near).where("_p").select(*keys, "line", F.inline("_f"))


def section_fold(found: DataFrame, *keys: str) -> DataFrame:
    """S14e: one row for each code of mentions (keys, code, page, name, priced): first page, first priced page, end (the last page up to the first priced one), name at the first priced page that has one, else the first."""
    priced = F.min(F.when(F.col("priced"), F.col("page"))).over(Window.partitionBy(*keys, "code"))
    d = found.withColumn("_f", priced)
    name = F.coalesce(F.min_by("name", F.when(F.col("priced") & (F.coalesce("name", F.lit("")) != ""), F.col("page"))), F.min_by("name", F.when(F.coalesce("name", F.lit("")) != "", F.col("page"))))
    return d.groupBy(*keys, "code").agg(F.min("page").alias("first_page"), F.min("_f").alias("priced_page"), F.max(F.when(F.col("_f").isNull() | (F.col("page") <= F.col("_f")), F.col("page"))).alias("end_page"), name.alias("name"))


def first_entries(entries: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first entry, by ``order``, of each key."""
    by = Window.partitionBy(*keys).orderBy(order)
    return entries.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def known_codes_priced(lines: DataFrame, codes: DataFrame, *keys: str, sign: str = "€") -> DataFrame:
    """S14h: keys, code, page: the first page with a euro sign (or another ``sign``) on which a known code begins a line."""
    with_price = lines.where(F.contains("text", F.lit(sign))).select(*keys, "page").distinct()
    first = lines.withColumn("code", F.regexp_extract("text", r"^\s*(\S+)", 1)).join(with_price, [*keys, "page"], "left_semi")
    return first.join(codes.select(*keys, "code").distinct(), [*keys, "code"]).groupBy(*keys, "code").agg(F.min("page").alias("page"))


def cleaned_name(c, junk: tuple[str, ...] = ("mm", "cm", "h", "l", "p", "Ø")) -> Column:
    """S14f: a name without trailing junk words, 60 characters at most."""
    words = "|".join(junk)
    return F.substring(F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), rf"(?i)(?:\s+(?:{words}))+$", ""), 1, 60)


def tier_tables(lines: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """S14g: rows and rejects of tier grids: a heading line of two tiers or more between two spaces, then lines of a label and as many prices.

    Lines under a heading whose prices don't fit it are not guessed at; they become rejects with a reason.
    """
    by = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    chunk = X.not_empty(F.split(F.trim("text"), r"\s{2,}"))
    price = r"^\+?\d{1,3}(\.\d{3})*(,\d+)?$"
    d = lines.withColumn("c", chunk).withColumn("heading", (F.size("c") >= 2) & F.forall("c", lambda x: X.normalize(x).isin(*X.KNOWN_TIERS) | x.rlike(r"(?i)^cat\.? ")))
    d = d.withColumn("tiers", F.last(F.when(F.col("heading"), F.col("c")), ignorenulls=True).over(by)).where(~F.col("heading") & F.col("tiers").isNotNull() & (F.size("c") >= 2))
    values = F.slice("c", F.lit(2), F.size("c"))
    d = d.withColumn("v", values).withColumn("priced", F.exists("v", lambda x: x.rlike(price))).where("priced")
    fits = (F.size("v") == F.size("tiers")) & F.forall("v", lambda x: x.rlike(price) | (x == "-"))
    rows = d.where(fits).select(*keys, "line", F.get("c", F.lit(0)).alias("label"), F.explode(F.arrays_zip("tiers", "v")).alias("x")).where("x.v <> '-'").select(*keys, "line", "label", F.col("x.tiers").alias("fabric_tier"), F.col("x.v").alias("price_eur"))
    return rows, d.where(~fits).select(*keys, "line", F.lit("prices don't fit the heading").alias("reason"))


def text_slices(lines: DataFrame, starts: DataFrame, *keys: str) -> DataFrame:
    """Keys, product_name, text: the lines from each product's start (keys, line, product_name) to the next one."""
    d = lines.join(starts.select(*keys, "line", F.col("product_name").alias("_s")), [*keys, "line"], "left")
    d = d.withColumn("product_name", F.last("_s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line"))).where("product_name is not null")
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return d.groupBy(*keys, "product_name").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def appended(entries: DataFrame, more: DataFrame, never: DataFrame, *keys: str) -> DataFrame:
    """Entries, and those of ``more`` whose key is absent, without keys in ``never``."""
    return entries.unionByName(more.join(entries, [*keys], "left_anti"), allowMissingColumns=True).join(never, [*keys], "left_anti")


def merged_index(old: DataFrame, new: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """New entries replace old ones of their brand and name, but protected names keep the old row. Merging twice is merging once."""
    keys = ["brand", "product_name"]
    if protected is not None:
        held = old.join(protected, keys, "left_semi").select(*keys)
        new = new.join(held, keys, "left_anti")
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merged_manual(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual rows replace all rows of their products. Merging twice is merging once."""
    keys = ["brand", "product_name"]
    return rows.join(manual.select(*keys).distinct(), keys, "left_anti").unionByName(manual, allowMissingColumns=True)


def backfilled_labels(texts: DataFrame, tiers: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Brand, product_name, label: the one word of ``words`` whose following text holds, or is held by, a trusted tier (brand, product_name, tier) of the product; none if several do."""
    pattern = rf"(?i)\b({'|'.join(words)})\b[:\s]+([^\n]{{1,60}})"
    d = texts.select("brand", "product_name", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
    d = d.select("brand", "product_name", F.lower(F.regexp_extract("m", pattern, 1)).alias("label"), X.normalize(F.regexp_extract("m", pattern, 2)).alias("v"))
    t = tiers.select("brand", "product_name", X.normalize("tier").alias("t")).where("t <> ''").distinct()
    hits = d.join(t, ["brand", "product_name"]).where(F.contains("v", F.col("t")) | F.contains("t", F.col("v")))
    return hits.groupBy("brand", "product_name").agg(F.collect_set("label").alias("l")).where(F.size("l") == 1).select("brand", "product_name", F.get("l", F.lit(0)).alias("label"))


def repaired_codes(index: DataFrame, prefix: str = "Composizione") -> DataFrame:
    """A missing art_code of names with the prefix becomes the index heading."""
    return index.withColumn("art_code", F.when(F.col("art_code").isNull() & F.col("product_name").startswith(prefix), F.col("index_heading")).otherwise(F.col("art_code")))


#: Index styles by name; each takes lines and their keys.
STYLES = {"grid": index_grid, "dot_leader": index_dot_leader, "headers": repeated_headers, "categories": category_headers}
