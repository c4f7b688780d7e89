"""Index pages by their layout (S6d, S6e): words with places become entries of name and printed page.

Words are (keys, page, top, left, text). Only a page is gathered, to cluster its words into rows (``extract.rows_of_words``);
all else are windows over the rows of a page or file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import carried, rows_of_words

NUMBER = r"^\d{1,4}$"
#: The headings that stand for an index itself, in lower case.
TITLES = ("indice", "interactive", "products index")


def visual_rows(words: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """keys, page, row, w: the words (left, text) of each visual row, from left to right."""
    rows = rows_of_words(words, tolerance, *keys, "page")
    return rows.groupBy(*keys, "page", "row").agg(F.array_sort(F.collect_list(F.struct("left", "text"))).alias("w"))


def joined(words: Column) -> Column:
    return F.trim(F.array_join(F.transform(words, lambda x: x["text"]), " "))


# ---- S6d: number, then name, in two columns, names wrapped over rows


def column_pieces(rows: DataFrame, gap: float, *keys: str) -> DataFrame:
    """Rows split into columns: keys, page, row, column (0 or 1), w.

    A row is split at its first gap over ``gap``. Rows without one belong to the right column if they begin right of the middle
    between the columns' starts, as the rows that were split show them on the same page; without such rows, to the left.
    """
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i < F.size("w")) & (F.get("w", i)["left"] - F.get("w", i - 1)["left"] > gap)))
    page = Window.partitionBy(*keys, "page")
    d = rows.withColumn("_at", at).withColumn("_left", F.get("w", F.lit(0))["left"]).withColumn("_right", F.get("w", F.col("_at"))["left"])
    middle = (F.max(F.when(F.col("_at").isNotNull(), F.col("_left"))).over(page) + F.min("_right").over(page)) / 2
    d = d.withColumn("_middle", middle)
    whole = F.when(F.col("_left") >= F.col("_middle"), 1).otherwise(0)
    part = lambda column, w: F.struct(column.cast("int").alias("column"), w.alias("w"))
    both = F.array(part(F.lit(0), F.slice("w", F.lit(1), F.col("_at"))), part(F.lit(1), F.slice("w", F.col("_at") + 1, F.size("w"))))
    pieces = F.when(F.col("_at").isNotNull(), both).otherwise(F.array(part(whole, F.col("w"))))
    return d.select(*keys, "page", "row", F.explode(pieces).alias("p")).select(*keys, "page", "row", "p.*")


def numbered_index(words: DataFrame, *keys: str, labels: tuple[str, ...] = (), stops: str = "(?!)", gap: float = 80.0, tolerance: float = 3.0, band: float = 3.0) -> DataFrame:
    """S6d: keys, page, column, name, printed of indexes that put the page number before the name, in up to two columns.

    A number counts only where numbers stand: within ``band`` of the most frequent rounded place of first words that are numbers,
    of its column and page, so a name that is a number doesn't begin an entry. A row without such a number continues the
    name of the entry above it in its column. Labels, a number without name and rows that match ``stops`` (legal notes) end an entry;
    titles are passed over. Equal entries of a page and column are one.
    """
    d = column_pieces(visual_rows(words, tolerance, *keys), gap, *keys)
    column = [*keys, "page", "column"]
    d = d.withColumn("text", joined(F.col("w"))).withColumn("first", F.get("w", F.lit(0))["text"]).withColumn("x", F.round(F.get("w", F.lit(0))["left"]).cast("int"))
    d = d.withColumn("rest", joined(F.slice("w", F.lit(2), F.size("w"))))
    numbers = d.where(F.col("first").rlike(NUMBER)).groupBy(*column, "x").agg(F.count("*").alias("c"))
    place = numbers.groupBy(*column).agg(F.min_by("x", F.struct(-F.col("c"), "x")).alias("place"))
    d = d.join(place, column).where((F.col("text") != "") & ~F.exists(F.array(*map(F.lit, TITLES)), lambda t: F.contains(F.lower("text"), t)))
    numbered = F.col("first").rlike(NUMBER) & (F.abs(F.col("x") - F.col("place")) <= band)
    listed = lambda c: F.col(c).isin(*labels) if labels else F.lit(False)
    entry = numbered & (F.col("rest") != "") & ~listed("rest")
    ends = F.col("text").rlike(stops) | (numbered & ~entry) | (~numbered & listed("text"))
    d = d.withColumn("kind", F.when(F.col("text").rlike(stops), "end").when(entry, "entry").when(ends, "end"))
    mark = F.when(F.col("kind").isNotNull(), F.struct("kind", "row"))
    d = d.withColumn("mark", F.last(mark, ignorenulls=True).over(Window.partitionBy(*column).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.where("mark.kind = 'entry'").withColumn("piece", F.when(F.col("kind") == "entry", F.col("rest")).otherwise(F.col("text")))
    names = d.groupBy(*column, F.col("mark.row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("row", "piece"))).alias("p"), F.max(F.when(F.col("kind") == "entry", F.col("first"))).alias("n"))
    return names.select(*column, F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("name"), F.col("n").cast("int").alias("printed")).distinct()


# ---- S6e: list view and card grid


def number_pairs(words: Column) -> Column:
    """The columns of a row made only of ``p.`` and a number, again and again: an array of (left, printed); null for any other row."""
    n = F.size(words)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i % 2 == 0)
    pair = F.transform(starts, lambda i: F.struct(F.get(words, i)["left"].alias("left"), F.get(words, i)["text"].alias("sign"), F.get(words, i + 1)["text"].alias("number")))
    whole = (n % 2 == 0) & F.forall(pair, lambda p: (p["sign"] == "p.") & p["number"].rlike(NUMBER))
    return F.when(whole, F.transform(pair, lambda p: F.struct(p["left"].alias("left"), p["number"].cast("int").alias("printed"))))


def card_entries(rows: DataFrame, slack: float, *keys: str) -> DataFrame:
    """Entries of card grids, from rows with ``pairs``: a row above pairs holds names, each word that of the last column that starts at most ``slack`` right of it; other rows are categories."""
    by = Window.partitionBy(*keys, "page").orderBy("row")
    d = rows.withColumn("next", F.lead("pairs").over(by))
    d = d.withColumn("category", F.when(F.col("pairs").isNull() & F.col("next").isNull(), joined(F.col("w"))))
    d = carried(d, "category", "row", *keys, "page").where("pairs is null and next is not null and category is not null")
    lefts = F.transform("next", lambda p: p["left"])
    cell = lambda p: joined(F.filter("w", lambda x: F.array_max(F.filter(lefts, lambda c: c <= x["left"] + slack)) == p["left"]))
    cells = F.transform("next", lambda p: F.struct(cell(p).alias("name"), p["printed"].alias("printed")))
    return d.select(*keys, "category", F.explode(cells).alias("e")).select(*keys, "category", "e.*").where("name <> ''")


def list_entries(rows: DataFrame, category_to: float, name_from: float, number_from: float, *keys: str) -> DataFrame:
    """Entries of list views: category, name and number stand in three bands of a row; a category holds until the next one of the page."""
    within = lambda lo, hi: F.filter("w", lambda x: (x["left"] >= lo) & (x["left"] < hi))
    low, high = float("-inf"), float("inf")
    d = rows.withColumn("category", F.nullif(joined(within(low, category_to)), F.lit("")))
    d = carried(d, "category", "row", *keys, "page").withColumn("name", joined(within(name_from, number_from)))
    d = d.withColumn("number", F.try_element_at(within(number_from, high), F.lit(-1))["text"])
    d = d.where(F.col("category").isNotNull() & (F.col("name") != "") & F.col("number").rlike(NUMBER))
    return d.select(*keys, "category", "name", F.col("number").cast("int").alias("printed"))


def category_index(words: DataFrame, *keys: str, noise: str = "(?!)", bottom: float = 750.0, category_to: float = 300.0, name_from: float = 400.0, number_from: float = 530.0, tolerance: float = 3.0, slack: float = 2.0) -> DataFrame:
    """S6e: keys, name, printed of indexes with categories, each page by its own layout.

    A page with a row made only of ``p.`` and numbers is a card grid (``card_entries``), any other a list view (``list_entries``). Words below
    ``bottom``, titles and rows that match ``noise`` (footers) are left out before. A name that several categories of a file
    have gets its category in parentheses. Equal entries are one. Entries before the first category of a page are none.
    """
    rows = visual_rows(words.where(F.col("top") <= bottom), tolerance, *keys).withColumn("text", joined(F.col("w")))
    rows = rows.where(~F.lower("text").isin(*TITLES) & ~F.col("text").rlike(noise)).withColumn("pairs", number_pairs(F.col("w")))
    page = Window.partitionBy(*keys, "page")
    rows = rows.withColumn("grid", F.max(F.col("pairs").isNotNull()).over(page))
    found = card_entries(rows.where("grid"), slack, *keys).unionByName(list_entries(rows.where("not grid"), category_to, name_from, number_from, *keys))
    same = Window.partitionBy(*keys, "name")
    found = found.withColumn("several", F.min("category").over(same) != F.max("category").over(same))
    name = F.when(F.col("several"), F.concat("name", F.lit(" ("), "category", F.lit(")"))).otherwise(F.col("name"))
    return found.select(*keys, name.alias("name"), "printed").distinct()
