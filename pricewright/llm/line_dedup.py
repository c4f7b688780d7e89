"""Line dedup: ranks of line sequences by prefix doubling find repeated runs of lines, later copies go. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import bits_for, running_sum
from .tables import BROADCAST_IDS, SPACE, named, unused, written

#: Words that a repeated run of lines has at least.
MIN_WORDS = 20
#: Hashed before a line for its second hash: each argument is hashed with the hash of those before it as seed, so a line after it isn't a function of its first hash.
SECOND = "second"
#: Distinct pairs of ranks, counted, whose running sums are windows in one task (2 MB, no shuffle); with more, sums go by buckets, so that no rank is one task's.
FEW_KINDS = 50_000


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, digest and ``lines`` of each document: for each line with a word its number, two 64-bit hashes and the lines of the least window of ``least`` words from it on (ahead) and up to it (back), null if none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, SPACE.replace("\n", ""), " " * (len(SPACE) - 1))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.split(plain, "\n").alias("l"))
    lines = F.transform("l", lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))
    lines = F.transform(F.filter(lines, lambda x: x["x"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["x"]).alias("h"), F.xxhash64(F.lit(SECOND), x["x"]).alias("h2"), F.size(F.array_remove(F.split(x["x"], " "), "")).alias("w")))
    d = d.select("doc_id", "digest", lines.alias("l")).where(F.size("l") > 0).select("doc_id", "digest", "l", F.transform("l", lambda x: x["w"]).alias("w"))
    d = d.withColumn("r", F.reverse("w"))

    def window(words, i):
        start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["s"] >= least, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")))
        return F.aggregate(F.slice(words, i + 1, F.lit(least)), start, step, lambda a: F.when(a["s"] >= least, a["n"]))

    lengths = lambda c: F.transform(c, lambda x, i: F.when(x >= least, F.lit(1)).otherwise(window(F.col(c), i)))
    d = d.select("doc_id", "digest", "l", lengths("w").alias("a"), F.reverse(lengths("r")).alias("b"))
    joined = F.transform(F.arrays_zip("l", "a", "b"), lambda x: F.struct(x["l"]["i"].alias("i"), x["l"]["h"].alias("h"), x["l"]["h2"].alias("h2"), x["a"].alias("ahead"), x["b"].alias("back")))
    return d.select("doc_id", "digest", joined.alias("lines"))


def placed(lines: DataFrame) -> tuple[DataFrame, int]:
    """Numbers documents by id, equal rows once: adds ``place``, and the bits that its lines take below it.

    Rows are dealt by ranges of (id, digest), so an id of many rows is spread too; numbers grow with the id.
    """
    d = lines.dropDuplicates(["doc_id", "digest"])
    parts = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("uid", F.monotonically_increasing_id())
    d = written(d, "lines")
    row = F.col("uid").bitwiseAND((1 << 33) - 1)
    most = d.agg(F.max(F.shiftright("uid", 33)), F.max(row), F.max(F.size("lines"))).first()
    bits = [((x or 0) + 1).bit_length() for x in most]
    if sum(bits) > 62:
        raise ValueError("documents and lines need more than 62 bits")
    return d.withColumn("place", F.shiftleft(F.shiftright("uid", 33), bits[1]) + row), bits[2]


def ranked_lines(at: DataFrame) -> DataFrame:
    """(p, r) of the lines that occur twice or more: r is the place of the line among sorted lines."""
    kinds = written(at.groupBy("h", "h2").agg(F.count("*").alias("c")).where("c > 1").withColumn("o", F.shiftrightunsigned("h", 1)), "kinds")
    kinds = written(running_sum(kinds, [], "o", "c", "r", 63, bits_for(kinds.count()), ["h", "h2"]).select("h", "h2", "r"), "ranks")
    return written(at.join(kinds, ["h", "h2"]).select("p", "r"), "suffixes")


def doubled(ranks: DataFrame, width: int, total: int) -> DataFrame:
    """(p, r) by twice the prefix, from ranks by a prefix of ``width`` lines: those whose doubled prefix occurs twice or more.

    The new rank is the old one and the number of suffixes of the same old rank with a smaller second half,
    summed over the distinct pairs of ranks.
    """
    second = ranks.select((F.col("p") - width).alias("p"), F.col("r").alias("s"))
    pairs = written(ranks.join(second, "p"), "pairs")
    kinds = written(pairs.groupBy("r", "s").agg(F.count("*").alias("c")).where("c > 1"), "kinds")
    known, bits = kinds.count(), max(1, total.bit_length())
    if known <= FEW_KINDS:
        earlier = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        kinds = kinds.coalesce(1).withColumn("n", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    else:
        kinds = running_sum(kinds, ["r"], "s", "c", "n", bits, min(bits, bits_for(known)))
    kinds = kinds.select("r", "s", (F.col("r") + F.col("n")).alias("t"))
    return written(pairs.join(kinds, ["r", "s"]).select("p", F.col("t").alias("r")), "suffixes")


def repeated_windows(docs: DataFrame, least: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """(p, n, first): windows of n lines from place p whose first copy, at place ``first``, ends before p; the placed documents; the bits of a line number.

    A run of ``least`` words or more is repeated exactly if its windows that just reach ``least`` words, from each
    line ahead and back, are; whether a window just reaches them depends on its content only. So all copies of a
    window are compared, in classes of (length, rank of its first 2**k lines, rank of its last 2**k lines): the
    intervals of suffixes whose common prefix has this length.
    """
    d, bits = placed(line_table(docs, least))
    at = d.select(F.shiftleft("place", bits).alias("base"), F.posexplode("lines").alias("j", "x")).select((F.col("base") + F.col("j")).alias("p"), "x.h", "x.h2", "x.ahead", "x.back")
    levels = [ranked_lines(at)]
    ahead = at.where("ahead is not null").select("p", F.col("ahead").alias("n"))
    back = at.where("back > 1").select((F.col("p") - F.col("back") + 1).alias("p"), F.col("back").alias("n"))
    # only windows from repeated lines on can be repeated
    windows = written(ahead.unionByName(back).join(levels[0].select("p"), "p", "left_semi").distinct(), "windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    total = levels[0].count()
    while 2 ** len(levels) <= longest:
        levels.append(doubled(levels[-1], 2 ** (len(levels) - 1), total))
    classes = None
    for k, ranks in enumerate(levels):
        w = windows.where((F.col("n") >= 2**k) & (F.col("n") < 2 ** (k + 1))).join(ranks.withColumnRenamed("r", "head"), "p")
        if k:
            w = w.withColumn("q", F.col("p") + F.col("n") - 2**k).join(ranks.select(F.col("p").alias("q"), F.col("r").alias("tail")), "q")
        w = w.select("p", "n", "head", F.col("tail") if k else F.col("head").alias("tail"))
        classes = w if classes is None else classes.unionByName(w)
    classes = written(classes, "classes")
    first = written(classes.groupBy("n", "head", "tail").agg(F.min("p").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "first")
    return classes.join(first, ["n", "head", "tail"]).where("p >= first + n").select("p", "n", "first"), d, bits


def deletions(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, gone): the numbers, in order, of the lines that go from each document that loses any."""
    windows, d, bits = repeated_windows(docs, least)
    lines = windows.select(F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("p")).distinct()
    lines = lines.groupBy(F.shiftright("p", bits).alias("place")).agg(F.collect_list(F.col("p").bitwiseAND((1 << bits) - 1).cast("int")).alias("j"))
    return d.join(lines, "place").select("doc_id", "digest", F.array_sort(F.transform("j", lambda j: F.get("lines", j)["i"])).alias("gone"))


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, from_line, to_line of each maximal run of lines that goes: consecutive lines with a word, by number."""
    gone = deletions(docs, least).select("doc_id", "digest", F.posexplode("gone").alias("j", "i"))
    runs = gone.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("i")))
    return runs.groupBy("doc_id", "digest", "island").agg(F.min("i").alias("from_line"), F.max("i").alias("to_line")).drop("digest", "island")


def without_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the columns they have, ``text`` without the lines of later copies of repeated runs, and n_lines, n_gone.

    Runs are of lines with a word (white space at the ends doesn't count), have ``least`` words at least, and stay
    within a document; lines without a word in between stay. A run is a later copy if an equal one ends before it, in
    its document or in one of a smaller id; copies that overlap the first one aren't, so of eight equal lines whose
    first four make a run four stay. A document may lose all its text and stays as an empty one.

    Only hashes of lines move, a row each and only those that repeat; ranks and classes are made by counts of
    distinct values, so a line of any frequency is split between tasks. The numbers of lines that go return to the
    texts by broadcast if few rows were counted, else by a join. Lines are equal if both their 64-bit hashes are.

    Null texts stay null, with no lines; empty ones stay. Very long texts have their lines in rows of their own.
    Equal rows of one id count as one document and stay as they are in number; null ids stand first. Empty table:
    no rows. Other columns pass; n_lines and n_gone replace columns of these names.
    """
    gone = written(deletions(docs, least), "gone")
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    few = 4 * rows <= BROADCAST_IDS and numbers <= 4 * BROADCAST_IDS
    names = [c for c in docs.columns if c not in ("n_lines", "n_gone")]
    i, x, l, d, g, out = unused(docs, "id", "digest", "lines", "gone_id", "gone_digest", "gone")
    gone = gone.select(F.col("doc_id").alias(d), F.col("digest").alias(g), F.col("gone").alias(out))
    text = F.col("text")
    rows = docs.select(*map(named, names), F.col("doc_id").cast("long").alias(i), F.xxhash64(F.coalesce(text, F.lit(""))).alias(x))
    rows = rows.join(F.broadcast(gone) if few else gone, F.col(i).eqNullSafe(F.col(d)) & (F.col(x) == F.col(g)), "left")
    lines = F.split(text, "\n")
    ends = F.concat(F.array(F.lit(-1)), out, F.array(F.size(lines)))
    parts = F.zip_with(F.slice(ends, 1, F.size(out) + 1), F.slice(ends, 2, F.size(out) + 1), lambda a, b: F.slice(l, a + 2, b - a - 1))
    left = F.when(F.col(out).isNotNull(), F.array_join(F.flatten(parts), "\n")).otherwise(text)
    count = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    columns = [left.alias("text") if c == "text" else named(c) for c in names]
    return rows.withColumn(l, lines).select(*columns, count(l).alias("n_lines"), count(out).alias("n_gone"))


DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, text, unnest(range(len(l))) AS i, unnest(l) AS raw FROM d),
y AS (SELECT doc_id, i, trim(translate(raw, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS s FROM x),
z AS (SELECT *, len(list_filter(string_split(s, ' '), lambda q: q <> '')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM y WHERE s <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY j) AS cw FROM z),
f AS (SELECT a.doc_id, a.j AS a, min(b.j) AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.cw - a.cw + a.w >= {MIN_WORDS} GROUP BY 1, 2
  UNION SELECT a.doc_id, max(b.j), a.j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j <= a.j AND a.cw - b.cw + b.w >= {MIN_WORDS} GROUP BY a.doc_id, a.j),
k AS (SELECT f.doc_id, a, b, string_agg(s, chr(10) ORDER BY j) AS run FROM f JOIN c ON c.doc_id = f.doc_id AND j BETWEEN a AND b GROUP BY 1, 2, 3),
e AS (SELECT run, min_by(doc_id, (doc_id, a)) AS first_doc, min_by(b, (doc_id, a)) AS first_end FROM k GROUP BY run),
g AS (SELECT DISTINCT k.doc_id, c.i FROM k JOIN e USING (run) JOIN c ON c.doc_id = k.doc_id AND j BETWEEN a AND b WHERE k.doc_id <> first_doc OR a > first_end)
SELECT x.doc_id, CASE WHEN any_value(text) IS NULL THEN 0 ELSE count(*) END AS n_lines, count(g.i) AS n_gone, md5(coalesce(string_agg(raw, chr(10) ORDER BY x.i) FILTER (g.i IS NULL), '')) AS text_md5
FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id
"""
