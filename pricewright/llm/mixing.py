"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import bits_for, running_sum
from .tables import BROADCAST_IDS, named, unused, words_of, written

#: Sources broadcast at most; with more, their joins are shuffled.
BROADCAST_SOURCES = 20_000
#: Cells of [0, 1) in which points look up their source.
CELLS = 4096
#: 2**32 divided by the golden ratio.
GOLDEN = 2_654_435_769


def digest() -> Column:
    """Column: what tells apart rows of one id; a null is none of the other values."""
    return F.xxhash64(F.col("text").isNull(), "text", F.col("source").isNull(), "source")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest: words ``[^\\x20\\x09-\\x0D]+`` of each text; the digest tells apart rows of one id."""
    size = F.size(words_of(F.col("text"))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), digest().alias("digest"))


def source_targets(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row for each source: key, source, source_size, target.

    Sources stand by code point, null last, and weigh ``weights`` in turn. Together they get ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size and the excess is shared again by weight.
    The level at which no target is above its stop is found by sorting stops per weight: below the level sources
    are full, above it they get level times weight. The windows are over sources, one row each, in one task: some
    millions of sources at most, of any number of rows.
    """
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("key")
    src = rows.groupBy(key).agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
    src = src.withColumn("stop", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("stop") / F.col("weight"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "key")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    full, heavy = (F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in ("stop", "weight"))
    src = src.withColumn("level", (total - full) / (F.sum("weight").over(everything) - heavy))
    src = src.withColumn("open", F.when(F.col("ratio") > F.col("level"), F.col("ratio")))
    level = F.min_by("level", "open").over(everything)
    return src.select("key", "source", "source_size", F.least("stop", F.coalesce(F.col("weight") * level, "stop")).alias("target"))


def boundaries(sources: DataFrame, block_words: int) -> DataFrame:
    """Adds the blocks of each source (``blocks`` of ``small`` or, the first ``extra``, small + 1 words) and the ``slots`` that its target takes."""
    blocks = F.when(F.col("source_size") > 0, F.ceil(F.col("source_size") / F.lit(block_words))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("blocks", blocks).withColumn("words", F.round("target").cast("long"))
    sources = sources.withColumn("small", F.expr("case when blocks > 0 then source_size div blocks end")).withColumn("extra", F.expr("case when blocks > 0 then source_size % blocks end"))
    sources = sources.withColumn("epochs", F.expr("case when blocks > 0 then words div source_size else 0 end")).withColumn("rest", F.expr("case when blocks > 0 then words % source_size else 0 end"))
    begun = F.when(F.col("rest") > 0, block_of(F.col("rest") - 1) + 1).otherwise(F.lit(0))
    return sources.withColumn("slots", F.col("epochs") * F.col("blocks") + begun)


def block_of(word):
    """Column: the block in which a word of its source stands."""
    large = F.col("extra") * (F.col("small") + 1)
    return F.when(word < large, (word / (F.col("small") + 1)).cast("long")).otherwise(F.col("extra") + ((word - large) / F.greatest("small", F.lit(1))).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """slot, key, epoch, block: which block of which source each slot of the mix takes.

    Slot i looks at the point i times the golden ratio modulo 1 and takes the source in whose share of [0, 1) it
    falls; the rank of the slot among its source's gives the block. A source's count stays within a few slots of
    its share at every place. Slots beyond a source's need are left out and the few missing follow at the end.
    """
    spark = sources.sparkSession
    known = sources.agg(F.sum("slots"), F.count("*")).first()
    slots, n = known[0] or 0, known[1]
    small = F.broadcast if n <= BROADCAST_SOURCES else lambda df: df
    shares = sources.where("slots > 0").select("key", "slots", "blocks")
    up_to = F.sum("slots").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    shares = shares.withColumn("hi", up_to).withColumn("lo", F.col("hi") - F.col("slots"))
    unit = F.lit(float(max(slots, 1)))
    cells = shares.select("key", (F.col("lo") / unit).alias("lo"), (F.col("hi") / unit).alias("hi"))
    cells = cells.select("key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    i = F.pmod("slot", F.lit(1 << 32))
    high, low = F.shiftright(i, 16), i.bitwiseAND(0xFFFF)
    product = F.pmod(F.pmod(high * GOLDEN, F.lit(1 << 16)) * (1 << 16) + low * GOLDEN, F.lit(1 << 32))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", product / F.lit(float(1 << 32)))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(small(cells), "cell").where("u >= lo and u < hi").select("slot", "key", F.lit(1).alias("one"))
    width = max(1, slots.bit_length())
    ranked = running_sum(hit, ["key"], "slot", "one", "rank", width, min(width, bits_for(slots)))
    counts = hit.groupBy("key").agg(F.count("*").alias("got"))
    short = shares.join(small(counts), "key", "left").where("slots > coalesce(got, 0)")
    late = short.select("key", "blocks", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    late = late.select((F.lit(slots) + F.col("rank")).alias("slot"), "key", "rank", "blocks")
    taken = ranked.join(small(shares.select("key", "blocks", "slots")), "key").where("rank < slots").select("slot", "key", "rank", "blocks")
    return taken.unionByName(late).select("slot", "key", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"))


def mix_plan(rows: DataFrame, sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """The mix, one row for each piece of a document in a slot: slot, epoch, block, row, doc_id, digest, source, size, at, from_word, to_word.

    Documents of a source stand shuffled by a hash of their id and the seed, one after the other (``at``); blocks
    cut this row of words evenly. Words from_word up to to_word of the document come at that slot. Documents from
    which no words are taken have one row without slot.
    """
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda df: df
    known = written(boundaries(sources, block_words), "sources")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = rows.withColumn("key", key).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 2))
    placed = running_sum(rows, ["key"], "h", "size", "at", 62, bits_for(rows.count()), ties=["doc_id", "digest"])
    placed = placed.drop("h").join(small(known.drop("source", "source_size", "words", "slots")), "key")
    ends = F.when(F.col("size") > 0, F.sequence(block_of(F.col("at")), block_of(F.col("at") + F.col("size") - 1)))
    pieces = placed.select("*", F.explode_outer(ends).alias("block"))
    start = F.col("block") * F.col("small") + F.least("block", "extra")
    end = start + F.col("small") + F.when(F.col("block") < F.col("extra"), 1).otherwise(0)
    slots = schedule(known)
    pieces = pieces.withColumn("first", F.greatest(start, "at") - F.col("at")).withColumn("last", F.least(end, F.col("at") + F.col("size")) - F.col("at"))
    joined = pieces.join(slots, ["key", "block"], "left")
    stops = F.when(F.col("epoch") < F.col("epochs"), F.col("last")).otherwise(F.least("last", F.col("rest") - F.col("at")))
    joined = joined.withColumn("to_word", F.greatest(stops, "first"))
    joined = joined.select("slot", "epoch", "block", "row", "doc_id", "digest", "source", "key", "size", "at", F.col("first").alias("from_word"), "to_word")
    return written(joined, "pieces")


def planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The mix's pieces, staged, and the sources: see ``mix_plan`` and ``source_targets``."""
    rows = written(sized(docs).withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = written(source_targets(rows, weights, share, most), "targets")
    plan = mix_plan(rows, sources, block_words, seed)
    words = F.when(F.col("slot").isNotNull(), F.col("to_word") - F.col("from_word")).otherwise(F.lit(0)).cast("long")
    return plan.withColumn("words", words), sources


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_words: int = 8192, seed: int = 17) -> DataFrame:
    """What the mix takes of each document: doc_id, digest, source, size, source_size, target, taken (words), first_slot, n_slots.

    The schedule deals blocks to slots, and words come at the slots of their blocks: ``n_slots`` slots take words of the
    document, the first of them is ``first_slot`` (null if none does). In every beginning of the mix each source's share
    is within a few blocks of its share of the whole. Only (id, source, size) move; a hot source is spread by hash
    buckets and its blocks are keys of their own. Targets are met to the word. ``taken`` is at most ``most`` (a whole
    number) times the size.

    Null and empty texts have size 0 and nothing is taken of them. Null sources are one source, the last. Very
    long documents span several blocks. Repeated rows are documents of their own, also those without words; null
    ids stand together. An empty table gives no rows. Other columns are ignored.
    """
    plan, sources = planned(docs, weights, share, most, block_words, seed)
    dealt = F.when(F.col("words") > 0, F.col("slot"))
    sums = plan.groupBy("row", "doc_id", "digest", "key", "source", "size").agg(F.sum("words").alias("taken"), F.min(dealt).alias("first_slot"), F.count(dealt).alias("n_slots"))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    known = sources.select("key", "source_size", "target")
    joined = sums.join(F.broadcast(known) if few else known, "key")
    return joined.select("doc_id", "digest", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def copies(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_words: int = 8192, seed: int = 17) -> DataFrame:
    """Every time that the mix takes a document: doc_id, digest, copy, many, size, slot, at, words.

    In each epoch of its source a document begins at the slot that took the block of its first word; ``at`` tells its
    place there. ``words`` is its size, or less where a target ends in it. ``copy`` numbers rows of one id, text and
    source from 0, ``many`` is their number.
    """
    plan, _ = planned(docs, weights, share, most, block_words, seed)
    taken = plan.where("words > 0").groupBy("row", "doc_id", "digest", "size", "at", "epoch").agg(F.min_by("slot", "from_word").alias("slot"), F.sum("words").alias("words"))
    equal = Window.partitionBy("doc_id", "digest")
    rows = plan.where("size > 0").select("row", "doc_id", "digest").distinct()
    rows = rows.select("row", (F.row_number().over(equal.orderBy("row")) - 1).alias("copy"), F.count("*").over(equal).alias("many"))
    return taken.join(rows, "row").select("doc_id", "digest", "copy", "many", "size", "slot", "at", "words")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the order of the mix, same columns: a row for every time a document is taken (``copies``), by slots.

    A document stands whole at the slot that takes its first word; where a source's target ends, one document is
    taken in part, its first words, joined by spaces. An ``n_chars`` column counts anew. Documents of which nothing is
    taken, those without words among them, go. Partitions hold consecutive slots, so a table that is written has
    the mix's order from file to file: any beginning of it holds the sources by their weights.

    Equal rows of one id are numbered, and each stands at its own places: these few rows are shuffled by id, the others
    are not. Places meet the texts by broadcast if they were counted and are few, else by a join. Texts are shuffled
    once, to their slots.
    """
    i, x, j, d, g, c, n, w, t, a, m = unused(docs, "id", "row_digest", "row_copy", "taken_id", "taken_digest", "copy", "size", "words", "slot", "at", "many")
    names = zip(("doc_id", "digest", "copy", "many", "size", "slot", "at", "words"), (d, g, c, m, n, t, a, w))
    taken = written(copies(docs, **how).select(*(F.col(old).alias(new) for old, new in names)), "taken")
    last, rows = taken.agg(F.max(t), F.count("*")).first()
    few = F.broadcast if rows <= BROADCAST_IDS else lambda df: df
    keyed = docs.withColumn(i, F.col("doc_id").cast("long")).withColumn(x, digest())
    same = F.col(i).eqNullSafe(F.col(d)) & (F.col(x) == F.col(g))
    found = keyed.join(few(taken.where(F.col(m) == 1)), same).withColumn(j, F.lit(0))
    again = taken.where(F.col(m) > 1)
    if not again.isEmpty():
        ids = again.select(F.col(d).alias(d), F.col(g).alias(g)).distinct()
        equal = keyed.join(few(ids), same, "left_semi")
        equal = equal.withColumn(j, F.row_number().over(Window.partitionBy(i, x).orderBy(*(F.to_json(F.struct(named(col))) for col in docs.columns))) - 1)
        found = found.unionByName(equal.join(few(again), same & (F.col(j) == F.col(c))))
    first_words = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col(w).cast("int")), " ")
    found = found.withColumn("text", F.when(F.col(w) < F.col(n), first_words).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.floor(F.col(t) * parts / F.lit((last or 0) + 1)).cast("int")
    return found.repartitionById(parts, to).sortWithinPartitions(t, a, d, c).select(*map(named, docs.columns))
