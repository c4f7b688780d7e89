"""N-gram Jaccard join: a blocked sparse product of documents by n-grams with bounds from set sizes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import emptied, named, small_batches, sole, unused, with_ids, written

#: Word hashes kept in a worker at most; the cache is emptied when full.
CACHE = 100_000
#: Counters of the n-gram frequency sketch: a fixed 16 MB whatever the corpus; they only order n-grams, results don't depend on them.
SKETCH_BITS, SKETCH_BLOCK = 24, 32768
#: Shingles that are passed on at once, more only where one document has more.
PASSED = 200_000
#: Rows of a column that are paired at once at most; columns of more go by pivots.
SHORT = 8


class Words(dict):
    """Signed 64-bit hashes of the words that a worker has seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


_words = Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased; fewer words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    ids = np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=n).view(np.uint64)
    width = min(n, k)
    acc = np.full(n - width + 1, 0x2545F4914F6CDD1D + width, dtype=np.uint64)
    for j in range(width):
        acc = (acc ^ ids[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    acc = acc * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def least_overlap(n, num: int, den: int):
    """The least overlap with any set that a set of n elements can link to: num / den of n, rounded up."""
    return -(-num * n // den)


def _sets(batches, k: int):
    sole(_words)
    for batch in batches:
        at, sets, n = 0, [], 0
        for i, text in enumerate(batch.column(1)):
            sets.append(shingles(text.as_py(), k))
            n += len(sets[-1])
            if n > PASSED or i + 1 == batch.num_rows:
                yield batch.column(0).slice(at, len(sets)), sets
                at, sets, n = i + 1, [], 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.uint64, copy=False).view(np.int64), pa.int64()))


def _class(a: np.ndarray) -> bytes:
    return hashlib.blake2b(a.tobytes(), digest_size=16).digest() if len(a) else b""


def digests(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, class) of each document, and counter blocks (block, counts) of the n-gram frequency sketch of each task."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)
        for ids, sets in _sets(batches, k):
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_class, sets), pa.binary()), none, pa.nulls(len(sets), pa.binary())], names=["doc_id", "n", "class", "block", "counts"])
            if sets and len(flat := np.concatenate(sets)):
                at, more = np.unique(flat >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                counts[at] = np.minimum(counts[at] + more, 65535)
        blocks = [i for i in range(0, len(counts), SKETCH_BLOCK) if counts[i : i + SKETCH_BLOCK].any()]
        packed = [zlib.compress(counts[i : i + SKETCH_BLOCK].tobytes(), 1) for i in blocks]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(blocks), pa.binary()), pa.array([i // SKETCH_BLOCK for i in blocks], pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "n", "class", "block", "counts"])

    return docs.mapInArrow(emptied(run), "doc_id long, n long, class binary, block int, counts binary")


def rough(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each: exact below 32, then eight steps for each doubling, up to 2**32."""
    steps = np.floor(8 * np.log2(np.maximum(counts, 32) / 32))
    return np.where(counts < 32, counts, 32 + steps).astype(np.uint8)


def frequency_sketch(found: DataFrame) -> np.ndarray:
    """The summed counters, in a byte each; tasks add up the blocks of all others as they come. The driver gets 16 MB at most."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(packed), dtype=np.uint16)
                if block not in sums:
                    sums[block] = np.zeros(SKETCH_BLOCK, dtype=np.int64)
                sums[block] += more
        packed = [zlib.compress(rough(v).tobytes(), 1) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    blocks = found.where("block is not null").select("block", "counts").repartition("block").mapInArrow(run, "block int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in blocks.collect():
        out[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint8)
    return out


def prefixes(docs: DataFrame, shared: Broadcast, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, class, n, tokens): the rarest n-grams of each set, in the order of (sketched frequency, hash); the sketch comes as a broadcast.

    Two sets that link have overlap of at least num / den of either, so among the n - overlap + 1 rarest of
    each there is a common one.
    """

    def run(batches):
        counts = shared.value
        for ids, sets in _sets(batches, k):
            tokens = []
            for s in sets:
                n = len(s)
                keys = (counts[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(48)) | (s & np.uint64((1 << 48) - 1))
                p = n - least_overlap(n, num, den) + 1 if n else 0
                tokens.append(np.sort(np.partition(keys, p - 1)[:p]) if p else keys)
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(_class, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(tokens)], names=["doc_id", "class", "n", "tokens"])

    return docs.mapInArrow(emptied(run), "doc_id long, class binary, n long, tokens array<long>")


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(id, grams): the whole set of each document."""

    def run(batches):
        for ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([ids, _lists(sets)], names=["id", "grams"])

    return docs.mapInArrow(emptied(run), "id long, grams array<long>")


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets have den * overlap >= num * union: the overlap is counted over the whole sets."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    sets = written(set_table(with_ids(docs, ids, "doc_id", "left_semi").select("doc_id", "text"), k), "sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return both.withColumn("o", overlap).where(F.col("o") * den >= (F.size("ga") + F.size("gb") - F.col("o")) * num).select("a", "b")


def reach(n: str, at: str, num: int, den: int):
    """Column: the largest set that a set of ``n`` can link to, if the first n-gram that both have is the one at place ``at``."""
    return F.expr(f"({n} - {at}) * {num + den}L div {num} - {n}")


def within_bounds(n1: str, at1: str, n2: str, at2: str, num: int, den: int):
    """Column: sizes and the places of the common n-gram leave room for the overlap that a link needs, num / (num + den) of both sizes."""
    return (F.col(n2) <= reach(n1, at1, num, den)) & (F.col(n1) <= reach(n2, at2, num, den))


def band(n: str):
    """Column: sizes in bands, exact below 128, then 64 to each doubling."""
    n = F.expr(n)
    return F.when(n < 128, n).otherwise(F.floor(F.log2(n) * 64) - 320).cast("int")


def between_groups(cells: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of rows of different groups ``g`` that share a column and are within the bounds, from open ``cells`` (token, id, n, at, g, most).

    Rows meet in keys of a column and a band of sizes: the smaller of two stands in all bands that its bound reaches,
    the larger in its own. So where a passage that many texts share is too small a part of them, as places tell, no
    two of them meet. Rows of the largest group ``most`` meet others only.
    """
    cells = written(cells.withColumn("r", reach("n", "at", num, den)).drop("at"), "open")
    ask = cells.where("r >= n").withColumn("band", F.explode(F.sequence(band("n"), band("r"))))
    told = cells.select("token", band("n").alias("band"), *(F.col(c).alias(f"{c}2") for c in ("id", "n", "r", "g", "most")))
    meet = lambda x, y: x.join(y, ["token", "band"]).where("g <> g2 and n2 <= r and n <= r2 and (n < n2 or n = n2 and id < id2)")
    both = meet(ask.where("g <> most"), told).unionByName(meet(ask.where("g = most"), told.where("g2 <> most2")))
    return both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def similar_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of documents linked by num / den Jaccard similarity of k-word shingle sets: doc_id, n_shingles, component_id.

    1. Documents of equal sets form a class, named by its smallest id; only these go on.
    2. Of the incidence matrix (class by n-gram) the columns that size bounds allow are kept: the rarest n-grams of
       each row. The product of the matrix with itself runs column by column: rows of short columns are all paired;
       in longer ones the row with the fewest rarer n-grams is the pivot, every other row is paired with it. Pairs below the size or place bounds are discarded, the
       overlap of the others is counted over whole rows. This costs a few pairs for each kept cell, however large a column.
    3. Links make components. Long columns whose rows are in several components then pair the rows outside the largest
       one with the rows of other components that the bounds allow (``between_groups``). Pairs within a component are
       never needed, so all links between different components are found, exactly.

    Texts without words, null or empty, have no shingles and are groups of their own. Very long texts are whole
    sets. Rows of the same id count as one document; rows with null ids join a class, but a class of null ids links
    with nothing. An empty table gives no rows. Other columns are ignored.
    """
    return grouped(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, class, component of each document as above; the component is null where nothing of the class has an id."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(digests(docs, k), "digests")
    known = found.where("block is null").select("doc_id", "n", "class")
    classes = written(known.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(found))
    rows = prefixes(docs, sketch, k, num, den).where("n > 0")
    rows = rows.join(classes, (rows["class"] == classes["class"]) & (rows.doc_id == classes.rep), "left_semi").select(F.col("doc_id").alias("id"), "n", "tokens")
    rows = written(rows, "prefixes")
    sketch.destroy()
    cells = rows.select("id", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("at", "token"))
    place = F.shiftleft(F.col("at").cast("long"), 44) + F.xxhash64("id").bitwiseAND((1 << 44) - 1)
    shared = written(cells.groupBy("token").agg(F.count("*").alias("c"), F.min(place).alias("po")).where("c > 1"), "shared")
    cells = written(cells.join(shared, "token"), "cells")
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    short = cells.where(F.col("c") <= SHORT).groupBy("token").agg(F.collect_list(F.struct("id", "n", "at")).alias("l"))
    short = short.select("l", F.posexplode("l").alias("i", "x")).select("x.*", F.explode(F.slice("l", F.col("i") + 2, SHORT)).alias("y")).select("id", "n", "at", *(F.col(f"y.{c}").alias(f"p{c}") for c in ("id", "n", "at")))
    cells = cells.where(F.col("c") > SHORT)
    pivots = written(cells.where(place == F.col("po")).groupBy("token").agg(F.min("id").alias("pid"), F.first("n").alias("pn"), F.first("at").alias("pat")), "pivots")
    cells = cells.select("token", "id", "n", "at")
    starred = cells.join(pivots, "token").select("id", "n", "at", "pid", "pn", "pat")
    pairs = short.unionByName(starred).where("id <> pid").where(within_bounds("n", "at", "pn", "pat", num, den)).select(*pair("id", "pid")).distinct()
    links = written(verified(docs, written(pairs, "pairs"), k, num, den), "verified")
    groups = written(connected_components(links), "groups")

    cells = cells.join(groups, "id", "left").select("token", "id", "n", "at", F.coalesce("component", "id").alias("g"))
    cells = written(cells, "cells")
    split = cells.groupBy("token", "g").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("g", "c").alias("most"), F.count("*").alias("groups"))
    split = written(split.where("groups > 1").select("token", "most"), "split")
    rest = written(between_groups(cells.join(split, "token"), num, den), "pairs")
    if not rest.isEmpty():
        more = written(verified(docs, rest, k, num, den), "verified")
        known_links = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        groups = written(connected_components(known_links.unionByName(more)), "groups")

    named = written(classes.join(groups, classes.rep == groups.id, "left").select("class", F.coalesce("component", "rep").alias("component")), "named")
    return known.join(named, "class", "left").select("doc_id", "n", "class", "component")


def without_similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id.

    Rows of one id and one class are one document, of which a row stays (of the smallest text hash). A row without id
    goes where its class is in a group of ids; of a class without ids one row stays. Documents without words stay,
    once for each id, and each of those without id.
    """
    found = written(grouped(docs, k, num, den), "grouped")
    gone = written(found.where("doc_id <> component").select("doc_id").distinct(), "gone")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null")
    several = written(ids.select("doc_id"), "several")  # ids of several rows; null if there are rows without
    columns = [named(c) for c in docs.columns]
    if several.isEmpty():
        return with_ids(docs, gone, "doc_id", "left_anti").select(*columns)
    several_ids, known = several.where("doc_id is not null"), F.col("doc_id").cast("long").isNotNull()
    once = with_ids(docs.where(known), gone.unionByName(several_ids).distinct(), "doc_id", "left_anti").select(*columns)
    rest = with_ids(docs.where(known), several_ids, "doc_id", "left_semi").select(*columns).unionByName(docs.where(~known))
    (row,) = unused(docs, "row")
    rest = written(rest.withColumn(row, F.monotonically_increasing_id()), "rest")
    rows = digests(small_batches(rest).select(F.col(row).alias("doc_id"), "text"), k).where("block is null").select(F.col("doc_id").alias(row), "n", "class")
    rows = rest.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("x")).join(rows, row)
    alone = F.when((F.col("n") == 0) & F.col("id").isNull(), F.col(row))
    rows = rows.groupBy("id", "class", "n", alone.alias("alone")).agg(F.min(F.struct("x", row))[row].alias(row))
    groups = found.where("component is not null").groupBy("class").agg(F.min("component").alias("component"))
    rows = rows.join(groups, "class", "left").where("n = 0 or id = component or id is null and component is null")
    return once.unionByName(rest.join(written(rows.select(row), "kept"), row, "left_semi").select(*columns))


GROUPS_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(id, x) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a),
m AS (SELECT id, min(x) AS c FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM s JOIN m ON id = doc_id
"""
