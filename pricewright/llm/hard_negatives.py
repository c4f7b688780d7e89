"""Hard negatives by bit-sliced integer products: planes of bits, most significant first, tighten the interval of every score."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import ship_package, written

#: Components of a block of rows and of a block of anchors at most; anchors that meet a block at once.
ROWS, ANCHORS, AT_ONCE = 1 << 20, 1 << 18, 64
#: Pairs of a block left, one in so many at most, from which on each anchor goes on with its own rows.
SPARSE = 16
#: The ends of a long; scores beyond count as these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def taking_part(vectors: DataFrame, every: int) -> DataFrame:
    """row, vec_id, label, n, embedding, anchor of the rows with id, label and a vector of finite components; ``row`` tells apart rows of one id."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    return v.select(F.monotonically_increasing_id().alias("row"), "*", F.size("embedding").alias("n"), (F.col("vec_id") % every == 0).alias("anchor"))


def integers(column, scale: int) -> np.ndarray:
    """floor(scale * component) of each vector, exactly: 64-bit integers, or Python's own where these are too small."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten()).astype(np.float64)
    if not len(x) or np.abs(x).max() < (1 << 52) / scale:
        return np.floor(x * scale).astype(np.int64).reshape(len(column), -1 if len(x) else 0)
    whole = [math.floor(c * scale) if abs(c) < 1e300 else int(c) * scale for c in x.tolist()]
    return np.array(whole, dtype=object).reshape(len(column), -1)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


class Planes:
    """The bits of a block of integer vectors (two's complement): plane ``top`` is the sign, worth -2**top, plane j is worth 2**j."""

    def __init__(self, x: np.ndarray):
        self.rows = len(x)
        self.top = max(int(x.max()), -int(x.min()) - 1).bit_length() if x.size else 0
        self.bits = [((x >> j) & 1).astype(np.uint8) for j in range(self.top)] + [(x < 0).astype(np.uint8)]

    def product(self, a: np.ndarray, j: int, at=slice(None)) -> np.ndarray:
        """Integer products of anchors with plane j; a sum of components, which floats of enough digits hold exactly."""
        kind = np.float32 if np.abs(a).sum(axis=-1).max(initial=0) < 1 << 24 else np.float64
        out = (a.astype(kind) @ self.bits[j][at].T.astype(kind)).astype(np.int64)
        return out * (-(1 << j) if j == self.top else 1 << j)


def sieve(a: np.ndarray, planes: Planes, alive: np.ndarray, coarse, fine) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor of ``a`` the rows that are left of its ``alive`` ones, and their exact scores.

    After each plane the bits that are not read yet add between (2**j - 1) times the anchor's negative components and as
    much of the positive ones. ``coarse(lower, upper, alive)`` says which pairs can still qualify, for all anchors at
    once while many are left; then ``fine(anchor, lower, upper)`` for the rows of each anchor.
    """
    if not a.shape[1]:
        return [(i := np.flatnonzero(row), np.zeros(len(i), dtype=np.int64)) for row in alive]
    below, above = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    score, j = planes.product(a, planes.top), planes.top
    while j and alive.sum() * SPARSE > alive.size:
        j -= 1
        score += planes.product(a, j)
        rest = (1 << j) - 1
        alive &= coarse(score + rest * below[:, None], score + rest * above[:, None], alive)
    out = []
    for i, row in enumerate(alive):
        at = np.flatnonzero(row)
        s = score[i, at]
        for k in range(j - 1, -1, -1):
            if not len(at):
                break
            s = s + planes.product(a[i], k, at)
            rest = (1 << k) - 1
            left = fine(i, s + rest * below[i], s + rest * above[i])
            at, s = at[left], s[left]
        out.append((at, s))
    return out


def exact(a: np.ndarray, c: np.ndarray, alive: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``sieve``, for integers of any size: whole products, no further than a long reaches."""
    out = []
    for x, row in zip(a.astype(object), alive):
        at = np.flatnonzero(row)
        scores = [min(MOST, max(LEAST, sum(p * q for p, q in zip(x, y)))) for y in c[at].astype(object)]
        out.append((at, np.array(scores, dtype=np.int64)))
    return out


def nth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, the least possible where there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else LEAST


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest integer s with low * score <= 100 * s <= high * score."""
    return max(LEAST, -(-low * score // 100)), min(MOST, high * score // 100)


def met(candidates: DataFrame, anchors: DataFrame, shape: tuple[int, int], run, schema: str) -> DataFrame:
    """``run`` over every block of candidates with every block of anchors of the same vector length."""
    rows, asked = shape
    at = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = candidates.withColumn("block", at(rows)).withColumn("chunk", every(asked))
    right = anchors.withColumn("chunk", at(asked)).withColumn("block", every(rows))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both may come of one table
    keys = ["n", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, largest first, then id."""
    return np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == LEAST else -scores))[:k]


def prepared(left: pa.Table, right: pa.Table, scale: int):
    """Candidates by label, anchors, their integers, and the planes, or none where the products don't fit 64 bits."""
    left = left.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    c, a = integers(left["embedding"], scale), integers(right["embedding"], scale)
    small = c.dtype != object and a.dtype != object and largest(c) * largest(a) * max(1, c.shape[1]) < 1 << 61
    small = small and largest(c) < 1 << 31 and largest(a) * max(1, c.shape[1]) < 1 << 52
    return left, c, a, Planes(c) if small else None


def positives(candidates: DataFrame, anchors: DataFrame, shape: tuple[int, int], k: int, scale: int) -> DataFrame:
    """row, vec_id of each anchor and its first ``k`` other rows of the same label: place, positive_id, positive_score."""
    schema = "row long, positive_id long, positive_score long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            left, c, a, planes = prepared(left, right, scale)
            ids, rows, labels = (left[x].to_numpy() for x in ("vec_id", "row", "label"))
            own, wanted = right["row"].to_numpy(), right["label"].to_numpy()
            for label in np.unique(wanted):
                lo, hi = np.searchsorted(labels, [label, label], side="left")[0], np.searchsorted(labels, label, side="right")
                if lo == hi:
                    continue
                part = Planes(c[lo:hi]) if planes else None
                mine = np.flatnonzero(wanted == label)
                for some in np.array_split(mine, -(-len(mine) // AT_ONCE)):
                    alive = own[some][:, None] != rows[None, lo:hi]

                    def coarse(lower, upper, alive):
                        if lower.shape[1] <= k:
                            return np.ones_like(alive)
                        lower = np.where(alive, lower, LEAST)
                        return upper >= np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k, None]

                    def fine(i, lower, upper):
                        return upper >= nth(lower, k)

                    left_over = sieve(a[some], part, alive, coarse, fine) if part else exact(a[some], c[lo:hi], alive)
                    for i, (at, s) in zip(some, left_over):
                        best = first_of(ids[lo:hi][at], s, k)
                        found[0].append(np.repeat(own[i], len(best)))
                        found[1].append(ids[lo:hi][at][best])
                        found[2].append(s[best])
        return table(schema, found)

    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    pairs = met(candidates, anchors, shape, run, schema)
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def table(schema: str, columns) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table({n: pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for n, c in zip(names, columns)})


def negatives(candidates: DataFrame, anchors: DataFrame, shape: tuple[int, int], k: int, low: int, high: int, scale: int) -> DataFrame:
    """For each anchor and place among its positives the first ``k`` rows of other labels in the score's window: row, place, negative_id, negative_score."""
    schema = "row long, place long, negative_id long, negative_score long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if left.num_rows and right.num_rows:
            left, c, a, planes = prepared(left, right, scale)
            ids, labels = left["vec_id"].to_numpy(), left["label"].to_numpy()
            own, wanted, scores = right["row"].to_numpy(), right["label"].to_numpy(), right["scores"].to_pylist()
            windows = [[window(s, low, high) for s in of] for of in scores]
            for begin in range(0, len(a), AT_ONCE):
                some = np.arange(begin, min(len(a), begin + AT_ONCE))
                alive = wanted[some][:, None] != labels[None, :]
                down = np.array([min(w[0] for w in windows[i]) for i in some])[:, None]
                up = np.array([max(w[1] for w in windows[i]) for i in some])[:, None]

                def coarse(lower, upper, alive):
                    return (upper >= down) & (lower <= up)

                def fine(i, lower, upper, some=some):
                    keep = np.zeros(len(lower), dtype=bool)
                    for a_least, a_most in windows[some[i]]:
                        surely = nth(lower[(lower >= a_least) & (upper <= a_most)], k)
                        keep |= (upper >= max(a_least, surely)) & (lower <= a_most)
                    return keep

                for i, (at, s) in zip(some, sieve(a[some], planes, alive, coarse, fine) if planes else exact(a[some], c, alive)):
                    for place, (a_least, a_most) in enumerate(windows[i], 1):
                        inside = at[(s >= a_least) & (s <= a_most)]
                        of = s[(s >= a_least) & (s <= a_most)]
                        best = first_of(ids[inside], of, k)
                        for column, values in zip(found, (np.repeat(own[i], len(best)), np.repeat(place, len(best)), ids[inside][best], of[best])):
                            column.append(values)
        return table(schema, found)

    return met(candidates, anchors, shape, run, schema)


def mined(vectors: DataFrame, every: int = 100, k_positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """Hard negatives of each anchor (vec_id divisible by ``every``) and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); scores are integer products. An anchor's positives are its first ``k_positives``
    other rows of its label, the negatives of a pair the first ``k`` rows of other labels whose score is ``low`` to ``high``
    percent of the positive's. Rows and anchors meet in blocks, by a hash of the row, so no label or vector is a key of its
    own: a block of rows holds a million components, one of anchors a quarter of that; each emits its best few, which
    meet once more by anchor. Within a block the bits of the rows are read plane by plane, the sign first, and a row is
    dropped once its interval lies below the k-th surest or out of every window. Nothing is approximate.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors meet those of their own
    length; empty ones have the score 0. Each row counts for itself: of repeated rows one can be the other's positive, and
    repeated anchors repeat their results. Ties go to smaller ids. Scores beyond a long count as its end. Anchors without
    positives or without negatives in the window give no rows, nor does an empty table. Other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    v = written(taking_part(vectors, every), "vectors")
    n, asked, width = v.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max("n"), F.lit(1))).first()
    most = max(64, ROWS // max(1, width))
    shape = (max(1, -(-n // max(64, min(most, n // 24)))), max(1, -(-asked // max(64, ANCHORS // max(1, width)))))
    v, anchors = v.drop("anchor"), v.where("anchor").drop("anchor")
    found = written(positives(v, anchors.drop("vec_id"), shape, k_positives, scale), "positives")
    scores = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("s"))
    asking = anchors.join(scores, "row").select("row", "label", "n", "embedding", F.col("s.positive_score").alias("scores"))
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    picked = negatives(v, asking, shape, k, low, high, scale).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = picked.join(found, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.x) = len(b.x)),
positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
found AS (
  SELECT p.r, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""
