"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value statistics of clean texts."""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import emptied, small_batches, sole, written

#: Hashed tokens and beginnings of tokens; a model is two arrays of 2**BITS counts, 8 MB, whatever the corpus.
BITS = 20
#: Labelled rows that a model is fitted on at most, those of the smallest id hashes.
FIT_ROWS = 24_000
#: Documents fall into folds by crc32(doc_id) % FOLDS: fold 0 is held out, the last one calibrates, the others give log-odds.
FOLDS = 5
#: Letters of the beginnings of a token, whose log-odds are the prior of longer ones.
BEGINNINGS = (3, 4, 5, 6)
#: Scores are whole hundredths of natural log-odds, so sums are exact.
UNIT = 100
#: Characters around a token that are no part of it, and tokens kept in a worker's cache at most.
EDGES, CACHE = ".,;:!?\"'()[]{}<>|*#…«»“”„’", 100_000


def hashed(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> (64 - BITS)


def beginning(core: str) -> str:
    """The longest beginning of a token that has a level of its own; it is shorter than the token."""
    return core[: min(BEGINNINGS[-1], len(core) - 1)] if len(core) > BEGINNINGS[0] else ""


def levels(word: str) -> list[int]:
    """The hashed beginnings of a word, shortest first, and the word itself; none for a word of marks only."""
    core = word.strip(EDGES).lower()
    longest = beginning(core)
    return [hashed(f"{k} {core[:k]}") for k in BEGINNINGS if k <= len(longest)] + [hashed(f"w {core}")] if core else []


@dataclass
class ToxicityModel:
    """Counts of documents for each hashed token, toxic ones and all, and the calibration of segment scores.

    A segment of score s in a text of n words is as good as ``k * n * exp(-rate * s)`` segments of a clean text would be by
    chance (its e-value). The document's evidence is turned into a probability by ``offset`` and ``slope``.
    """

    toxic: array
    seen: array
    documents: tuple[int, int]  # toxic ones and all
    strength: float = 8.0
    drift: float = 1.5
    rate: float = 1.0
    k: float = 1.0
    offset: float = 0.0
    slope: float = 1.0
    cache: dict = field(default_factory=dict, repr=False)
    begun: dict = field(default_factory=dict, repr=False)

    @property
    def share(self) -> float:
        return (self.documents[0] + 0.5) / (self.documents[1] + 2)

    def posterior(self, p: float, feature: str) -> float:
        """The share of toxic documents among those with a feature, given the one that its level above says."""
        h = hashed(feature)
        return (self.toxic[h] + self.strength * p) / (self.seen[h] + self.strength)

    def token(self, word: str) -> int:
        """Log-odds of a token's class against the corpus, less the drift, in hundredths.

        Each level is a Dirichlet posterior (of two classes): its counts, and ``strength`` more that are shared as the
        level above it says, from the share of toxic documents down to the whole word. Beginnings are kept once found.
        """
        core = word.strip(EDGES).lower()
        longest = beginning(core)
        p = self.begun.get(longest)
        if p is None:
            p = self.share
            for k in BEGINNINGS:
                if k <= len(longest):
                    p = self.posterior(p, f"{k} {longest[:k]}")
            self.begun[longest] = p
        if core:
            p = self.posterior(p, f"w {core}")
        return round(UNIT * (math.log(p / (1 - p)) - math.log(self.share / (1 - self.share)) - self.drift))

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of every word of a text."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        if len(self.begun) > CACHE:
            self.begun.clear()
        for w in set(words).difference(cache):
            cache[w] = self.token(w)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))

    def surprise(self, score: float, n: int) -> float:
        """Minus the logarithm of the e-value; ``score`` in hundredths."""
        return self.rate * score / UNIT - math.log(self.k * max(n, 1))

    def evidence(self, found: list[tuple[int, int, int]], n: int, least: float) -> float:
        """What the segments of a text say together: the surprises of all significant ones, or else that of the best."""
        all_of = [self.surprise(s, n) for _, _, s in found] or [self.surprise(0, n)]
        return sum(x for x in all_of if x >= least) or max(all_of)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.offset + self.slope * evidence))))


def segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal scoring segments (begin, end, score), in order; linear in the number of scores.

    A segment is maximal if every part of it scores less and no larger segment has that property. Running over the
    positive scores, a stack holds candidates with the sum before and up to each, and for each the last one below it
    with a smaller sum before; a new segment joins with that one if it ends higher, and looks again.
    """
    at = np.flatnonzero(scores > 0)
    up_to = np.cumsum(scores)[at]
    stack: list[tuple[int, int, int, int, int]] = []  # sum before, sum up to, begin, end, the candidate before with a smaller sum before
    for i, after, gain in zip(at.tolist(), up_to.tolist(), scores[at].tolist()):
        before, begin, j = after - gain, i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                break
            before, _, begin, _, lower = stack[j]
            del stack[j:]
            j = lower
        stack.append((before, after, begin, i + 1, j))
    return [(begin, end, after - before) for before, after, begin, end, _ in stack]


def extreme_values(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and k of the Gumbel law of the best segment of clean texts of n words, by maximum likelihood.

    Texts without a positive score (best 0) are censored: their best lies anywhere below. For each rate on a grid the
    likeliest k is known; the rate of the highest likelihood is taken. With fewer than 20 positive ones, the rate is 1.
    """
    some, n, s = best > 0, np.maximum(n, 1).astype(float), best / UNIT
    found = []
    for rate in np.geomspace(0.1, 10, 81) if some.sum() >= 20 else [1.0]:
        k = max(some.sum(), 0.5) / max(1.0, (n * np.exp(-rate * s)).sum())
        found.append((some.sum() * (math.log(rate) + math.log(k)) - rate * s[some].sum(), float(rate), float(k)))
    return max(found)[1:]


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0) -> tuple[float, float]:
    """Offset and slope (0 at least) of P(y) by Newton steps, the slope drawn to 1 by ``ridge``; with one class only, the offset of ``share`` and slope 0."""
    if not len(y) or y.min() == y.max():
        return math.log(share / (1 - share)), 0.0
    order = np.lexsort((y, x))  # sums don't depend on the order of rows
    x, y = np.clip(x[order], -50, 50), y[order].astype(float)
    beta = np.array([math.log(y.mean() / (1 - y.mean())), 0.0])
    a, pull = np.stack([np.ones(len(x)), x], axis=1), np.array([0.01, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, a.T @ (y - p) - pull * (beta - [0.0, 1.0]))
        beta = beta + step * min(1.0, 1 / max(1e-12, float(np.abs(step).max())))
    return float(beta[0]), max(0.0, float(beta[1]))


def fold():
    """Column: crc32 of doc_id's decimal text, modulo the folds; rows without id are in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % FOLDS, F.lit(0).cast("long"))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, fold) of the labelled documents that are not held out, at most ``rows`` labels; a document of several labels is toxic if one says so."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.withColumn("fold", fold()).where("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it is broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic", "fold")


def counted(batches):
    """Documents of each hashed token, in each place -1 the documents themselves: place, toxic, seen."""
    toxic, seen, documents = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64), [0, 0]
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            found = np.unique(np.array([h for w in set((text.as_py() or "").split()) for h in levels(w)], dtype=np.int64))
            seen[found] += 1
            toxic[found] += y
            documents[0] += y
            documents[1] += 1
    at = np.flatnonzero(seen)
    columns = [np.append(at, -1), np.append(toxic[at], documents[0]), np.append(seen[at], documents[1])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "toxic", "seen"])


def judged(docs: DataFrame, model: ToxicityModel, result, schema: str) -> DataFrame:
    """``result(words, segments)`` of every text (the second column), a list of rows that follow the text's first column; the model is broadcast, 8 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    kinds = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        fitted = shared.value
        sole(fitted.cache)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").split()
                rows += [(i, *row) for row in result(fitted, words, segments(fitted.scores(words)))]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return small_batches(docs).mapInArrow(emptied(run), schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, max_e: float = 0.01) -> ToxicityModel:
    """The model of the labelled documents that are not held out, at most ``rows`` of them (those of the smallest id hashes).

    Three folds give counts, summed where the texts lie and by hashed token (2**BITS at most, which the driver gets); the
    fourth, which these counts haven't seen, gives the law of the best segment of clean texts, then the probability of a
    label given a text's evidence; then its counts are added. Labels with nulls give no rows, nor do labels without a
    document; null and empty texts have no tokens; long ones are read whole; repeated documents all count. Where the
    fourth fold lacks toxic or clean texts, every text gets about the share of toxic ones among the labels, a quarter without labels. Other columns are ignored.
    """
    least = -math.log(max_e)
    picked = written(labelled(small_batches(docs), labels, rows), "labelled")
    fresh, rest = picked.where(f"fold < {FOLDS - 1}"), picked.where(f"fold = {FOLDS - 1}").select("toxic", "text")
    none = array("i", bytes(4 << BITS))
    model = ToxicityModel(none[:], none[:], (0, 0))
    learn(model, fresh)
    tops = judged(rest, model, lambda m, words, found: [(len(words), max([s for _, _, s in found], default=0))], "toxic int, n long, best long").toArrow()
    y, n, best = (tops[c].to_numpy() for c in ("toxic", "n", "best"))
    model.rate, model.k = extreme_values(best[y == 0], n[y == 0])
    weighed = judged(rest, model, lambda m, words, found: [(m.evidence(found, len(words), least),)], "toxic int, evidence double").toArrow()
    model.offset, model.slope = logistic(weighed["evidence"].to_numpy(), weighed["toxic"].to_numpy(), model.share)
    learn(model, rest)
    return model


def learn(model: ToxicityModel, rows: DataFrame) -> None:
    """Adds the counts of (text, toxic) ``rows`` to the model."""
    sums = rows.select("text", "toxic").mapInArrow(emptied(counted), "place long, toxic long, seen long")
    sums = sums.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen")).toArrow()
    place, toxic, seen = (sums[c].to_numpy() for c in ("place", "toxic", "seen"))
    token = place >= 0
    model.cache.clear()
    model.begun.clear()
    for counts, more in ((model.toxic, toxic), (model.seen, seen)):
        np.frombuffer(counts, dtype=np.int32)[place[token]] += more[token].astype(np.int32)
    model.documents = (model.documents[0] + int(toxic[~token].sum()), model.documents[1] + int(seen[~token].sum()))


def passages(docs: DataFrame, model: ToxicityModel, max_e: float = 0.01) -> DataFrame:
    """Every significant toxic passage: doc_id, from_word, to_word (not included), log_odds, e_value, passage.

    Words are what stands between white space. Null and empty texts have none; a row for each passage of each row,
    repeated rows and rows without id included. Other columns are ignored.
    """

    def result(m, words, found):
        out = [(a, b, s / UNIT, math.exp(-m.surprise(s, len(words))), " ".join(words[a:b])) for a, b, s in found]
        return [row for row in out if row[3] <= max_e]

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(ids, model, result, "doc_id long, from_word long, to_word long, log_odds double, e_value double, passage string")


def score(docs: DataFrame, model: ToxicityModel, max_e: float = 0.01, at: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, toxic_words, e_value (of the best passage) of each document.

    The score is the probability of a toxic label by the evidence of all significant passages, or of the best one where
    none is. It is made of the text alone. Null and empty texts are texts without words and have a low score where
    toxic ones do; very long texts are read whole. Repeated rows and rows without id (held out): a result for
    each row. Empty table: no rows. Other columns are ignored.
    """
    least = -math.log(max_e)

    def result(m, words, found):
        n = len(words)
        p = m.probability(m.evidence(found, n, least))
        significant = [(a, b) for a, b, s in found if m.surprise(s, n) >= least]
        e = math.exp(-m.surprise(max([s for _, _, s in found], default=0), n))
        return [(p, int(p >= at), len(significant), sum(b - a for a, b in significant), e)]

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = judged(ids, model, result, "doc_id long, score double, predicted int, n_passages long, toxic_words long, e_value double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", "n_passages", "toxic_words", "e_value")
