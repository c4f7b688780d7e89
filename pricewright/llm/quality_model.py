"""Quality classifier: ordinal cumulative-link regression over hashed text, for expected grades and tail probabilities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import emptied, small_batches, sole

#: Hashed features; a model is 2**BITS floats and its thresholds, 1 MB, whatever the corpus.
BITS = 18
#: Words kept in a worker's cache at most.
CACHE = 60_000
#: Labelled rows that a model is fitted on at most, those of the smallest id hashes.
FIT_ROWS = 12_000
#: Characters around a word that are features of their own when there is more than one of them.
EDGES = ".,;:!?\"'()[]|*#"

_words: dict[str, tuple[int, ...]] = {}


def hashed(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> (64 - BITS)


def _word(word: str) -> tuple[int, ...]:
    core = word.strip(EDGES)
    edge = word if not core else word[len(word.rstrip(EDGES)) :]
    core = core.lower()
    out = (hashed("w " + core), *(hashed(f"p {core[:k]}") for k in (4, 5, 6) if k < len(core))) if core else ()
    out += (hashed("e " + edge[:4]),) if len(edge) > 1 or not core else ()
    if len(_words) > CACHE:
        _words.clear()
    _words[word] = out
    return out


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: its words and their first letters (4 to 6, so that forms of a word share weights), odd word ends, and its shape in steps (length, distinct words, capitals, letters, repeated lines)."""
    text = text or ""
    words = text.split()
    kinds = set(words)
    out = {hashed("bias")}
    for w in kinds:
        out.update(_words.get(w) or _word(w))
    n = len(words)
    if n:
        step = int(math.log2(n))
        letters = sum(map(len, words))
        upper = sum(len(w) for w in kinds if w.isupper()) / max(1, sum(map(len, kinds)))
        plain = sum(len(w) for w in kinds if w.isalpha()) / max(1, sum(map(len, kinds)))
        lines = text.split("\n")
        out.update((hashed(f"n {step}"), hashed(f"d {min(step, 12)} {len(kinds) * 10 // n}"), hashed(f"u {upper * 10:.0f}"), hashed(f"a {plain * 10:.0f}"), hashed(f"l {min(20, letters // n)}"), hashed(f"r {(len(lines) - len(set(lines))) * 10 // len(lines)}")))
    else:
        out.add(hashed("none"))
    return np.fromiter(out, dtype=np.int32, count=len(out))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - score), the score being the sum of the weights of a text's features."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k from 1 on, one row for each text."""
        flat = np.concatenate(found) if found else np.empty(0, dtype=np.int32)
        starts = np.cumsum([0, *map(len, found)])[:-1]
        scores = np.add.reduceat(self.weights[flat], starts) if len(flat) else np.zeros(len(found))
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cuts_of(steps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first one, and each next one an exponential further."""
    return np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))])


def likelihoods(weights: np.ndarray, steps: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= y) and P(grade < y) of each row, given its features; the difference is the likelihood of its grade."""
    scores = np.add.reduceat(weights[np.concatenate(rows)], np.cumsum([0, *map(len, rows)])[:-1])
    edge = np.concatenate([[-np.inf], cuts_of(steps), [np.inf]])
    return sigmoid(edge[y + 1] - scores), sigmoid(edge[y] - scores)


def slopes(weights: np.ndarray, steps: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean log likelihood by weights and by steps."""
    hi, lo = likelihoods(weights, steps, rows, y)
    # by the score: minus the density at both edges over their difference, which is hi + lo - 1
    by_score = np.bincount(np.concatenate(rows), weights=np.repeat(hi + lo - 1, list(map(len, rows))), minlength=len(weights)) / len(y)
    p = np.maximum(hi - lo, 1e-9)
    by_cut = np.zeros(len(steps))
    for k in range(len(steps)):
        by_cut[k] = ((hi * (1 - hi) / p)[y == k].sum() - (lo * (1 - lo) / p)[y == k + 1].sum()) / len(y)
    by_step = [by_cut[k:].sum() * np.exp(steps[k]) for k in range(1, len(steps))]
    return by_score, np.concatenate([[by_cut.sum()], by_step])


def fit_ordinal(flat: np.ndarray, ends: np.ndarray, grades: np.ndarray, levels: int = 3, rounds: int = 10, rate: float = 0.15, l1: float = 1e-3, batch: int = 128, rare: int = 3, seed: int = 7) -> OrdinalModel:
    """Fits weights shared by all levels and ordered thresholds by adaptive gradient steps with an L1 penalty.

    ``flat`` has the features of all rows, ``ends`` where each row's end. Features of fewer than ``rare`` rows are left
    out. Thresholds are a first one and positive gaps (exponentials), so they stay ordered. No rows: weights 0 and
    thresholds far below 0, by which every text has the top grade.
    """
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    if not len(grades):
        return OrdinalModel(weights, np.arange(levels - 1) * 0.1 - 10.0)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for i in range(0, len(flat), 1 << 20):
        counts += np.bincount(flat[i : i + (1 << 20)], minlength=1 << BITS)
    known = counts >= rare
    known[hashed("bias")] = True
    starts = np.concatenate([[0], ends[:-1]])
    below = [np.clip((grades <= k).mean(), 0.01, 0.99) for k in range(levels - 1)]
    cuts = np.log(np.array(below) / (1 - np.array(below)))
    steps = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    step_squares = np.full(levels - 1, 1e-8)
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        for at in np.array_split(random.permutation(len(grades)), max(1, len(grades) // batch)):
            rows = [f[known[f]] for f in (flat[starts[i] : ends[i]] for i in at)]
            by_score, by_step = slopes(weights, steps, rows, grades[at])
            used = np.unique(np.concatenate(rows))
            g = by_score[used]
            squares[used] += g * g
            pace = rate / np.sqrt(squares[used])
            moved = weights[used] + pace * g
            weights[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - pace * l1)
            step_squares += by_step * by_step
            steps = steps + rate * by_step / np.sqrt(step_squares)
    return OrdinalModel(weights, cuts_of(steps))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 2 for good and harmless, one less for low quality and one less for toxic; the least of a document's. Rows with nulls give none."""
    grade = (F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("grade")
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def training_rows(docs: DataFrame, grades: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, grade, found): grades and features, as bytes, of at most ``rows`` labelled documents; texts are hashed where they lie."""
    picked = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it is broadcast

    def run(batches):
        sole(_words)
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "grade", "found"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = small_batches(text).join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")
    return labelled.mapInArrow(emptied(run), "doc_id long, grade int, found binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> OrdinalModel:
    """The model of the labelled documents, at most ``rows`` of them (those of the smallest id hashes).

    The features of these rows, some 40 MB for 12,000, meet in one task, in the order of their ids, and are fitted
    there: the driver gets a model of 2 MB, and a lost executor costs one task. Labels with nulls give no rows, nor do
    labels without a document; a document of several labels has the least grade; documents of one id all count.
    Null and empty texts have the features of a text without words, very long ones are read whole. Without rows,
    every text has the top grade. Other columns are ignored.
    """

    def run(batches):
        flat, sizes, grades = [], [], []
        for batch in batches:
            for grade, found in zip(batch.column(1).to_pylist(), batch.column(2)):
                flat.append(np.frombuffer(found.as_py(), dtype=np.int32))
                sizes.append(len(flat[-1]))
                grades.append(grade)
        whole = np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)
        model = fit_ordinal(whole, np.cumsum(sizes, dtype=np.int64), np.array(grades, dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tobytes()]})

    one = training_rows(docs, graded(labels), rows).repartition(1).sortWithinPartitions("doc_id", "found")
    got = one.mapInArrow(emptied(run), "weights binary, thresholds binary").collect()
    if not got:  # an empty input has no task
        return fit_ordinal(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    return OrdinalModel(*(np.frombuffer(x, dtype=np.float64) for x in got[0]))


def judge(docs: DataFrame, at: int, model: OrdinalModel, result, schema) -> DataFrame:
    """Applies ``result`` to batches of ``docs`` and the tail probabilities of their texts, column ``at``; the model is broadcast, 1 MB.

    A row gives a result of its own, whatever its id; texts as in ``fit``; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches):
        sole(_words)
        fitted = OrdinalModel(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield result(part, fitted.tails([features(t.as_py()) for t in part.column(at)]).astype(float))

    return small_batches(docs).mapInArrow(emptied(run), schema)


def score(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_low (grade 0), p_top (the top grade) and selected (p_top >= ``least``) of each document.

    Null and empty texts have the features of a text without words. Very long texts are read whole. Repeated rows
    and null ids: a result for each row. Empty table: no rows. Other columns are ignored.
    """

    def result(part, tails):
        out = [part.column(0), pa.array(tails.sum(1)), pa.array(1 - tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "expected_grade", "p_low", "p_top", "selected"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(ids, 1, model, result, "doc_id long, expected_grade double, p_low double, p_top double, selected boolean")


def selected(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, all columns as they are: a narrow pass, texts are not shuffled.

    Rows are judged by their texts alone: null and empty ones as texts without words, repeated rows and rows without id
    each for themselves, very long ones whole. Where no labelled document is found nothing is rejected. Empty table: no rows.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of any kind
    kept = judge(plain, docs.columns.index("text"), fit(docs, labels), lambda part, tails: part.filter(pa.array(tails[:, -1] >= least)), plain.schema)
    return kept.toDF(*docs.columns)
