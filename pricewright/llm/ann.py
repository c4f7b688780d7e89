"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches, written

#: Vectors that the index is fitted on at most, those of the smallest id hashes; every vector is indexed.
FIT_ROWS = 16_384


#: Lengths of so many vectors at most, but for the most frequent, are searched exactly, each in one task.
EXACT_ROWS = 4_096
#: Coarse centroids and fine ones, which are added to them, at most: lists grow with the root of the vectors up to 32,768 of them.
COARSE, FINE = 1024, 32
#: Distances of sampled vectors to centroids that the number of probes is found by, at most (but for 32 vectors).
TRIED = 1 << 22
#: Queries of one list that meet a block of it at once.
CHUNK = 2048
#: Standard deviations of a coded distance within which a vector may still be nearer.
SURE = 3


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that can be compared: not empty or zero, without null or non-finite components, with an id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("embedding", lambda x: x != 0))


def rows_of(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled in double precision first, so that none over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, components up to 1: their cosines are the same to the last bit, but squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def kmeans(x: np.ndarray, k: int, rounds: int, random) -> np.ndarray:
    """Centroids by Lloyd's rounds; those that lose all points move to random ones."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, of, x)
        counts = np.bincount(of, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[random.integers(0, len(x), k)]).astype(np.float32)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, dtype=np.int64)


@dataclass
class IvfPq:
    """Coarse centroids, a code book for each part of the residual, and how many lists a query probes.

    Centroids are sums of one of ``coarse`` and one of ``fine``: list i is that of coarse i // len(fine) and fine i % len(fine).
    """

    coarse: np.ndarray
    fine: np.ndarray
    books: np.ndarray  # part, code, component
    probes: int

    def centre(self, at):
        return self.coarse[at // len(self.fine)] + self.fine[at % len(self.fine)]

    @property
    def centres(self) -> np.ndarray:
        return (self.coarse[:, None, :] + self.fine[None, :, :]).reshape(-1, self.coarse.shape[1])

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: by the nearest coarse centroid, then by what remains."""
        first = nearest(x, self.coarse)
        return first * len(self.fine) + nearest(x - self.coarse[first], self.fine)

    def parts(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, length of the residual, the code of its direction (dense lists, of short residuals, are coded as finely as others), and the code's distance from that direction."""
        lists = self.lists(x)
        lengths, rest = shapes(x - self.centre(lists))
        rest = self.parts(rest)
        codes = np.stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)
        missed = sum(((rest[:, m] - self.books[m][codes[:, m]]) ** 2).sum(1) for m in range(len(self.books)))
        return lists, lengths, codes, np.sqrt(missed).astype(np.float32)

    def distances(self, q: np.ndarray, at: int, lengths: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Asymmetric square distances of queries to the coded vectors of one list, and their standard deviations: tables hold the product of each part of a query's own residual with each code word."""
        rest = q - self.centre(at)
        tables = np.einsum("qmd,mcd->qmc", self.parts(rest), self.books)
        products = np.zeros((len(q), len(codes)), dtype=np.float32)
        for m in range(codes.shape[1]):
            products += tables[:, m, :][:, codes[:, m]]
        own = (rest * rest).sum(1)[:, None]
        # what a code misses has any direction, so the part of it along the query's residual is one of as many as there are components; the rest is rounding
        spread = 2 * np.sqrt(own) * (lengths * errors) / math.sqrt(q.shape[1]) + 1e-6 * (own + lengths * lengths)
        return own - 2 * lengths * products + lengths * lengths, spread


def shapes(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(rest, axis=1).astype(np.float32)
    return lengths, (rest / np.maximum(lengths, 1e-30)[:, None]).astype(np.float32)


def fit(x: np.ndarray, asked: np.ndarray, rows: int, part: int, target: float, seed: int) -> IvfPq:
    """Fits the index on a sample of unit vectors. The probes are the fewest by which ``target`` of the five nearest neighbours in the sample
    lie in probed lists, those of the sample's own vectors and those of ``asked``, a sample of the queries, which may lie elsewhere."""
    random = np.random.default_rng(seed)
    wanted = max(1, round(math.sqrt(rows) / 2))
    coarse = kmeans(x, max(1, min(wanted, COARSE, len(x) // 8)), 8, random)
    rest = x - coarse[nearest(x, coarse)]
    fine = kmeans(rest, min(FINE, -(-wanted // len(coarse))), 8, random) if wanted > len(coarse) else np.zeros((1, x.shape[1]), dtype=np.float32)
    parts = -(-x.shape[1] // part)
    index = IvfPq(coarse, fine, np.zeros((parts, 1, part), dtype=np.float32), 1)
    rest = index.parts(shapes(x - index.centre(index.lists(x)))[1])
    books = [kmeans(rest[:, m], 256, 6, random) for m in range(parts)]
    books = [np.concatenate([b, np.repeat(b[:1], 256 - len(b), 0)]) for b in books]
    index.books = np.stack(books)
    x = np.unique(x, axis=0)  # copies of one vector, which are easy to find, don't count more than others
    centres = index.centres
    most = min(max(32, TRIED // len(centres)), 1024)
    index.probes = max(probes(index, x, x[random.choice(len(x), min(most, len(x)), replace=False)], target), probes(index, x, np.unique(asked, axis=0)[:most], target))
    return index


def probes(index: IvfPq, x: np.ndarray, tried: np.ndarray, target: float) -> int:
    """The lists that ``tried`` vectors must probe to meet ``target`` of their five nearest others of ``x``."""
    if not len(tried) or len(x) < 2:
        return 1
    x, at = np.unique(np.concatenate([tried, x]), axis=0, return_inverse=True)
    own, centres = at.ravel()[: len(tried)], index.centres
    near = tried @ x.T
    near[np.arange(len(tried)), own] = -9
    best = np.argpartition(-near, min(5, len(x) - 1), axis=1)[:, : min(5, len(x) - 1)]
    place = np.argsort(np.argsort(-(tried @ centres.T - (centres * centres).sum(1) / 2), axis=1), axis=1)
    return int(np.sort(np.take_along_axis(place, index.lists(x)[best], 1).ravel())[min(best.size - 1, int(target * best.size))]) + 1


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, kept: int = 12, rerank: int = 64, part: int = 2, target: float = 0.99, seed: int = 11) -> DataFrame:
    """The ``k`` nearest vectors by cosine of each query (vec_id divisible by ``every``): query_id, rank, vec_id, score.

    Vectors are coded once, with their list and a block of it; a list of any size falls into blocks of some
    hundred to 16,384 vectors, the queries that probe it into chunks of some 2,048, so a task holds one block and one
    chunk, and a code is copied only as often as its own list has chunks. Lists grow with the root of the number of
    vectors, so the work does with its power 1.5 at most. A query
    meets the blocks of the lists that it probes (as many as ``target`` asks for, more while these hold few
    vectors), keeps ``kept`` of each block by asymmetric distance, ``rerank`` of all, and in both steps every other vector that could
    be among the nearest: ``SURE`` standard deviations of its distance (of what its code misses) reach that of the last of the k + 1 nearest.
    So codes that can't tell the vectors of a dense group apart lose none of them. These get their exact
    cosine in double precision from the original vectors. Ties go to smaller ids at every step. Of copies
    only the k + 1 of the smallest ids go on: no others can be among the nearest.

    Vectors are compared with those of their own length: the most frequent length and others of more than
    ``EXACT_ROWS`` vectors have an index each, the rest are searched exactly. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without id. Rows with the query's own id are no candidates; of
    several queries with one id that of the more frequent (then smaller) length counts, then the least vector. Fewer
    candidates than ``k`` are all returned. An empty table gives no rows. Other columns are ignored.
    """
    v = written(taking_part(small_batches(vectors)), "vectors")
    sizes = [tuple(r) for r in v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").collect()]  # a row for each length
    if not sizes:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = v.where(F.col("vec_id") % every == 0)
    if len(sizes) == 1:
        queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    else:
        places = v.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(sizes)], "n int, place int")
        queries = queries.withColumn("n", F.size("embedding")).join(F.broadcast(places), "n").groupBy("vec_id").agg(F.min(F.struct("place", "embedding"))["embedding"].alias("embedding"))
    queries = written(queries, "queries")
    large = [s for i, s in enumerate(sizes) if not i or s[1] > EXACT_ROWS]
    of = lambda df, n: df.where(F.size("embedding") == n) if len(sizes) > 1 else df
    found = [indexed(of(v, n), of(queries, n), rows, k, kept, rerank, part, target, seed) for n, rows in large]
    if len(large) < len(sizes):
        few = ~F.size("embedding").isin([n for n, _ in large])
        found.append(compared(v.where(few), queries.where(few), k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def compared(v: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The nearest vectors as in ``neighbours``, by all cosines of the vectors and queries of a length, 64 queries at a time."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "rank": pd.Series(dtype="int32"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(left) and len(right):
            ids, asked = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            a, b = np.stack(left["embedding"]), np.stack(right["embedding"])
            a, b = scaled(a), scaled(b)
            a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
            for at in range(0, len(b), 64):
                scores = np.stack([(a * q).sum(1) for q in b[at : at + 64]])  # copies get the same score to the last bit
                for query, score in zip(asked[at : at + 64], scores):
                    order = np.lexsort((ids, -score))
                    order = order[ids[order] != query][:k]
                    out.append(pd.DataFrame({"query_id": query, "rank": np.arange(1, len(order) + 1, dtype=np.int32), "vec_id": ids[order], "score": score[order]}))
        return pd.concat(out) if len(out) == 1 else pd.concat(out[1:])

    n = F.size("embedding").alias("n")
    return v.select(n, "vec_id", "embedding").groupBy("n").cogroup(queries.select(n, "vec_id", "embedding").groupBy("n")).applyInPandas(meet, "query_id long, rank int, vec_id long, score double")


def indexed(v: DataFrame, queries: DataFrame, n: int, k: int, kept: int, rerank: int, part: int, target: float, seed: int) -> DataFrame:
    """The nearest vectors as in ``neighbours``, by an index of the ``n`` vectors ``v`` of one length."""
    spark = v.sparkSession
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow()
    x = np.concatenate([unit(rows_of(chunk)) for chunk in sample.column(0).chunks if len(chunk)])
    del sample
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(1024).select("embedding").toArrow()
    asked = np.concatenate([x[:0], *(unit(rows_of(chunk)) for chunk in some.column(0).chunks if len(chunk))])
    index = spark.sparkContext.broadcast(fit(x, asked, n, part, target, seed))

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(1))
                lists, lengths, codes, errors = index.value.encode(unit(x))
                same = np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in scaled(x)])
                columns = [batch.column(0), pa.array(lists.astype(np.int32)), pa.array(lengths), pa.array(errors), pa.array(same), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "list", "length", "error", "same", "code"])

    codes = written(v.mapInArrow(encode, "vec_id long, list int, length float, error float, same long, code binary"), "codes")
    lists = len(index.value.coarse) * len(index.value.fine)
    sizes = np.zeros(lists, dtype=np.int64)
    for row in codes.groupBy("list").count().collect():  # a row for each centroid, 32,768 at most
        sizes[row["list"]] = row["count"]
    block = max(256, min(16_384, n // 64))
    split = -(-sizes // block)
    held = spark.sparkContext.broadcast(sizes)

    def probe(batches):
        found, many = index.value, held.value
        centres = found.centres
        half = (centres * centres).sum(1) / 2
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                q = unit(rows_of(part.column(1)))
                order = np.argsort(half - q @ centres.T, axis=1, kind="stable")
                enough = (np.cumsum(many[order], axis=1) < 4 * rerank).sum(1) + 1
                probed = np.minimum(np.maximum(found.probes, enough), len(centres))
                at = np.repeat(np.arange(len(q)), probed)
                to = np.concatenate([row[:p] for row, p in zip(order, probed)])
                at, to = at[many[to] > 0], to[many[to] > 0]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(to.astype(np.int32)), pa.array([q[i].tobytes() for i in at], pa.binary())], names=["query_id", "list", "q"])

    probes = written(queries.mapInArrow(probe, "query_id long, list int, q binary"), "probes")
    asked = np.zeros(lists, dtype=np.int64)
    for row in probes.groupBy("list").count().collect():
        asked[row["list"]] = row["count"]
    shape = [(i, int(s), int(c)) for i, (s, c) in enumerate(zip(split, -(-asked // CHUNK))) if s and c]
    shape = F.broadcast(spark.createDataFrame(shape, "list int, blocks int, chunks int"))
    cells = codes.join(shape, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    cells = cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("blocks", "chunks")
    probes = probes.join(shape, "list").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int"))
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "chunks")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = index.value
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query_id", "int64"), ("vec_id", "int64"), ("same", "int64"), ("far", "float32"), ("least", "float32"))})
        left = left.sort_values("vec_id")
        left = left[left.groupby("same").cumcount() <= k]  # of copies only those of the smallest ids can be found
        ids, same = left["vec_id"].to_numpy(), left["same"].to_numpy()
        code = np.frombuffer(b"".join(left["code"]), dtype=np.uint8).reshape(len(left), -1)
        q = np.frombuffer(b"".join(right["q"]), dtype=np.float32).reshape(len(right), -1)
        out = []
        for at in range(0, len(q), 64):
            far, spread = found.distances(q[at : at + 64], int(left["list"].iloc[0]), left["length"].to_numpy(), code, left["error"].to_numpy())
            least = far - SURE * spread
            order = np.argsort(far, axis=1, kind="stable")
            keep = least <= np.take_along_axis(far, order[:, min(k, len(ids) - 1)][:, None], 1)
            np.put_along_axis(keep, order[:, : kept + 1], True, 1)
            i, j = np.nonzero(keep)
            out.append(pd.DataFrame({"query_id": right["query_id"].to_numpy()[at + i], "vec_id": ids[j], "same": same[j], "far": far[i, j].astype("float32"), "least": least[i, j].astype("float32")}))
        out = pd.concat(out)
        return out[out["query_id"] != out["vec_id"]]

    keys = ["list", "block", "chunk"]
    met = cells.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, same long, far float, least float")
    first = Window.partitionBy("query_id").orderBy("far", "vec_id")
    copies = Window.partitionBy("query_id", "same").orderBy("vec_id")
    picked = met.distinct().withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    picked = picked.withColumn("r", F.row_number().over(first)).withColumn("bar", F.max(F.when(F.col("r") <= k + 1, F.col("far"))).over(Window.partitionBy("query_id")))
    picked = picked.where((F.col("r") <= rerank) | (F.col("least") <= F.col("bar"))).select("query_id", "vec_id").distinct()
    picked = written(picked, "picked")
    pairs = picked.join(v, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = scaled(rows_of(batch.column("embedding"))), scaled(rows_of(batch.column("q")))
                score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "embedding", "q").mapInArrow(exact, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
