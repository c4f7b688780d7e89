"""Reading, writing and cutting lineage, shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged as written

__all__ = ["BROADCAST_IDS", "SPACE", "emptied", "named", "ship_package", "small_batches", "sole", "unused", "vocabulary", "with_ids", "words_of", "written"]

#: Ids broadcast at most (some 50 MB as a hash table); beyond it the same join is a shuffled one.
BROADCAST_IDS = 500_000

#: The class of characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with the distinct ``ids[key]``; broadcast only if they were counted and are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


_caches: list = []
_shipped: list = []


def sole(cache):
    """``cache`` (anything with ``clear``) of an operator in a Python worker; those of other operators, which the worker ran before, are emptied."""
    for c in _caches:
        if c is not cache:
            c.clear()
    _caches[:] = [cache]
    return cache


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors where their Python wouldn't find it: it is neither installed nor on PYTHONPATH nor in the working folder."""
    root = Path(__file__).resolve().parents[2]
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if root.name == "site-packages" or root in known or root == Path.cwd() or spark.sparkContext in _shipped:
        return
    at = tempfile.mkdtemp(prefix="pricewright-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/pricewright", "zip", root, "pricewright"))  # served by the driver
    _shipped.append(spark.sparkContext)


#: Settings of the session that the operators give batches of texts, unless the caller set others: rows and bytes of a batch at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("268435456", str(4 << 20))}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the executors able to import this package and texts passed to Python in small batches.

    Batches are read from the session's settings when a plan runs, so they stay set: those of ``BATCHES`` that have
    Spark's default value get 1,000 rows and 4 MB, so that long texts don't add up; values of the caller's are kept.
    """
    ship_package(df.sparkSession)
    for name, (default, ours) in BATCHES.items():
        if df.sparkSession.conf.get(name, default).removesuffix("b") in (default, "256m"):
            df.sparkSession.conf.set(name, ours)
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, those that ``df`` has already (in capitals or not) with more underscores before them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str):
    """Column of exactly this name, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def words_of(text):
    """Column: the array of words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    plain = F.coalesce(text, F.lit(""))
    for c in SPACE[1:]:  # ``translate`` looks up every character, which takes longer
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def vocabulary() -> str:
    """The path of the production vocabulary of BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def emptied(run):
    """``run`` for ``mapInArrow``, after whose last batch the worker gives back the memory that its batches took."""

    def whole(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library's own pool, where it has one
            trim(0)

    return whole
