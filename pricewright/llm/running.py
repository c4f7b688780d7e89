"""Running sums over groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bits_for(rows: int, per_bucket: int = 64) -> int:
    """Bits of buckets so that ``rows`` even keys leave about ``per_bucket`` in each."""
    return max(0, (max(rows, 1) // per_bucket).bit_length())


def running_sum(df: DataFrame, group: list[str], key: str, value: str, out: str, key_bits: int, bits: int, ties: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come before in the order of ``key``.

    ``key`` is a long from 0 to 2**key_bits. Rows fall into 2**bits buckets of consecutive keys; sums run inside
    a bucket, over the buckets of a super bucket, and over super buckets, so that no task needs a whole group.
    ``ties`` orders rows of equal keys.
    """
    fine, coarse = max(0, key_bits - bits), max(0, key_bits - bits // 2)
    before = lambda part, order: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_b", F.shiftright(F.col(key), fine))
    sums = rows.groupBy(*group, "_b").agg(F.sum(value).alias("_v")).withColumn("_s", F.shiftright("_b", coarse - fine))
    tops = sums.groupBy(*group, "_s").agg(F.sum("_v").alias("_w"))
    tops = tops.select(*group, "_s", F.coalesce(F.sum("_w").over(before(group, ["_s"])), F.lit(0)).alias("_o"))
    sums = sums.withColumn("_i", F.coalesce(F.sum("_v").over(before([*group, "_s"], ["_b"])), F.lit(0)))
    starts = sums.join(tops, [*group, "_s"]).select(*group, "_b", (F.col("_i") + F.col("_o")).alias("_at"))
    inside = F.coalesce(F.sum(value).over(before([*group, "_b"], [key, *(ties or [])])), F.lit(0))
    return rows.withColumn("_in", inside).join(starts, [*group, "_b"]).withColumn(out, (F.col("_in") + F.col("_at")).cast("long")).drop("_b", "_in", "_at")
