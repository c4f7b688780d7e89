"""Connected components of links between longs: by merging sets in one task where links are few, else by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ship_package, written

#: Links, counted, that one task merges (some 30 MB); more of them are merged by distributed rounds.
ONE_TASK = 200_000


def merged(batches):
    """The components of all links of a task: each end points to a smaller one of its set, in the end to the smallest."""
    least: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := least.setdefault(root, root)) != root:
            root = up
        while x != root:
            least[x], x = root, least[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
    ids = sorted(least)
    for at in range(0, len(ids), 100_000):
        part = ids[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(part)), pa.array(np.array([find(x) for x in part]))], names=["id", "component"])


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): for each end of ``links`` (a, b) the smallest id that links reach. Nulls and loops link nothing.

    Up to ``ONE_TASK`` links, counted, are merged in one task. Beyond that, every round is written to the shared folder,
    so its lineage stays short, and a round aggregates neighbours to their minimum before joining, so a vertex with
    many links is never gathered in one row. Both give the same components.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    if edges.count() <= ONE_TASK:
        ship_package(edges.sparkSession)
        return edges.coalesce(1).mapInArrow(merged, "id long, component long")
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionByName(edges.join(least, "a").where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(star.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    ends = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return ends.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
