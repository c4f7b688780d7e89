"""Brand files that arrive one after another, as a stream into a table by brand (S22, S23): a new file replaces its brand, nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.staging import staged


def newest(rows: DataFrame) -> DataFrame:
    """Of each brand the rows of its newest file (columns file and modified), without these columns."""
    last = F.max(F.struct("modified", "file")).over(Window.partitionBy("brand"))
    return rows.withColumn("_l", last).where((F.col("file") == F.col("_l.file")) & (F.col("modified") == F.col("_l.modified"))).drop("_l", "file", "modified")


def replace_brands(rows: DataFrame, path: str, merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Replaces the partitions of the brands that ``rows`` have in the table at ``path``; other brands' files are not touched.

    ``merge`` may add to the rows (manual ones, an earlier index: S18, S19), also from the table itself: what it makes
    is staged before anything is overwritten. The same rows again give the same table.
    """
    found = staged(merge(rows) if merge else rows, "brands")
    found.repartition("brand").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("brand").parquet(path)


def stream_brands(spark: SparkSession, source: str, schema: T.StructType, path: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Reads the JSON files that appear in ``source`` (one array of rows each), in batches, into the table by brand at ``path``; ends when all are read.

    Of several files of a brand in a batch the newest counts. A batch that is done again after a failure replaces the same
    brands with the same rows. Readers that kept the table's files see them anew through ``readers.reload``.
    """
    files = spark.readStream.schema(schema).option("multiLine", True).json(source)
    rows = files.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))

    def load(batch: DataFrame, _: int) -> None:
        replace_brands(newest(batch), path, merge)

    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
