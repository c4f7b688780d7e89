"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, list[str]] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a temporary folder is made, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="pricewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what several branches of a plan read is made once, lineage ends here, and lost executors cost only their running tasks."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = True
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` if ``staged`` has made it, else staged."""
    return df if getattr(df, "_staged", False) else staged(df, name)


def staged_so_far(spark: SparkSession) -> int:
    """The number of tables that are staged and not cleared, for ``since`` below."""
    return len(_paths.get(spark.sparkContext.applicationId, []))


def clear_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that this application staged after the first ``since``, but for the last ``keep``, once results that read them are written; returns their number."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    mine = _paths.get(spark.sparkContext.applicationId, [])
    gone = mine[since : len(mine) - keep]
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del mine[since : len(mine) - keep]
    return len(gone)


def forget(spark: SparkSession) -> None:
    """Collects the driver's garbage: Spark then removes the shuffle files and broadcasts of plans that are done, and the driver's heap shrinks. For use between long steps."""
    spark.sparkContext._jvm.System.gc()
