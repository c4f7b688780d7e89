"""Sources and sinks: JSON tables in order, page texts, word lists, rejects, ledgers; partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema


def json_table(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Files that hold one JSON array each; ``row_ord`` is a row's place in its array, missing fields are null."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", T.ArrayType(row), {"mode": "FAILFAST"})).alias("row_ord", "r"))
    return rows.select("r.*", F.col("row_ord").cast("long").alias("row_ord"))


def prices(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, schema.PRICES)


def index(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, schema.INDEX)


def flags(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, schema.FLAGS)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The triage ledger, a row for each brand and product."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema.LEDGER)).alias("brand", "m"))
    return whole.select("brand", F.explode("m").alias("product_name", "e")).select("brand", "product_name", "e.*")


def valid_text(content) -> Column:
    """Bytes as text; those that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files whose pages follow marks ``<<<PDFPAGE:n>>>``: file, page, text. Bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), valid_text(F.col("content")).alias("t"))
    plain = F.regexp_replace("t", "\r\n?", "\n")
    return files.select("file", F.explode(F.split(plain, "<<<PDFPAGE:")).alias("p")).where("p rlike '^[0-9]+>>>'").select("file", F.regexp_extract("p", r"^(\d+)>>>", 1).cast("int").alias("page"), F.regexp_replace("p", r"^\d+>>>\n?", "").alias("text"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """Word lists, tab-separated with a header; rows of level 5 are words."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", schema="level int, page_num int, par_num int, block_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string")
    return raw.where("level = 5").select(F.col("page_num").alias("page"), "left", "top", "width", "text")


def half(found: DataFrame, side: str, middle: float = 595.0) -> DataFrame:
    """The words of the left or right half of spreads."""
    return found.where(F.col("left") < middle if side == "L" else F.col("left") >= middle)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """S6j: a literal list of [name, printed page]."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("ord", "e"))
    return whole.select("ord", F.get("e", F.lit(0)).alias("name"), F.get("e", F.lit(1)).cast("int").alias("printed"))


def write_brand_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table written by brand, so that readers of one brand read its folder only."""
    df.repartition("brand").write.mode("overwrite").partitionBy("brand").format(kind).save(path)


def reload(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Forgets what is kept of a table's files and reads them anew."""
    spark.catalog.refreshByPath(path)
    return spark.read.format(kind).load(path)
