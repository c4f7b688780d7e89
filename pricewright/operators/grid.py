"""Price grids (G1 to G7): variant groups, size columns safe against colliding codes, cells, order, audits, chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

GROUP = ["brand", "product_name", "variant_context", "model_variant"]


def grouped(rows: DataFrame) -> DataFrame:
    """Adds group_label and column_key, column_label. A size under which a group has several codes gets a column for each code; a missing code is one of them."""
    rows = rows.withColumn("_key", F.coalesce("size", F.lit("__flat__")))
    rows = rows.withColumn("_cell", F.xxhash64("variant_context", "model_variant", "_key"))
    # both windows read one order of a product's rows; hashes before names only make them cheap to sort
    by = Window.partitionBy("brand", "product_name").orderBy("_cell", "variant_context", "model_variant", "_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    contexts = F.min(F.coalesce("variant_context", F.lit(""))).over(by) != F.max(F.coalesce("variant_context", F.lit(""))).over(by)
    variant = F.coalesce("model_variant", F.lit("Standard"))
    label = F.when(contexts & F.col("variant_context").isNotNull(), F.concat("variant_context", F.lit(" — "), variant)).otherwise(variant)
    code = F.coalesce("code", F.lit(""))
    cell = Window.partitionBy("brand", "product_name", "_cell", "variant_context", "model_variant", "_key")
    rows = rows.withColumn("group_label", label).withColumn("_several", F.min(code).over(cell) != F.max(code).over(cell))
    shown = F.coalesce("size", F.lit("—"))
    rows = rows.withColumn("column_key", F.when(F.col("_several"), F.concat("_key", F.lit("::"), code)).otherwise(F.col("_key")))
    return rows.withColumn("column_label", F.when(F.col("_several"), F.concat(shown, F.lit(" ("), code, F.lit(")"))).otherwise(shown)).drop("_key", "_cell", "_several")


def cells(rows: DataFrame) -> DataFrame:
    """The first row of each tier and column of a group: brand, product_name, variant_context, model_variant, group_label, fabric_tier, column_key, column_label, price_eur, code."""
    keys = [*GROUP, "group_label", "fabric_tier", "column_key", "column_label"]
    order = Window.partitionBy("_hash", *keys).orderBy("row_ord", "price_eur", "code")
    first = rows.withColumn("_hash", F.xxhash64(*keys)).withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return first.select(*keys, "price_eur", "code")


def tier_rank(c) -> Column:
    """The place of a tier in the order to show, unknown ones last."""
    at = F.array_position(X.words_literal(X.TIER_ORDER), X.normalize(c))
    return F.when(at > 0, at).otherwise(len(X.TIER_ORDER) + 1)


def layout(rows: DataFrame) -> DataFrame:
    """Cells with tier_place and column_place in their group, tiers by their order, columns by their first number, missing ones last."""
    c = cells(grouped(rows))
    width = F.coalesce(X.leading_digits("column_key").cast("int"), F.lit(1 << 30))
    by = Window.partitionBy(*GROUP)
    c = c.withColumn("tier_place", F.dense_rank().over(by.orderBy(tier_rank("fabric_tier"), F.asc_nulls_last("fabric_tier"))))
    return c.withColumn("column_place", F.dense_rank().over(by.orderBy(width, "column_key")))


def pivoted(rows: DataFrame, product: str, brand: str, columns: list[str]) -> DataFrame:
    """G3 in wide form for one product with known columns."""
    one = cells(grouped(rows.where((F.col("brand") == brand) & (F.col("product_name") == product))))
    return one.groupBy("group_label", "fabric_tier").pivot("column_key", columns).agg(F.min("price_eur"))


def lost_rows(rows: DataFrame) -> DataFrame:
    """Clean rows whose own cell doesn't give their price back. Cells are those of ``cells``, read off beside their rows; rows move once, by group, for codes and cells alike."""
    keys = [*GROUP, "fabric_tier", "column_key", "column_label"]
    own = Window.partitionBy("_hash", *keys)
    clean = grouped(rows.where(~F.col("ambiguous")).repartition(*GROUP)).withColumn("_hash", F.xxhash64(*keys)).withColumn("shown", F.min(F.struct("row_ord", "price_eur", "code")).over(own)["price_eur"])
    return clean.where("shown <> price_eur").select("brand", "product_name", "model_variant", "size", "fabric_tier", "code", "row_ord", "price_eur", "shown")


def chips(rows: DataFrame) -> DataFrame:
    """Brand, product_name, kind, place, label, question: sizes, tiers and contexts of a product with more than one, with the question that each asks."""
    options = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("size", "size"), ("tier", "fabric_tier"), ("category", "variant_context"))))
    o = rows.select("brand", "product_name", "row_ord", F.explode(options).alias("o")).select("brand", "product_name", "row_ord", "o.*").where("value is not null")
    o = o.groupBy("brand", "product_name", "kind", "value").agg(F.min("row_ord").alias("first"))
    by = Window.partitionBy("brand", "product_name", "kind")
    o = o.withColumn("n", F.count("*").over(by)).where("n > 1").withColumn("place", F.row_number().over(by.orderBy("first", "value")))
    limit = F.when(F.col("kind") == "category", 2).otherwise(6)
    ask = F.concat(F.lit("give "), "product_name", F.lit(" "), "value", F.lit(" price"))
    return o.where(F.col("place") <= limit).select("brand", "product_name", "kind", "place", X.chip_label("value").alias("label"), ask.alias("question"))


def sections(rows: DataFrame, limit: int = 4) -> DataFrame:
    """Qid, product_name, place, n_rows, as_grid: one section for each product of an answer, in first-seen order, the first ``limit``."""
    s = rows.groupBy("qid", "product_name").agg(F.min("row_ord").alias("first"), F.count("*").alias("n_rows"), F.max(F.col("status").isin("full_price_grid", "multi_product")).alias("grid"))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("first", "product_name")))
    return s.where(F.col("place") <= limit).select("qid", "product_name", "place", "n_rows", (F.col("grid") | (F.col("n_rows") > 6)).alias("as_grid"))


def tier_header(rows: DataFrame) -> DataFrame:
    """brand, product_name, header: the first tier label in capitals, else FABRIC if there is a tier, else a dash."""
    g = rows.groupBy("brand", "product_name").agg(F.min_by("tier_label", F.when(F.col("tier_label").isNotNull(), F.col("row_ord"))).alias("label"), F.count("fabric_tier").alias("tiers"))
    return g.select("brand", "product_name", F.coalesce(F.upper("label"), F.when(F.col("tiers") > 0, "FABRIC").otherwise("—")).alias("header"))
