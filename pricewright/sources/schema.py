"""The schemas of the price-list model."""

from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PRICES = _struct(*((n, _S) for n in ("brand", "product_name", "model_variant", "variant_context", "size", "fabric_tier", "tier_label", "code", "price_eur")), ("ambiguous", T.BooleanType()), ("source_pdf_page", _I))
INDEX = _struct(
    *((n, _S) for n in ("brand", "product_name", "slug", "collection", "art_code", "index_heading", "source_file", "shape", "section_category")),
    *((n, _I) for n in ("printed_page_start", "printed_page_end", "pdf_page_start", "pdf_page_end")),
    ("mini_pdf", _S), ("text_file", _S), ("images", T.ArrayType(_S)), ("page_images", T.MapType(_S, _S)),
)
FLAGS = _struct(("page", _I), ("product_name", _S), ("brand", _S), ("reason", _S))
LEDGER = T.MapType(_S, T.MapType(_S, _struct(("status", _S), ("note", _S))))
WORDS = _struct(("level", _I), ("page", _I), ("left", T.DoubleType()), ("top", T.DoubleType()), ("width", T.DoubleType()), ("text", _S))
INTENT = _struct(("product_names", T.ArrayType(_S)), ("size", _S), ("fabric_tiers", T.ArrayType(_S)), ("wants_full_list", T.BooleanType()))
QUESTIONS = _struct(("qid", T.LongType()), ("brand", _S), ("message", _S), ("last_product", _S), ("last_variants", T.ArrayType(_S)), ("last_candidates", T.ArrayType(_S)), ("intent", INTENT))
