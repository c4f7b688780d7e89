import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewright.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("given_, want", [("4.397", "€4.397"), ("342", "€342"), ("+200", "€+200"), ("+1.699", "€+1.699"), ("3,07", "€3,07"), ("MRD40", "€MRD40"), ("Price upon request", "Price upon request"), ("N/A", "N/A")])
def test_price_display(spark, given_, want):
    assert one(spark, X.price_display("a"), a=given_) == want


def test_numbers(spark):
    assert one(spark, X.italian_number("a"), a="1884") == "1.884"
    assert one(spark, X.add_on_total("a", "b"), a="1.290", b="+158") == "1.448"
    assert [float(one(spark, X.price_number("a"), a=a)) for a in ("4.397", "3,07", "+200", "1.234.567")] == [4397, 3.07, 200, 1234567]
    assert one(spark, X.price_number("a"), a="Price upon request") is None
    assert one(spark, X.retry_milliseconds("a"), a="try again in 26m50.4s") == 1610400


@pytest.mark.parametrize("given_, want", [("h.7", "h:7"), ("h7", "h:7"), ("sp.10", "sp:10"), ("sp 10", "sp:10"), ("sp.4.5", "sp:4.5"), ("sofa", None)])
def test_short_code(spark, given_, want):
    assert one(spark, X.short_code("a"), a=given_) == want


def test_sizes(spark):
    assert one(spark, X.extract_size("a"), a="bed 160 x 200 please") == "160x200"
    assert one(spark, X.extract_size("a"), a="240x120×74h") == "240x120x74"
    groups = lambda q, n="zzz": one(spark, X.size_groups("q", "n"), q=q, n=n)
    assert groups("120 40 and 180 90") == [[40, 120], [90, 180]]
    assert groups("120x40") == groups("120 40") == [[40, 120]]
    assert groups("2er and 3er") == []
    words = lambda a: one(spark, X.size_words("a"), a=a)
    assert words("A 200x100x73h") == ["a"]
    assert words("240x120x74h sag") == ["sag"]
    assert words("X fissaggio a muro") == ["x", "fissaggio", "a", "muro"]
    assert words("LA") == ["la"]


def test_balanced(spark):
    for text in ("Frassino Lino)", "Laccato e Vetro Marmo)", "Marmo)"):
        assert one(spark, X.balanced("a"), a=text) is None
    for text in ("2-er sofa", "3-er maxi sofa", "a (b)"):
        assert one(spark, X.balanced("a"), a=text) == text


@pytest.mark.parametrize("a, b, d", [("wlima", "wilma", 2), ("kaay", "kay", 1), ("bishp", "bishop", 1), ("hystrx", "hystrix", 1), ("agata", "agatha", 1)])
def test_distance(spark, a, b, d):
    assert one(spark, F.levenshtein("a", "b"), a=a, b=b) == d


def score(spark, pairs):
    d = spark.createDataFrame(pairs, "q string, c string").select(X.normalize("q").alias("q"), X.normalize("c").alias("c"))
    d = d.withColumn("qt", X.score_tokens("q")).withColumn("ct", X.score_tokens("c"))
    return [r.s for r in d.select(X.similarity("q", "c", "qt", "ct").alias("s")).collect()]


def test_similarity_cases(spark):
    assert score(spark, [("cuff pouf", "Cuff bench and pouf"), ("cuff pouf", "Cuff"), ("online", "On Line"), ("Vexalon armchair", "Zoe armchair"), ("sofa", "Any (Sofa)"), ("Any", "any")]) == [80, 80, 80, 0, 80, 100]


def plain_score(q, c):
    q, c = ("".join(x for x in unicodedata.normalize("NFD", t.lower()) if not 0x300 <= ord(x) <= 0x36F).strip() for t in (q, c))
    if q == c:
        return 100.0
    qt, ct = ([w for w in re.split(r"\s+", re.sub("[–—]", " ", t).replace("(", "").replace(")", "")) if w] for t in (q, c))
    word = lambda text, x: x != "" and re.search(r"(?:^|\W)" + re.escape(x) + r"(?:$|\W)", text, re.A) is not None
    if qt and set(qt) <= set(ct) or ct and set(ct) <= set(qt) or len(ct) > 1 and word(q, "".join(ct)) or len(qt) > 1 and word(c, "".join(qt)):
        return 80.0
    both = [t for t in qt if t in ct]
    weak = {*X.GENERIC, *X.RISKY, *X.FILLER}
    if not both or all(t in weak or t.isdigit() for t in both) and any(t not in ct and t not in X.RISKY and t not in X.FILLER for t in qt):
        return 0.0
    return len(both) / max(len(qt), len(ct)) * 60


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.lists(st.sampled_from("sofa bed greta wood 120 price è-lite on line online the (x) jack–e cuff".split()), max_size=5).map(" ".join)] * 2), min_size=1, max_size=20))
def test_similarity_like_plain(spark, pairs):
    assert score(spark, pairs) == pytest.approx([plain_score(*p) for p in pairs])


def test_nulls(spark):
    for f in (X.normalize, X.tokenize_loose, X.extract_size, X.size_numbers, X.extract_tiers, X.size_words, X.short_code, X.price_number, X.price_display, X.balanced, X.slug, X.chip_label):
        spark.createDataFrame([(None,), ("",)], "a string").select(f("a")).collect()
