"""Text functions of the price-list model, as Column expressions. None needs Python on the executors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closed vocabularies.
KNOWN_TIERS = ("nuvola leather", "luxury leather", "super nuvola fabric", "extra luxury fabric", "b e tcl", "super", "extra", "plus", "d, e", "c", "d", "e")
TIER_ORDER = ("b e tcl", "c", "d", "e", "d, e", "plus", "extra", "extra luxury fabric", "luxury leather", "super", "super nuvola fabric", "nuvola leather")
GENERIC = (
    "table", "chair", "armchair", "console", "office", "bench", "pouf", "stand", "mirror", "lounge", "coffee", "wood", "tv", "sofa", "bed", "cuscini",
    "cuscino",
)
FILLER = (
    "what", "whats", "are", "is", "the", "a", "an", "for", "of", "me", "give", "show", "tell", "please", "how", "much",
    "do", "you", "have", "can", "i", "get", "price", "prices", "pricing", "cost", "costs", "all", "full", "complete", "every", "list",
    "in", "about", "and", "then", "con", "di", "per",
)
RISKY = (
    "a", "i", "o", "u", "me", "my", "is", "am", "be", "we", "us", "or", "if", "in", "on", "at",
    "to", "so", "no", "go", "do", "up", "it", "as", "an", "the", "and", "not", "but", "out", "get", "has",
    "had", "was", "who", "how", "why", "him", "her", "his", "its", "our", "let", "put", "via", "she", "may", "say",
    "too", "own", "new", "use", "way", "now", "old", "see", "one", "two", "big", "top", "ask", "try", "any", "add",
    "day", "need", "come", "long", "than", "more", "much", "like", "just", "also", "this", "that", "with", "from", "have", "will",
    "been", "were", "then", "when", "all", "for", "give", "price", "prices", "yes", "yeah", "yep", "ok", "okay", "sure", "please",
    "full", "list", "of", "them",
)
UNITS = ("h", "mt", "mq", "cm", "ø")
TIER_FILLER = ("cat", "category")


def _folding() -> tuple[str, str]:
    """Small letters that decompose to one letter and marks, and those letters; made from Unicode's own data."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if plain != c and len(plain) == 1:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_literal(words) -> Column:
    return F.array(*map(F.lit, words))


def normalize(c) -> Column:
    """Small letters, ligatures apart, accents off, no white space at the ends; null becomes ''."""
    out = F.lower(F.coalesce(_c(c), F.lit("")))
    out = F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    out = F.regexp_replace(F.translate(out, ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")
    return F.regexp_replace(out, r"^[\s ]+|[\s ]+$", "")


def not_empty(tokens: Column) -> Column:
    return F.array_remove(tokens, "")


def tokenize_loose(c) -> Column:
    """Runs of a-z and 0-9 of the normalised text."""
    return not_empty(F.split(normalize(c), "[^a-z0-9]+"))


def mention_tokens(c) -> Column:
    """Runs of a-z, 0-9 and apostrophes of the normalised text."""
    return not_empty(F.split(normalize(c), "[^a-z0-9']+"))


def score_tokens(normal) -> Column:
    """Words between white space of a normalised text without parentheses, long dashes being spaces."""
    return not_empty(F.split(F.translate(F.regexp_replace(_c(normal), "[–—]", " "), "()", ""), r"\s+"))


def contains_word(text, needle) -> Column:
    """Whether ``needle`` stands in ``text`` between characters that are no ASCII word characters, or at an end; '' never does."""
    text, needle = _c(text), _c(needle)
    return (needle != "") & F.regexp_like(text, F.concat(F.lit(r"(?i)(?:^|\W)\Q"), needle, F.lit(r"\E(?:$|\W)")))


def strong_tokens(qt) -> Column:
    """Tokens that are no numbers and neither generic nor weak words."""
    weak = words_literal(dict.fromkeys([*GENERIC, *RISKY, *FILLER]))
    return F.filter(F.array_except(_c(qt), weak), lambda t: ~t.rlike(r"^\d+$"))


def content_tokens(qt) -> Column:
    """Tokens that are no weak words."""
    return F.array_except(_c(qt), words_literal(dict.fromkeys([*RISKY, *FILLER])))


def similarity(q, c, qt, ct, strong=None, content=None) -> Column:
    """Score of a question against a name, of normalised texts and their ``score_tokens``.

    100 if equal; 80 if the tokens of one are all in the other, or joined stand in it as a word; else 60 times the
    question's tokens in the name (repeats count) by the longer token list, but 0 if these are only generic or weak words
    and something else is left. ``strong`` and ``content`` are the question's own, worked out before it meets names.
    """
    strong = strong_tokens(qt) if strong is None else _c(strong)
    content = content_tokens(qt) if content is None else _c(content)
    q, c, qt, ct = map(_c, (q, c, qt, ct))
    inside = lambda a, b: (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)
    whole = lambda tokens: F.array_join(tokens, "")
    joined = lambda text, tokens: (F.size(tokens) > 1) & F.contains(text, whole(tokens)) & contains_word(text, whole(tokens))
    overlap = F.size(F.filter(qt, lambda t: F.array_contains(ct, t)))
    only_weak = ~F.arrays_overlap(strong, ct) & (F.size(F.array_except(content, ct)) > 0)
    out = F.when(q == c, 100.0).when(inside(qt, ct) | inside(ct, qt) | joined(q, ct) | joined(c, qt), 80.0)
    return out.when(~F.arrays_overlap(qt, ct) | only_weak, 0.0).otherwise(overlap / F.greatest(F.size(qt), F.size(ct)) * 60)


def common_prefix(a, b) -> Column:
    """Number of leading tokens that two lists share."""
    a, b = _c(a), _c(b)
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    n = F.greatest(F.size(a), F.size(b))
    return F.when(differs == 0, n).otherwise(differs - 1).cast("int")


def extract_size(c) -> Column:
    """The first ``W x D [x H]`` of two or three digits each, joined by x; null if there is none."""
    text = _c(c)
    pattern = r"(?i)(\d{2,3})\s*[x×]\s*(\d{2,3})(?:\s*[x×]\s*(\d{2,3}))?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(part(1) != "", F.concat(part(1), F.lit("x"), part(2), F.when(part(3) != "", F.concat(F.lit("x"), part(3))).otherwise("")))


def size_numbers(c) -> Column:
    """All numbers of a size, sorted; none for null."""
    return F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"(\d+)")), lambda x: x.cast("int")))


def strip_name(text, name) -> Column:
    """A normalised text without any occurrence of a normalised name and, once, without its longest prefix of two words or more that occurs."""
    text, name = _c(text), _c(name)
    gone = F.when(name != "", F.replace(text, name, F.lit(" "))).otherwise(text)
    words = F.split(name, r"\s+")
    prefixes = F.when(F.size(words) > 2, F.transform(F.reverse(F.sequence(F.lit(2), F.size(words) - 1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")))
    found = F.get(F.filter(prefixes, lambda p: F.contains(gone, p)), F.lit(0))
    at = F.position(found, gone)
    return F.when(found.isNull(), gone).otherwise(F.concat(F.substring(gone, F.lit(1), at - 1), F.lit(" "), F.substring(gone, at + F.length(found), F.length(gone))))


def size_groups(text, name) -> Column:
    """Groups of two- and three-digit numbers, sorted, between ``and`` or commas of a question without its product's name; empty groups left out."""
    plain = strip_name(normalize(text), normalize(name))
    parts = F.split(plain, r"\band\b|,")
    numbers = lambda p: F.array_sort(F.transform(F.regexp_extract_all(F.regexp_replace(p, r"(\d)\s*[x×]\s*(?=\d)", "$1 "), F.lit(r"\b(\d{2,3})\b")), lambda x: x.cast("int")))
    return F.filter(F.transform(parts, numbers), lambda g: F.size(g) > 0)


def size_matches(wanted: Column, real: Column) -> Column:
    """Wanted numbers against real ones, both sorted: equal if as many, members if fewer, never if more."""
    same = F.array_join(wanted, ",") == F.array_join(real, ",")
    return F.when(F.size(wanted) == F.size(real), same).otherwise((F.size(wanted) < F.size(real)) & F.forall(wanted, lambda n: F.array_contains(real, n)))


def extract_tiers(text) -> Column:
    """Known tiers that stand as words in a text, in the order of the list."""
    q = normalize(text)
    return F.filter(words_literal(KNOWN_TIERS), lambda t: contains_word(q, t))


def size_words(c) -> Column:
    """Letter words of a size but units, and but an x between numbers."""
    chunks = F.regexp_extract_all(normalize(c), F.lit(r"([a-zø]+|\d+(?:[.,]\d+)?)"))
    number = lambda x: F.coalesce(x.rlike(r"^\d"), F.lit(False))
    between = lambda i: number(F.get(chunks, i - 1)) & number(F.get(chunks, i + 1))
    return F.filter(chunks, lambda x, i: ~number(x) & ~x.isin(*UNITS) & ~((x == "x") & between(i)))


def size_signals(text, name) -> Column:
    """Words of a question that may name a size: no weak ones and none of the name, those after size, style, version, option, model or code, and the one after the name."""
    q, n = normalize(text), normalize(name)
    loose, of_name = tokenize_loose(text), tokenize_loose(name)
    risky = words_literal(RISKY)
    plain = F.filter(loose, lambda w: (F.length(w) >= 2) & ~F.array_contains(risky, w) & ~F.array_contains(of_name, w))
    after = F.regexp_extract_all(q, F.lit(r"\b(?:size|style|version|option|model|code)\s+([a-z0-9]+)"))
    at = F.position(n, q)
    next_word = F.regexp_extract(F.when(at > 0, F.substring(q, at + F.length(n), F.length(q))).otherwise(""), r"^\s+([a-z0-9]+)", 1)
    return not_empty(F.array_union(F.array_union(plain, after), F.array(next_word)))


def short_code(c) -> Column:
    """``h:7`` of h.7 or h7, ``sp:4.5`` of sp.4.5; null if there is none."""
    text = normalize(c)
    pattern = r"\b(h|sp)[.\s]?\s*(\d+(?:\.\d+)?)\b"
    return F.when(F.regexp_extract(text, pattern, 1) != "", F.concat(F.regexp_extract(text, pattern, 1), F.lit(":"), F.regexp_extract(text, pattern, 2)))


def italian_number(c) -> Column:
    """A number rounded, with a dot between thousands."""
    return F.translate(F.format_number(F.round(_c(c)).cast("bigint"), 0), ",", ".")


def price_number(c) -> Column:
    """The number of a price text, dots being thousands and a comma the decimal; null if there is none."""
    text = F.replace(F.replace(F.regexp_replace(_c(c), "[^0-9.,]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(text.rlike(r"^\d+(\.\d*)?$|^\.\d+$"), text.try_cast("decimal(18,2)"))


def add_on_total(main, add_on) -> Column:
    """The sum of the digits of two prices, as a price."""
    digits = lambda x: F.regexp_replace(_c(x), "[^0-9]", "").try_cast("bigint")
    return italian_number(digits(main) + digits(add_on))


def price_display(c) -> Column:
    """A euro sign before a price that has a digit; others as they are."""
    text = _c(c)
    return F.when(text.rlike("[0-9]"), F.concat(F.lit("€"), text)).otherwise(text)


def display_name(name, overrides: dict[str, str] | None = None, qualifiers: dict[str, str] | None = None) -> Column:
    """A product's name to show: an override, else with its last (Qualifier) translated."""
    name = _c(name)
    inner = F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1)
    out = name
    if qualifiers:
        known = F.create_map(*(F.lit(x) for kv in qualifiers.items() for x in kv))
        word = F.try_element_at(known, inner)
        out = F.when(word.isNotNull(), F.concat(F.regexp_replace(name, r"\([^()]*\)\s*$", ""), F.lit("("), word, F.lit(")"))).otherwise(name)
    if overrides:
        out = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)), name), out)
    return out


def variant_suffix(variant, product) -> Column:
    """A normalised variant without its product's name; '' if the name contains the variant."""
    v, p = normalize(variant), normalize(product)
    return F.when(F.contains(p, v), "").otherwise(F.trim(F.replace(v, p, F.lit(""))))


def leading_digits(c) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"^(\d+)", 1), F.lit(""))


def chip_label(c) -> Column:
    """A label of 40 characters at most."""
    return F.when(F.length(_c(c)) > 40, F.concat(F.substring(_c(c), 1, 39), F.lit("…"))).otherwise(_c(c))


def title_case(c) -> Column:
    return F.initcap(_c(c))


def retry_milliseconds(c) -> Column:
    """Milliseconds of ``try again in 26m50.4s``; null without such words."""
    pattern = r"try again in (?:(\d+)m)?(\d+(?:\.\d+)?)s"
    part = lambda i: F.coalesce(F.regexp_extract(_c(c), pattern, i).try_cast("double"), F.lit(0.0))
    return F.when(_c(c).rlike(pattern), F.ceil((part(1) * 60 + part(2)) * 1000))


def strip_tiers(text, tiers: Column) -> Column:
    """A normalised text without the tier phrases of four letters or more, longest first."""
    ordered = F.array_sort(F.filter(tiers, lambda t: F.length(t) >= 4), lambda a, b: F.length(b) - F.length(a))
    cut = lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?i)(?:^|\W)\Q"), t, F.lit(r"\E(?:$|\W)")), F.lit(" "))
    return F.aggregate(ordered, normalize(text), cut)


def balanced(c) -> Column:
    """A text, or null if its parentheses don't balance."""
    text = _c(c)
    count = lambda x: F.length(text) - F.length(F.translate(text, x, ""))
    return F.when(count("(") == count(")"), text)


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
