"""Fill-in-middle transformation: texts cut at word ends into prefix, middle and suffix, and put together again with sentinels."""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .tables import small_batches

#: A unit: a word with the white space before it, or white space that no word follows.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: What the transformation returns for each text.
CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """The place at which each unit of ``text`` ends, in code points, four bytes each."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def seeds(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits from the hash of the seed and a row's key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(text: str, key: str, rate: int, spm: int, seed: int, sentinels: tuple[str, str, str]) -> tuple:
    """n, form, prefix and middle length (None if plain) and the output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h = seeds(seed, key)
    if not text or h[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text of an output and its form alone; a part holds no sentinel, so the first one after it ends it."""
    if form == "plain":
        return output
    p, s, m = sentinels
    opening, between = (s, p) if form == "spm" else (p, s)
    left, _, rest = output[len(opening) :].partition(between)
    right, _, middle = rest.partition(m)
    prefix, suffix = (right, left) if form == "spm" else (left, right)
    return prefix + middle + suffix


def transformed(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Every text as training input for filling in: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    ``rate`` % of texts are cut at two of their n + 1 unit ends, drawn from a hash of seed and id, ``spm`` % of these with the
    suffix first. ``restored_sha256`` is that of the text which ``restore`` makes of output and form alone. Narrow: an
    Arrow-batched pandas UDF, no shuffle, memory bounded by a batch of rows and four bytes for each unit of one text.

    Null and empty texts are plain and empty. Texts that hold a sentinel are plain. Very long texts are cut whole. Equal
    ids draw equal numbers; rows without id draw those of an empty key. A row of its own for each input row,
    repeated ones included; an empty table gives none. Other columns are ignored, whatever their names.
    """
    if any(len(s) < 2 or s[0] != "<" or s[-1] != ">" or set(s[1:-1]) & {"<", ">"} for s in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels are three different names in <>, which can't overlap with text around them")
    sentinels = tuple(sentinels)

    @pandas_udf(CUT)
    def run(text: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k in zip(text, key):
            n, form, a, b, output = cut(t, k, rate, spm, seed, sentinels)
            back = restore(output, form, sentinels)
            rows.append((n, form, a, b, output, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CUT.split(", ")], dtype=object)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), run(F.coalesce("text", F.lit("")), key).alias("cut"))
    return rows.select("doc_id", "cut.*")


FIM_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END AS output FROM parts),
back AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'spm' THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(substr(output, 4), '<P>', 1)
    ELSE split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1) END AS restored FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back
"""
