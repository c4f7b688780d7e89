"""Licence scans: normalised sentences become identifiers, and rules are ordered sequences of them. Built-in functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of public licences and notices, by identifier.
SENTENCES: dict[int, str] = {
    1: "Released under the MIT License",
    2: "Licensed under the MIT License",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    5: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    6: "Licensed under the Apache License, Version 2.0",
    7: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    8: "you may not use this file except in compliance with the License",
    9: "You may obtain a copy of the License at",
    10: "This work is licensed under the GNU General Public License, version 3",
    11: "This program is free software",
    12: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    13: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    14: "Licensed under CC BY-NC 4.0",
    15: "Licensed under CC BY 4.0",
    16: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    17: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    18: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    19: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    20: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    21: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    22: "All rights reserved",
    23: "This project is licensed under the MIT License",
    24: "Distributed under the MIT License",
    25: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    26: "either version 2 of the License, or (at your option) any later version",
    27: "Licensed under the GNU General Public License v2.0",
    28: "Licensed under the GNU General Public License v3.0",
    29: "This library is free software",
    30: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    31: "either version 2.1 of the License, or (at your option) any later version",
    32: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    33: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    34: "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    35: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    36: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    37: "Licensed under the Mozilla Public License 2.0",
    38: "Licensed under the Mozilla Public License, Version 2.0",
    39: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    40: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    41: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    42: "Licensed under CC0 1.0",
    43: "Licensed under CC BY-SA 4.0",
    44: "Licensed under CC BY-ND 4.0",
    45: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    46: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    47: "This is free and unencumbered software released into the public domain",
    48: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    49: "Licensed under the BSD 2-Clause License",
    50: "Licensed under the BSD 3-Clause License",
    51: "Distributed under the Boost Software License, Version 1.0",
    52: "This work is licensed under the GNU General Public License, version 2",
}


@dataclass(frozen=True)
class LicenceRule:
    """A licence is found where these sentences stand in this order, up to ``GAP`` other known sentences between two of them."""

    licence: str
    sentences: tuple[int, ...]
    verdict: str  # allow, review or block


#: Other known sentences that may stand between two of a rule.
GAP = 3

#: Rules in the order in which they take sentences; what one rule took is there no more for those after it.
RULES = (
    LicenceRule("BSD-3-Clause", (18, 19, 20, 21), "allow"),
    LicenceRule("BSD-2-Clause", (18, 19, 20), "allow"),
    LicenceRule("BSD-3-Clause", (50,), "allow"),
    LicenceRule("BSD-2-Clause", (49,), "allow"),
    LicenceRule("MIT", (3, 4, 5), "allow"),
    LicenceRule("MIT", (1,), "allow"),
    LicenceRule("MIT", (2,), "allow"),
    LicenceRule("MIT", (23,), "allow"),
    LicenceRule("MIT", (24,), "allow"),
    LicenceRule("Apache-2.0", (7, 8, 9), "allow"),
    LicenceRule("Apache-2.0", (6,), "allow"),
    LicenceRule("AGPL-3.0", (11, 33, 13), "block"),
    LicenceRule("LGPL-3.0", (11, 32, 13), "review"),
    LicenceRule("LGPL-2.1", (29, 30, 31), "review"),
    LicenceRule("GPL-3.0", (11, 12, 13), "review"),
    LicenceRule("GPL-2.0", (11, 25, 26, 13), "review"),
    LicenceRule("GPL-3.0", (10,), "review"),
    LicenceRule("GPL-3.0", (28,), "review"),
    LicenceRule("GPL-2.0", (27,), "review"),
    LicenceRule("GPL-2.0", (52,), "review"),
    LicenceRule("MPL-2.0", (34, 35), "review"),
    LicenceRule("MPL-2.0", (34, 36), "review"),
    LicenceRule("MPL-2.0", (37,), "review"),
    LicenceRule("MPL-2.0", (38,), "review"),
    LicenceRule("ISC", (39,), "allow"),
    LicenceRule("0BSD", (40,), "allow"),
    LicenceRule("CC0-1.0", (41,), "allow"),
    LicenceRule("CC0-1.0", (42,), "allow"),
    LicenceRule("CC-BY-NC-4.0", (14,), "block"),
    LicenceRule("CC-BY-NC-4.0", (17,), "block"),
    LicenceRule("CC-BY-ND-4.0", (44,), "block"),
    LicenceRule("CC-BY-ND-4.0", (46,), "block"),
    LicenceRule("CC-BY-SA-4.0", (43,), "review"),
    LicenceRule("CC-BY-SA-4.0", (45,), "review"),
    LicenceRule("CC-BY-4.0", (15,), "allow"),
    LicenceRule("CC-BY-4.0", (16,), "allow"),
    LicenceRule("Unlicense", (47, 48), "allow"),
    LicenceRule("Unlicense", (47,), "allow"),
    LicenceRule("BSL-1.0", (51,), "allow"),
    LicenceRule("All-rights-reserved", (22,), "block"),
)

#: Marks before the first letter or digit of a line (indents, comment marks, bullets); ends of sentences; all else that isn't a letter or digit.
MARKS, ENDS, OTHER = r"\n[^\p{L}\p{N}\n]+", r"[.;:!?]+[ \t\r\n]+", r"[^\p{L}\p{N}\n]+"


def normalised(text) -> Column:
    """Column: a text in lower case, everything but letters and digits one space; a line feed where a line ends, two or more at an end of a sentence or a blank line (also one of marks only)."""
    text = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text)), MARKS, "\n")
    return F.regexp_replace(F.regexp_replace(text, ENDS, "\n\n"), OTHER, " ")


def plain(sentence: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def forms(sentences: dict[int, str]) -> dict[str, int]:
    """Normalised sentences, in both spellings of licence, to identifiers."""
    plains = [(plain(s), i) for i, s in sentences.items()]
    return {x.replace("license", spelling): i for x, i in plains if x for spelling in ("license", "licence")}


def pattern(rule: LicenceRule) -> str:
    """Regular expression of a rule over a sequence, a group for what stands between two sentences."""
    between = rf"((?:\d+ ){{0,{GAP}}}?)"
    return r"\b" + between.join(f"{i} " for i in rule.sentences)


def between(rule: LicenceRule, sign: str) -> str:
    """What is left of a match of ``pattern``: the groups, by the sign of references."""
    return "".join(f"{sign}{i}" for i in range(1, len(rule.sentences)))


def from_texts(texts: dict[str, tuple[str, str]], first_id: int = 1) -> tuple[dict[int, str], tuple[LicenceRule, ...]]:
    """Sentences and rules of whole licence texts (name to text and verdict): a rule is all sentences of a text in order.

    Equal sentences share an identifier; rules of more sentences come first, so that a text that holds a shorter one
    isn't taken for it. ``scan`` takes both in place of, or beside, the fixed ones.
    """
    ids: dict[str, int] = {}
    rules = []
    for name, (text, verdict) in texts.items():
        found = [x for x in map(plain, re.split(r"[.;:!?]+[ \t\r\n]+|\n[^\w\n]*\n", text)) if x]
        rules.append(LicenceRule(name, tuple(ids.setdefault(x, first_id + len(ids)) for x in found), verdict))
    return {i: x for x, i in ids.items()}, tuple(sorted((r for r in rules if r.sentences), key=lambda r: -len(r.sentences)))


def heads(known) -> dict[str, int]:
    """First two words of the known sentences (one, of those of one word) to the most words of a sentence that begins so."""
    words = [x.split(" ") for x in known]
    return {h: max(len(w) for w in words if " ".join(w[:2]) == h) for h in sorted({" ".join(w[:2]) for w in words})}


def identified(d: DataFrame, known: dict[str, int]) -> DataFrame:
    """Adds ``s``, the identifiers of the known sentences of ``text`` in order.

    The text is cut once into lines (``p``; an empty one where a sentence ends). A line whose first words begin a known
    sentence begins a candidate; the candidates are it and the lines after it, up to the end of the sentence and to
    as many lines as the sentence has words. Each is looked up in the set of known sentences, the longest counts.
    Costs follow the lines, not the dictionary: both look-ups are in hash sets.
    """
    begins = heads(known)
    single = [x for x in known if " " not in x]
    line = lambda i: F.nullif(F.get("p", i), F.lit(""))
    head = lambda i: F.substring_index(F.concat_ws(" ", line(i), line(i + 1)), " ", 2)
    begun = lambda i: line(i).isNotNull() & (head(i).isin(*begins) | F.get("p", i).isin(*single))
    most = F.create_map(*(F.lit(x) for h, n in begins.items() for x in (h, n)))
    after = lambda i: F.slice("p", i + 1, F.coalesce(F.try_element_at(most, head(i)), F.lit(1)))
    upto = lambda x: F.when(F.array_contains(x, ""), F.slice(x, 1, (F.array_position(x, "") - 1).cast("int"))).otherwise(x)
    joined = lambda x, n: F.array_join(F.slice(x, 1, n), " ")
    candidates = lambda r: F.transform(F.sequence(F.lit(1), F.size(r["x"])), lambda n: F.struct(r["at"].alias("at"), (r["at"] + n).alias("end"), joined(r["x"], n).alias("form")))
    longest = lambda r: F.try_element_at(F.filter(candidates(r), lambda c: c["form"].isin(*known)), F.lit(-1))
    ids = F.create_map(*(F.lit(x) for form, i in known.items() for x in (form, str(i))))
    # one that began up to a sentence's length before may reach over this one
    reach = max(begins.values())
    earlier = lambda j: F.slice("f", F.greatest(j - reach + 1, F.lit(1)), F.least(j, F.lit(reach)))
    free = lambda f, j: ~F.exists(earlier(j), lambda g: g["end"] > f["at"])
    d = d.withColumn("p", F.transform(F.split(normalised(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x)))
    d = d.withColumn("b", F.filter(F.sequence(F.lit(0), F.size("p") - 1), begun))
    d = d.withColumn("r", F.transform("b", lambda i: F.struct(i.alias("at"), upto(after(i)).alias("x"))))
    d = d.withColumn("f", F.filter(F.transform("r", longest), lambda f: f.isNotNull()))
    return d.withColumn("s", F.transform(F.filter("f", free), lambda f: F.element_at(ids, f["form"]))).drop("p", "b", "r", "f")


def scan(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, n_sentences, sequence, licences, verdict: known sentences of each text, in order, and the rules that they fulfil.

    Narrow: the dictionary and the rules are literals of the plan (a bounded table of known texts), nothing is
    shuffled, and a document of any length is one row. ``sequence`` holds the identifiers between spaces. Rules are
    tried in their order; each takes all the runs of sentences that fulfil it, so that a rule of fewer sentences
    after it doesn't find them again. ``licences`` has the distinct names in order, between commas; ``verdict`` the
    strictest (block, review, allow) or none.

    A known sentence may be wrapped over lines, with comment marks (without letters: #, *, //, ;;) before and (but for .;:!?) after
    each, but not over a blank line. It starts where a line or a sentence starts and ends where one ends, so a line
    alone counts as well; of several that start at one place the longest counts, and none that starts within another found one.

    Null and empty texts have no sentences and the verdict none. Repeated rows and null ids: a row for each.
    Empty table: no rows. Other columns are ignored.
    """
    known = forms(sentences)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = identified(d, known) if known else d.withColumn("s", F.array().cast("array<string>"))
    sequence = F.when(F.size("s") > 0, F.concat(F.lit(" "), F.array_join("s", " "), F.lit(" "))).otherwise("")
    d = d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), sequence.alias("sequence"))
    none = F.array().cast("array<string>")
    if rules:
        ordered = F.array(*(F.struct(F.lit(pattern(r)).alias("p"), F.lit(between(r, "$")).alias("left"), F.lit(r.licence).alias("l"), F.lit(r.verdict).alias("v")) for r in rules))
        start = F.struct(F.col("sequence").alias("q"), none.alias("l"), none.alias("v"))
        took = lambda a, r: F.struct(F.regexp_replace(a["q"], r["p"], r["left"]).alias("q"), F.concat(a["l"], F.array(r["l"])).alias("l"), F.concat(a["v"], F.array(r["v"])).alias("v"))
        applied = F.aggregate(ordered, start, lambda a, r: F.when(F.rlike(a["q"], r["p"]), took(a, r)).otherwise(a))
        d = d.withColumn("f", F.when(F.col("n_sentences") > 0, applied))
    else:
        d = d.withColumn("f", F.struct(none.alias("l"), none.alias("v")))
    has = lambda v: F.coalesce(F.array_contains("f.v", v), F.lit(False))
    verdict = F.when(has("block"), "block").when(has("review"), "review").when(has("allow"), "allow").otherwise("none")
    names = F.coalesce(F.array_join(F.array_sort(F.array_distinct("f.l")), ","), F.lit(""))
    return d.select("doc_id", "n_sentences", "sequence", names.alias("licences"), verdict.alias("verdict"))


def scan_sql(sentences: dict[int, str] = SENTENCES, rules=RULES) -> str:
    known = ", ".join(f"({i}, '{s}')" for s, i in forms(sentences).items())
    most = max(heads(forms(sentences)).values())
    steps = [f"""
q{k + 1} AS (SELECT rid, sequence, CASE WHEN regexp_matches(q, '{pattern(r)}') THEN regexp_replace(q, '{pattern(r)}', '{between(r, chr(92))}', 'g') ELSE q END AS q,
  CASE WHEN regexp_matches(q, '{pattern(r)}') THEN list_append(l, '{r.licence}') ELSE l END AS l,
  CASE WHEN regexp_matches(q, '{pattern(r)}') THEN greatest(v, {("allow", "review", "block").index(r.verdict) + 1}) ELSE v END AS v FROM q{k})""" for k, r in enumerate(rules)]
    return f"""
WITH known(id, s) AS (VALUES {known}),
d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
t AS (SELECT rid, string_split(regexp_replace(regexp_replace(regexp_replace(chr(10) || lower(coalesce(text, '')),
        '\\n[^\\p{{L}}\\p{{N}}\\n]+', chr(10), 'g'), '[.;:!?]+[ \\t\\r\\n]+', chr(10) || chr(10), 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)) AS l FROM d),
p AS (SELECT rid, trim(unnest(l)) AS x, unnest(range(len(l))) AS pos FROM t),
b AS (SELECT *, count_if(x = '') OVER (PARTITION BY rid ORDER BY pos) AS sentence FROM p),
w AS (SELECT rid, sentence, pos, x FROM b WHERE x <> ''),
a AS MATERIALIZED (SELECT * FROM w WHERE EXISTS (SELECT 1 FROM known k WHERE starts_with(k.s || ' ', w.x || ' '))),
r AS (SELECT a.rid, a.pos, list(w.x ORDER BY w.pos) AS x
      FROM a JOIN w ON w.rid = a.rid AND w.sentence = a.sentence AND w.pos >= a.pos AND w.pos < a.pos + {most} GROUP BY a.rid, a.pos),
c AS (SELECT rid, pos, pos + k AS until, array_to_string(x[1:k], ' ') AS s FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM r)),
n AS (SELECT rid, pos, max(until) AS until, arg_max(id, until) AS id FROM c JOIN known USING (s) GROUP BY rid, pos),
o AS (SELECT *, max(until) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM n),
f AS (SELECT rid, count(*) AS n, ' ' || string_agg(id::VARCHAR, ' ' ORDER BY pos) || ' ' AS sequence FROM o WHERE covered IS NULL OR covered <= pos GROUP BY rid),
q0 AS (SELECT rid, sequence, sequence AS q, []::VARCHAR[] AS l, 0 AS v FROM f),{",".join(steps)}
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_sentences, coalesce(f.sequence, '') AS sequence, coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') AS licences,
       CASE v WHEN 3 THEN 'block' WHEN 2 THEN 'review' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict
FROM d LEFT JOIN f USING (rid) LEFT JOIN q{len(rules)} USING (rid)
"""
