"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import json
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewright.llm import ann, bpe, chat, components, licenses, line_dedup, mixing, ngram_join, quality_model, quality_rules, urls

DOCS = "doc_id long, text string, source string, n_gone string, size string"
TEXTS = [None, "", "one", "a b c d e f g h i j k l", " x\ty\x0bz \n\n", "Grüße déjà <|endoftext|> 日本語 don't", "lorem ipsum " * 4000, "a b c d e f g h i j k l", "a b c d e f g h i j k m"]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id here", "s1", "", "")], DOCS)


def random_docs(n=120, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = [f"w{x}" for x in r.integers(0, 60, r.integers(1, 60))]
        out.append(" ".join(w))
        if i % 3 == 0:
            v = list(w)
            for _ in range(r.integers(0, 3)):
                v[r.integers(0, len(v))] = f"z{r.integers(0, 9)}"
            out.append(" ".join(v))
    return out


# ---- 1


def brute_lines(rows, least):
    """A line goes if a run of lines that holds it, of ``least`` words or more, equals one that ends before it."""
    docs = {}
    for i, t in sorted(rows):
        lines = [(k, words(x), re.sub("[\x09\x0b-\x0d]", " ", x).strip(" ")) for k, x in enumerate(t.split("\n"))]
        docs[i] = [x for x in lines if x[1]]
    runs = [(i, a, b, tuple(x[2] for x in d[a : b + 1])) for i, d in docs.items() for a in range(len(d)) for b in range(a, len(d)) if sum(len(x[1]) for x in d[a : b + 1]) >= least]
    ends = {}
    for i, _, b, run in runs:
        ends.setdefault(run, []).append((i, b))
    gone = {i: set() for i in docs}
    for i, a, b, run in runs:
        if any((j, end) < (i, a) for j, end in ends[run]):
            gone[i] |= {x[0] for x in docs[i][a : b + 1]}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_dedup_brute(spark, least):
    r = np.random.default_rng(least)
    kinds = ["", "a", "b b", "c c c", "d d", "e e e e e"]
    rows = [(i, "\n".join(kinds[k] for k in r.integers(0, 6, r.integers(1, 12)))) for i in range(60)]
    got = {x.doc_id: x.text for x in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    assert got == brute_lines(rows, least)


def test_line_dedup_edges(spark, docs):
    out = line_dedup.without_repeats(docs, 3).collect()
    assert len(out) == len(TEXTS) + 2
    by = {x.doc_id: x for x in out}
    assert by[0].text is None and by[1].text == "" and by[7].text == "" and by[3].text == TEXTS[3]
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0
    runs = line_dedup.repeated_runs(spark.createDataFrame([(1, "a a a\nb b b"), (2, "x\na a a\nb b b\ny")], "doc_id long, text string"), 3).collect()
    assert [tuple(x) for x in runs] == [(2, 1, 2)]


def test_line_dedup_first_copy(spark):
    line = "one two three four five"
    rows = [(1, "\n".join([line] * 8)), (2, "\n".join(["a b c d e", "f g h i j"] * 4 + ["end"])), (3, "x\n" + "\n".join([line] * 3) + "\ny")]
    got = {r.doc_id: (r.text, r.n_gone) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("\n".join([line] * 4), 4)  # the first run of 20 words stays whole
    assert got[2] == ("\n".join(["a b c d e", "f g h i j"] * 2 + ["end"]), 4)
    assert got[3] == (rows[2][1], 0)  # 15 words


def test_clashing_columns(spark):
    names = ["gone", "Lines", "id", "digest", "gone_id", "gone_digest", "_d", "_g", "_l", "row", "times", "words", "part", "taken_id", "taken_digest", "row_digest", "_w", "_s", "_t", "at", "a.b"]
    rows = [(i, "\n".join(["one two three four five"] * 8) + f" {i % 4}", f"s{i % 2}", *([f"c{i}"] * len(names))) for i in range(6)]
    rows += [rows[0], (None, rows[0][1], *rows[0][2:]), (None, "only here", *rows[0][2:])]
    d = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = line_dedup.without_repeats(d)
    assert out.columns == [*d.columns, "n_lines", "n_gone"] and out.count() == 9 and {r["a.b"] for r in out.collect()} == {f"c{i}" for i in range(6)}
    assert {r["gone"] for r in out.collect()} == {r["_l"] for r in out.collect()} == {f"c{i}" for i in range(6)}
    mixed = mixing.mixed(d, block_words=8)
    assert mixed.columns == d.columns and mixed.count() > 6 and all(r["_w"] == r["a.b"] == r["at"] for r in mixed.collect())
    kept = ngram_join.without_similar(d)
    assert kept.columns == d.columns and sorted((r.doc_id is None, r.row) for r in kept.collect()) == [*((False, f"c{i}") for i in range(4)), (True, "c0")]
    judged = quality_model.selected(d, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    assert judged.columns == d.columns


# ---- 2


def test_chat_links_orders_checks(spark):
    call = lambda i, n, a, after=(): {"id": i, "name": n, "arguments": a, "after": list(after)}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "early"})), (1, 2, "assistant", json.dumps({"tool_calls": [call("a", "add", '{"y": 2, "x":1}'), call("b", "add", '{"x":"1"}', ["a"])]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "3"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (1, 5, "assistant", json.dumps({"tool_calls": [call("a", "add", '{"x":1,"y":1}'), call("c", "odd", "{}"), call("d", "add", "nope")]})),
        (2, 0, None, None), (None, None, "user", ""), (2, 1, "assistant", json.dumps({"tool_calls": [call("p", "add", '{"x":1,"y":1}', ["q"]), call("q", "add", '{"x":1,"y":1}', ["p"])]})), (2, 2, "tool", json.dumps({"tool_call_id": "p"})), (2, 3, "tool", json.dumps({"tool_call_id": "q"})),
    ]
    schemas = {"add": (("x", "integer", True), ("y", "integer", True))}
    m = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    out = {(r.conv_id, r.turn, r.part): r for r in chat.formatted(chat.parts_of_messages(m), schemas).collect()}
    assert len(out) == 15
    early, first = out[1, 1, 0], out[1, 2, 0]
    assert (early.linked_turn, early.at, early.depth) == (2, 2, 1) and first.linked_turn == 1
    assert first.json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","role":"assistant"}'
    assert (first.problem, out[1, 2, 1].problem, out[1, 4, 0].problem, out[1, 5, 0].problem, out[1, 5, 1].problem, out[1, 5, 2].problem) == (None, "kind of x", "no call", "repeated", "unknown tool", "not an object")
    assert out[1, 2, 1].problem == "kind of x" and (out[1, 2, 1].at, out[1, 2, 1].depth) == (2, 2)
    assert {out[2, 1, 0].cyclic, out[2, 1, 1].cyclic} == {True}
    assert out[2, 0, 0].json == "{}" and out[None, None, 0].json == '{"content":"","role":"user"}'
    assert chat.formatted(chat.parts_of_messages(m.limit(0)), schemas).count() == 0


def test_chat_query_reads_tool_calls(spark, tmp_path):
    from pricewright.llm.queries import op2_chat

    call = lambda i, n, a, after=(): {"id": i, "name": n, "arguments": a, "after": list(after)}
    rows = [
        (1, 0, "user", "hi there"), (1, 1, "assistant", "hello"), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "early"})),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("a", "reply", '{"prompt":"x","words":"1"}'), call("b", "odd", "{}", ["a"])]})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (2, 0, "user", '{"no": "tool_calls"}'), (2, 1, "assistant", None), (None, 0, "system", ""),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn, r.call_id): (r.kind, r.linked_turn, r.at, r.problem) for r in op2_chat(spark, str(tmp_path)).collect()}
    assert got == {
        (1, 0, "turn-0"): ("call", 1, 0, None), (1, 1, "turn-0"): ("result", 0, 1, None), (1, 2, "a"): ("result", 3, 3, None), (1, 3, "a"): ("call", 2, 3, "kind of words"),
        (1, 3, "b"): ("call", None, 3, "unknown tool"), (1, 4, "zz"): ("result", None, 4, "no call"), (2, 0, "turn-0"): ("call", 1, 0, None), (2, 1, "turn-0"): ("result", 0, 1, None), (None, 0, None): ("message", None, 0, None),
    }
    plain, names = m.where("turn < 2"), ["conv_id", "turn", "part", "role", "kind", "call_id", "name", "arguments", "content", "after"]
    assert sorted(map(repr, chat.parts_of_messages(plain, turns=True).select(names).collect())) == sorted(map(repr, chat.parts_of_turns(plain).select(names).collect()))


def brute_order(needs, turns):
    """Places by repeated relaxation, from the definition; no cycles here."""
    place = {}
    for _ in range(len(needs) + 2):
        new = {}
        for x, y in needs:
            at, depth = place.get(y, (turns[y], 0))
            if at > turns[x] or at == turns[x] and (y in place or y[1] >= x[1]):
                new[x] = max(new.get(x, (-1, 0)), (at, depth + 1))
        if new == place:
            return place
        place = new
    raise AssertionError("a cycle")


def test_chat_orders_chains_and_cycles(spark):
    r = np.random.default_rng(3)
    rows, needs, turns = [], [], {}
    n = 50  # a chain against the order of turns: each call is after the result of the call one turn later
    for i in range(n):
        rows.append((1, i, "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "t", "arguments": "{}", "after": [f"c{i + 1}"]}]})))
        rows.append((1, n + i, "tool", json.dumps({"tool_call_id": f"c{n - 1 - i}", "content": ""})))
    order = r.permutation(60)  # 30 calls after up to three calls of smaller number, turns at random
    for i in range(30):
        after = [int(x) for x in r.choice(i, min(i, 3), replace=False)] if i % 2 else []
        rows.append((2, int(order[i]), "assistant", json.dumps({"tool_calls": [{"id": f"d{i}", "name": "t", "arguments": "{}", "after": [f"d{x}" for x in after]}]})))
        rows.append((2, int(order[30 + i]), "tool", json.dumps({"tool_call_id": f"d{i}", "content": ""})))
    for i in range(20):  # one ring
        rows.append((3, i, "assistant", json.dumps({"tool_calls": [{"id": f"e{i}", "name": "t", "arguments": "{}", "after": [f"e{(i + 1) % 20}"]}]})))
        rows.append((3, 100 + i, "tool", json.dumps({"tool_call_id": f"e{i}", "content": ""})))
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.parts_of_messages(m)
    p = [x.asDict() for x in parts.collect()]
    for conv in (1, 2):
        own = [x for x in p if x["conv_id"] == conv]
        call = {x["call_id"]: (x["turn"], x["part"], "call") for x in own if x["kind"] == "call"}
        result = {x["call_id"]: (x["turn"], x["part"], "result") for x in own if x["kind"] == "result"}
        needs = [(result[i], call[i]) for i in result] + [(call[x["call_id"]], result[y]) for x in own for y in x["after"] or [] if y in result]
        turns = {x: x[0] for pair in needs for x in pair}
        want = brute_order(needs, turns)
        got = {(x.turn, x.part, x.kind): (x["at"], x.depth, x.cyclic) for x in chat.ordered(parts.where(F.col("conv_id") == conv)).collect()}
        assert all(got[x] == (*want.get(x, (x[0], 0)), False) for x in turns)
    third = chat.ordered(parts.where("conv_id = 3")).collect()
    assert all(x.cyclic and x["at"] == x.turn for x in third if x.kind == "call")


def test_chat_long_numbers(spark):
    long = "123456789012345678901234567890123456789012345"
    cases = {
        f'{{"y": -{long}, "x":"a {long}, b", "z":[{long},1.5,{long}.5]}}': f'{{"x":"a {long}, b","y":-{long},"z":[{long},1.5,1.2345678901234567E44]}}',
        f'{{"y": 0{long}}}': None, f'{{"s":"{chr(92)}"{long}","y":{long}}}': f'{{"s":"{chr(92)}"{long}","y":{long}}}',
        f'{{"y":"{chat.MARK}1{chat.MARK}","z":{long}}}': f'{{"y":"{chat.MARK}1{chat.MARK}","z":1.2345678901234567E44}}',
        '{"y":12345678901234567890}': '{"y":12345678901234567890}', '{"t":"' + "q" * 50000 + '","y":[' + "1,[2]," * 20000 + long + "]}": '{"t":"' + "q" * 50000 + '","y":[' + "1,[2]," * 20000 + long + "]}",
    }
    d = spark.createDataFrame([(x, y, "t") for x, y in cases.items()], "arguments string, want string, name string")
    schemas = {"t": (("y", "integer", False), ("x", "string", False))}
    out = d.withColumn("got", chat.canonical(F.col("arguments"))).withColumn("problem", chat.problem_of(schemas)).collect()
    assert all(x.got == x.want for x in out)
    assert [x.problem for x in out] == ["unexpected", "not an object", "unexpected", "kind of y", None, "kind of y"]


# ---- 3


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark, docs):
    r = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(r.integers(0, 90))), ["b", "a", None, "", "ü", "z"][int(r.integers(0, 6)) if i % 3 else 0]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, block_words=64).toPandas()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 1 and g.source_size.iloc[0] == sizes[s]
    assert len(got) == 400 and (got.taken <= 2 * got["size"]).all()
    assert sorted(map(tuple, mixing.mix(d.repartition(7), block_words=64).select("doc_id", "taken").collect())) == sorted(map(tuple, got[["doc_id", "taken"]].to_numpy()))
    mixed = mixing.mixed(d, block_words=64)
    assert mixed.columns == d.columns and mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0] == got.taken.sum()
    assert mixing.mix(docs).count() == len(TEXTS) + 2 and mixing.mix(docs.limit(0)).count() == 0
    slots = mixing.schedule(mixing.boundaries(mixing.written(mixing.source_targets(mixing.sized(d), (5.0, 2.0, 1.0), 1.5, 2.0), "t"), 64)).toPandas()
    assert slots.slot.is_unique and not slots.duplicated(["key", "epoch", "block"]).any()


def test_mixing_keeps_rows_without_words(spark):
    rows = [(5, None, "a"), (5, None, "a"), (5, "", "a"), (5, "x y", "a"), (5, "x y", "a"), (None, None, None), (None, None, None), (6, "", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 8 and sum(r["size"] == 0 for r in got) == 6 and sum(r.taken for r in got) == 6
    assert {r.taken for r in got if r["size"] == 0} == {0}


# ---- 4


def test_licences(spark, docs):
    full = "Copyright.\n" + ". ".join(licenses.SENTENCES[i] for i in (18, 19, 22, 20, 21)) + "."
    d = spark.createDataFrame([(1, "x\nReleased under the  MIT License.\ny", ""), (2, full, ""), (3, "Licensed under CC BY-NC 4.0. Released under the MIT licence", ""), (4, ". ".join(licenses.SENTENCES[i] for i in (20, 19, 18)), "")], "doc_id long, text string, licences string")
    got = {r.doc_id: (r.licences, r.verdict) for r in licenses.scan(d).collect()}
    assert got == {1: ("MIT", "allow"), 2: ("All-rights-reserved,BSD-3-Clause", "block"), 3: ("CC-BY-NC-4.0,MIT", "block"), 4: ("", "none")}
    assert {r.verdict for r in licenses.scan(docs).collect()} == {"none"} and licenses.scan(docs.limit(0)).count() == 0


def test_licence_rules_take_sentences(spark):
    text = lambda *ids: ". ".join(licenses.SENTENCES[i] for i in ids) + "."
    cases = [
        (text(18, 19, 20, 21), "BSD-3-Clause", "allow"), (text(18, 19, 20), "BSD-2-Clause", "allow"), (text(18, 19, 20, 21, 18, 19, 20), "BSD-2-Clause,BSD-3-Clause", "allow"),
        (text(18, 19, 20, 21, 18, 19, 20, 21), "BSD-3-Clause", "allow"), (text(18, 1, 2, 6, 10, 19, 20), "Apache-2.0,GPL-3.0,MIT", "review"),  # too far apart
        (text(11, 25, 26, 13), "GPL-2.0", "review"), (text(11, 12, 13), "GPL-3.0", "review"), (text(29, 30, 31, 13), "LGPL-2.1", "review"), (text(11, 33, 13), "AGPL-3.0", "block"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0", "review"),
        ("Licensed under the Mozilla Public License 2.0", "MPL-2.0", "review"), ("Released under the MIT licence", "MIT", "allow"), (text(39), "ISC", "allow"), (text(40), "0BSD", "allow"), (text(42), "CC0-1.0", "allow"),
        (text(43), "CC-BY-SA-4.0", "review"), (text(44), "CC-BY-ND-4.0", "block"), (text(47, 48), "Unlicense", "allow"), (text(4, 3, 5), "", "none"),
    ]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.verdict) for r in licenses.scan(d).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert licenses.scan(d, rules=()).where("verdict <> 'none'").count() == 0


def test_licences_wrapped(spark):
    import textwrap

    groups = [(3, 4, 5), (6,), (7, 8, 9), (11, 12, 13), (16,), (17,), (18, 19, 20, 21), (22,)]
    rows, want = [], {}

    def add(text, ids):
        rows.append((len(rows), text))
        want[len(rows) - 1] = "".join(f" {i}" for i in ids) + " " if ids else ""

    for g in groups:
        text = ". ".join(licenses.SENTENCES[i] for i in g) + "."
        for width in (40, 76, 80):
            lines = textwrap.wrap(text, width)
            for first, last, end in (("", "", "\n"), ("# ", "", "\n"), (" * ", "", "\r\n"), ("// ", "  //", "\n"), (";; ", "", "\n"), ("! ", " |", "\n")):
                add(end.join(["/*", *(first + x + last for x in lines), "*/ code"]), g)
        add("Copyright 2020 Someone\n" + "\n\n".join("\n".join(textwrap.wrap(licenses.SENTENCES[i], 60)) + "." for i in g), g)
    nc = licenses.SENTENCES[17]
    half = nc.split(" ")
    for gap in ("\n\n", "\n \n", "\n#\n# ", ".\n", "\n \r\n"):  # a blank line or an end stands in the sentence
        add(" ".join(half[:5]) + gap + " ".join(half[5:]), ())
    add("some word " + nc, ())
    add(nc + " and more", ())
    add("a title\n# Released under the MIT License\nimport x\nAll rights\nreserved\nby us", (1, 22))
    add("Licensed under the Apache License, Version 2.0\n(the \"License\");\nAll rights reserved\nAll rights reserved", (7, 22, 22))
    add("x\n" * 20000 + "Licensed under\nCC BY 4.0", (15,))
    overlap = {**licenses.SENTENCES, 60: "Licensed under CC BY 4.0 or MIT License", 61: "MIT License", 62: "Free", 63: "MIT License or"}
    add("Licensed under CC BY 4.0 or\nMIT License\nMIT License\n", (60, 61))
    add("Licensed under CC BY 4.0\nMIT License\nor\nFREE\nas in free. Free!", (15, 63, 62, 62))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), overlap).collect()
    assert {r.doc_id: r.sequence for r in got} == {**want, len(rows) - 1: " 15 63 62 62 "}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows] + [None, 0], "text": [t for _, t in rows] + [None, ""]}))
    of_sql = [r for r in con.execute(licenses.scan_sql(overlap)).fetchall() if r[1]]
    assert sorted(of_sql) == sorted(tuple(r) for r in got if r.n_sentences)
    assert [r.sequence for r in licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}).collect()] == [""]


def test_licences_from_texts(spark):
    long = "The Plain Licence\n\nYou may copy this. You may sell this;\nyou must keep\nthis notice."
    short = "You may copy this. You may sell this."
    sentences, rules = licenses.from_texts({"Short": (short, "review"), "Plain": (long, "allow")}, first_id=100)
    assert [r.licence for r in rules] == ["Plain", "Short"] and len(sentences) == 4 and min(sentences) == 100
    d = spark.createDataFrame([(1, "# The Plain\n# Licence\n#\n# You may copy this. You\n# may sell this; you must\n# keep this notice.\n"), (2, short), (3, long + "\n\n" + short), (4, "You may sell this")], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licenses.scan(d, sentences, rules).collect()} == {1: "Plain", 2: "Short", 3: "Plain,Short", 4: ""}


# ---- 5


def test_bpe_like_library(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    own = bpe.ByteBpe(open(path, encoding="utf-8").read())
    for text in [*(x or "" for x in TEXTS), "a" * 3000, "\u00a0\u3000 x", "I'LL we'll", "<|endoftext|><|endoftext|>", "\x85\x1c\x1f a"]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids and own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    for n in (1, 2, 9, 500):
        ids = np.random.default_rng(n).integers(0, 50257, n).tolist()
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    got = bpe.encode_decode(docs, path, keep_ids=True, keep_text=True).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "null id here" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), path).count() == 0


# ---- 6


def brute_groups(rows, k, num, den):
    sets, parent = {}, {}
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_one_column(spark, monkeypatch):
    """All rows share a passage, in one column of the product; own words of different numbers decide which link."""
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    made = []
    between = ngram_join.between_groups
    monkeypatch.setattr(ngram_join, "between_groups", lambda *a: made.append(between(*a)) or made[-1])
    passage = " ".join(f"p{i}" for i in range(60))
    r = np.random.default_rng(6)
    rows = [(i, passage + "".join(f" own{i}x{j}" for j in range(r.integers(0, 9)))) for i in range(150)]
    rows += [(150 + i, " ".join(f"p{j}" for j in range(r.integers(0, 12), 60)) + f" q{i % 20} q{i % 7}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_groups(d, 3, 90, 100).collect()}
    assert got == brute_groups(rows, 3, 90, 100)
    assert made[0].count() < 2000  # of 26,335 pairs


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80), (1, 60), (2, 50)])
@pytest.mark.parametrize("short", [8, 2])
def test_ngram_join_brute(spark, monkeypatch, k, num, short):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    rows = list(enumerate(random_docs(60, k)))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, k, num, 100)


def test_ngram_join_edges(spark, docs):
    got = ngram_join.similar_groups(docs, 3, 90, 100).collect()
    assert len(got) == len(TEXTS) + 2
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert of[0] == (0, 0) and of[1] == (0, 1) and of[2] == (1, 2) and of[7] == (10, 3) and of[8] == (10, 8) and of[None] == (1, None)
    assert {r.doc_id for r in ngram_join.without_similar(docs, 3, 90, 100).collect()} == {0, 1, 2, 3, 4, 5, 6, 8, None}
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_ngram_join_copies_of_an_id(spark, monkeypatch, broadcast):
    from pricewright.llm import tables

    monkeypatch.setattr(tables, "BROADCAST_IDS", broadcast)
    a, b, c, d = ("one two three four five six seven", "q w e r t y u", "only rows without id here", "near copy of a long line that has many words in it so that few differ x")
    rows = [
        (1, a), (1, a), (1, a), (1, "a text of its own in id one"), (2, a), (2, c + " but two"), (None, a), (None, a.upper()), (3, b), (None, b), (None, c), (None, c), (None, c + " too"), (4, None), (4, ""), (None, None), (None, ""), (5, b), (5, b),
        (6, d), (7, d + " y"), (7, d + " y"), (None, d + " y"), (8, "last"),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = ngram_join.without_similar(t, 3, 80, 100)
    assert got.columns == t.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = [(1, a), (1, "a text of its own in id one"), (2, c + " but two"), (3, b), (4, ""), (6, d), (8, "last"), (None, c), (None, c + " too"), (None, ""), (None, "")]
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=key) == sorted(want, key=key)
    assert ngram_join.without_similar(t.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 40), (40, 77), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 40, 40: 40, 77: 40}


# ---- 7


def brute_measures(t):
    t = t or ""
    w = words(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in windows if windows.count(x) > 1} if len(w) < 3000 else set(windows)
    marked = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark, docs):
    texts = TEXTS + [t + "\n" + t[: len(t) // 2] + " # | x" for t in random_docs(40)] + ["a b c d e f " * 3 + "a", "p\np\n\nq\np", "x " * 9]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality_rules.judged(d).collect()
    for r in out:
        want = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
        lines, capitals = sum(bool(words(x)) for x in (texts[r.doc_id] or "").split("\n")), sum("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        soft = (10 * want[1] < 22 * want[0]) + (10 * want[1] > 140 * want[0]) + (100 * want[3] > 30 * lines) + (want[0] > 1000000)
        hard = 10 * want[2] > want[0] or 100 * capitals > 40 * want[1]
        assert r.kept == (not r.base_failed and not hard and soft <= 1)
    found = quality_rules.ledger(d)
    few = {r.rule: (r.failed, r.alone) for r in quality_rules.ablations(found).where("policy = 'base'").collect()}
    bits = [r.failed for r in found.collect()]
    assert few["few_words"] == (sum(b & 1 for b in bits), sum(b & 3 == 1 for b in bits))
    assert quality_rules.judged(docs).count() == len(TEXTS) + 2 and quality_rules.judged(docs.limit(0)).count() == 0


# ---- 8


def test_urls(spark):
    cases = [
        (0, None, "", "", None), (1, "no scheme.net/", "", "", None), (2, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"), (3, "http://x.net", "x.net", "", None), (4, "x://net/", "net", "/", "net/"),
        (5, "http://b.org/fr/", "b.org", "/fr/", "org/fr/"), (6, "http://notexample.com/de/", "notexample.com", "/de/", None), (7, "http://example.com/de/1", "example.com", "/de/1", "example.com/de/"), (8, "http://h?x/y", "h", "", None), (9, "a://b://c/d", "b:", "//c/d", None),
    ]
    bad = [(100 + i, "http://bad.com/" + str(i)) for i in range(40)] + [(200 + i, "http://good.com/" + str(i)) for i in range(40)]
    pages = spark.createDataFrame([(*c[:2], "x") for c in cases] + [(*b, "x") for b in bad] + [(None, "http://good.com/", "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(b[0], 0 if b[0] < 200 else 1, 0) for b in bad] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judged(pages, labels).collect()}
    for i, _, host, path, rule in cases:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
    assert [got[i].verdict for i in (2, 4, 5, 7, 100, 200, None)] == ["allow", "block", "allow", "block", "block", "allow", "allow"]
    assert {r.verdict for r in urls.judged(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"} and urls.judged(pages.limit(0), labels).count() == 0


# ---- 9


def test_ann(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 12)).astype(np.float32)
    x[300:450] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 12), (1100, [float("nan")] * 12), (1150, [1.0] * 11 + [None]), (1200, [1.0]), (None, [1.0] * 12), (1250, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash"))
    got = ann.neighbours(v).toPandas()
    x = x.astype(float)
    score = x @ x.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))
    hits = 0
    for q, g in got.groupby("query_id"):
        s = score[q].copy()
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        g = g.sort_values("rank")
        hits += len(set(best) & set(g.vec_id))
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(g.score, score[q][g.vec_id.to_numpy()], atol=1e-12)
    assert set(got.query_id) == set(range(0, 600, 50)) and hits >= 0.9 * 60
    few = ann.neighbours(v.where("vec_id < 3")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert ann.neighbours(v.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [4096, 100])
def test_ann_lengths(spark, monkeypatch, exact):
    monkeypatch.setattr(ann, "EXACT_ROWS", exact)
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=12 if i % 4 < 2 else 7 if i % 4 == 2 else 3).tolist()) for i in range(800)]
    rows += [(2000, [1.0, 2.0]), (2001, [2.0, 4.0]), (2002, [1.0, 0.0]), (2003, [2.0, 4.0]), (2003, [0.0, 0.0]), (2050, [1.0]), (50, [9.0, 9.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    of, hits, want_rows = {}, 0, 0
    for i, x in rows:
        if any(x):
            of.setdefault(len(x), []).append((i, np.array(x)))
    for q in [*range(0, 800, 50), 2000, 2050]:
        n, x = next((len(x), np.array(x)) for i, x in rows if i == q)
        best = sorted((-float(x @ y / np.sqrt((x @ x) * (y @ y))), i) for i, y in of[n] if i != q)[:5]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(best) + 1))
        want = {i: -s for s, i in best}
        hits += len(want.keys() & set(g.vec_id))
        want_rows += len(want)
        assert np.allclose([s for i, s in zip(g.vec_id, g.score) if i in want], [want[i] for i in g.vec_id if i in want], atol=1e-12)
        if n < 3 or n < 12 and exact == 4096:
            assert set(g.vec_id) == set(want)
    assert got[got.query_id == 2000].sort_values("rank").vec_id.tolist()[:2] == [2001, 2003] and len(got) == want_rows and hits >= 0.9 * want_rows


def brute_neighbours(x, ids, query, k=5):
    x = x / np.abs(x).max(axis=1, keepdims=True)
    score = (x * x[query]).sum(1) / np.sqrt((x * x).sum(1) * (x[query] ** 2).sum())
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]][:k]
    return {int(ids[i]): score[i] for i in order}


@pytest.mark.parametrize("lists", ["plain", "fine", "chunks"])
def test_ann_doubles(spark, monkeypatch, lists):
    """Double columns whose squares over- or underflow, centroids in two levels, and lists of several chunks of queries."""
    if lists == "fine":
        monkeypatch.setattr(ann, "COARSE", 3)
    if lists == "chunks":
        monkeypatch.setattr(ann, "CHUNK", 2)
    r = np.random.default_rng(9)
    x = r.normal(size=(700, 6)) * 10.0 ** r.integers(-200, 200, (700, 1))
    x[50], x[51], x[100], x[101] = [1e200, 0, 0, 0, 0, 0], [2e-200, 1e-201, 0, 0, 0, 0], [5e-324] + [0] * 5, [1.7e308] * 6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        want = brute_neighbours(x, np.arange(700), q)
        assert g.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5]
        found = dict(zip(g.vec_id, g.score))
        hits += len(found.keys() & want.keys())
        assert all(found[i] == pytest.approx(want[i], abs=1e-12) for i in found.keys() & want.keys())
    assert got.query_id.nunique() == 70 and hits >= 0.95 * 350


# ---- 10


def test_quality_model(spark, docs):
    r = np.random.default_rng(2)
    good, bad, worse = ([f"{k}{i}" for i in range(40)] for k in "gbw")
    rows = []
    for i in range(900):
        y = i % 3
        text = " ".join([*r.choice(good, 12), *(r.choice(bad, 4) if y < 2 else []), *(r.choice(worse, 4) if y < 1 else [])])
        rows.append((i, text, int(y > 0), int(y == 1)))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = d.where("doc_id < 600").select("doc_id", (F.col("quality") * 0 + F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1)).alias("quality"), F.when(F.col("doc_id") % 3 == 2, 0).otherwise(1).alias("toxic"))
    model = quality_model.fit(d, labels)
    assert (np.diff(model.thresholds) > 0).all()
    held = quality_model.score(d.where("doc_id >= 600"), model).toPandas()
    grade = held.doc_id % 3
    assert (held.selected == (grade == 2)).mean() > 0.97
    assert held[grade == 0].expected_grade.mean() < held[grade == 1].expected_grade.mean() < held[grade == 2].expected_grade.mean()
    kept = quality_model.selected(d, labels)
    assert kept.columns == d.columns and (kept.toPandas().doc_id % 3 == 2).mean() > 0.97
    assert quality_model.score(docs, model).count() == len(TEXTS) + 2 and quality_model.score(docs.limit(0), model).count() == 0
    assert quality_model.selected(d, labels.limit(0)).count() == 900


def ordinal_rows(n=240, levels=3, seed=4):
    r = np.random.default_rng(seed)
    rows = [np.unique(np.append(r.choice(12, 4, replace=False), 12)) for _ in range(n)]  # 12 is in all rows
    true = r.normal(size=13)
    score = np.array([true[x].sum() for x in rows]) + r.logistic(size=n) * 0.7
    return rows, np.digitize(score, np.quantile(score, [(k + 1) / levels for k in range(levels - 1)]))


def plain_likelihood(weights, cuts, rows, y):
    """Mean log likelihood of cumulative links, from the definition."""
    total = 0.0
    for x, grade in zip(rows, y):
        below = lambda k: 1.0 if k == len(cuts) else 0.0 if k < 0 else 1 / (1 + np.exp(weights[x].sum() - cuts[k]))
        total += np.log(below(grade) - below(grade - 1))
    return total / len(y)


def test_ordinal_gradients_and_likelihood():
    rows, y = ordinal_rows()
    r = np.random.default_rng(1)
    weights, steps = r.normal(size=13) * 0.3, np.array([-0.4, 0.2])
    cuts = quality_model.cuts_of(steps)
    hi, lo = quality_model.likelihoods(weights, steps, rows, y)
    assert np.log(hi - lo).mean() == pytest.approx(plain_likelihood(weights, cuts, rows, y), abs=1e-9)
    by_score, by_step = quality_model.slopes(weights, steps, rows, y)
    for k in range(13):
        d = np.eye(13)[k] * 1e-5
        want = (plain_likelihood(weights + d, cuts, rows, y) - plain_likelihood(weights - d, cuts, rows, y)) / 2e-5
        assert by_score[k] == pytest.approx(want, abs=1e-6)
    for k in range(2):
        d = np.eye(2)[k] * 1e-5
        want = (plain_likelihood(weights, quality_model.cuts_of(steps + d), rows, y) - plain_likelihood(weights, quality_model.cuts_of(steps - d), rows, y)) / 2e-5
        assert by_step[k] == pytest.approx(want, abs=1e-6)


def test_ordinal_fit_like_plain_optimiser(monkeypatch):
    """The fit without penalty comes to the likelihood, thresholds and tails of plain gradient ascent on all rows."""
    monkeypatch.setattr(quality_model, "BITS", 4)
    monkeypatch.setattr(quality_model, "hashed", lambda f: 12)
    rows, y = ordinal_rows()
    flat, ends = np.concatenate(rows).astype(np.int32), np.cumsum(list(map(len, rows)))
    model = quality_model.fit_ordinal(flat, ends, y, rounds=4000, rate=0.3, l1=0.0, batch=len(rows), rare=1)
    weights, steps = np.zeros(16), np.array([-0.5, 0.0])
    for _ in range(6000):
        cuts = np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))])
        at = np.array([weights[x].sum() for x in rows])
        edge = np.concatenate([[-40.0], cuts, [40.0]])
        hi, lo = 1 / (1 + np.exp(at - edge[y + 1])), 1 / (1 + np.exp(at - edge[y]))
        by_row = (lo * (1 - lo) - hi * (1 - hi)) / (hi - lo)  # the slope by the score
        g = np.zeros(16)
        for x, v in zip(rows, by_row):
            g[x] += v / len(rows)
        by_cut = np.array([(np.where(y == k, hi * (1 - hi), 0) / (hi - lo)).mean() - (np.where(y == k + 1, lo * (1 - lo), 0) / (hi - lo)).mean() for k in range(2)])
        weights, steps = weights + g, steps + np.array([by_cut.sum(), by_cut[1] * np.exp(steps[1])])
    cuts = quality_model.cuts_of(steps)
    assert plain_likelihood(model.weights, model.thresholds, rows, y) == pytest.approx(plain_likelihood(weights, cuts, rows, y), abs=2e-3)
    want = np.array([[1 / (1 + np.exp(c - weights[x].sum())) for c in cuts] for x in rows])
    assert np.abs(model.tails([x.astype(np.int32) for x in rows]) - want).max() < 0.03
    assert np.diff(model.thresholds)[0] == pytest.approx(np.diff(cuts)[0], abs=0.05)


# ---- what is too much to broadcast


def test_shuffled_paths_agree(spark, docs, monkeypatch):
    from pricewright.llm import tables

    d = spark.createDataFrame([(i, t + "\n" + t, f"s{i % 3}") for i, t in enumerate(random_docs(50))], "doc_id long, text string, source string").unionByName(docs.select("doc_id", "text", "source"))
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.com/") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 7 > 3), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    key = lambda x: sorted(map(repr, map(tuple, x.collect())))
    runs = [
        lambda: key(line_dedup.without_repeats(d, 5)), lambda: key(mixing.mixed(d, block_words=64)), lambda: key(mixing.mix(d, block_words=64)), lambda: key(ngram_join.without_similar(d, 3, 60, 100)),
        lambda: key(ngram_join.similar_groups(d, 3, 60, 100)), lambda: key(urls.judged(pages, labels)),
    ]
    want = [r() for r in runs]
    for module, name in ((tables, "BROADCAST_IDS"), (line_dedup, "BROADCAST_IDS"), (mixing, "BROADCAST_IDS"), (mixing, "BROADCAST_SOURCES"), (urls, "BROADCAST_HOSTS"), (components, "ONE_TASK"), (line_dedup, "FEW_KINDS")):
        monkeypatch.setattr(module, name, 0)
    assert [r() for r in runs] == want


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for (name, stage), keeps in zip(corpus_pipeline.STAGES[:-1], ("labels", "rows", "groups", None)):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        after = docs.collect()
        assert docs.columns == names and {r.doc_id for r in after} <= set(before)
        if keeps == "rows":
            got = brute_lines(list(before.items()), line_dedup.MIN_WORDS)
            assert {r.doc_id: r.text for r in after} == got
        if keeps == "groups":
            want = brute_groups(list(before.items()), 5, 80, 100)
            assert {r.doc_id for r in after} == {i for i, (_, g) in want.items() if g == i}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()) == sorted(r.decoded_sha256 for r in out)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows, clashing columns, an empty table: all stages run."""
    import corpus_pipeline
    from pricewright.sources import staging

    r = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 500, n))
    one, two = text(80), text(60) + "\n" + text(40)
    rows = [(1, one, "en", "a", 5, "x", "y"), (1, one, "en", "a", 5, "x", "y"), (2, one, None, "b", None, None, None), (3, two, "en", None, 1, "", ""), (4, None, None, None, None, None, None), (5, "", "en", "a", 0, "", "")]
    rows += [(None, two, "en", "a", 1, "x", "y"), (None, None, None, None, None, None, None), (None, text(50), "fr", "a", 1, "", ""), (6, text(30000), "de", "b", 1, "", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string, `a.b` string")
    for name, part in (("some", d), ("none", d.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(99, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        counts = []
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(f(spark, docs, str(tmp_path / name)), stage)
            assert docs.columns == d.columns
            counts.append(docs.count())
        begun = staging.staged_so_far(spark)
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len(out) == counts[-1] and staging.staged_so_far(spark) == begun + 1
        if name == "none":
            assert counts == [0, 0, 0, 0]
        else:
            assert counts[:2] == [10, 10]
            # the copies of id 1, its text under id 2, and the text of id 3 without id are left out; texts without words stay to the mix
            kept = {x.doc_id for x in ngram_rows(spark, d)}
            assert kept == {1, 3, 4, 5, 6, None}


def ngram_rows(spark, d):
    return ngram_join.without_similar(d).collect()


def test_neighbours_in_dense_groups(spark):
    """More groups of near vectors than lists, dense to different degrees, and queries that lie elsewhere than the other vectors: nearest ones are found where codes can't tell them apart."""
    random = np.random.default_rng(8)
    for spread, apart in ((0.1, 0.0), (0.001, 0.0), (0.01, 1.0)):
        x = random.standard_normal((50, 32))[random.integers(0, 50, 4000)] + spread * random.standard_normal((4000, 32))
        x[::50] += apart * random.standard_normal((80, 32))
        got = ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u[::50] @ u.T
        near[np.arange(80), np.arange(0, 4000, 50)] = -9
        want = {(50 * i, int(j)) for i, row in enumerate(np.argsort(-near, axis=1)[:, :5]) for j in row}
        assert len(got) == 400 and len(want & set(zip(got["query_id"], got["vec_id"]))) >= 0.9 * len(want)
