"""Hard negatives, fill-in-middle and toxicity against brute force, on small fixtures with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import chat, fim, hard_negatives, line_dedup, mixing, toxicity

SPACES = "\x20\x09-\x0d"


# ---- 11

VECTORS = "vec_id long, embedding array<double>, label int, row string, n string, anchor string"


def brute_negatives(rows, every=100, kp=5, k=5, low=80, high=100, scale=256):
    rows = [(i, [math.floor(scale * x) if abs(x) < 1e300 else scale * int(x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: min(2**63 - 1, max(-(2**63), s))
    out = []
    for at, (i, a, y) in enumerate(rows):
        if i % every:
            continue
        scored = [(clip(sum(p * q for p, q in zip(a, b))), j, z) for other, (j, b, z) in enumerate(rows) if other != at and len(a) == len(b)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for s, j, _ in [x for x in scored if x[2] == y][:kp]:
            fits = [x for x in scored if x[2] != y and low * s <= 100 * x[0] <= high * s]
            out += [(i, j, r, m, s, t) for r, (t, m, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS)
    return sorted((x.anchor_id, x.positive_id, x["rank"], x.negative_id, x.positive_score, x.negative_score) for x in hard_negatives.mined(df, **how).collect())


def test_hard_negatives_brute(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), (r.normal(size=12) / 4).tolist(), int(r.integers(0, 4))) for i in range(900)]
    assert mined(spark, rows, every=50) == brute_negatives(rows, every=50) != []


def test_hard_negatives_copies_and_edges(spark):
    """A third of the rows one vector of one label, ties, repeated rows and ids, all kinds of rows that take no part, other lengths."""
    r = np.random.default_rng(6)
    rows = [(int(i), [0.5, 0.25, -0.125], int(i % 5 == 0)) for i in range(150)]
    rows += [(int(i), r.integers(-3, 4, 3).astype(float).tolist(), int(r.integers(0, 3))) for i in range(150, 420)]
    rows += [rows[100], rows[200], (100, [1.0, 1.0, 1.0], 0), (300, [], 1), (400, [], 1), (7, [], 2), (800, [2.0], 1), (801, [1.0], 1), (802, [1.75], 3)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (900, None, 1), (900, [1.0, None, 1.0], 1), (900, [1.0, math.inf, 1.0], 1), (900, [math.nan, 0.0, 0.0], 1), (900, [9.0, 9.0, 9.0], None)]
    assert mined(spark, rows) == brute_negatives(rows) != []


def test_hard_negatives_large_components(spark):
    """Integers beyond 32, 53 and 63 bits are exact as long as their product is a long, and stop at its ends beyond it."""
    rows = [(i, [x, y], z) for i, (x, y, z) in enumerate([(1e9, 1e-3, 0), (9e8, 0.5, 0), (8.9e8, 3.0, 1), (7.3e8, -1e5, 1), (-1e200, 1.0, 1), (1e200, 0.0, 0), (1e306, 1.0, 1), (3e7, 0.0, 1)])]
    assert mined(spark, rows, every=1) == brute_negatives(rows, every=1) != []


def test_hard_negatives_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mined(empty).count() == 0
    assert hard_negatives.mined(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    one = spark.createDataFrame([(100, [1.0], 1, "", "", "")], VECTORS)
    assert hard_negatives.mined(one).count() == 0


def test_planes_hold_the_score_at_every_bit():
    r = np.random.default_rng(2)
    c, a = r.integers(-300, 300, (40, 7)), r.integers(-90, 90, (3, 7))
    planes = hard_negatives.Planes(c)
    seen = []

    def coarse(lower, upper, alive):
        true = a @ c.T
        assert (lower <= true).all() and (true <= upper).all()
        seen.append((upper - lower).max())
        return np.ones_like(alive)

    out = hard_negatives.sieve(a, planes, np.ones((3, 40), dtype=bool), coarse, None)
    assert all((s == a[i] @ c.T).all() for i, (_, s) in enumerate(out))
    assert seen == sorted(seen, reverse=True) and seen[-1] == 0 and len(seen) == planes.top


# ---- 12


def brute_fim(doc_id, text, rate=50, spm=80):
    t = text or ""
    units = re.findall(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+", t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t, t
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


def test_fim_brute(spark):
    r = np.random.default_rng(1)
    letters = list("ab<>PSM \t\n\x0b\x0c\r\x1c é日🙂")
    texts = ["".join(r.choice(letters, r.integers(0, 40))) for _ in range(400)] + [None, "", " ", "a", " a ", "x<P>y", "<S>", "word " * 60_000, "<", "é" * 5000]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(3, texts[3], "", 1), (None, "no id here", "", 1), (10**18 + 1, "long id", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fim.transformed(df).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *(w := brute_fim(i, t))[:5], sha(w[4]), sha(w[5])) for i, t, _, _ in rows]
    key = lambda x: tuple(map(repr, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fim.transformed(df.limit(0)).count() == 0


def test_fim_restores_at_sentinel_like_ends():
    for text in ("< S> <", "<S <P <M", ">P> >S> <<< <S", "P>S>M>"):
        for key in map(str, range(300)):
            n, form, a, b, output = fim.cut(text, key, 100, 50, 42, fim.SENTINELS)
            assert fim.restore(output, form) == text


def test_fim_refuses_overlapping_sentinels(spark):
    with pytest.raises(ValueError):
        fim.transformed(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=("aa", "<S>", "<M>"))


# ---- 13


def brute_segments(s):
    """By the definition: every part scores less, and no larger segment has that property."""
    n, total = len(s), np.concatenate([[0], np.cumsum(s)])
    of = lambda a, b: total[b] - total[a]
    good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if of(a, b) > 0 and all(of(x, y) < of(a, b) for x in range(a, b) for y in range(x + 1, b + 1) if (x, y) != (a, b))]
    return [(a, b, int(of(a, b))) for a, b in good if not any((x, y) != (a, b) and x <= a and b <= y for x, y in good)]


def test_segments_brute():
    r = np.random.default_rng(4)
    for _ in range(150):
        s = r.integers(-4, 4, r.integers(0, 22))
        assert toxicity.segments(s) == sorted(brute_segments(s))


def test_segments_are_linear():
    for s in (np.tile([1, -2], 200_000), np.tile([3, -2], 200_000), np.concatenate([np.tile([1, -2], 100_000), np.tile([3, -1], 200_000)])):
        found = toxicity.segments(s)
        assert sum(x[2] for x in found) > 0 and found == sorted(found)


def test_extreme_values_of_known_law():
    r = np.random.default_rng(8)
    n = r.integers(50, 500, 4000)
    best = np.maximum(0, (np.log(0.02 * n) + r.gumbel(size=4000)) / 1.5 * toxicity.UNIT)
    rate, k = toxicity.extreme_values(best, n)
    assert abs(rate - 1.5) < 0.15 and 0.015 < k < 0.027


def corpus(n=600, seed=9):
    r = np.random.default_rng(seed)
    plain, bad = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vin", "dor", "pel")], ["vile", "Filth!", "vermin", "scorned"]
    rows, labels = [], []
    for i in range(n):
        w = list(r.choice(plain, r.integers(5, 80)))
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            w.insert(int(r.integers(0, len(w))), str(r.choice(bad)))
        rows.append((i, " ".join(w), "clash", 1))
        labels.append((i, 1, toxic))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, score string, fold int", "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    rows += [(None, "vile vermin vile", "", 0), (5000, None, "", 0), (5001, "", "", 0), (5002, "karen " * 30_000 + "vile vermin vile vermin", "", 0), rows[6]]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], LABELS)
    model = toxicity.fit(docs, marks)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    truth = {i: y for i, _, y in labels}
    for x in out:
        assert x.held_out == (x.doc_id is None or zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        if x.doc_id in truth:
            assert x.predicted == truth[x.doc_id]
    by = {x.doc_id: x for x in out}
    assert by[None].predicted == 1 and by[5002].predicted == 1 and by[5000].score == by[5001].score < 0.2
    found = [x for x in toxicity.passages(docs, model).collect() if x.doc_id == 5002]
    assert [(x.from_word, x.to_word, x.passage) for x in found] == [(30_000, 30_004, "vile vermin vile vermin")] and found[0].e_value < 0.01


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, DOCS)
    scores = lambda marks: sorted((x.doc_id, x.score) for x in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(marks, LABELS))).collect())
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    assert scores(labels) == scores(flipped)


def test_toxicity_counts_by_brute(spark):
    rows, labels = corpus(120)
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    seen = [(set(t.split()), y) for (i, t, _, _), (_, _, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5]
    at = toxicity.hashed("w vermin")
    assert model.seen[at] == sum("vermin" in s for s, _ in seen) and model.toxic[at] == sum("vermin" in s and y for s, y in seen)
    assert model.documents == (sum(y for _, y in seen), len(seen))


def test_toxicity_without_classes(spark):
    rows, labels = corpus(40)
    docs = spark.createDataFrame(rows, DOCS)
    none = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], LABELS))).agg(F.min("score"), F.max("score")).first()
    assert 0 <= none[0] <= none[1] <= 1
    clean = toxicity.fit(docs, spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], LABELS))
    assert toxicity.score(docs, clean).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), clean).count() == 0 and toxicity.passages(docs.limit(0), clean).count() == 0


# ---- 3, in slot order


def brute_mix(rows, hashes, targets, block_words):
    """Pieces (slot, doc_id, from_word, to_word) by the definition: golden-ratio points through cumulative shares, ranks by source, blocks of its shuffled words."""
    by = {}
    for i, size, source in sorted(rows, key=lambda x: (hashes[x[0]], x[0])):
        by.setdefault(source, []).append((i, size))
    plans = {}
    for source, docs in by.items():
        total, words = sum(n for _, n in docs), round(targets[source])
        blocks = -(-total // block_words)
        if not blocks:
            continue
        small, extra = divmod(total, blocks)
        ends = np.cumsum([small + (b < extra) for b in range(blocks)]).tolist()
        epochs, rest = divmod(words, total)
        slots = epochs * blocks + (next(b for b, e in enumerate(ends) if e > rest - 1) + 1 if rest else 0)
        plans[source] = (docs, ends, rest, epochs, slots)
    order = sorted(plans, key=lambda s: "n" if s is None else "s" + s)
    edges, total = np.cumsum([0, *(plans[s][4] for s in order)]).tolist(), sum(plans[s][4] for s in order)
    rank, taken, out = dict.fromkeys(order, 0), {}, []
    for slot in range(total):
        u = slot % 2**32 * 2_654_435_769 % 2**32 / 2**32
        source = next(s for s, lo, hi in zip(order, edges, edges[1:]) if lo / total <= u < hi / total)
        if rank[source] < plans[source][4]:
            taken[slot] = (source, rank[source])
            rank[source] += 1
    for source in order:
        for r in range(rank[source], plans[source][4]):
            out.append((total + r, source, r))
    for slot, source, r in [*((k, *v) for k, v in taken.items()), *out]:
        docs, ends, rest, epochs, _ = plans[source]
        epoch, block = divmod(r, len(ends))
        lo, hi = (ends[block - 1] if block else 0), ends[block]
        hi = min(hi, rest) if epoch == epochs else hi
        at = 0
        for i, n in docs:
            a, b = max(lo, at), min(hi, at + n)
            if a < b:
                yield slot, source, i, a - at, b - at
            at += n


@pytest.fixture(scope="module")
def mix_rows(spark):
    r = np.random.default_rng(11)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 90))), ["b", "a", None, "", "z"][int(r.integers(0, 5)) if i % 3 else 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {x.doc_id: x.h for x in df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 2).alias("h")).collect()}
    return rows, df, hashes


@pytest.mark.parametrize("block_words", [16, 64])
def test_mix_follows_its_schedule(mix_rows, block_words):
    rows, df, hashes = mix_rows
    got = mixing.mix(df, block_words=block_words).collect()
    targets = {x.source: x.target for x in got}
    pieces = list(brute_mix([(i, len(t.split()), s) for i, t, s in rows], hashes, targets, block_words))
    want = {i: (0, None, 0) for i, _, _ in rows}
    for slot, _, i, a, b in pieces:
        n, first, slots = want[i]
        want[i] = (n + b - a, slot if first is None else min(first, slot), slots + 1)
    assert {x.doc_id: (x.taken, x.first_slot, x.n_slots) for x in got} == want


def test_mix_of_another_schedule_differs(mix_rows, monkeypatch):
    _, df, _ = mix_rows
    slots = lambda **how: sorted((x.doc_id, x.first_slot, x.n_slots) for x in mixing.mix(df, **how).collect() if x.taken)
    before = slots(block_words=32)
    assert slots(block_words=48) != before
    monkeypatch.setattr(mixing, "GOLDEN", 0)
    assert slots(block_words=32) != before


def test_every_beginning_of_the_mix_holds_the_shares(mix_rows):
    """In slot order each source's words stay within a few blocks (and a document) of its share."""
    _, df, _ = mix_rows
    rows = mixing.mixed(df, block_words=32).toPandas()  # in the order of its partitions
    words = np.array([len(t.split()) for t in rows.text])
    up_to = np.cumsum(words)
    for source in rows.source.drop_duplicates():
        mine = (rows.source == source) if source is not None else rows.source.isna()
        own = np.cumsum(words * mine.to_numpy())
        assert np.abs(own - up_to * own[-1] / up_to[-1]).max() <= 6 * 32 + 90


def test_mixed_table_is_written_in_slot_order(spark, mix_rows, tmp_path):
    _, df, _ = mix_rows
    at = str(tmp_path / "mix")
    mixing.mixed(df, block_words=32).write.parquet(at)
    parts = [spark.read.parquet(str(f)).toPandas() for f in sorted((tmp_path / "mix").glob("part-*"))]
    want = mixing.copies(df, block_words=32).orderBy("slot", "at").toPandas()
    assert [i for p in parts for i in p.doc_id] == want.doc_id.tolist()


def test_equal_rows_share_odd_numbers_of_words(spark):
    """Two equal rows of 10 words and a target of 29 words in all: none is lost."""
    rows = [(1, "a b c d e f g h i j", "s", k) for k in range(2)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang long"), share=1.45, block_words=4).collect()
    assert sorted(len(x.text.split()) for x in got) == [9, 10, 10] and {x.lang for x in got} == {0, 1}


# ---- 1 and 2


def test_second_hash_of_lines_is_no_function_of_the_first(spark):
    import xxhash

    docs = spark.createDataFrame([(1, "a line"), (2, "another line")], "doc_id long, text string")
    for x in line_dedup.line_table(docs, 2).collect():
        line = x.lines[0]
        signed = lambda v: v - 2**64 if v >= 2**63 else v
        text = {1: b"a line", 2: b"another line"}[x.doc_id]
        assert line.h == signed(xxhash.xxh64(text, seed=42).intdigest())
        assert line.h2 == signed(xxhash.xxh64(text, seed=xxhash.xxh64(b"second", seed=42).intdigest()).intdigest())
        assert line.h2 != signed(xxhash.xxh64(b"second", seed=line.h % 2**64).intdigest())


def messages(calls):
    """One call with its needs each turn, then its result the turn after; ``calls``: conversation, turn, name, names of calls whose results it needs, turn of the result."""
    out = []
    for conv, turn, name, after, answered in calls:
        out.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": name, "name": "t", "arguments": "{}", "after": after}]})))
        out.append((conv, answered, "tool", json.dumps({"tool_call_id": name, "content": "ok"})))
    return out


def relaxed(needs):
    """Places by relaxation from the definition, and what is in or behind a cycle."""
    place, nodes = {}, {n for n, _ in needs}
    by = {n: [x for m, x in needs if m == n] for n in nodes}
    open_ = set(nodes)
    while ready := [n for n in open_ if not any(x in open_ for x in by[n])]:
        for n in ready:
            behind = []
            for x in by[n]:
                at, depth = place.get(x, (x[0], 0))
                if at > n[0] or (at == n[0] and (depth or x[1] >= n[1])):
                    behind.append((at, depth + 1))
            place[n] = max(behind, default=(n[0], 0))
        open_ -= set(ready)
    return place, open_


def test_chat_places_by_relaxation(spark):
    r = np.random.default_rng(12)
    calls = []
    for conv in range(12):
        names, turns = [f"c{i}" for i in range(14)], r.permutation(32)
        for i, name in enumerate(names):
            pool = names[:i] if conv % 3 else names  # every third conversation may hold cycles
            some = r.choice(pool, min(len(pool), int(r.integers(0, 3))), replace=False).tolist() if pool else []
            calls.append((conv, int(turns[2 * i]), name, some, int(turns[2 * i + 1])))
    parts = chat.parts_of_messages(spark.createDataFrame(messages(calls), "conv_id long, turn long, role string, text string"))
    needs = [(x.conv_id, tuple(x.node), tuple(x.need)) for x in chat.needs_of(parts).collect()]
    got = {(x.conv_id, (x.turn, x.part, x.kind)): (x["at"], x.depth, x.cyclic) for x in chat.ordered(parts).collect()}
    cycles = 0
    for conv in range(12):
        place, stuck = relaxed([(n, x) for c, n, x in needs if c == conv])
        for n, p in place.items():
            assert got[conv, n] == (*p, False), (conv, n)
        for n in stuck:
            assert got[conv, n] == (n[0], 0, True)
        cycles += bool(stuck)
    assert 0 < cycles < 12


def test_chat_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 1,000 delayed calls; a cycle elsewhere costs no round more."""
    n, made = 1000, []
    calls = [(1, i, f"c{i}", [f"c{i - 1}"] if i else [], i + (2500 if not i else 1)) for i in range(n)]
    calls += [(2, i, f"e{i}", [f"e{(i + 1) % 3}"], i + 1) for i in range(3)]
    parts = chat.parts_of_messages(spark.createDataFrame(messages(calls), "conv_id long, turn long, role string, text string"))
    kept = chat.written
    monkeypatch.setattr(chat, "written", lambda df, name: made.append(name) or kept(df, name))
    out = {(x.conv_id, x.turn, x.kind): x for x in chat.ordered(parts).collect()}
    assert made.count("paths") <= 14
    assert {out[2, i, "call"].cyclic for i in range(3)} == {True}
    assert out[1, n - 1, "call"]["at"] == 2500 and out[1, n - 1, "call"].depth == 2 * n - 3
