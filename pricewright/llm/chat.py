"""Chat formatting: tool calls are linked to their results, ordered, checked against schemas and written as canonical JSON. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Parameters of a tool: name, kind (string, integer, number, boolean, object or array), and whether it must be there.
Schemas = dict[str, tuple[tuple[str, str, bool], ...]]

#: The tool of the production query, which reads a user's turn as a call that the next assistant turn answers.
REPLY: Schemas = {"reply": (("prompt", "string", True), ("words", "integer", True), ("system", "string", False))}

#: What a schema kind may be as a variant.
KINDS = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}

MESSAGE = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string,content:string>"


def parts_of_messages(messages: DataFrame, turns: bool = False) -> DataFrame:
    """conv_id, turn, part, kind, role, call_id, name, arguments, content, after: the parts of messages (conv_id, turn, role, text).

    A text that is a JSON object with ``tool_calls`` (id, name, arguments, and ``after``: ids whose results a call
    needs) has a part for each call; one with ``tool_call_id`` is a result; any other is a plain message, or with
    ``turns`` what ``parts_of_turns`` makes of it.
    """
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    # only texts that can be such objects are parsed
    likely = F.ltrim(F.coalesce("text", F.lit(""))).startswith("{") & (F.col("text").contains('"tool_calls"') | F.col("text").contains('"tool_call_id"'))
    m = m.withColumn("j", F.when(likely, F.from_json("text", MESSAGE)))
    none = F.lit(None).cast("string")
    shape = lambda kind, i, name, arguments, content, after: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), i.alias("call_id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"), after.alias("after"))
    no_ids = F.lit(None).cast("array<string>")
    calls = F.transform("j.tool_calls", lambda c: shape("call", c["id"], c["name"], c["arguments"], none, c["after"]))
    result = F.array(shape("result", F.col("j.tool_call_id"), none, none, F.col("j.content"), no_ids))
    plain = F.array(shape(*turn_part(), no_ids) if turns else shape("message", none, none, none, F.col("text"), no_ids))
    found = F.when(F.size("j.tool_calls") > 0, calls).when(F.col("j.tool_call_id").isNotNull(), result).otherwise(plain)
    return m.select("conv_id", "turn", "role", F.posexplode(found).alias("part", "p")).select("conv_id", "turn", "part", "role", "p.*")


def turn_part() -> tuple:
    """Columns kind, call_id, name, arguments and content of a turn without markup."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("role") == "user", "call").when((F.col("role") == "assistant") & (F.col("turn") > 0), "result").otherwise("message")
    number = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    words = F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), ""))
    arguments = F.to_json(F.struct(words.alias("words"), text.alias("prompt")))
    return (
        kind, F.when(kind != "message", F.concat(F.lit("turn-"), number)), F.when(kind == "call", "reply"),
        F.when(kind == "call", arguments), F.when(kind != "call", F.col("text")),
    )


def parts_of_turns(messages: DataFrame) -> DataFrame:
    """Parts as above from conversations without markup: a user's turn is a call of ``reply``, named by its turn, and an assistant's turn is the result of the turn before."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    kind, call_id, name, arguments, content = turn_part()
    return m.select(
        "conv_id", "turn", F.lit(0).alias("part"), "role", kind.alias("kind"), call_id.alias("call_id"), name.alias("name"),
        arguments.alias("arguments"), content.alias("content"), F.lit(None).cast("array<string>").alias("after"),
    )


#: Stands around integers of over 38 digits, which variants don't hold, while arguments are read as strings.
MARK = "\ue0f0"
#: What comes before such an integer, from the end of the last one on: all but strings and numbers, strings, other numbers. Steps are never taken back.
BEFORE = r'[^"\d-]++|"(?:[^"\\]++|\\.)*+"|-(?!\d)|(?!-?[1-9]\d{38,}+(?![.eE]))-?\d++(?:[.eE][+-]?\d*+)*+'
LONG = rf"(?s)\G((?:{BEFORE})*+)(-?[1-9]\d{{38,}}+)"


def holding_long(arguments):
    """Column: JSON whose integers of over 38 digits are strings between marks, so that no digit is lost; texts that hold the mark stay."""
    some = arguments.rlike(r"\d{39}") & ~arguments.contains(MARK)
    return F.when(some, F.regexp_replace(arguments, LONG, f'$1"{MARK}$2{MARK}"')).otherwise(arguments)


def canonical(arguments):
    """Column: JSON with sorted keys and without white space, null where the text is none; long integers come back digit by digit."""
    form = F.to_json(F.try_parse_json(holding_long(arguments)))
    return F.when(arguments.contains(MARK), form).otherwise(F.regexp_replace(form, f'"{MARK}(-?\\d+){MARK}"', "$1"))


def kind_of(v, key: str, arguments):
    """Columns: the value of ``key`` in a variant, and its kind in SQL's names."""
    value = F.try_variant_get(v, f"$.{key}", "variant")
    long = F.try_variant_get(v, f"$.{key}", "string").rlike(f"^{MARK}-?\\d+{MARK}$") & ~arguments.contains(MARK)
    return value, F.when(long, "DECIMAL(39,0)").otherwise(F.schema_of_variant(value))


def problem_of(schemas: Schemas):
    """Column: the first thing wrong with a call's arguments, null if none: ``unknown tool``, ``not an object``, ``missing x``, ``kind of x`` or ``unexpected``."""
    name, arguments = F.col("name"), F.col("arguments")
    v = F.try_parse_json(holding_long(arguments))
    out = F.when(~name.isin(*schemas) | name.isNull(), "unknown tool")
    out = out.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    for tool, parameters in schemas.items():
        for key, kind, needed in parameters:
            value, found = kind_of(v, key, arguments)
            if needed:
                out = out.when((name == tool) & value.isNull(), f"missing {key}")
            out = out.when((name == tool) & value.isNotNull() & ~found.rlike(KINDS[kind]), f"kind of {key}")
        keys = F.array(*(F.lit(k) for k, _, _ in parameters)) if parameters else F.array().cast("array<string>")
        others = F.array_except(F.json_object_keys(arguments), keys)
        out = out.when((name == tool) & (F.size(others) > 0), "unexpected")
    return out


def linked(parts: DataFrame) -> DataFrame:
    """Adds linked_turn: a result's call (the first of its identifier in the conversation) and a call's first result.

    Calls and results of an identifier are reduced to their first turn before the joins, so repeated identifiers
    make no products; the joins are on (conv_id, call_id), a conversation of any length is spread by identifiers.
    """
    ends = parts.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("kind") == "call", F.col("turn"))).alias("call_turn"), F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("result_turn"))
    ends = written(ends, "links")
    joined = parts.join(ends, ["conv_id", "call_id"], "left")
    return joined.withColumn("linked_turn", F.when(F.col("kind") == "call", F.col("result_turn")).when(F.col("kind") == "result", F.col("call_turn"))).drop("call_turn", "result_turn")


def needs_of(parts: DataFrame) -> DataFrame:
    """(conv_id, node, need): a result needs the first call of its identifier, a call the first results that it is ``after``; nodes are (turn, part, kind)."""
    p = parts.withColumn("node", F.struct("turn", "part", "kind"))
    first = lambda kind: p.where(F.col("kind") == kind).groupBy("conv_id", "call_id").agg(F.min("node").alias("need"))
    on_call = p.where("kind = 'result' and call_id is not null").select("conv_id", "node", "call_id")
    after = p.where("size(after) > 0").select("conv_id", "node", F.explode("after").alias("call_id"))
    on_call = on_call.join(first("call"), ["conv_id", "call_id"])
    after = after.join(first("result"), ["conv_id", "call_id"])
    return on_call.unionByName(after).select("conv_id", "node", "need").distinct()


def later(at, than):
    """Column: whether a part in turn ``at`` whose need stands at ``than`` (at, depth, same) must move behind it.

    It must if the need stands in a later turn, or in the same turn and has itself moved, or, neither having moved, stands there
    at the same place or behind (``same``).
    """
    return (than["at"] > at) | ((than["at"] == at) & ((than["depth"] > 0) | than["same"]))


def followed(paths: DataFrame) -> DataFrame:
    """Paths of single needs, followed to their ends: node, root, top, same, hops, at, depth, open.

    A path says where ``node`` stands given where ``root``, the need at its end, does: behind the root, ``hops`` deeper, if that is
    ``later`` than the largest turn ``top`` of the path's parts; else at (at, depth), which no root before that turn changes.
    Every round puts each path and that of its root together, so a chain of n parts takes log n rounds, whichever of its
    parts move. Paths that are still ``open`` after them run in a cycle.
    """
    paths = written(paths, "paths")
    rounds = (paths.count() + 1).bit_length() + 1
    for _ in range(rounds):
        names = ("root", "top", "same", "hops", "at", "depth")
        ahead = paths.select("conv_id", F.col("node").alias("root"), *(F.col(c).alias(f"far_{c}") for c in names))
        far = F.struct(F.col("far_at").alias("at"), F.col("far_depth").alias("depth"), F.col("same").alias("same"))
        moves, longer = later(F.col("top"), far), F.col("far_root").isNotNull()
        both = paths.join(ahead, ["conv_id", "root"], "left").select(
            "conv_id", "node", F.coalesce("far_root", "root").alias("root"), F.greatest("top", "far_top").alias("top"),
            F.when(longer, (F.col("far_top") < F.greatest("top", "far_top")) | F.col("far_same")).otherwise(F.col("same")).alias("same"),
            (F.col("hops") + F.coalesce("far_hops", F.lit(0))).alias("hops"),
            F.when(longer & moves, F.col("far_at")).otherwise(F.col("at")).alias("at"),
            F.when(longer & moves, F.col("far_depth") + F.col("hops")).otherwise(F.col("depth")).alias("depth"), longer.alias("open"),
        )
        paths = written(both, "paths")
        if paths.where("open").isEmpty():
            break
    return paths


def moved_places(needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, node, at, depth) of the parts with needs, and (conv_id, node) of those in or behind a cycle.

    A part stands in its own turn, or behind the need that stands last if that is ``later``: in that one's turn (``at``), a
    depth further. Chains of parts with one need each are followed by doubling, once, whether their parts move or not.
    Parts with several needs wait until the ends of all their chains are placed: one round for each such part
    on the longest way between them. What never gets a place is in or behind a cycle; that delays no other conversation.
    """
    several = written(needs.groupBy("conv_id", "node").agg(F.count("*").alias("n")).where("n > 1"), "several")
    own = F.col("node.turn")
    step = needs.join(several, ["conv_id", "node"], "left_anti").select(
        "conv_id", "node", F.col("need").alias("root"), own.alias("top"), (F.col("need.part") >= F.col("node.part")).alias("same"),
        F.lit(1).cast("long").alias("hops"), own.alias("at"), F.lit(0).cast("long").alias("depth"),
    )
    paths = followed(step)
    places = paths.where("not open").join(needs.select("conv_id", F.col("node").alias("root")).distinct(), ["conv_id", "root"], "left_anti")
    places = written(places.select("conv_id", "node", *placed(F.struct(F.col("root.turn").alias("at"), F.lit(0).cast("long").alias("depth")))), "places")
    if not several.isEmpty():
        # a need of several is the end of a path itself, or leads to one
        asked = needs.join(several.drop("n"), ["conv_id", "node"]).join(paths.select("conv_id", F.col("node").alias("need"), "root", "top", "same", "hops", "at", "depth"), ["conv_id", "need"], "left")
        asked = written(asked, "asked")
        base = needs.select("conv_id", F.col("node").alias("root")).distinct()
        open_, settled = several.drop("n"), places.limit(0)
        while True:
            known = settled.select("conv_id", F.col("node").alias("root"), F.col("at").alias("root_at"), F.col("depth").alias("root_depth"))
            ends = asked.join(open_, ["conv_id", "node"]).withColumn("root", F.coalesce("root", "need"))
            ends = ends.join(base.withColumn("waits", F.lit(True)), ["conv_id", "root"], "left").join(known, ["conv_id", "root"], "left")
            ends = ends.withColumn("ready", F.col("waits").isNull() | F.col("root_at").isNotNull())
            root = F.struct(F.coalesce("root_at", "root.turn").alias("at"), F.coalesce("root_depth", F.lit(0)).alias("depth"))
            at, depth = placed(root)
            ends = ends.withColumn("n_at", F.when(F.col("hops").isNull(), root["at"]).otherwise(at)).withColumn("n_depth", F.when(F.col("hops").isNull(), root["depth"]).otherwise(depth))
            than = F.struct(F.col("n_at").alias("at"), F.col("n_depth").alias("depth"), (F.col("need.part") >= F.col("node.part")).alias("same"))
            behind = F.when(later(own, than), F.struct(F.col("n_at").alias("at"), (F.col("n_depth") + 1).alias("depth"))).otherwise(F.struct(own.alias("at"), F.lit(0).cast("long").alias("depth")))
            found = ends.groupBy("conv_id", "node").agg(F.max(behind).alias("p"), F.min("ready").alias("ready")).where("ready").select("conv_id", "node", "p.at", "p.depth")
            found = written(found, "found")
            if found.isEmpty():
                break
            settled, open_ = written(settled.unionByName(found), "settled"), written(open_.join(found, ["conv_id", "node"], "left_anti"), "open")
        roots = settled.select("conv_id", F.col("node").alias("root"), F.struct("at", "depth").alias("r"))
        late = paths.where("not open").join(roots, ["conv_id", "root"]).select("conv_id", "node", *placed(F.col("r")))
        places = written(places.unionByName(settled).unionByName(late), "places")
    cyclic = needs.select("conv_id", "node").distinct().join(places, ["conv_id", "node"], "left_anti")
    return places, written(cyclic, "cyclic")


def placed(root):
    """Columns at and depth of a path's node, its root standing at the struct ``root``."""
    moves = later(F.col("top"), F.struct(root["at"].alias("at"), root["depth"].alias("depth"), F.col("same").alias("same")))
    return F.when(moves, root["at"]).otherwise(F.col("at")).alias("at"), F.when(moves, root["depth"] + F.col("hops")).otherwise(F.col("depth")).alias("depth")


def ordered(parts: DataFrame) -> DataFrame:
    """Adds at, depth and cyclic: (at, depth, turn, part) is a topological order of a conversation's parts.

    Parts whose needs (``needs_of``) stand before them keep their turn (at = turn, depth 0), others move as in
    ``moved_places``. Those in or behind a cycle keep their turn and are marked.
    """
    needs = written(needs_of(parts), "needs")
    late = needs.where("need.turn > node.turn or (need.turn = node.turn and need.part >= node.part)")
    if late.isEmpty():
        return parts.withColumns({"at": F.col("turn"), "depth": F.lit(0).cast("long"), "cyclic": F.lit(False)})
    places, cyclic = moved_places(needs)
    marks = places.withColumn("cyclic", F.lit(False)).unionByName(cyclic.withColumn("cyclic", F.lit(True)), allowMissingColumns=True)
    p = parts.withColumn("node", F.struct("turn", "part", "kind")).join(marks, ["conv_id", "node"], "left").drop("node")
    return p.withColumns({"at": F.coalesce("at", "turn"), "depth": F.coalesce("depth", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))})


def quoted(column: str):
    """Column: a string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)


def json_of():
    """Column: a part in canonical JSON, keys sorted, without nulls; arguments that are no JSON are a string."""
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    arguments = F.coalesce(canonical(F.col("arguments")), quoted("arguments"))
    fields = [
        ("arguments", call & F.col("arguments").isNotNull(), arguments),
        ("content", ~call & F.col("content").isNotNull(), quoted("content")),
        ("id", call & F.col("call_id").isNotNull(), quoted("call_id")),
        ("name", call & F.col("name").isNotNull(), quoted("name")),
        ("role", F.col("role").isNotNull(), quoted("role")),
        ("tool_call_id", result & F.col("call_id").isNotNull(), quoted("call_id")),
    ]
    held = F.array_compact(F.array(*(F.when(held, F.concat(F.lit(f'"{key}":'), value)) for key, held, value in fields)))
    return F.concat(F.lit("{"), F.array_join(held, ","), F.lit("}"))


def formatted(parts: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, turn, part, kind, call_id, linked_turn, at, depth, cyclic, problem, json: every part, linked, ordered, checked and in canonical JSON.

    ``problem`` also tells ``no call`` (a result without one), ``no result`` (a call without one), ``repeated`` (an
    identifier of an earlier call) and ``cycle``. ``json`` has sorted keys, no white space and no nulls; arguments that
    are JSON are put into the same form, integers of any length digit by digit, other arguments stay a string. The order
    is given by (at, depth, turn, part), not by gathering conversations into rows, so they can be of any length.

    Null texts are messages without content. Empty and very long texts are kept whole. Null conversations or turns:
    their parts stay, unlinked. Repeated rows: the first call of an identifier counts, others are ``repeated``.
    Empty table: no rows. Other columns are ignored.
    """
    first = F.min(F.struct("turn", "part"))
    calls = parts.where("kind = 'call'").groupBy("conv_id", "call_id").agg(first.alias("first_call"))
    p = linked(ordered(parts)).join(written(calls, "calls"), ["conv_id", "call_id"], "left")
    call, unlinked = F.col("kind") == "call", F.col("linked_turn").isNull()
    problem = F.when(F.col("cyclic"), "cycle")
    problem = problem.when(call & (F.struct("turn", "part") != F.col("first_call")), "repeated")
    problem = problem.when(call, F.coalesce(problem_of(schemas), F.when(unlinked, "no result")))
    problem = problem.when((F.col("kind") == "result") & unlinked, "no call")
    return p.select("conv_id", "turn", "part", "kind", "call_id", "linked_turn", "at", "depth", "cyclic", problem.alias("problem"), json_of().alias("json"))


TURNS_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS x FROM conversations),
p AS (SELECT *, CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' AND turn > 0 THEN 'result' ELSE 'message' END AS kind FROM t),
q AS (SELECT *, CASE WHEN kind = 'call' THEN turn WHEN kind = 'result' THEN turn - 1 END AS n FROM p),
e AS (SELECT conv_id, n, min(turn) FILTER (kind = 'call') AS call_turn, min(turn) FILTER (kind = 'result') AS result_turn FROM q WHERE n IS NOT NULL GROUP BY 1, 2)
SELECT q.conv_id, q.turn, kind, 'turn-' || q.n AS call_id, CASE kind WHEN 'call' THEN result_turn WHEN 'result' THEN call_turn END AS linked_turn,
  turn AS at, CASE WHEN kind = 'call' AND result_turn IS NULL THEN 'no result' WHEN kind = 'result' AND call_turn IS NULL THEN 'no call' END AS problem,
  md5(CASE kind WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(x)::VARCHAR || ',"words":' || len(list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) || '},"id":"turn-' || turn || '","name":"reply","role":' || to_json(role)::VARCHAR || '}'
    WHEN 'result' THEN '{"content":' || to_json(x)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"tool_call_id":"turn-' || q.n || '"}'
    ELSE '{"content":' || to_json(x)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' END) AS json_md5
FROM q LEFT JOIN e ON q.conv_id = e.conv_id AND q.n = e.n
"""
