"""Tool-call linking and canonical chat records; DataFrame functions only.

Calls and results are rows with an identifier. They are hash-joined by conversation and
identifier, ordered topologically (a call comes after the calls and results that its
arguments name; a result after its call), their arguments are validated against the tool's
schema, and each conversation becomes one canonical JSON record.

In a ``conversations`` table a tool call is written in a turn of the assistant as
``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`` and its result in a
turn of role ``tool`` as ``<tool_result>{"id": ..., "content": ...}</tool_result>``. The
synthetic table has no such marks, so :func:`op4_tool_calls` reads every user turn as a
call, whose identifier is its turn, and the assistant turn that follows as the result. By
fixed rules on turn, conversation and length of the text some of these calls are repeated,
break the schema, name a later call, or name each other.

Validation looks at the parsed arguments: unknown tool, no object, a required argument
missing, an unknown argument, one of another type than the schema's (the text "1" is no
integer, 1 no string, null nothing; 1e2, 100.0 and an integer of 45 digits are integers).

Order: an argument names the call whose identifier is the argument's text, or that of a string
inside it at any depth; where several have it, the first. A call stays in its place, unless it names one that stands later: then it
goes right behind the last of those that it names, or that those name, and so on. Most
conversations need no move, which a hash join of named identifiers and calls tells; only in
the others the order is worked out, in rounds over arrays of numbers: the last place
reached, with shortcuts through what others reach, then the steps to it. The rounds are as
many as the longest chain of moved calls, each linear in the conversation.

Canonical JSON: keys in order, within arguments too, no spaces, ``/`` and non-ASCII
characters as they are, control characters as ``to_json`` escapes them. Equal numbers have one
text, with all their digits: 1000, 1e3 and 1000.0 are ``1000``, 1.50 is ``1.5``, -0.0 is ``0``, 1e400 stays itself.

Cases: a row with a null conversation is in none, so it is a record of its own, ``open`` or
``orphan``; null identifiers never link; a call without result is ``open``, a result without
call ``orphan``; where an identifier has several calls (or results), in order of turn and
text, the first call links with the first result, and so on; repeated rows are turns of
their own; arguments that are no JSON object, or break the schema, are kept as text with
their ``fault``; calls that name each other in a cycle, and those that go behind such calls,
keep their places; null texts are empty; an empty table gives an empty result; extra columns
are not read. A conversation is one record, so its turns meet in one row; calls of different
conversations never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.llm.common import table

#: For each tool its required arguments and, for every argument, its type.
SCHEMAS = {"reply": {"required": ["text", "turn"], "types": {"text": "string", "turn": "integer", "after": "string"}}}
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
#: What ``schema_of_variant`` says of a value of each type.
SHAPES = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": r"^BOOLEAN$", "object": r"^OBJECT", "array": r"^ARRAY"}


def json_text(x: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _with(x: Column, f) -> Column:
    """``f`` of ``x``, which is worked out once."""
    return F.get(F.transform(F.array(x), f), 0)


#: Stand for an escaped backslash and an escaped quote while a JSON text is cut; raw, neither is in valid JSON.
BACKSLASH, QUOTE = "\u0001", "\u0002"
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def _tokens(x: Column) -> Column:
    """A valid JSON text as strings, numbers and what stands between them; only strings begin with a quote."""
    plain = F.replace(F.replace(x, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    between = lambda p: F.regexp_extract_all(p, F.lit(f"({NUMBER}|[^-0-9]+|-)"), F.lit(1))
    return F.flatten(F.transform(F.split(plain, '"'), lambda p, i: F.when(i % 2 == 1, F.array(F.concat(F.lit('"'), p, F.lit('"')))).otherwise(between(p))))


def _text(tokens: Column) -> Column:
    return F.replace(F.replace(F.array_join(tokens, ""), F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))


def _is_number(token: Column) -> Column:
    return token.rlike(r"^-?\d")


def _placed(tokens: Column) -> Column:
    """The JSON text with every number replaced by its place among the tokens, so that a parser that rounds can't touch it."""
    return _text(F.transform(tokens, lambda t, i: F.when(_is_number(t), i.cast("string")).otherwise(t)))


def decimal(token: Column) -> Column:
    """A JSON number as ``(digits, e)``: digits without zeros at either end ("" for 0), and the power of ten they are times of (null beyond a long)."""
    whole, part = F.regexp_extract(token, r"^-?(\d+)", 1), F.regexp_extract(token, r"\.(\d+)", 1)
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    power = F.regexp_extract(token, r"[eE]\+?(-?\d+)$", 1)
    power = F.when(power == "", F.lit(0).cast("long")).otherwise(power.try_cast("long")) - F.length(part)
    short = F.regexp_replace(digits, "0+$", "")
    return F.struct(short.alias("digits"), (power + F.length(digits) - F.length(short)).alias("e"))


def number_text(token: Column) -> Column:
    """One text for equal numbers, whose digits are all kept: plain with up to 38 places on either side of the point, else as ``1.5e99``."""

    def said(x):
        d, e = x["digits"], x["e"]
        n = F.length(d)
        cut = (n + e).cast("int")
        zeros = lambda k: F.repeat(F.lit("0"), F.greatest(F.lit(0), F.least(F.lit(38), k)).cast("int"))
        plain = F.when((e >= 0) & (n + e <= 38), F.concat(d, zeros(e))).when((e < 0) & (e >= -38), F.when(cut > 0, F.concat(F.left(d, cut), F.lit("."), F.substr(d, cut + 1, n))).otherwise(F.concat(F.lit("0."), zeros(-cut), d)))
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 2_000_000_000))).otherwise(F.lit(""))
        long = F.concat(F.left(d, F.lit(1)), tail, F.lit("e"), (e + n - 1).cast("string"))
        sign = F.when(token.startswith("-"), "-").otherwise("")
        return F.when(d == "", F.lit("0")).when(e.isNull(), F.lower(token)).otherwise(F.concat(sign, F.coalesce(plain, long)))

    return _with(decimal(token), said)


def canonical(x: Column) -> Column:
    """JSON with the keys of every object in order, without spaces, and one text for equal numbers; null if it is none, or repeats a key."""

    def exact(tokens):
        sorted_ = _tokens(F.to_json(F.try_parse_json(_placed(tokens))))
        return _text(F.transform(sorted_, lambda t: F.when(_is_number(t), number_text(F.get(tokens, t.try_cast("int")))).otherwise(t)))

    # integers of up to fifteen digits come through the parser as they are
    special = x.rlike(r"\d[.eE]|\d{16}|-0")
    parsed = F.try_parse_json(x)
    return F.when(parsed.isNotNull(), F.when(special, _with(_tokens(x), exact)).otherwise(F.to_json(parsed)))


def _path(name: str) -> str | None:
    """The place of an argument; null for a name that has both kinds of quotes, which no path can say."""
    mark = '"' if "'" in name else "'"
    return None if mark in name else f"$[{mark}{name}{mark}]"


def _argument(text: Column, name: str) -> Column:
    """The value of an argument as a variant."""
    if _path(name) is None:
        return F.element_at(F.from_json(text, "map<string,variant>"), name)
    return F.try_variant_get(F.try_parse_json(text), _path(name), "variant")


def is_whole(arguments: Column, name: str) -> Column:
    """Whether an argument that is a number is an integer, however it is written (1e2, 45 digits)."""
    return _with(_tokens(arguments), lambda tokens: decimal(F.get(tokens, F.try_variant_get(_argument(_placed(tokens), name), "$", "int")))["e"] >= 0)


def marked_calls(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results written in the turns' texts."""
    base = [F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn")]

    def part(pattern: str):
        return F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1)))

    calls = turns.where(F.col(role) == "assistant").select(*base, part(CALL).alias("part", "body"))
    results = turns.where(F.col(role) == "tool").select(*base, part(RESULT).alias("part", "body"))
    get = F.get_json_object
    return (
        calls.select("conv", "turn", "part", get("body", "$.id").alias("id"), get("body", "$.name").alias("name"), get("body", "$.arguments").alias("arguments")),
        results.select("conv", "turn", "part", get("body", "$.id").alias("id"), get("body", "$.content").alias("content")),
    )


def invalid(name: Column, arguments: Column, schemas: dict) -> Column:
    """The first fault of a call's arguments, or null: unknown tool, no object, missing, unknown or mistyped argument."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    tests = F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool")).when(parsed.isNull() | keys.isNull(), F.lit("no object"))
    for tool, schema in sorted(schemas.items()):
        here = name == tool
        for k in schema["required"]:
            tests = tests.when(here & ~F.array_contains(keys, k), F.lit(f"missing {k}"))
        tests = tests.when(here & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in schema["types"]]))) > 0), F.lit("unknown argument"))
        for k, kind in sorted(schema["types"].items()):
            found = F.schema_of_variant(_argument(arguments, k))
            fits = F.coalesce(found.rlike(SHAPES[kind]), F.lit(False))
            if kind == "integer":  # doubles and decimals may be whole
                fits = fits | F.when(found.rlike("^D(OUBLE|ECIMAL)"), is_whole(arguments, k)).otherwise(F.lit(False))
            tests = tests.when(here & F.array_contains(keys, k) & ~F.coalesce(fits, F.lit(False)), F.lit(f"bad {k}"))
    return tests


def linked(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """``calls(conv, turn, part, id, name, arguments)`` and ``results(conv, turn, part, id, content)`` -> one row a call, and one for each result without call."""

    def numbered(rows, *order):
        # what never links gets no number, and no window of its own
        able = F.col("conv").isNotNull() & F.col("id").isNotNull()
        nth = F.row_number().over(Window.partitionBy("conv", "id").orderBy("turn", "part", *order))
        return rows.where(able).withColumn("nth", nth).unionByName(rows.where(~able).withColumn("nth", F.lit(None).cast("int")))

    a = numbered(calls, "name", "arguments")
    b = numbered(results, "content").select(F.col("conv").alias("r_conv"), F.col("id").alias("r_id"), F.col("nth").alias("r_nth"), F.col("turn").alias("r_turn"), F.col("part").alias("r_part"), "content", F.lit(True).alias("r_is"))
    a = a.withColumn("is", F.lit(True))
    both = a.join(b.hint("shuffle_hash"), (F.col("conv") == F.col("r_conv")) & (F.col("id") == F.col("r_id")) & (F.col("nth") == F.col("r_nth")), "full")
    state = F.when(F.col("is").isNull(), "orphan").when(F.col("r_is").isNull(), "open").otherwise("linked")
    is_call = F.col("is").isNotNull()
    return both.select(F.when(is_call, F.col("conv")).otherwise(F.col("r_conv")).alias("conv"), F.coalesce("id", "r_id").alias("id"), "turn", "part", "name", "arguments", "r_turn", "r_part", "content", state.alias("state"), F.when(is_call, invalid(F.col("name"), F.col("arguments"), schemas)).alias("fault"))


def named(arguments: Column) -> Column:
    """The texts of a call's arguments, each of which may be an identifier: the top values, and the strings at any depth."""
    top = F.coalesce(F.map_values(F.from_json(arguments, "map<string,string>")), F.array().cast("array<string>"))

    def strings(tokens):
        values = F.filter(tokens, lambda t, i: t.startswith('"') & ~F.ltrim(F.coalesce(F.get(tokens, i + 1), F.lit(""))).startswith(":"))
        return F.coalesce(F.from_json(F.concat(F.lit("["), F.replace(F.replace(F.array_join(values, ","), F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\")), F.lit("]")), "array<string>"), F.array().cast("array<string>"))

    deep = arguments.rlike(r"(?s)^\s*\{.*[\[{]") & F.try_parse_json(arguments).isNotNull()
    return F.when(deep, F.array_distinct(F.concat(top, _with(_tokens(arguments), strings)))).otherwise(top)


def out_of_order(pairs: DataFrame) -> DataFrame:
    """``conv`` of the conversations in which a call names one that does not stand before it."""
    calls = pairs.where(F.col("conv").isNotNull() & (F.col("state") != "orphan"))
    place = F.struct(F.col("turn").alias("at"), "part")
    hashes = lambda x: (F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))  # noqa: E731  texts may be long
    first = calls.where("id is not null").groupBy(F.col("conv").alias("c"), *hashes(F.col("id"))).agg(F.min(place).alias("first"))
    names = calls.select("conv", place.alias("place"), F.xxhash64("id").alias("own"), F.explode(named(F.col("arguments"))).alias("x")).select("conv", "place", "own", *hashes(F.col("x")))
    names = names.where(F.coalesce(F.col("own") != F.col("h1"), F.lit(True)))
    met = names.join(first.hint("shuffle_hash"), (names["conv"] == first["c"]) & (names["h1"] == first["h1"]) & (names["h2"] == first["h2"]))
    return met.where(F.col("first") >= F.col("place")).select("conv").distinct()


def topological(calls: Column) -> Column:
    """An array of calls, in order of their places, put into topological order."""
    number = lambda x: x.cast("int")
    ids = F.transform(calls, lambda c: F.when(c["state"] != "orphan", c["id"]))

    def needs(ids):
        return F.transform(calls, lambda c: F.filter(F.transform(F.filter(named(c["arguments"]), lambda v: (c["id"].isNull() | (v != c["id"]))), lambda v: number(F.coalesce(F.array_position(ids, v), F.lit(0)) - 1)), lambda j: j >= 0))

    def reached(deps):
        """For each call the last place reached, itself included."""

        def once(state, _):
            def moved(x, i):
                return F.aggregate(F.get(deps, i), F.greatest(x, F.get(state["last"], x)), lambda m, j: F.greatest(m, F.get(state["last"], j)))

            return F.when(~state["go"], state).otherwise(_with(F.transform(state["last"], moved), lambda new: F.struct(new.alias("last"), (new != state["last"]).alias("go"))))

        start = F.struct(F.transform(deps, lambda _, i: i).alias("last"), F.lit(True).alias("go"))
        return F.aggregate(F.sequence(F.lit(1), F.size(deps)), start, once)["last"]

    def steps(tight, most):
        """For each call the steps to the last place; ``most`` + 1 if there is no end to them."""
        start = F.transform(tight, lambda _: F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), most), start, lambda t, _: F.transform(tight, lambda js: F.coalesce(F.array_max(F.transform(js, lambda j: F.get(t, j))) + 1, F.lit(0))))

    def placed(last, t, most):
        keys = F.transform(calls, lambda c, i: F.struct(F.when(F.get(t, i) > most, i).otherwise(F.get(last, i)).alias("last"), F.when(F.get(t, i) > most, F.lit(0)).otherwise(F.get(t, i)).alias("step"), i.alias("i"), c.alias("call")))
        return F.transform(F.sort_array(keys), lambda x: x["call"])

    def behind(deps, last):
        tight = F.transform(deps, lambda js, i: F.filter(js, lambda j: F.get(last, j) == F.get(last, i)))
        return _with(tight, lambda tight: _with(F.size(F.filter(tight, lambda js: F.size(js) > 0)), lambda most: _with(steps(tight, most), lambda t: placed(last, t, most))))

    return _with(ids, lambda ids: _with(needs(ids), lambda deps: _with(reached(deps), lambda last: behind(deps, last))))


def records(pairs: DataFrame) -> DataFrame:
    """Rows of :func:`linked` -> ``conv, n_calls, n_linked, n_orphans, n_invalid, record``, one row a conversation."""
    one = F.struct(F.coalesce("turn", "r_turn").alias("at"), F.coalesce("part", "r_part").alias("part"), F.coalesce("id", F.lit("")).alias("id"), "name", "arguments", "content", "state", "fault", canonical(F.col("arguments")).alias("canonical"))
    rows = pairs.where("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("calls"))
    odd = out_of_order(pairs).select(F.col("conv").alias("odd"))
    rows = rows.join(odd, rows["conv"] == odd["odd"], "left").select("conv", F.when(F.col("odd").isNotNull(), topological(F.col("calls"))).otherwise(F.col("calls")).alias("calls"))
    rows = rows.union(pairs.where("conv is null").select("conv", F.array(one).alias("calls")))
    text = F.transform(
        "calls",
        lambda c: F.concat(
            F.lit('{"arguments":'), F.when(c["fault"].isNull() & c["canonical"].isNotNull(), c["canonical"]).otherwise(F.when(c["arguments"].isNull(), F.lit("null")).otherwise(json_text(c["arguments"]))),
            F.lit(',"content":'), F.when(c["state"] == "open", F.lit("null")).otherwise(json_text(c["content"])),
            F.lit(',"fault":'), F.when(c["fault"].isNull(), F.lit("null")).otherwise(json_text(c["fault"])),
            F.lit(',"id":'), json_text(c["id"]),
            F.lit(',"name":'), F.when(c["name"].isNull(), F.lit("null")).otherwise(json_text(c["name"])),
            F.lit(',"state":'), json_text(c["state"]), F.lit("}"),
        ),
    )
    count = lambda f: F.size(F.filter("calls", f)).cast("long")
    return rows.select("conv", count(lambda c: c["state"] != "orphan").alias("n_calls"), count(lambda c: c["state"] == "linked").alias("n_linked"), count(lambda c: c["state"] == "orphan").alias("n_orphans"), count(lambda c: c["fault"].isNotNull()).alias("n_invalid"), F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("record"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    turn, size = F.col("turn").cast("long"), F.coalesce(F.length("text"), F.lit(0))
    users = turns.where("role = 'user'").select(F.col("conv_id").alias("conv"), turn.alias("turn"), F.col("text"), size.alias("size"), F.pmod("conv_id", F.lit(3)).alias("kind"))
    other = F.when(F.col("kind") == 0, F.col("turn") + 2).when(F.col("kind") == 1, F.col("turn") - 2).otherwise(F.col("turn").bitwiseXOR(F.lit(2).cast("long")))
    arguments = F.concat(
        F.lit("{"),
        F.when(F.col("size") % 13 == 0, F.lit("")).when(F.col("turn") % 5 == 3, F.concat(F.lit('"turn": "'), F.col("turn"), F.lit('", '))).otherwise(F.concat(F.lit('"turn": '), F.col("turn"), F.lit(", "))),
        F.lit('"text": '), F.when(F.col("size") % 7 == 0, F.col("size").cast("string")).otherwise(json_text(F.col("text"))),
        F.lit(', "after": "t'), other.cast("string"), F.lit('"}'),
    )
    copies = F.explode(F.when(F.col("size") % 5 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    calls = users.select("conv", "turn", copies.alias("part"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.when(F.col("size") % 11 == 0, "lookup").otherwise("reply").alias("name"), arguments.alias("arguments"))
    replies = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), turn.alias("turn"), F.lit(0).alias("part"), F.concat(F.lit("t"), (turn - 1).cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    marked_c, marked_r = marked_calls(turns)
    got = records(linked(calls.unionByName(marked_c), replies.unionByName(marked_r)))
    return got.withColumnRenamed("conv", "conv_id")


OP4_SQL = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text, coalesce(length(text), 0) AS size,
             CASE conv_id % 3 WHEN 0 THEN turn + 2 WHEN 1 THEN turn - 2 ELSE xor(turn, 2) END AS other
           FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, 't' || turn AS id, text, size, 't' || other AS after,
             CASE WHEN size % 11 = 0 THEN 'lookup' ELSE 'reply' END AS name,
             CASE WHEN size % 7 = 0 THEN CAST(size AS VARCHAR) ELSE CAST(to_json(coalesce(text, '')) AS VARCHAR) END AS text_json,
             CASE WHEN size % 13 = 0 THEN NULL WHEN turn % 5 = 3 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END AS turn_json,
             row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS nth
      FROM u, range(CASE WHEN size % 5 = 0 THEN 2 ELSE 1 END)),
v AS (SELECT *, '{' || coalesce('"turn": ' || turn_json || ', ', '') || '"text": ' || text_json || ', "after": "' || after || '"}' AS arguments,
             '{"after":"' || after || '","text":' || text_json || coalesce(',"turn":' || turn_json, '') || '}' AS canonical,
             CASE WHEN name = 'lookup' THEN 'unknown tool' WHEN turn_json IS NULL THEN 'missing turn' WHEN size % 7 = 0 THEN 'bad text'
                  WHEN turn_json LIKE '"%' THEN 'bad turn' END AS fault FROM c),
r AS (SELECT conv_id, turn, 't' || (turn - 1) AS id, coalesce(text, '') AS content,
             row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(text, '')) AS nth
      FROM conversations WHERE role = 'assistant'),
p AS (SELECT coalesce(v.conv_id, r.conv_id) AS conv_id, coalesce(v.turn, r.turn) AS place, coalesce(v.id, r.id) AS id,
             v.name, v.arguments, v.canonical, v.fault, v.text, v.after, r.content,
             CASE WHEN v.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'open' ELSE 'linked' END AS state
      FROM v FULL JOIN r ON v.conv_id = r.conv_id AND v.id = r.id AND v.nth = r.nth),
node AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, id, name NULLS FIRST, arguments NULLS FIRST, content NULLS FIRST) - 1 AS i FROM p),
edge AS (SELECT x.conv_id, x.i, min(y.i) AS j FROM node x JOIN node y ON y.conv_id = x.conv_id AND y.id IN (x.after, x.text) AND y.id <> x.id
         WHERE x.state <> 'orphan' AND y.state <> 'orphan' GROUP BY x.conv_id, x.i, y.id),
reach AS (SELECT conv_id, i, j FROM edge UNION SELECT reach.conv_id, reach.i, edge.j FROM reach JOIN edge ON edge.conv_id = reach.conv_id AND edge.i = reach.j),
k AS (SELECT node.conv_id, node.i, greatest(node.i, coalesce(max(reach.j), 0)) AS k FROM node LEFT JOIN reach ON reach.conv_id = node.conv_id AND reach.i = node.i GROUP BY node.conv_id, node.i),
tight AS (SELECT edge.* FROM edge JOIN k a ON a.conv_id = edge.conv_id AND a.i = edge.i JOIN k b ON b.conv_id = edge.conv_id AND b.i = edge.j WHERE a.k = b.k),
walk AS (SELECT conv_id, i, 0 AS n FROM node UNION SELECT tight.conv_id, tight.i, n + 1 FROM walk JOIN tight ON tight.conv_id = walk.conv_id AND tight.j = walk.i WHERE n < 40),
t AS (SELECT conv_id, i, max(n) AS n FROM walk GROUP BY conv_id, i),
o AS (SELECT node.*, CASE WHEN n = 40 THEN node.i ELSE k END AS k, CASE WHEN n = 40 THEN 0 ELSE n END AS n FROM node JOIN k USING (conv_id, i) JOIN t USING (conv_id, i))
SELECT conv_id, CAST(count(*) FILTER (state <> 'orphan') AS BIGINT) AS n_calls,
       CAST(count(*) FILTER (state = 'linked') AS BIGINT) AS n_linked,
       CAST(count(*) FILTER (state = 'orphan') AS BIGINT) AS n_orphans, CAST(count(fault) AS BIGINT) AS n_invalid,
       '[' || string_agg('{"arguments":' || CASE WHEN state = 'orphan' THEN 'null' WHEN fault IS NULL THEN canonical ELSE CAST(to_json(arguments) AS VARCHAR) END
         || ',"content":' || CASE WHEN state = 'open' THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END
         || ',"fault":' || coalesce('"' || fault || '"', 'null') || ',"id":"' || id || '","name":' || coalesce('"' || name || '"', 'null')
         || ',"state":"' || state || '"}', ',' ORDER BY k, n, i) || ']' AS record
FROM o GROUP BY conv_id
"""
