"""Canonical numbers, names with quotes and nested identifiers of tool calls."""

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgermark.llm import toolcalls

CALLS = "conv long, turn long, part int, id string, name string, arguments string"


def plain(x):
    """Brute force: the text of a number by exact decimals."""
    v = Decimal(x)
    if v == 0:
        return "0"
    sign, digits, e = v.as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    n = len(digits.rstrip("0"))
    e, digits = e + len(digits) - n, digits[:n]
    head = "-" if sign else ""
    if e >= 0 and n + e <= 38:
        return head + digits + "0" * e
    if -38 <= e < 0:
        return head + (digits[: n + e] + "." + digits[n + e :] if n + e > 0 else "0." + "0" * -(n + e) + digits)
    return head + digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{e + n - 1}"


def test_equal_numbers_have_one_text(spark):
    random.seed(3)
    numbers = ["1000", "1e3", "1000.0", "1.0E+3", "-0.0", "0e5", "1.50", "1e400", "-1e-400", "9" * 45, "0.1", "1e-7", "12345678901234567.0", "1.23456789012345678901", "-7"]
    numbers += [f"{random.choice(['', '-'])}{random.randrange(10 ** random.randrange(1, 20))}{random.choice(['', '.0', '.25', '.' + str(random.randrange(10**9))])}{random.choice(['', 'e5', 'E-9', 'e+30', 'e-45', 'e60'])}" for _ in range(200)]
    text = '{"b": [%s, {"a\\\\\\"1.50": "1.50 \\" 1e3 \\\\"}], "a" : %s, "t": "5.0\\u0001\\\\"}'
    texts = [text % (x, x) for x in numbers] + ['{"x":01.5}', '{"x":1.}', '{"x":1.5,"x":2}', None, ""]
    assert all(json.loads(t) for t in texts[: len(numbers)])
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(toolcalls.canonical(F.col("x")).alias("c")).collect()]
    assert got[: len(numbers)] == ['{"a":%s,"b":[%s,{"a\\\\\\"1.50":"1.50 \\" 1e3 \\\\"}],"t":"5.0\\u0001\\\\"}' % (plain(x), plain(x)) for x in numbers]
    assert got[len(numbers) :] == [None] * 5
    assert len({got[numbers.index(x)] for x in ("1000", "1e3", "1000.0", "1.0E+3")}) == 1


def test_whole_numbers_and_names_with_quotes(spark):
    names = ["it's", 'say "x"', "both ' and \"", "a.b", "a]b", "back\\slash"]
    schemas = {"t": {"required": names, "types": dict.fromkeys(names, "integer")}}
    values = {"1e2": True, "100.0": True, "9" * 45: True, "-0.0": True, "1e400": True, "1.5": False, "1e-2": False, '"1"': False, "null": False, "[1e2]": False}
    calls = [(i, 0, 0, "x", "t", "{" + ", ".join(f"{json.dumps(n)}: {v if n == name else 1}" for n in names) + "}") for i, (name, v) in enumerate((n, v) for n in names for v in values)]
    none = spark.createDataFrame([], "conv long, turn long, part int, id string, content string")
    got = {r["conv"]: json.loads(r["record"])[0]["fault"] for r in toolcalls.records(toolcalls.linked(spark.createDataFrame(calls, CALLS), none, schemas)).collect()}
    assert got == {i: None if fine else f"bad {name}" for i, (name, fine) in enumerate((n, f) for n in names for f in values.values())}


def test_nested_identifiers_order_calls(spark):
    calls = [
        (1, 0, 0, "a", "t", json.dumps({"x": {"deep": [1.5, {"of": 'the "b"\\ one'}]}})), (1, 1, 0, 'the "b"\\ one', "t", "{}"),
        (2, 0, 0, "a", "t", json.dumps({"x": [["b"]]})), (2, 1, 0, "b", "t", json.dumps({"y": {"z": "c"}})), (2, 2, 0, "c", "t", "{}"),
        (3, 0, 0, "a", "t", json.dumps({"x": {"b": "a key names nothing"}})), (3, 1, 0, "b", "t", "{}"),
        (4, 0, 0, "a", "t", '{"x": ["b"'), (4, 1, 0, "b", "t", "{}"),
    ]
    none = spark.createDataFrame([], "conv long, turn long, part int, id string, content string")
    got = {r["conv"]: [c["id"] for c in json.loads(r["record"])] for r in toolcalls.records(toolcalls.linked(spark.createDataFrame(calls, CALLS), none)).collect()}
    assert got == {1: ['the "b"\\ one', "a"], 2: ["c", "b", "a"], 3: ["a", "b"], 4: ["a", "b"]}
