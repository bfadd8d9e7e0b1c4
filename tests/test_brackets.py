"""Calls and argument positions by brackets, against a reading character by character."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from seepline.operators import brackets, facts, taint as tnt

LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`(?:[^`\\]|\\.)*`')


def read(text):
    """(name, args, opened at, closed at) of each call, by a stack; places in characters."""
    stack, found, at, plain = [], [], 0, 0
    while at < len(text):
        literal = LITERAL.match(text, at)
        if literal:
            at = literal.end()
            continue
        ch = text[at]
        if ch in "([{":
            head = re.search(brackets.HEAD, text[plain:at]) if ch == "(" else None
            call = {"name": head[1], "args": [], "at": at, "end": None} if head else None
            if call:
                found.append(call)
            stack.append([call, at + 1])
        elif ch in ")]}" and stack:
            call, start = stack.pop()
            if call:
                call["args"].append(text[start:at].strip(" "))
                call["end"] = at
        elif ch == "," and stack:
            if stack[-1][0]:
                stack[-1][0]["args"].append(text[stack[-1][1] : at].strip(" "))
            stack[-1][1] = at + 1
        if ch in "()[]{},":
            plain = at + 1
        at += 1
    return [(c["name"], [a for a in c["args"] if a], c["end"] is not None) for c in found]


def table(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").repartition(3)


def test_calls_against_a_stack(spark):
    r = random.Random(5)
    parts = ["f(", "a.b->c(", "g (", "(", ")", "[", "]", "{", "}", ",", " x", "1", '"p(,"', "'q)'", "`z${a}(`", '"', "'", " + ", "\\", "if ("]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(600)] + ["", "é(ü, \"日(\")"]
    # a closing bracket without an opening one starts no level for what follows
    texts = [t for t in texts if least_depth(t) >= 0]
    got = {}
    for x in brackets.calls(table(spark, texts), ["k"], "text").orderBy("k", "call_no").collect():
        got.setdefault(x.k, []).append((x.name, list(x.args), x.closed is not None))
    assert len(texts) > 100
    for k, text in enumerate(texts):
        assert got.get(k, []) == read(text), text


def least_depth(text):
    depth = least = 0
    for ch in LITERAL.sub("", text):
        depth += (ch in "([{") - (ch in ")]}")
        least = min(least, depth)
    return least


@pytest.mark.parametrize("text", ["; ".join(f'call{i}(a{i}, in{i}(x, [{i}, "s,("]))' for i in range(12_000)), "(" * 30_000 + "f(x)" + ")" * 30_000, "f(" + ", ".join(map(str, range(60_000))) + ")"])
def test_long_lines_take_seconds(spark, text):
    df = table(spark, [text])
    begin = time.time()
    n = brackets.calls(df, ["k"], "text").agg(F.count("*"), F.sum(F.size("args"))).first()
    assert time.time() - begin < 60
    want = read(text) if len(text) < 500_000 and "call0" not in text else None
    assert tuple(n) == ((24_000, 48_000) if want is None else (len(want), sum(len(a) for _, a, _ in want)))


def test_argument_positions_of_own_functions(spark):
    text = 'def g(a, b):\n    return b\ndef k(a, b):\n    return a\nx = g(k(1, q), 2)\ny = k(q, g(1, z))\nw = k(q, 1) + g(1, z)\nv = g("s, (", r)\n'
    lines = facts.explode_lines(spark.createDataFrame([(1, "python", text)], "file_id long, lang string, content string"))
    assigns = facts.explode_targets(facts.extract_assignments(lines))
    rows = tnt.call_assignments(assigns, facts.extract_functions(lines)).collect()
    assert {(r.lhs, r.callee, r.arg_pos, r.src) for r in rows} == {("x", "g", 0, "k"), ("x", "g", 0, "q"), ("y", "k", 0, "q"), ("y", "k", 1, "g"), ("y", "k", 1, "z"), ("v", "g", 1, "r")}


def test_taint_takes_the_right_parameter(spark):
    text = 'def g(a, b):\n    return b\ndef k(a, b):\n    return a\ndef h():\n    q = request.args.get("q")\n    x = g(k(1, q), 2)\n    y = g(1, q)\n'
    lines = facts.explode_lines(spark.createDataFrame([(1, "python", text)], "file_id long, lang string, content string"))
    marked = {r["var"] for r in tnt.interprocedural(lines).filter("scope_id = 5").collect()}
    assert marked == {"q", "y"}
