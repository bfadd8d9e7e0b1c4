"""Statements of files read in their rows against those over lines, and bracket counting against Python."""

import random

from pyspark.sql import functions as F

from seepline.operators import facts, groups


def brute(content):
    import re

    lines = re.split(r"\r\n|\n|\r", re.sub(r"(?:\r\n|\n|\r)\Z", "", content))
    out, balance = [], 0
    for i, line in enumerate(lines, 1):
        if balance <= 0:
            out.append([i, i, [line.strip(" ")]])
        else:
            out[-1][1] = i
            out[-1][2].append(line.strip(" "))
        bare = re.sub(r'"[^"]*"|\'[^\']*\'', "", line)
        balance += sum(bare.count(c) for c in "([") - sum(bare.count(c) for c in ")]")
    return {(a, b, " ".join(t)) for a, b, t in out}


def odd_files(n=60):
    r = random.Random(3)
    parts = ["f(", "a[", ")", "]", "x = 1", "", "  y ", '"("', "'['", '"', "'", "é(", "\t", "))", "{"]
    breaks = ["\n", "\r\n", "\r"]
    return [
        "".join("".join(r.choices(parts, k=r.randint(0, 4))) + r.choice(breaks) for _ in range(r.randint(0, 12))) + r.choice(["", "end", "("])
        for _ in range(n)
    ]


def as_sets(df):
    found = {}
    for r in df.collect():
        assert (r.line_no, r.end_line, r.text) not in found.setdefault(r.file_id, set())
        found[r.file_id].add((r.line_no, r.end_line, r.text))
    return found


def test_statements_of_files(spark):
    contents = [*odd_files(), "", "\n".join(["g(1,"] + ["2,"] * 700 + ["3)", "last"]), "\n".join(["ok"] * groups.IN_ROW), "\n".join(["("] * 600)]
    files = spark.createDataFrame(list(enumerate(contents)), "file_id long, content string").withColumn("lang", F.lit("python"))
    want = {k: brute(c) for k, c in enumerate(contents)}
    assert as_sets(facts.file_statements(files)) == want
    assert as_sets(facts.assemble_statements(facts.explode_lines(files))) == want
    none = spark.createDataFrame([(1, None)], "file_id long, content string").withColumn("lang", F.lit("python"))
    assert facts.file_statements(none).count() == 0


def test_short_files_are_not_shuffled(spark):
    files = spark.createDataFrame([(k, "a(\nb)\nc") for k in range(9)], "file_id long, content string").withColumn("lang", F.lit("python"))
    found = facts.file_statements(files)
    assert "Exchange" not in found._jdf.queryExecution().toString() and found.count() == 18
