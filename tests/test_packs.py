"""What the packs of a language share, and what stands before regular expressions."""

import re

import pytest

from pyspark.sql import functions as F

from seepline.functions import text as tx
from seepline.operators import detect as det, facts
from seepline.rules import rules_for
from workload import catalog, q_packs

SMALL = "/root/testdata/sf0.001"


def of(lang, category):
    return [r for r in rules_for(lang) if r.category == category]


def test_packs_of_a_language_read_lines_that_are_written_once(spark, monkeypatch):
    made = []
    whole = q_packs.lines
    monkeypatch.setattr(q_packs, "lines", lambda *a: made.append(a) or whole(*a))
    monkeypatch.setattr(q_packs, "_TAINT", {})
    queries = catalog.load()[0]
    for name in ("pack_java_deserialization", "pack_java_command_injection"):
        assert queries[name](spark, SMALL).count()
    assert len(made) == 1


def test_a_line_is_put_in_lower_case_once(spark):
    lines = spark.createDataFrame([(1, "javascript", 1, "x")], "file_id long, lang string, line_no int, text string")
    plan = det.match_rules(lines, of("javascript", "SQL_INJECTION"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\(text", plan)) == 1


@pytest.mark.parametrize("name", ["dangerous_eval", "nosql_injection", "sql_injection", "dom_xss", "xpath_injection", "command_injection"])
def test_a_pack_sends_its_rules_to_all_tasks_and_nothing_else(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = catalog.load()[0][f"pack_javascript_{name}"](spark, SMALL)
        assert df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"BroadcastExchange", final)) == 1


def test_lines_of_any_breaks(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na", "a\r\nb", "a\rb\n", "a\n\r", "ä\nb€\n", "a\r\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.split(F.regexp_replace("t", r"(?:\r\n|\n|\r)\z", ""), tx.LINE_BREAK)
    for r in df.select("t", tx.split_lines(F.col("t")).alias("now"), old.alias("old")).collect():
        assert r.now == r.old, r


def test_ends_and_plain_targets(spark):
    rows = ["x = a;", "x = a ;  ", "x = f(b)", "this.x = y", "{a, b: c} = d", "_ = e", "x2 = 'q'", "x = a; "]
    df = spark.createDataFrame([(1, "javascript", i, t) for i, t in enumerate(rows)], "file_id long, lang string, line_no int, text string")
    got = facts.explode_targets(facts.extract_assignments(df, ["javascript"])).select("line_no", "lhs", "rhs").collect()
    assert {tuple(r) for r in got if r.line_no < 7} == {
        (0, "x", "a"), (1, "x", "a "), (2, "x", "f(b)"), (3, "x", "y"), (4, "a", "d"), (4, "c", "d"), (6, "x2", "'q'")}
