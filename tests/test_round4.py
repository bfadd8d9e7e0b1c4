"""Joins that send nothing through the driver, brackets in the row, summaries that go on from the round before."""

import random

from pyspark.sql import functions as F

from seepline.operators import brackets, facts, scopes, taint as tnt


def texts(spark):
    r = random.Random(11)
    parts = ["f(", "a.b->c(", "g (", "(", ")", "[", "]", "{", "}", ",", " x", "1", '"p(,"', "'q)'", '"', "'", " + ", "if (", " => ", "=> {"]
    found = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(800)]
    found += ["é(ü, \"日(\")", "f(g(1, h(2)), 3) {", "(a, b) => { k(c) }", ")) f(a, b) ) g(c", "f(,,)", "f()"]
    return spark.createDataFrame(list(enumerate(found)), "k long, text string").repartition(3)


def test_brackets_in_the_row_are_those_over_windows(spark):
    df = texts(spark)
    for followed in (None, scopes.ARROW):
        wide = {(r.k, r.opened): r for r in brackets._over_windows(df, ["k"], "text", followed).collect()}
        row = {(r.k, r.opened): r for r in brackets._in_row(df, ["k"], "text", followed).select("k", F.explode_outer("found").alias("r")).filter("r is not null").select("k", "r.*").collect()}
        assert row == wide and len(row) > 500


def test_short_calls_move_nothing(spark):
    short, _ = brackets._by_length(texts(spark), "text")
    plan = brackets._in_row(short, ["k"], "text", None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_long_text_gives_the_same_calls(spark):
    line = "; ".join(f"f{i}(a{i}, g(b{i}, \"(\"))" for i in range(200))
    df = spark.createDataFrame([(1, line), (2, line[: brackets.SHORT - 20])], "k long, text string")
    got = {(r.k, r.call_no): (r.name, list(r.args)) for r in brackets.calls(df, ["k"], "text").collect()}
    assert got[(1, 0)] == got[(2, 0)] == ("f0", ["a0", 'g(b0, "(")'])
    assert [got[(1, k)] for k in range(4)] == [got[(2, k)] for k in range(4)] and sum(k[0] == 1 for k in got) == 400


def test_joins_of_facts_are_never_sent_through_the_driver(spark):
    """A table that is small as a file would be broadcast by its size on disk."""
    lines = spark.createDataFrame([(1, "java", 1, "h = x -> x + 1;"), (1, "java", 2, "h.accept(v1);"), (1, "java", 3, "v2 = v1;")], "file_id long, lang string, line_no int, text string")
    assigns = facts.explode_targets(facts.extract_assignments(lines))
    taint = spark.createDataFrame([(1, 0, "v1", "user")], "file_id long, scope_id int, var string, label string")
    for df in (tnt.lambda_edges(lines), tnt.table_name_taint(assigns, taint), tnt.call_assignments(assigns, facts.extract_functions(lines))):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.src, r.dst) for r in tnt.lambda_edges(lines).collect()] == [("v1", "x")]


def test_large_and_small_frontiers_reach_the_same(spark, monkeypatch):
    r = random.Random(3)
    edges = spark.createDataFrame([(f, 0, f"v{r.randint(0, 9)}", f"v{r.randint(0, 9)}", "user", 1) for f in range(30) for _ in range(12)], "file_id long, scope_id int, src string, dst string, label string, line_no int")
    seeds = spark.createDataFrame([(f, 0, f"v{f % 4}", "user", f % 3 + 1) for f in range(30)], "file_id long, scope_id int, var string, label string, line_no int")
    sets = []
    for small in (50_000, 5, 0):
        monkeypatch.setattr(tnt, "SMALL", small)
        sets.append({tuple(r) for r in tnt.propagate(seeds, edges).collect()})
    assert sets[0] == sets[1] == sets[2] and max(r[-1] for r in sets[0]) > 2
    first = spark.createDataFrame([(0, 0, "v0", "user")], "file_id long, scope_id int, var string, label string")
    rest = tnt.propagate(seeds.filter("file_id > 0"), edges, known=first)
    assert {tuple(r) for r in rest.collect()} == {r for r in sets[0] if r[0] > 0}


def test_summaries_through_a_chain_of_calls(spark):
    text = ["def a(p, q):", "  return q"]
    for k, (name, of) in enumerate(zip("bcdefg", "abcdef")):
        text += [f"def {name}(p, q):", f"  x = {of}(p, q)", "  return x"]
    lines = spark.createDataFrame([(1, "python", k + 1, t) for k, t in enumerate(text)], "file_id long, lang string, line_no int, text string")
    scoped = facts.assign_scope(lines)
    got = tnt.summarize_functions(scoped, facts.extract_functions(lines)).collect()
    assert {r.name: list(r.param_to_return) for r in got} == {n: [1] for n in "abcdefg"}
