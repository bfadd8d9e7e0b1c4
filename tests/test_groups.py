"""Closures of small groups in one row, and of large ones by hops."""

import random
from dataclasses import replace

import pytest

from seepline.operators import detect as det, facts, groups, joins, taint as tnt
from seepline.rules.model import Rule

EDGE = "file_id long, scope_id int, src string, dst string, label string, line_no int"
SEED = "file_id long, scope_id int, var string, label string, line_no int"


@pytest.fixture
def tables(monkeypatch):
    """Counts the tables written by the closures."""
    written = []
    cut = tnt.cut
    monkeypatch.setattr(tnt, "cut", lambda df: written.append(1) or cut(df))
    return written


def test_a_small_group_is_closed_in_one_table_however_many_hops(spark, tables):
    edges = spark.createDataFrame([(1, 0, f"v{k}", f"v{k + 1}", "user", 1) for k in range(12)], EDGE)
    got = tnt.propagate(spark.createDataFrame([(1, 0, "v0", "user", 7)], SEED), edges).collect()
    assert {(r["var"], r.origin_line, r.hop) for r in got} == {(f"v{k}", 7, k) for k in range(13)}
    assert len(tables) == 1


def test_small_and_large_groups_reach_the_same(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f, 0, f"v{r.randint(0, 7)}", f"v{r.randint(0, 7)}", r.choice(["user", "db"]), 1) for f in range(6) for _ in range(4 * f + 4)]
    edges = spark.createDataFrame(rows, EDGE)
    seeds = spark.createDataFrame([(f, 0, f"v{f % 3}", label, f + k) for f in range(6) for k, label in enumerate(("user", "user", "db"))], SEED)
    known = spark.createDataFrame([(f, 0, "v1", "user") for f in range(3)], "file_id long, scope_id int, var string, label string")
    sets = []
    for size in (512, 12, 0):
        monkeypatch.setattr(groups, "IN_ROW", size)
        asked = (tnt.propagate(seeds, edges), tnt.propagate(seeds, edges.drop("label"), max_hops=2), tnt.propagate(seeds, edges, known=known))
        sets.append([sorted(map(tuple, df.select(*tnt.KEY, "origin_line", "hop").collect())) for df in asked])
    assert sets[0] == sets[1] == sets[2] and max(r[-1] for r in sets[0][0]) > 1


def test_walks_back_are_looked_up_once_however_many_steps(spark, monkeypatch):
    written = []
    cut = joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: written.append(1) or cut(df))
    kind = "file_id long, lang string, scope_id int, lhs string, rhs string, line_no int"
    rows = [(1, "python", 0, "v0", 'request.args.get("q")', 1), (1, "python", 0, "v3", "1", 14)]
    assigns = spark.createDataFrame(rows + [(1, "python", 0, f"v{k}", f"v{k - 1}", k + 1) for k in range(1, 12)], kind)
    points = spark.createDataFrame([(1, "python", 0, "v11", 13), (1, "python", 0, "v3", 15), (1, "python", 0, "v3", 10)], "file_id long, lang string, scope_id int, var string, line_no int")
    assert {(r["var"], r.line_no) for r in joins.flow_sensitive(points, assigns).collect()} == {("v11", 13), ("v3", 10)}
    assert len(written) == 2
    assert {(r["var"], r.line_no) for r in joins.flow_sensitive(points, assigns, depth=4).collect()} == {("v3", 10)}


def test_sweeps_and_chains_of_small_and_large_groups(spark, monkeypatch, tables):
    r = random.Random(8)
    rows = [(f, 0, f"v{r.randint(0, 7)}", f"v{r.randint(0, 7)}", "user", r.randint(1, 20)) for f in range(5) for _ in range(4 * f + 5)]
    edges = spark.createDataFrame(rows, EDGE).cache()
    seeds = spark.createDataFrame([(f, 0, f"v{f % 3}", "user", 1) for f in range(5)], SEED)
    reached = tnt.propagate(seeds, edges)
    sets, counts = [], []
    for size in (512, 0):
        monkeypatch.setattr(groups, "IN_ROW", size)
        before = len(tables)
        passes, ways = tnt.propagate_passes(seeds, edges, 2), tnt.chains(reached, edges)
        counts.append(len(tables) - before)
        sets.append([sorted(map(tuple, passes.collect())), sorted((*row[:4], row.origin_line, *row.chain) for row in ways.collect())])
    assert sets[0] == sets[1] and max(map(len, sets[0][1])) > 6
    assert counts[0] == 2 < counts[1]


def test_summaries_of_small_and_large_files(spark, monkeypatch, tables):
    text = ["def a(p, q):", "  return q", "def r(p, q):", "  x = r(q, p)", "  y = a(1, p)", "  return y"]
    for name, of in zip("bcdef", "abcde"):
        text += [f"def {name}(p, q):", f"  x = {of}(p, q)", "  return x"]
    lines = spark.createDataFrame([(f, "python", k + 1, t) for f in (1, 2) for k, t in enumerate(text[: 9 * f])], "file_id long, lang string, line_no int, text string")
    scoped = facts.assign_scope(lines)
    sets, counts = [], []
    for size in (512, 40, 0):
        monkeypatch.setattr(groups, "IN_ROW", size)
        before = len(tables)
        sets.append({(r.file_id, r.name): list(r.param_to_return) for r in tnt.summarize_functions(scoped, facts.extract_functions(lines)).collect()})
        counts.append(len(tables) - before)
    assert sets[0] == sets[1] == sets[2] and sets[0][2, "d"] == [1] and sets[0][1, "r"] == [0]
    assert counts[0] == 5 < counts[2]


def test_a_line_is_matched_once_and_by_its_language(spark):
    rules = [Rule("a", "X", r"zzsink\(", "m", "HIGH/HIGH", near=r"zznear", near_frame=(-2, 0)), Rule("b", "X", r"yysink\(", "m", "HIGH/HIGH")]
    rules = [replace(r, lang=lang) for r, lang in zip(rules, ("python", "java"), strict=True)]
    rows = [(1, "python", 1, "zznear"), (1, "python", 2, "zzsink(yysink(1))"), (2, "java", 1, "yysink(zzsink(2))")]
    got = det.match_rules(spark.createDataFrame(rows, "file_id long, lang string, line_no int, text string"), rules)
    assert sorted((r.file_id, r.line_no, r.rule_no) for r in got.collect()) == [(1, 2, 0), (2, 1, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "sink" in x]
