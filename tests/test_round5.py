"""What the fifth round changed: plans that do less per line and give the same rows."""

import random

from pyspark.sql import functions as F

from seepline.operators import brackets, scopes
from workload.corpus import LANGS, SHAPES, samples

ODD = {
    "javascript": ["f(a, b] {", "x = (a) : T => {", "get(a) {", "a => {", "k: async (b) => {", "function(a", "m(a): {", "m(a;b) : x {"],
    "java": ["List<String> foo(int a) {", "Foo(a} {", "A b (", "int[] a (x)", "foo<T>(x) {", "C (int a) {", "return foo(a) {", "int f(a);"],
    "csharp": ["~K() {", "int? f(a)", "K(a) : base {", "K(a) : base(a) {", "Task<int> G(a) where T : x {", "void f(a,"],
    "php": ["fn($a) => 1", "$x = function ($a) use ($b) {", "if (a) {"],
    "go": ["func (r *T) m(a int) {", "x := func(a int) {", "go f(a)"],
    "python": ["async def f(a):", "  def g(", "x = undef (a)"],
    "ruby": ["def f", "  def self.g!(a)", "def h(a"],
}


def test_lines_without_a_header_arent_cut_into_pieces(spark):
    rows = [(1, l, n, t) for l in LANGS if l != "webconfig" for n, t in enumerate(x for s in (*SHAPES[l], *samples(l), *ODD[l]) for x in s.split("\n"))]
    lines = spark.createDataFrame(rows, "file_id long, lang string, line_no int, text string")
    every = brackets.rounds(scopes.readable(lines).filter(F.col("text").contains("(")), scopes.KEYS, "text", scopes.ARROW)
    leads = {(r.lang, r.line_no) for r in lines.filter(scopes._may_lead(F.col("text"))).collect()}
    assert len(leads) * 4 < every.select("lang", "line_no").distinct().count() * 2 < 2 * len(rows)

    plain = scopes._may_lead
    found = sorted(map(str, scopes.headers(lines).collect()))
    scopes._may_lead = lambda text: text.contains("(")
    try:
        assert found == sorted(map(str, scopes.headers(lines).collect()))
    finally:
        scopes._may_lead = plain


def test_marks_of_a_text_are_those_of_its_pieces(spark):
    texts = [t for l in LANGS for s in (*SHAPES[l], *samples(l)) for t in s.split("\n")] + ['a("x{", \'}\' + "{', "`a{${b}` {", '"\\"{" }', ""]
    lines = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "line_no int, text string")
    whole = F.array_join(F.transform(brackets.cut_text("text"), lambda p: p["mark"]), "")
    assert lines.filter(whole != brackets.marks("text")).count() == 0


def test_written_tables_arent_written_again(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "javascript", n, t) for n, t in enumerate(["function f(a) {", "  x = a;", "}", "y = 1;"], 1)], "file_id long, lang string, line_no int, text string")
    found = scopes.cut(scopes.functions(scopes.cut(lines)))
    monkeypatch.setattr(scopes.frames, "cut", lambda df: (_ for _ in ()).throw(AssertionError("written again")))
    assert {r.line_no: r.scope_id for r in scopes.assign(lines, found).collect()} == {1: 1, 2: 1, 3: 1, 4: 0}


def test_contexts_are_seen_across_blocks_in_one_pass(spark, monkeypatch):
    from seepline.operators import detect as det
    from seepline.rules.model import Rule

    texts = ["hit_a", "hit_b", "ctx_one", "other", "ctx_two"]
    r = random.Random(7)
    rows = [(f, "python", n, r.choice(texts)) for f in (1, 2, 3) for n in range(1, 60)] + [(None, "python", 1, "hit_a"), (None, "python", 2, "ctx_one"), (4, "python", 1, "hit_b"), (4, "python", 1, None)]
    lines = spark.createDataFrame(rows, "file_id long, lang string, line_no int, text string")
    rules = [
        Rule("a", "A", "hit_a", "", "LOW/LOW", lang="python", near="ctx_one", near_frame=(-2, 3)), Rule("b", "B", "hit_b", "", "LOW/LOW", lang="python", absent="ctx_two", absent_frame=(0, 4)),
        Rule("c", "C", "hit_[ab]", "", "LOW/LOW", lang="python", near="ctx_one", near_frame=(-1, 0), absent="ctx_two", absent_frame=(-3, -1)), Rule("d", "D", "hit_b", "", "LOW/LOW", lang="python"),
    ]

    def there(f, n, text, lo, hi):
        return any(x[0] == f and n + lo <= x[2] <= n + hi and x[3] == text for x in rows)

    want = []
    for f, _, n, t in rows:
        one, two = (lambda lo, hi: there(f, n, "ctx_one", lo, hi)), (lambda lo, hi: there(f, n, "ctx_two", lo, hi))
        want += [(f, n, k) for k, ok in enumerate((t == "hit_a" and one(-2, 3), t == "hit_b" and not two(0, 4), t in ("hit_a", "hit_b") and one(-1, 0) and not two(-3, -1), t == "hit_b")) if ok]
    key = lambda x: (x[0] or 0, *x[1:])
    for size in (det.NEAR, 3):
        monkeypatch.setattr(det, "NEAR", size)
        hits = det.match_rules(lines, rules)
        assert sorted(((r.file_id, r.line_no, r.rule_no) for r in hits.collect()), key=key) == sorted(want, key=key)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("windowspecdefinition(") == plan.count("collect_set(") == 1


def test_lines_that_call_no_function_of_their_file_arent_read_by_brackets(spark):
    from seepline.operators import evidence, facts

    texts = ["function f(a, b) {", "g(f(x, y), 1)", "h(z)", "9f(v)", "o.f(w)", "this.f(u, f(t))", "x = 1", "f (s", "'f(q)'"]
    rows = [(f, "javascript", 0, n, t) for f in (1, 2) for n, t in enumerate(texts, 1) if f == 1 or n > 1]
    scoped = spark.createDataFrame(rows, "file_id long, lang string, scope_id int, line_no int, text string")
    params = spark.createDataFrame([(1, 1, "f", p, v) for p, v in enumerate("ab")], "file_id long, scope_id int, name string, arg_pos int, var string")
    named = params.select("file_id", "name").distinct()
    assert sorted(r.line_no for r in evidence._calling(scoped, named).collect()) == [1, 2, 4, 5, 6, 8, 9]
    got = sorted((r.line_no, r.src, r.dst) for r in evidence.argument_edges(scoped, params).collect())
    monkey = evidence._calling
    evidence._calling = lambda scoped, named: scoped
    try:
        assert got == sorted((r.line_no, r.src, r.dst) for r in evidence.argument_edges(scoped, params).collect()) and (2, "x", "a") in got and (6, "t", "a") in got
    finally:
        evidence._calling = monkey


def test_lines_without_comments_are_read_once_for_all_seeds_and_edges(spark):
    from seepline.functions import text as tx
    from seepline.operators import facts
    from seepline.plans import scan

    langs = [l for l in LANGS if l != "webconfig"]
    rows = [(1, l, n, t) for l in langs for n, t in enumerate(x for s in (*SHAPES[l], *samples(l), "  # a", "\t// b", "/* c", " * d", "x # e", 'f("a{b}", `c${d}`)', "g({e})", "") for x in s.split("\n"))]
    lines = spark.createDataFrame(rows, "file_id long, lang string, line_no int, text string")
    code = scan.taint_inputs(lines, langs)[0]
    assert "RLIKE" not in code._jdf.queryExecution().optimizedPlan().toString()
    comment = tx.by_language(F.col("lang"), lambda l: F.col("text").rlike(l.comment), langs)
    assert sorted(map(str, code.collect())) == sorted(map(str, lines.filter(~comment).collect()))

    def plain(l):
        bare = F.regexp_extract_all(F.regexp_replace("text", l.literal, '""'), F.lit(l.token), F.lit(1))
        inner = F.regexp_extract_all(F.array_join(F.regexp_extract_all("text", F.lit(l.interpolation), F.lit(1)), " "), F.lit(l.token), F.lit(1)) if l.interpolation else F.array().cast("array<string>")
        return F.array_union(bare, inner)

    both = lines.select(tx.identifiers(F.col("text"), F.col("lang"), langs).alias("a"), tx.by_language(F.col("lang"), plain, langs).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
