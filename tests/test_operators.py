"""Operators against brute force on small fixtures, and invariants."""

import fnmatch
import json
import random

from pyspark.sql import functions as F

from seepline.functions import frames, text as tx
from seepline.operators import detect as det, facts, findings as fnd, joins, taint as tnt
from seepline.plans import scan
from seepline.rules import all_rules, rules_for
from seepline.sources import advisories, config, files as src, reports

LINES = "file_id long, lang string, line_no int, text string"


def numbers(spark, n=60, keys=3, seed=1):
    rnd = random.Random(seed)
    rows = [(k, i, rnd.choice([None, None, rnd.randint(0, 9)])) for k in range(keys) for i in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, "k int, pos int, v int")


def test_framed_matches_brute_force_across_blocks(spark):
    rows, df = numbers(spark)
    for lo, hi in ((-5, 0), (-2, 10), (1, 10), (0, 3), (-7, -2)):
        got = {(r.k, r.pos): r.s for r in frames.framed(df, ["k"], "pos", {"s": (F.sum("v"), lo, hi)}, block=4).collect()}
        for k, pos, _ in rows:
            inside = [v for kk, p, v in rows if kk == k and pos + lo <= p <= pos + hi and v is not None]
            assert got[k, pos] == (sum(inside) if inside else None)
        assert len(got) == len(rows)


def test_running_values_match_brute_force_across_blocks(spark):
    rows, df = numbers(spark)
    for inclusive in (True, False):
        got = {(r.k, r.pos): r.x for r in frames.running_last(df, ["k"], "pos", F.col("v"), "x", inclusive=inclusive, block=5).collect()}
        for k, pos, _ in rows:
            seen = [v for kk, p, v in rows if kk == k and v is not None and (p <= pos if inclusive else p < pos)]
            assert got[k, pos] == (seen[-1] if seen else None)
    got = {(r.k, r.pos): r.x for r in frames.running_sum(df, ["k"], "pos", F.coalesce("v", F.lit(0)), "x", block=7).collect()}
    for k, pos, _ in rows:
        assert got[k, pos] == sum(v or 0 for kk, p, v in rows if kk == k and p <= pos)


def chain(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(1, 0, f"x{rnd.randint(0, 7)}", f"x{rnd.randint(0, 7)}", "user", rnd.randint(1, 20)) for _ in range(14)})
    edges = [e for e in edges if e[2] != e[3]]
    df = spark.createDataFrame(edges, "file_id long, scope_id int, src string, dst string, label string, line_no int")
    seeds = spark.createDataFrame([(1, 0, "x0", "user", 1)], "file_id long, scope_id int, var string, label string, line_no int")
    return edges, seeds, df


def test_propagation_matches_closure_and_sweeps(spark):
    for seed in range(4):
        edges, seeds, df = chain(spark, seed)
        reach, frontier, hops = {"x0": 0}, ["x0"], 0
        while frontier:
            hops += 1
            frontier = sorted({e[3] for e in edges if e[2] in frontier} - set(reach))
            reach.update({v: hops for v in frontier})
        full = {r["var"]: r["hop"] for r in tnt.propagate(seeds, df).collect()}
        assert full == reach
        for passes in (1, 2, 3):
            tainted = {"x0"}
            for _ in range(passes):
                for line in sorted({e[5] for e in edges}):
                    before = set(tainted)
                    tainted |= {e[3] for e in edges if e[5] == line and e[2] in before}
            got = {r["var"] for r in tnt.propagate_passes(seeds, df, passes).collect()}
            assert got == tainted and got <= set(full)


def test_cycles_end(spark):
    edges = [(1, 0, "a", "b", "user", 2), (1, 0, "b", "a", "user", 3)]
    df = spark.createDataFrame(edges, "file_id long, scope_id int, src string, dst string, label string, line_no int")
    seeds = spark.createDataFrame([(1, 0, "a", "user", 1)], "file_id long, scope_id int, var string, label string, line_no int")
    assert {r["var"] for r in tnt.propagate(seeds, df).collect()} == {"a", "b"}


def code(spark, lang, text):
    return facts.explode_lines(spark.createDataFrame([(1, "p", lang, text)], "file_id long, path string, lang string, content string"))


def test_lines_keep_inner_blanks_and_drop_the_last_break(spark):
    got = [(r.line_no, r.text) for r in code(spark, "python", "a\r\n\nb\rc\n").orderBy("line_no").collect()]
    assert got == [(1, "a"), (2, ""), (3, "b"), (4, "c")]


def test_calls_read_nested_arguments(spark):
    rows = facts.extract_calls(code(spark, "python", 'a.run(f(x, y), "p(q", [1, 2], k)')).collect()
    got = {r.callee: (r.receiver, r.args) for r in rows}
    assert got["run"] == ("a", ["f(x, y)", '""', "[1, 2]", "k"])
    assert got["f"] == ("", ["x", "y"])


def test_destructuring_takes_local_names(spark):
    a = facts.explode_targets(facts.extract_assignments(code(spark, "javascript", "const {a, b: c, ...d} = req.body;\nconst [e, f] = g;")))
    assert {r.lhs for r in a.collect()} == {"a", "c", "d", "e", "f"}


def test_statements_join_open_lines_and_split_unbounded_ones(spark):
    got = [r.text for r in facts.assemble_statements(code(spark, "python", "run(a,\n  b)\nx = 1")).orderBy("line_no").collect()]
    assert got == ["run(a, b)", "x = 1"]


def test_constants_are_folded(spark):
    text = "\n".join([
        'a = base64.b64decode("b3Muc3lzdGVt").decode()', 'b = bytes.fromhex("6576616c").decode()', 'c = codecs.decode("riny", "rot13")',
        "d = chr(101) + chr(118)", "e = 'sys' + 'tem'", "f = ''.join(['e', 'v', 'al'])", "g = other(1)",
    ])
    got = {r["var"]: r["value"] for r in joins.constants(facts.extract_assignments(code(spark, "python", text))).collect()}
    assert got == {"a": "os.system", "b": "eval", "c": "eval", "d": "ev", "e": "system", "f": "eval"}


def test_summaries_carry_taint_through_calls(spark):
    text = 'def g(x, y):\n    z = y\n    return z\ndef h():\n    a = request.args.get("q")\n    b = g(1, a)\n    c = g(a, 1)'
    got = {(r.scope_id, r["var"]) for r in tnt.interprocedural(code(spark, "python", text)).collect()}
    assert (4, "b") in got and (4, "c") not in got


def test_summaries_follow_long_chains_of_calls(spark):
    text = "def f0(x):\n    return x\n" + "".join(f"def f{k}(x):\n    y = f{k - 1}(x)\n    return y\n" for k in range(1, 7))
    text += 'def h():\n    a = request.args.get("q")\n    b = f6(a)'
    scoped = facts.assign_scope(code(spark, "python", text))
    names = {r["name"] for r in tnt.summarize_functions(scoped, facts.extract_functions(scoped.drop("scope_id"))).collect()}
    assert names == {f"f{k}" for k in range(7)}


def test_as_of_walks_have_no_depth(spark):
    text = 'v0 = request.args.get("q")\n' + "\n".join(f"v{k} = v{k - 1}" for k in range(1, 9)) + "\nw = 1\nrun(v8, w)"
    assigns = facts.explode_targets(facts.extract_assignments(code(spark, "python", text)))
    points = spark.createDataFrame([(1, "python", 0, v, 11) for v in ("v8", "w")], "file_id long, lang string, scope_id long, var string, line_no int")
    points = points.join(assigns.select("file_id").distinct().withColumnRenamed("file_id", "own")).drop("file_id").withColumnRenamed("own", "file_id")
    assert {r["var"] for r in joins.flow_sensitive(points, assigns).collect()} == {"v8"}


def test_literals_of_any_length(spark):
    text = 'x = "' + '\\"' * 100_000 + '" + y'
    row = code(spark, "python", text).select(tx.identifiers(F.col("text"), F.col("lang")).alias("names")).first()
    assert row.names == ["x", "y"]


def test_gates_need_anchor_exit_and_open_block(spark):
    text = '$p = "/^[a-z]+$/";\n$v = $_GET["q"];\nif (!preg_match($p, $v)) {\n  exit();\n}\n$w = $_GET["r"];\nif (!preg_match($p, $w)) {\n  log();\n}\nexit();'
    lines = code(spark, "php", text)
    a = facts.explode_targets(facts.extract_assignments(lines))
    assert {r["var"] for r in joins.validation_gates(lines, a).collect()} == {"v"}


def test_flow_sensitive_lookup_follows_last_assignment(spark):
    text = '$a = $_GET["q"];\n$b = $a;\nuse($b);\n$b = "x";\nuse($b);'
    a = facts.explode_targets(facts.extract_assignments(code(spark, "php", text)))
    points = spark.createDataFrame([(1, "php", 0, "b", 3), (1, "php", 0, "b", 5)], "file_id long, lang string, scope_id int, var string, line_no int")
    assert [r.line_no for r in joins.flow_sensitive(points, a).collect()] == [3]


def test_one_variable_sanitized_for_one_category_only(spark):
    text = '$v = escapeshellarg($_GET["q"]);\nsystem("ls " . $v);\nmysqli_query($c, "SELECT a FROM t WHERE n=$v");'
    got = {(r.line_no, r.category) for r in scan.scan_language(code(spark, "php", text), "php").filter("tainted").collect()}
    assert (3, "SQL_INJECTION") in got and (2, "COMMAND_INJECTION") not in got


def test_scan_suppresses_and_keeps_the_best_finding(spark):
    text = 'v = request.args.get("q")\neval(v)\neval(v)  # nosec\nos.system(v)'
    files = spark.createDataFrame([(1, "p.py", "python", text)], "file_id long, path string, lang string, content string")
    got = scan.scan(files, rules_for("python"))
    rows = {(r.line_no, r.category): (r.severity, r.rule_id) for r in got.collect()}
    assert rows[2, "CODE_INJECTION"] == ("CRITICAL", "py-eval") and (3, "CODE_INJECTION") not in rows
    again = fnd.dedup_findings(got.withColumn("priority", F.lit(0)))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got.collect()}


def test_all_languages_in_one_plan(spark):
    rows = [(1, "a.py", "python", 'v = request.args.get("q")\neval(v)'), (2, "b.php", "php", '$v = $_GET["q"];\neval($v);'), (3, "c.config", "webconfig", '<trace enabled="true" />')]
    files = spark.createDataFrame(rows, "file_id long, path string, lang string, content string")
    got = {(r.file_id, r.category) for r in scan.scan(files, [r for r in all_rules() if r.lang in ("python", "php", "webconfig")]).collect()}
    assert {(1, "CODE_INJECTION"), (2, "CODE_INJECTION"), (3, "INFO_DISCLOSURE")} <= got


def test_result_does_not_depend_on_partitions(spark):
    text = "\n".join(['v0 = request.args.get("q")'] + [f"v{i + 1} = v{i}" for i in range(6)] + ["eval(v6)"])
    lines = code(spark, "python", text)
    out = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(tuple(r) for r in scan.scan_language(lines, "python").select("line_no", "rule_id", "tainted").collect()))
    assert out[0] == out[1] and (8, "py-eval", True) in out[0]


def test_prefilter_literals_never_hide_a_match():
    for r in all_rules():
        pattern = r.pattern[4:].lower() if r.pattern.startswith("(?i)") else r.pattern
        text = r.hit.replace("{a}", "1")
        literals = det.required_literals(pattern)
        subject = text.lower() if r.pattern.startswith("(?i)") else text
        assert not literals or any(x in subject for x in literals), r.rule_id


def test_globs_match_like_fnmatch(spark):
    paths = ["a/b.py", "a/tests/x.js", "lib/q.js", "r1/x.js", "api/v1/z.go"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for g in ("*/tests/*", "r?/*.js", "[al]*/b.py", "*.go", "a/*"):
        kept = {r.path for r in src.exclude_globs(df, [g]).collect()}
        assert kept == {p for p in paths if not fnmatch.fnmatchcase(p, g)}
    assert {r.path for r in src.exclude_globs(df, ["api/"]).collect()} == set(paths[:4])


def test_files_are_read_decoded_and_selected(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes("x = 'é'\n".encode())
    (tmp_path / "src" / "b.php").write_bytes("$x = 'é';\n".encode("latin-1"))
    (tmp_path / "src" / "c.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r.lang, r.content, r.utf8) for r in
           src.with_language(src.decode_content(src.with_file_id(src.read_files(spark, str(tmp_path))))).collect()}
    assert got == {"a.py": ("python", "x = 'é'\n", True), "b.php": ("php", "$x = 'é';\n", False)}


def test_config_and_reports(spark, tmp_path):
    conf = tmp_path / "rules.json"
    conf.write_text(json.dumps({"sources": {"python": ["get_input"]}, "sinks": {"php": {"SQL": ["run"]}}, "min_confidence": "LOW"}))
    assert {tuple(r)[1:] for r in config.load_rules(spark, str(conf)).collect()} == {("source", "python", None, "get_input"), ("sink", "php", "SQL", "run")}
    rows = [(1, 2, "SSTI", "HIGH", "LOW", "r1"), (1, 1, "SSTI", "LOW", "LOW", "r2")]
    found = spark.createDataFrame(rows, "file_id long, line_no int, category string, severity string, confidence string, rule_id string")
    reports.write_text_report(found, str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()][0].startswith("1:1 [LOW/LOW] SSTI")
    reports.write_json_report(found, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 2 + 4


def test_advisories_keep_plain_and_described_causes(spark):
    doc = json.dumps({"vulnerabilities": {"p": {"severity": "moderate", "range": "<2", "fixAvailable": {"name": "p"}, "via": ["q", {"title": "T", "url": "U"}]}, "r": {"via": []}}})
    got = {r.package: (r.severity, r.description) for r in advisories.flatten_advisories(spark.createDataFrame([(1, doc)], "id int, doc string"), "id", "doc").collect()}
    assert got == {"p": ("MEDIUM", "T; U; Fix available: yes; Affected range: <2"), "r": ("LOW", "Fix available: no; Affected range: unknown")}


def test_ranges_exclude_hits_inside(spark):
    hits = spark.createDataFrame([(1, n) for n in range(1, 10)], "page_id int, line_no int")
    ranges = spark.createDataFrame([(1, 2, 3), (1, 6, 6)], "page_id int, start_line int, end_line int")
    assert sorted(r.line_no for r in joins.exclude_ranges(hits, ranges, "page_id").collect()) == [1, 4, 5, 7, 8, 9]
