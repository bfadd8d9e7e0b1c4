"""Categories for which input still reaches a point, by the definitions on its way."""

from seepline.operators import facts, joins


def test_cleared_state_follows_copies_and_is_reset(spark):
    text = """$q = $_GET["q"];
$s = addslashes($q);
$t = $s . "x";
$m = $t . $q;
$n = intval($q);
$s = $_GET["z"];
$e = escapeshellarg($t);
run($q, $s, $t, $m, $n, $e);"""
    lines = facts.explode_lines(spark.createDataFrame([(1, "php", text)], "file_id long, lang string, content string"))
    assigns = facts.explode_targets(facts.extract_assignments(lines))
    points = spark.createDataFrame([(1, "php", 0, v, 8) for v in "qstmne"] + [(1, "php", 0, "s", 3), (1, "php", 0, "none", 8)], "file_id long, lang string, scope_id int, var string, line_no int")
    got = {}
    for r in joins.category_taint(points, assigns).collect():
        got.setdefault((r["var"], r.line_no), set()).add(r.category)
    every = set(joins.SANITIZED)
    assert every == {"SQL_INJECTION", "COMMAND_INJECTION", "XSS"}
    assert got == {("q", 8): every, ("s", 8): every, ("t", 8): every - {"SQL_INJECTION"}, ("s", 3): every - {"SQL_INJECTION"}, ("m", 8): every, ("e", 8): {"XSS"}}


def test_no_points(spark):
    lines = facts.explode_lines(spark.createDataFrame([(1, "php", "$a = 1;")], "file_id long, lang string, content string"))
    points = spark.createDataFrame([], "file_id long, lang string, scope_id int, var string, line_no int")
    assert joins.category_taint(points, facts.explode_targets(facts.extract_assignments(lines))).count() == 0
