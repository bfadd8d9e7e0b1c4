"""Every rule row against its own matching and non-matching code."""

import pytest

from seepline.operators import facts
from seepline.plans import scan
from seepline.rules import PACKS, all_rules, rules_for

SEEDS = {
    "python": {"user": 'v1 = request.args.get("q")', "db": "v1 = cur.fetchone()"},
    "javascript": {"user": "const v1 = req.query.q;", "db": "const v1 = await User.findOne({id: 1});"},
    "java": {"user": 'String v1 = request.getParameter("q");', "db": "User v1 = em.find(User.class, 1);"},
    "php": {"user": '$v1 = $_GET["q"];', "db": "$v1 = $st->fetch_assoc();", "json": "$v1 = json_decode($x);",
            "unser": "$v1 = unserialize($x, ['allowed_classes' => false]);", "table": "$row9 = $st->fetch_assoc();\n$v1 = $row9['t'];"},
    "csharp": {"user": 'var v1 = Request.QueryString["q"];', "db": "var v1 = db.Users.Find(1);"},
    "ruby": {"user": "v1 = params[:q]", "db": "v1 = User.find(1)"},
    "go": {"user": 'v1 := r.FormValue("q")', "db": "rows.Scan(&v1)"},
}


def fill(text):
    return text.replace("{a}", "1").replace("{b}", "2")


def files_of(lang):
    rows, expect = [], []
    for rule in rules_for(lang):
        for kind, sample in (("hit", rule.hit), ("miss", rule.miss)):
            if not sample:
                continue
            label = (rule.label or "").split(",")[0]
            # Distance keeps seed lines out of context frames.
            head = SEEDS[lang][label] + "\n" * 25 if label else ""
            rows.append((len(rows), f"f{len(rows)}", lang, head + fill(sample)))
            expect.append((rule, kind))
    return rows, expect


@pytest.mark.parametrize("lang", PACKS)
def test_rule_samples(spark, lang):
    rows, expect = files_of(lang)
    files = spark.createDataFrame(rows, "file_id long, path string, lang string, content string")
    hits = scan.scan_language(facts.explode_lines(files), lang).select("file_id", "rule_id", "tainted").collect()
    found = {(r.file_id, r.rule_id) for r in hits}
    tainted = {(r.file_id, r.rule_id) for r in hits if r.tainted}
    wrong = []
    for n, (rule, kind) in enumerate(expect):
        key = (n, rule.rule_id)
        if kind == "hit" and key not in (tainted if rule.label else found):
            wrong.append((rule.rule_id, "not found"))
        if kind == "miss" and key in (tainted if rule.plain else found):
            wrong.append((rule.rule_id, "found"))
    assert not wrong


def test_conditions_on_the_whole_file(spark):
    """The other pattern stands thousands of lines away, in other blocks, before or after."""
    far = "\n" * 9000
    use, key = "t1.Execute(w, d)", "ViewStateUserKey = Session.SessionID;"
    imported, view = 'import "text/template"', "EnableViewState = true;"
    texts = [
        ("go", imported + far + use), ("go", use + far + imported), ("go", imported + far), ("go", use),
        ("csharp", view + far + key), ("csharp", key + far + view), ("csharp", view + far), ("csharp", key),
    ]
    rows = [(n, f"f{n}", lang, text) for n, (lang, text) in enumerate(texts)]
    lines = facts.explode_lines(spark.createDataFrame(rows, "file_id long, path string, lang string, content string"))
    hits = [h for lang in ("go", "csharp") for h in scan.scan_language(lines, lang).collect()]
    found = {(h.file_id, h.line_no) for h in hits if h.rule_id in ("go-text-template", "cs-viewstate-user")}
    assert found == {(0, 1), (1, 9001), (6, 1)}


def test_rule_ids_are_unique_and_sampled():
    ids = [r.rule_id for r in all_rules()]
    assert len(ids) == len(set(ids))
    assert all(r.hit for r in all_rules())
