"""Nested functions: facts of modern code, and the innermost function around each line."""

import random

import pytest
from pyspark.sql import functions as F

from seepline.operators import facts, scopes, taint as tnt
from seepline.plans import scan
from seepline.rules import rules_for

CODE = {
    "javascript": """app.get('/x', async (req, res) => {
  const q = req.query.q;
  items.forEach(x => {
    use(x);
  });
  db.query(q);
});
class A extends B {
  async run(a, {b, c}) {
    if (a) {
      return b;
    }
  }
  static go(x) { return x; }
}
const f = (a, b = g(1, 2)) => {
  return a;
};
function outer(p) {
  function inner(q) {
    return q;
  }
  return inner(p);
}
const h = async y => {
  return "}";
};
module.exports.z = function (u) {
  return u;
};
top();""",
    "java": """public class C {
  @GetMapping("/x")
  public String f(@RequestParam("q") String q, Map<String, List<Integer>> m) throws A, B {
    Runnable r = new Runnable() {
      public void run() {
        go(q);
      }
    };
    return q;
  }
  int g(int a)
  {
    if (a > 1) { return a; }
    return 2;
  }
  C(String s) {
    this.s = s;
  }
  abstract void n(String t);
}""",
    "python": """def a(x, y=f(1, 2)):
    z = 1

    def b(q):
        return q
    return b(x)
w = 2
class K:
    async def m(self, p):
        return p
    def n(self): return 1
v = 3
def last(u):
    return u""",
    "go": """func (s *Srv) H(w http.ResponseWriter, r *http.Request) {
  f := func(a int) int {
    return a
  }
  f(1)
}
func g(x string) (int, error) {
  return 1, nil
}""",
    "csharp": """public class K : B {
  public K(string v) : base(v) {
    x = v;
  }
  ~K() {
    Run(x);
  }
  public async Task<List<string>> F(string a, int b = 2)
  {
    return a;
  }
}""",
    "php": """class H {
  public function __construct($a) {
    $this->a = $a;
  }
  public function g($x): ?string
  {
    array_map(function ($y) {
      return $y;
    }, $x);
  }
}""",
    "ruby": """def a(x)
  x.each do |y|
    y
  end
  x
end
def b
  1
end
c""",
}
# name, first line, last line, parents
FUNCTIONS = {
    "javascript": {("", 1, 7, ()), ("", 3, 5, (1,)), ("run", 9, 13, ()), ("go", 14, 14, ()), ("f", 16, 18, ()), ("outer", 19, 24, ()), ("inner", 20, 22, (19,)), ("h", 25, 27, ()), ("", 28, 30, ())},
    "java": {("f", 3, 10, ()), ("run", 5, 7, (3,)), ("g", 11, 15, ()), ("C", 16, 18, ())},
    "python": {("a", 1, 6, ()), ("b", 4, 5, (1,)), ("m", 9, 10, ()), ("n", 11, 11, ()), ("last", 13, 14, ())},
    "go": {("H", 1, 6, ()), ("", 2, 4, (1,)), ("g", 7, 9, ())},
    "csharp": {("K", 2, 4, ()), ("K", 5, 7, ()), ("F", 8, 11, ())},
    "php": {("__construct", 2, 4, ()), ("g", 5, 10, ()), ("", 7, 9, (5,))},
    "ruby": {("a", 1, 6, ()), ("b", 7, 9, ())},
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, lang, text) for k, (lang, text) in enumerate(sorted(CODE.items()))]
    return facts.explode_lines(spark.createDataFrame(rows, "file_id long, lang string, content string"))


@pytest.fixture(scope="module")
def found(lines):
    return scopes.functions(lines).cache()


def test_functions_of_each_language(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.lang, set()).add((r.name, r.start_line, r.end_line, tuple(r.parents)))
    assert got == FUNCTIONS


def test_parameters_within_brackets(found):
    params = {(r.lang, r.name): r.params for r in found.filter("name <> ''").collect()}
    assert params["javascript", "f"] == ["a", "b = g(1, 2)"] and params["javascript", "run"] == ["a", "{b, c}"]
    assert params["java", "f"][0] == '@RequestParam("q") String q' and len(params["java", "f"]) == 2
    assert params["python", "a"] == ["x", "y=f(1, 2)"] and params["go", "H"] == ["w http.ResponseWriter", "r *http.Request"]
    seeds = tnt.seed_parameters(facts.explode_parameters(found.filter("lang = 'java'"), ["java"]), ["java"], file_level=False)
    assert [(r["scope_id"], r["var"]) for r in seeds.collect()] == [(3, "q")]


def test_lines_belong_to_the_innermost_function(lines, found):
    for r in scopes.assign(lines, found).collect():
        around = [f for f in FUNCTIONS[r.lang] if f[1] <= r.line_no <= f[2]]
        assert r.scope_id == max((f[1] for f in around), default=0), (r.lang, r.line_no)


def test_random_nesting_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(scopes.frames, "BLOCK", 7)
    for fn in (scopes.frames.running_last, scopes.frames.running_sum):
        monkeypatch.setattr(fn, "__defaults__", tuple(7 if d == 4096 else d for d in fn.__defaults__))
    r = random.Random(3)
    rows, want = [], {}
    for file_id in range(12):
        text, stack, n = [], [], 0
        while len(text) < 120:
            act, line = r.random(), len(text) + 1
            if act < 0.25 and len(stack) < 9:
                kind = r.choice(["fn", "fn", "if"])
                text.append(f"function n{line}(a) {{" if kind == "fn" else "if (a) {")
                stack.append(line if kind == "fn" else None)
                inner = [s for s in stack if s]
            elif act < 0.5 and stack:
                inner = [s for s in stack if s]  # a closing line is still inside
                text.append("}")
                stack.pop()
            else:
                inner = [s for s in stack if s]
                text.append('use("{", a);')
            want[file_id, line] = inner[-1] if inner else 0
        while stack:
            want[file_id, len(text) + 1] = ([s for s in stack if s] or [0])[-1]
            text.append("}")
            stack.pop()
        rows.append((file_id, "javascript", "\n".join(text)))
    lines = facts.explode_lines(spark.createDataFrame(rows, "file_id long, lang string, content string")).repartition(5)
    got = {(x.file_id, x.line_no): x.scope_id for x in scopes.assign(lines, scopes.functions(lines)).collect()}
    assert got == want


def test_no_functions(spark):
    lines = facts.explode_lines(spark.createDataFrame([(1, "python", "x = 1\n\n"), (2, "go", "")], "file_id long, lang string, content string"))
    found = scopes.functions(lines)
    assert found.count() == 0 and scopes.assign(lines, found).filter(F.col("scope_id") != 0).count() == 0


JS = """app.get('/a', (req, res) => {
  const q = req.query.q;
  items.forEach(x => {
    db.query("select " + q);
  });
});
app.get('/b', (req, res) => {
  const q = "static";
  db.query("select " + q);
});
function pass(a, b) {
  return b;
}
function use(r) {
  const t = req.body.t;
  const v = pass(id(t, 1), 2);
  const w = pass(1, t);
  db.query("select " + v);
  db.query("select " + w);
}"""
PY = """def a():
    q = request.args.get("q")
    def inner():
        cursor.execute("SELECT " + q)
    inner()
def b():
    q = "x"
    cursor.execute("SELECT " + q)"""


def test_findings_by_function(spark):
    files = spark.createDataFrame([(1, "a.js", "javascript", JS), (2, "a.py", "python", PY)], "file_id long, path string, lang string, content string")
    rules = [r for lang in ("javascript", "python") for r in rules_for(lang) if r.category == "SQL_INJECTION"]
    strong = lambda df: sorted((r.file_id, r.line_no) for r in df.filter("severity = 'CRITICAL' and confidence = 'HIGH'").collect())
    by_function, by_file = strong(scan.scan_functions(files, rules)), strong(scan.scan(files, rules))
    # the second handler's own q is no input, the first one's is captured, and only the second argument comes back
    assert [x for x in by_function if x[0] == 1] == [(1, 4), (1, 19)]
    assert [x for x in by_file if x[0] == 1] == [(1, 4), (1, 9), (1, 18), (1, 19)]
    assert (2, 4) in by_function and (2, 8) not in by_function and (2, 8) in by_file


def test_owner_is_the_innermost_declaring_scope(spark):
    found = spark.createDataFrame([(1, 1, []), (1, 3, [1]), (1, 5, [3, 1])], "file_id long, scope_id int, parents array<int>")
    declared = spark.createDataFrame([(1, 0, "g"), (1, 1, "a"), (1, 3, "a"), (1, 5, "b")], "file_id long, scope_id int, var string")
    names = spark.createDataFrame([(1, 5, v) for v in "abgz"] + [(1, 1, "a"), (1, 0, "g"), (1, 1, "b")], "file_id long, scope_id int, var string")
    got = {(r.scope_id, r["var"]): r.owner for r in scopes.owners(names, declared, found).collect()}
    assert got == {(5, "a"): 3, (5, "b"): 5, (5, "g"): 0, (1, "a"): 1, (0, "g"): 0}
    assert {(r.scope_id, r["var"]) for r in scopes.resolve(names, scopes.owners(names, declared, found)).collect()} == {(3, "a"), (5, "b"), (0, "g"), (5, "z"), (1, "a"), (1, "b")}


FLOWS = """function handler(req, res) {
  const q = req.query.q;
  const copy = q;
  store(1, copy);
  store("x", 2);
  other.store(3, copy);
}
function store(n, value) {
  db.query("select " + value);
  db.query("select " + n);
}
function put(target, key, free) {
  target[key] = 1;
  const own = free;
  items.forEach((x) => {
    target[x] = 2;
    target[key] = 3;
    target[own] = 4;
    if (target[key] == 5) return;
  });
}
function answer(req, res) {
  const name = req.body.name;
  const fixed = "a";
  respond(res, name);
  respond(res, fixed);
}"""


def test_taint_enters_parameters_and_findings_say_all(spark):
    files = spark.createDataFrame([(1, "src/a.js", "javascript", FLOWS)], "file_id long, path string, lang string, content string")
    rules = [r for r in rules_for("javascript") if r.category in ("SQL_INJECTION", "PROTOTYPE_POLLUTION", "REFLECTED_XSS")]
    rows = scan.scan_described(files, rules).collect()
    strong = {r.line_no: r for r in rows if r.category == "SQL_INJECTION" and r.severity == "CRITICAL" and r.confidence == "HIGH"}
    assert set(strong) == {9}  # the second argument, through the file's own function only
    assert strong[9].path == "src/a.js" and strong[9].chain == "user source at line 2: q -> copy -> value" and strong[9].code == 'db.query("select " + value);'
    assert FLOWS.split("\n")[8][strong[9].column - 1 :].lstrip(".").startswith(("db", "query")) and strong[9].cwe_id == "CWE-89" and "line 9" in strong[9].message
    # the innermost parameter or the captured one, not a variable made of one, not a comparison
    assert {r.line_no for r in rows if r.rule_id == "js-parameter-key"} == {13, 16, 17}
    assert [r.line_no for r in rows if r.rule_id == "js-output-wrapper"] == [25]
    assert {(r.file_id, r.line_no, r.category) for r in rows} == {(r.file_id, r.line_no, r.category) for r in scan.scan_functions(files, rules).collect()}
