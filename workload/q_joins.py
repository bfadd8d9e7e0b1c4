"""Joins between facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepline.operators import detect as det, facts, findings as fnd, joins, taint as tnt
from seepline.plans import scan
from seepline.plans.durable import cut
from seepline.rules import rules_for
from seepline.rules.languages import CATEGORY_SANITIZERS

from . import sqlfacts as sf
from .corpus import files, quote, tables
from .q_sources import AW, CW, FOLD_SQL, FW, LW, code, lines
from .q_taint import R, assigns
from .registry import query

PHP = ("php",)
PHP_RULES = rules_for("php")
PY_RULES = rules_for("python")
PY = ("python",)


def pack_ctes(lang, rules, taint=True):
    return ",".join([sf.base((lang,)), sf.full_taint((lang,)), sf.pack_hits(lang, rules, taint), sf.GRADED])


PY_SQL = "with recursive " + pack_ctes("python", PY_RULES)


def python_hits(spark, d):
    return scan.scan_language(lines(spark, d, PY), "python")


@query("sink_taint_join", PY_SQL + " select file_id, line_no, rule_id from flagged where tainted")
def sink_taint_join(spark, d):
    ls = lines(spark, d, PY)
    t = scan.file_taint(ls, PY)
    hits = det.join_taint(cut(det.match_rules(ls, PY_RULES)), PY_RULES, t.marks, t.sanitized).filter("tainted")
    dim = F.broadcast(det.rule_table(spark, PY_RULES).select("rule_no", "rule_id"))
    return hits.join(dim, "rule_no").select("file_id", "line_no", "rule_id")


@query("grade_untainted", PY_SQL + " select file_id, line_no, rule_id, severity, confidence from graded where severity is not null and not tainted")
def grade_untainted(spark, d):
    return python_hits(spark, d).filter("not tainted").select("file_id", "line_no", "rule_id", "severity", "confidence")


@query("rule_dimension_join", PY_SQL + " select file_id, line_no, rule_id, category, priority from graded where severity is not null")
def rule_dimension_join(spark, d):
    return python_hits(spark, d).select("file_id", "line_no", "rule_id", "category", "priority")


@query("drop_sanitized", "with recursive " + sf.base(PHP) + "," + sf.full_taint(PHP) + " select m.file_id, m.var, c.category from marks m, (values ('SQL_INJECTION'),('COMMAND_INJECTION')) c(category) where label = 'user' and not exists (select 1 from san s where s.file_id = m.file_id and s.var = m.var and s.category = c.category)")
def drop_sanitized(spark, d):
    t = scan.file_taint(lines(spark, d, PHP), PHP)
    wanted = F.explode(F.array(F.lit("SQL_INJECTION"), F.lit("COMMAND_INJECTION")))
    users = t.marks.filter("label = 'user'").select("file_id", "scope_id", "var", wanted.alias("category"))
    return users.join(t.sanitized, ["file_id", "scope_id", "var", "category"], "left_anti").select("file_id", "var", "category")


RECV = ",".join(quote(x) for x in joins.RECEIVERS)


@query(
    "gate_receivers",
    CW + f""", c as (select file_id, line_no, unnest(regexp_extract_all(regexp_replace(text, '"[^"]*"|''[^'']*''', '""', 'g'), {quote(facts.CALL)}, 1)) nm from code where lang = 'python')
 select distinct file_id, line_no, nm as name from c where regexp_replace(regexp_extract(nm, '^(\\w+)', 1), '\\d+$', '') in ({RECV}) and contains(nm, '.')""",
)
def gate_receivers(spark, d):
    calls = facts.extract_calls(code(spark, d, PY)).filter("receiver <> ''")
    return joins.gate_receivers(calls).select("file_id", "line_no", F.concat_ws(".", "receiver", "callee").alias("name")).distinct()


@query(
    "unsecured_factories",
    "with " + sf.base(("java",)) + "," + sf.code_lines(("java",)) + f""", c as (select file_id, line_no, regexp_extract(text, {quote(joins.FACTORY)}, 1) as var, regexp_extract(text, {quote(joins.FACTORY)}, 2) factory from code),
 h as (select distinct file_id, regexp_extract(text, {quote(joins.HARDENING)}, 1) as var from code) select file_id, var, line_no, factory from c where var <> '' and not exists (select 1 from h where h.file_id = c.file_id and h.var = c.var)""",
)
def unsecured_factories(spark, d):
    return joins.unsecured_factories(code(spark, d, ("java",))).select("file_id", "var", "line_no", "factory")


POINTS = "pt as (select distinct file_id, lang, line_no, unnest({}) as var from code where contains(text, '(') and lang <> 'webconfig')".format(sf.idents(sf.rhs_sql("text")))


def points(spark, d, langs=None, of=None):
    """Names used by calls; of: code lines that are there already."""
    from seepline.functions import text as tx

    c = facts.with_scope(code(spark, d, langs) if of is None else of).filter(F.col("text").contains("(")).withColumn("part", tx.right_hand_side(F.col("text")))
    return facts.explode_tokens(c, "part", langs).select("file_id", "lang", "scope_id", "line_no", "var")


@query(
    "nearest_assignment",
    AW + "," + POINTS + """, dd as (select file_id, lhs as var, line_no, max(rhs) rhs from tgt group by all)
 select p.file_id, p.var, p.line_no, arg_max(dd.rhs, dd.line_no) as rhs, cast(max(dd.line_no) as int) as def_line from pt p join dd on dd.file_id = p.file_id and dd.var = p.var and dd.line_no < p.line_no group by p.file_id, p.var, p.line_no""",
)
def nearest_assignment(spark, d):
    read = cut(code(spark, d))  # points and assignments read the same lines
    placed = joins.nearest_assignment(points(spark, d, of=read).drop("lang"), facts.explode_targets(facts.extract_assignments(read)))
    return placed.filter("rhs is not null").select("file_id", "var", "line_no", "rhs", "def_line")


SOURCE = sf.case(lambda l: f"({sf.rx('rhs', l.source)} and not {sf.rx('rhs', l.safe_source)})")
KILLED = sf.case(lambda l: sf.rx("rhs", l.killer))


@query(
    "flow_sensitive_taint",
    AW.replace("with ", "with recursive ", 1) + "," + POINTS + f""", dd as (select file_id, lang, lhs as var, line_no, max(rhs) rhs from tgt group by all),
lk as (select distinct file_id, lang, var, line_no from pt union select file_id, lang, unnest({sf.idents('rhs')}) as var, line_no from dd),
nd as (select l.file_id, l.lang, l.var, l.line_no, max(dd.line_no) def_line, arg_max(dd.rhs, dd.line_no) rhs from lk l join dd on dd.file_id = l.file_id and dd.var = l.var and dd.line_no < l.line_no group by all),
jd as (select *, {SOURCE} as is_source from nd where not {KILLED}),
st as (select distinct file_id, var as of_var, line_no as of_line, def_line as line_no, unnest({sf.idents('rhs')}) as var from jd where not is_source),
ok(file_id, var, line_no) as (
 select file_id, var, line_no from jd where is_source
 union select s.file_id, s.of_var, s.of_line from st s join ok o on o.file_id = s.file_id and o.var = s.var and o.line_no = s.line_no)
select distinct p.file_id, p.var, p.line_no from pt p join ok o on o.file_id = p.file_id and o.var = p.var and o.line_no = p.line_no""",
)
def flow_sensitive_taint(spark, d):
    read = cut(code(spark, d))  # points and assignments read the same lines
    return joins.flow_sensitive(points(spark, d, of=read), cut(facts.explode_targets(facts.extract_assignments(read)))).select("file_id", "var", "line_no")


CLEARS = " or ".join(f"(d.lang = {quote(l)} and c.category = {quote(c)} and {sf.rx('d.rhs', p)})" for l, by in CATEGORY_SANITIZERS.items() for c, p in by.items())


@query(
    "category_taint",
    AW.replace("with ", "with recursive ", 1) + "," + POINTS + f""", dd as (select file_id, lang, lhs as var, line_no, max(rhs) rhs from tgt group by all),
cat(category) as (values {','.join(f"({quote(c)})" for c in joins.SANITIZED)}),
dk as (select *, {KILLED} as killed, {SOURCE} as is_source from dd),
op as (select d.*, category from dk d, cat c where not killed and not ({CLEARS})),
us as (select distinct file_id, var as of_var, line_no as of_line, category, unnest({sf.idents('rhs')}) as var from op),
ed as (select u.file_id, of_var, of_line, u.var, category, max(d.line_no) line_no from us u join dd d on d.file_id = u.file_id and d.var = u.var and d.line_no < u.of_line group by all),
got(file_id, var, line_no, category) as (
 select file_id, var, line_no, category from op where is_source
 union select e.file_id, e.of_var, e.of_line, e.category from ed e join got g on g.file_id = e.file_id and g.var = e.var and g.line_no = e.line_no and g.category = e.category),
pn as (select p.file_id, p.var, p.line_no, max(d.line_no) def_line from pt p join dd d on d.file_id = p.file_id and d.var = p.var and d.line_no < p.line_no group by all)
select p.file_id, p.var, p.line_no, category from pn p join got g on g.file_id = p.file_id and g.var = p.var and g.line_no = p.def_line""",
)
def category_taint(spark, d):
    return joins.category_taint(points(spark, d), cut(assigns(spark, d))).select("file_id", "var", "line_no", "category")


@query("assign_scope", FW + " select c.file_id, c.line_no, coalesce((select max(scope_id) from fn f where f.file_id = c.file_id and f.scope_id <= c.line_no), 0) as scope_id from code c where lang <> 'webconfig'")
def assign_scope(spark, d):
    return facts.assign_scope(code(spark, d)).select("file_id", "line_no", "scope_id")


@query("validation_gates", "with recursive " + sf.base(PHP) + "," + sf.code_lines(PHP) + "," + sf.assigns(PHP) + "," + sf.GATE_SQL + " select file_id, var from gat")
def validation_gates(spark, d):
    a = assigns(spark, d, PHP)
    return joins.validation_gates(lines(spark, d, PHP), a).select("file_id", "var")


@query("subtract_validated", "with recursive " + sf.base(PHP) + "," + sf.full_taint(PHP) + " select distinct file_id, var, label from taint t where not (label = 'user' and exists (select 1 from gat g where g.file_id = t.file_id and g.var = t.var))")
def subtract_validated(spark, d):
    ls = lines(spark, d, PHP)
    _, a, seeds, edges = scan.taint_inputs(ls, PHP)
    return joins.subtract_validated(tnt.propagate(seeds, edges), joins.validation_gates(ls, a)).select("file_id", "var", "label")


@query("safe_literals", AW + f" select file_id, lhs as var from tgt group by file_id, lhs having bool_and(regexp_matches(rhs, {quote(joins.LITERAL_ONLY)}))")
def safe_literals(spark, d):
    return joins.safe_literals(assigns(spark, d)).select("file_id", "var")


DNG = ",".join(f"({quote(m)},{quote(f)})" for m, fs in joins.DANGEROUS.items() for f in fs)
VS = f"""dng(module, func) as (values {DNG}),
fd as (select file_id, lhs as var, line_no, {FOLD_SQL} as value from tgt), fc as (select * from fd where value is not null),
ga as (select file_id, lhs as var, line_no, regexp_extract(rhs, {quote(joins.GETATTR)}, 1) module, regexp_extract(rhs, {quote(joins.GETATTR)}, 2) nm from tgt),
tx as (select file_id, var as nm, arg_max(value, struct_pack(l := line_no, v := value)) value from fc group by file_id, var),
vs0 as (select g.file_id, g.var, g.line_no, g.module, coalesce(regexp_extract(value, '([^.]*)$', 1), g.nm) func from ga g left join tx on tx.file_id = g.file_id and tx.nm = g.nm where g.module <> ''
  union all select file_id, var, line_no, '', value from fc),
vs as (select v.* from vs0 v join dng on dng.module = v.module and dng.func = v.func)"""


@query("virtual_sinks", AW + "," + VS + " select file_id, var, line_no, module, func from vs")
def virtual_sinks(spark, d):
    a = cut(assigns(spark, d))
    return joins.virtual_sinks(a, joins.constants(a)).select("file_id", "var", "line_no", "module", "func")


@query("virtual_calls", AW + "," + VS + r", cc as (select file_id, line_no, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^\w.>])\$?(\w+)\s*\(', 1))) as var from code where lang <> 'webconfig') select cc.file_id, cc.line_no, cc.var, module, func from cc join (select distinct file_id, var, module, func from vs) v on v.file_id = cc.file_id and v.var = cc.var")
def virtual_calls(spark, d):
    a = cut(assigns(spark, d))
    return joins.virtual_calls(code(spark, d), joins.virtual_sinks(a, joins.constants(a))).select("file_id", "line_no", "var", "module", "func")


@query("hidden_functions", AW + "," + VS + " select file_id, var, line_no, value from fc where regexp_extract(value, '([^.]*)$', 1) in (select func from dng)")
def hidden_functions(spark, d):
    return joins.hidden_functions(joins.constants(assigns(spark, d))).select("file_id", "var", "line_no", "value")


CLS = f"cls as (select c.*, arg_max(case when regexp_matches(text, {quote(joins.CLASS)}) then regexp_extract(text, {quote(joins.CLASS)}, 1) end, case when regexp_matches(text, {quote(joins.CLASS)}) then line_no end) over (partition by file_id order by line_no) class_name from code c where lang <> 'webconfig')"
FLD = f"fset as (select file_id, class_name, regexp_extract(text, {quote(joins.FIELD_SET)}, 1) field, regexp_extract(text, {quote(joins.FIELD_SET)}, 2) as var from cls where class_name is not null), fld as (select distinct file_id, class_name, field from fset f where field <> '' and exists (select 1 from marks m where m.file_id = f.file_id and m.var = f.var and m.label = 'user'))"


@query(
    "field_taint",
    R + "," + sf.full_taint() + "," + CLS + "," + FLD
    + rf", fr as (select file_id, class_name, line_no, unnest(list_distinct(regexp_extract_all({sf.rhs_sql("text")}, {quote(joins.FIELD_USE)}, 1))) field from cls where class_name is not null)"
    " select fr.file_id, fr.class_name, fr.field, fr.line_no from fr join fld on fld.file_id = fr.file_id and fld.class_name = fr.class_name and fld.field = fr.field",
)
def field_taint(spark, d):
    ls = cut(lines(spark, d).filter("lang <> 'webconfig'"))
    marks = scan.file_taint(ls, list(sf.CODE_LANGS)).marks
    c = facts.drop_comments(ls)
    return joins.field_uses(c, joins.tainted_fields(c, marks)).select("file_id", "class_name", "field", "line_no")


MAGIC = ",".join(quote(m) for m in joins.MAGIC)


@query(
    "gadget_methods",
    "with " + sf.base(PHP) + "," + sf.code_lines(PHP) + "," + sf.functions(PHP)
    + f", sc as (select c.file_id, c.text, coalesce((select max(scope_id) from fn f where f.file_id = c.file_id and f.scope_id <= c.line_no), 0) scope_id from code c) select file_id, scope_id, name from fn where name in ({MAGIC}) and exists (select 1 from sc where sc.file_id = fn.file_id and sc.scope_id = fn.scope_id and regexp_matches(sc.text, {quote(joins.MAGIC_CALLS)}))",
)
def gadget_methods(spark, d):
    c = code(spark, d, PHP)
    return joins.gadget_methods(facts.assign_scope(c, PHP), facts.extract_functions(c, PHP)).select("file_id", "scope_id", "name")


@query(
    "exclude_script_ranges",
    r"""with ls0 as (select page_id, string_split_regex(regexp_replace(html, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r') p from pages), ls as (select page_id, unnest(range(1, len(p) + 1)) line_no, unnest(p) as text from ls0),
 p as (select page_id, string_split_regex(html, '(?i)<script[^>]*>') pc, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) bd from pages),
 s as (select page_id, pc, unnest(range(0, len(bd))) script_no, unnest(bd) body from p),
 r as (select page_id, 1 + list_sum(list_transform(pc[1:script_no + 1], lambda x: length(x) - length(replace(x, chr(10), '')))) st, body from s),
 rr as (select page_id, st, st + length(body) - length(replace(body, chr(10), '')) en from r)
 select page_id, line_no from ls where regexp_matches(text, '<[a-z]') and not exists (select 1 from rr where rr.page_id = ls.page_id and ls.line_no between st and en)""",
)
def exclude_script_ranges(spark, d):
    pages = tables(spark, d, "pages")
    ls = facts.explode_lines(pages.select(F.col("page_id").alias("file_id"), F.lit("markup").alias("lang"), F.col("html").alias("content")))
    hits = ls.filter(F.col("text").rlike("<[a-z]")).select(F.col("file_id").alias("page_id"), "line_no")
    return joins.exclude_ranges(hits, facts.extract_scripts(pages, "page_id", "html"), "page_id")


@query("allow_listed", CW + r" select file_id, line_no, regexp_extract(text, '^\s*if\s+(\w+)\s+(?:not\s+)?in\s+[\[({\w]', 1) as var from code where lang = 'python' and regexp_extract(text, '^\s*if\s+(\w+)\s+(?:not\s+)?in\s+[\[({\w]', 1) <> ''")
def allow_listed(spark, d):
    return joins.allow_listed(code(spark, d)).select("file_id", "line_no", "var")
