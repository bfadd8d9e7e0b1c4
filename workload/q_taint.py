"""Seeds, edges, closures, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepline.operators import facts, joins, taint as tnt
from seepline.plans import scan
from seepline.plans.durable import cut

from . import sqlfacts as sf
from .q_sources import AW, CW, LW, code, lines
from .registry import query

ALL = list(sf.CODE_LANGS)
R = "with recursive " + sf.base()
SE = AW + "," + sf.seeds_edges()


def assigns(spark, d, langs=None):
    return facts.explode_targets(facts.extract_assignments(code(spark, d, langs), langs))


@query("seed_sources", SE + " select file_id, var, label, line_no from seed0 where label = 'user'")
def seed_sources(spark, d):
    return tnt.seed_sources(assigns(spark, d), labels=["user"]).select("file_id", "var", "label", "line_no")


@query("seed_db_sources", SE + " select file_id, var, label, line_no from seed0 where label = 'db'")
def seed_db_sources(spark, d):
    return tnt.seed_sources(assigns(spark, d), labels=["db"]).select("file_id", "var", "label", "line_no")


@query("def_use_edges", SE + " select file_id, src, dst, label, line_no from edge0")
def def_use_edges(spark, d):
    return tnt.def_use_edges(assigns(spark, d)).select("file_id", "src", "dst", "label", "line_no")


HOPS = """
sd as (select file_id, scope_id, var, label, cast(min(line_no) as int) origin from seed group by all),
ed as (select distinct file_id, scope_id, src, dst, label from edge),
walk(file_id, scope_id, var, label, hop, origin) as (
 select file_id, scope_id, var, label, 0, origin from sd
 union select w.file_id, w.scope_id, e.dst, w.label, w.hop + 1, w.origin from walk w join ed e on e.file_id = w.file_id and e.scope_id = w.scope_id and e.src = w.var and e.label = w.label where w.hop < 14),
least_hop as (select file_id, scope_id, var, label, min(hop) hop from walk group by all),
reach as (select w.file_id, w.scope_id, w.var, w.label, w.hop, min(w.origin) origin_line from walk w join least_hop l on l.file_id = w.file_id and l.scope_id = w.scope_id and l.var = w.var and l.label = w.label and l.hop = w.hop group by all)"""
BASE = f"{R},{sf.code_lines()},{sf.assigns()},{sf.seeds_edges()},seed as (select * from seed0), edge as (select * from edge0)"


def closed(spark, d):
    a = cut(assigns(spark, d))
    return tnt.propagate(tnt.seed_sources(a), tnt.def_use_edges(a))


@query("propagate_taint", BASE + "," + HOPS + " select file_id, var, label, hop, origin_line from reach")
def propagate_taint(spark, d):
    return closed(spark, d).select("file_id", "var", "label", "hop", "origin_line")


@query("propagate_json_decoded", BASE + "," + sf.closure() + " select file_id, var from taint where label = 'json'")
def propagate_json_decoded(spark, d):
    a = cut(assigns(spark, d, ["php"]))
    return tnt.propagate(tnt.seed_sources(a, ["php"], ["json"]), tnt.def_use_edges(a, ["php"])).select("file_id", "var")


@query("propagate_unserialized", BASE + "," + sf.closure() + " select file_id, var from taint where label = 'unser'")
def propagate_unserialized(spark, d):
    a = cut(assigns(spark, d, ["php"]))
    return tnt.propagate(tnt.seed_sources(a, ["php"], ["unser"]), tnt.def_use_edges(a, ["php"])).select("file_id", "var")


@query("render_taint_chain", BASE + "," + HOPS + " select file_id, var || ' <- ' || label || ' source (line ' || origin_line || ')' as chain from reach")
def render_taint_chain(spark, d):
    from seepline.operators.findings import taint_chain

    return taint_chain(closed(spark, d)).select("file_id", "chain")


CHAINS = """
pd as (select r.file_id, r.scope_id, r.var, r.label, min(e.src) src from reach r join ed e on e.file_id = r.file_id and e.scope_id = r.scope_id and e.dst = r.var and e.label = r.label
  join reach b on b.file_id = r.file_id and b.scope_id = r.scope_id and b.var = e.src and b.label = r.label and b.hop = r.hop - 1 group by all),
way(file_id, scope_id, var, label, chain) as (
 select file_id, scope_id, var, label, var from reach where hop = 0
 union all select p.file_id, p.scope_id, p.var, p.label, w.chain || ' -> ' || p.var from way w join pd p on p.file_id = w.file_id and p.scope_id = w.scope_id and p.src = w.var and p.label = w.label)"""


@query("taint_chains", BASE + "," + HOPS + "," + CHAINS + " select file_id, var, label, chain from way")
def taint_chains(spark, d):
    a = cut(assigns(spark, d))
    edges = cut(tnt.def_use_edges(a))
    return tnt.chains(tnt.propagate(tnt.seed_sources(a), edges), edges).select("file_id", "var", "label", F.array_join("chain", " -> ").alias("chain"))


PASSES = """
ed as (select distinct file_id, scope_id, src, dst, label, line_no el from edge),
walk(file_id, scope_id, var, label, pass_no, line_no) as (
 select distinct file_id, scope_id, var, label, 1, 0 from seed
 union select w.file_id, w.scope_id, e.dst, w.label, w.pass_no + case when el <= w.line_no then 1 else 0 end, cast(el as int) from walk w
  join ed e on e.file_id = w.file_id and e.scope_id = w.scope_id and e.src = w.var and e.label = w.label
  where w.pass_no + case when el <= w.line_no then 1 else 0 end <= 2)
select file_id, var, label, cast(min(pass_no * 100000 + line_no) // 100000 as int) as pass_no, cast(min(pass_no * 100000 + line_no) % 100000 as int) as line_no from walk group by file_id, scope_id, var, label"""


@query("propagate_taint_passes", BASE + "," + PASSES)
def propagate_taint_passes(spark, d):
    a = cut(assigns(spark, d))
    return tnt.propagate_passes(tnt.seed_sources(a), tnt.def_use_edges(a), passes=2).select("file_id", "var", "label", "pass_no", "line_no")


@query("table_name_taint", BASE + "," + sf.closure() + "," + sf.TABLE_SQL.format(idents=sf.idents("rhs", ("php",))).replace("from tgt where", "from tgt where lang = 'php' and") + " select file_id, var, line_no from tbl")
def table_name_taint(spark, d):
    a = cut(assigns(spark, d, ["php"]).filter("lang = 'php'"))
    t = tnt.propagate(tnt.seed_sources(a, ["php"], ["db", "json"]), tnt.def_use_edges(a, ["php"]))
    return tnt.table_name_taint(a, t).select("file_id", "var", "line_no")


@query("builder_taint", CW + "," + sf.BUILD_SQL(None) + " select file_id, src, dst, line_no from bld")
def builder_taint(spark, d):
    return tnt.builder_edges(code(spark, d)).select("file_id", "src", "dst", "line_no")


@query("wrapped_stream_taint", AW + "," + sf.WRAP_SQL + " select file_id, src, dst, line_no from wrp where file_id in (select file_id from files where lang = 'java')")
def wrapped_stream_taint(spark, d):
    return tnt.wrapper_edges(assigns(spark, d, ["java"]).filter("lang = 'java'")).select("file_id", "src", "dst", "line_no")


@query("lambda_taint", "with " + sf.base(("java",)) + "," + sf.code_lines(("java",)) + "," + sf.LAMBDA_SQL + " select file_id, src, dst, line_no from lam")
def lambda_taint(spark, d):
    return tnt.lambda_edges(code(spark, d, ("java",))).select("file_id", "src", "dst", "line_no")


@query("linq_taint", "with " + sf.base(("csharp",)) + "," + sf.code_lines(("csharp",)) + "," + sf.LINQ_SQL + " select file_id, src, dst, line_no from lnq")
def linq_taint(spark, d):
    return tnt.linq_edges(code(spark, d, ("csharp",))).select("file_id", "src", "dst", "line_no")


@query("wildcard_taint", CW + "," + sf.WILD_SQL + " select file_id, line_no from wld")
def wildcard_taint(spark, d):
    return tnt.wildcard_seeds(code(spark, d)).select("file_id", "line_no")


@query("scan_target_taint", CW + "," + sf.SCAN_SQL + " select file_id, var, label, line_no from scn")
def scan_target_taint(spark, d):
    return tnt.seed_scans(code(spark, d)).select("file_id", "var", "label", "line_no")


@query("file_level_taint", R + "," + sf.full_taint() + " select file_id, var, label from marks")
def file_level_taint(spark, d):
    return scan.file_taint(cut(lines(spark, d).filter("lang <> 'webconfig'")), ALL).marks.select("file_id", "var", "label")


# Function scopes, summaries and calls of the file's own functions.
SCOPED = f"""{sf.code_lines()},{sf.functions()},
sc as (select c.file_id, c.lang, c.line_no, c.text, coalesce((select max(scope_id) from fn f where f.file_id = c.file_id and f.scope_id <= c.line_no), 0) as scope from code c),
{sf.assigns(None, 'sc', 'scope')},{sf.seeds_edges()},
cl0 as (select file_id, lang, scope_id, line_no, lhs, regexp_extract(rhs, '^\\s*(?:await\\s+)?[$\\w.]*?(\\w+)\\s*\\((.*)\\)\\s*$', 1) callee,
  string_split(regexp_extract(rhs, '^\\s*(?:await\\s+)?[$\\w.]*?(\\w+)\\s*\\((.*)\\)\\s*$', 2), ',') args from tgt),
cl1 as (select file_id, lang, scope_id, line_no, lhs, callee, unnest(range(0, len(args))) arg_pos, unnest(args) arg from cl0 where callee <> ''
  and exists (select 1 from fn where fn.file_id = cl0.file_id and fn.name = callee)),
cl as (select file_id, scope_id, line_no, lhs, callee, arg_pos, unnest({sf.idents('arg')}) src from cl1),
own as (select distinct file_id, scope_id, line_no, lhs dst from cl1),
plain as (select distinct e.file_id, e.scope_id, e.src, e.dst from edge0 e where label = 'user' and not exists (select 1 from own o where o.file_id = e.file_id and o.scope_id = e.scope_id and o.line_no = e.line_no and o.dst = e.dst)),
rt as (select distinct file_id, scope_id, var from (select file_id, scope scope_id, unnest({sf.idents('x')}) as var from (select file_id, lang, scope, {sf.case(lambda l: f"regexp_extract(text, {sf.quote(l.returns)}, 1)")} x from sc) q where x <> '') z)"""


def _round(n: int) -> str:
    """Summaries of round n: parameters walk over plain edges and those of round n - 1."""
    extra = "" if n == 1 else f" union select c.file_id, c.scope_id, src, lhs from cl c join s{n - 1} s on s.file_id = c.file_id and s.name = c.callee and s.arg_pos = c.arg_pos where src <> lhs"
    return f"""
g{n} as materialized (select file_id, scope_id, src, dst from plain{extra}),
w{n}(file_id, scope_id, var, pos) as (select file_id, scope_id, var, arg_pos from par
  union select w.file_id, w.scope_id, g.dst, w.pos from w{n} w join g{n} g on g.file_id = w.file_id and g.scope_id = w.scope_id and g.src = w.var),
s{n} as materialized (select distinct w.file_id, f.name, cast(w.pos as int) arg_pos from w{n} w join rt on rt.file_id = w.file_id and rt.scope_id = w.scope_id and rt.var = w.var
  join fn f on f.file_id = w.file_id and f.scope_id = w.scope_id)"""


# As many rounds as the corpus's longest chain of calls needs, and more; the operator itself has no such number.
ROUNDS = 6
SUMM = ",".join([SCOPED, *(_round(n + 1) for n in range(ROUNDS))])
LAST = f"s{ROUNDS}"


@query("summarize_functions", f"{R},{SUMM} select file_id, name, array_to_string(list_sort(list(arg_pos)), ',') as params from {LAST} group by file_id, name")
def summarize_functions(spark, d):
    scoped = cut(facts.assign_scope(code(spark, d)))
    fns = cut(facts.extract_functions(scoped.drop("scope_id")))
    return tnt.summarize_functions(scoped, fns).select("file_id", "name", F.array_join("param_to_return", ",").alias("params"))


@query("apply_function_summaries", f"{R},{SUMM} select distinct c.file_id, c.scope_id, src, lhs as dst, line_no from cl c join {LAST} s on s.file_id = c.file_id and s.name = c.callee and s.arg_pos = c.arg_pos where src <> lhs")
def apply_function_summaries(spark, d):
    scoped = cut(facts.assign_scope(code(spark, d)))
    fns = cut(facts.extract_functions(scoped.drop("scope_id")))
    own = cut(facts.explode_targets(facts.extract_assignments(scoped)))
    calls = cut(tnt.call_assignments(own, fns))
    return tnt.summary_edges(calls, tnt.summarize_functions(scoped, fns, calls, own)).select("file_id", "scope_id", "src", "dst", "line_no")


@query(
    "interprocedural_fixpoint",
    f"""{R},{SUMM}, ge as (select file_id, scope_id, src, dst from plain union select c.file_id, c.scope_id, src, lhs from cl c join {LAST} s on s.file_id = c.file_id and s.name = c.callee and s.arg_pos = c.arg_pos where src <> lhs),
 gw(file_id, scope_id, var) as (select file_id, scope_id, var from (select file_id, scope_id, var from seed0 where label = 'user' union select file_id, scope_id, var from par where tainted) q
  union select w.file_id, w.scope_id, g.dst from gw w join ge g on g.file_id = w.file_id and g.scope_id = w.scope_id and g.src = w.var) select file_id, scope_id, var from gw""",
)
def interprocedural_fixpoint(spark, d):
    return tnt.interprocedural(lines(spark, d).filter("lang <> 'webconfig'")).select("file_id", "scope_id", "var")
