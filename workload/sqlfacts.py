"""DuckDB text of the fact, taint and detection operators, written from their meaning.

Each function returns CTEs that build on ``files`` and ``lines`` of the corpus view.
"""

from __future__ import annotations

from seepline.functions import text as tx
from seepline.operators import taint as tnt
from seepline.operators.detect import LABEL_BITS
from seepline.rules.languages import ACCESS, CATEGORY_SANITIZERS, LABEL_SEEDS, LANGUAGES, NEVER

from .corpus import LINES_SQL, files_sql, quote

CODE_LANGS = tuple(l for l in LANGUAGES if l != "webconfig")


def rx(subject: str, pattern: str) -> str:
    if pattern.startswith(NEVER):
        return "false"
    return f"regexp_matches({subject}, {quote(pattern)})"


def rhs_sql(subject: str) -> str:
    part = f"regexp_extract({subject}, {quote(tx.RIGHT_HAND)}, 1)"
    return f"case when regexp_matches({subject}, '^\\s*(?:if|while)\\b') or {part} = '' then {subject} else {part} end"


def case(build, langs=None, default: str | None = None) -> str:
    names = langs or CODE_LANGS
    arms = " ".join(f"when {quote(n)} then {build(LANGUAGES[n])}" for n in names)
    return f"(case lang {arms} {'else ' + default if default else ''} end)"


def base(langs=None) -> str:
    return files_sql(langs) + "," + LINES_SQL


def code_lines(langs=None) -> str:
    return f"code as (select * from lines where not {case(lambda l: rx('text', l.comment), langs, 'false')})"


def idents(subject: str, langs=None) -> str:
    def build(l):
        bare = f"regexp_extract_all(regexp_replace({subject}, {quote(l.literal.replace("*+", "*"))}, '\"\"', 'g'), {quote(l.token)}, 1)"
        if not l.interpolation:
            return bare
        inner = f"array_to_string(regexp_extract_all({subject}, {quote(l.interpolation)}, 1), ' ')"
        return f"list_concat({bare}, regexp_extract_all({inner}, {quote(l.token)}, 1))"

    return f"list_distinct({case(build, langs)})"


def assigns(langs=None, source: str = "code", scope: str = "0") -> str:
    grp = lambda n: case(lambda l: f"regexp_extract_all(text, {quote(l.assign)}, {n})", langs)
    return f"""
asg0 as (select file_id, lang, {scope} scope_id, line_no, unnest({grp(1)}) lhs, unnest({grp(2)}) rhs from {source}),
asg as (select file_id, lang, scope_id, line_no, trim(lhs, ' ') lhs, regexp_replace(rhs, ';?\\s*$', '') rhs from asg0),
tgt0 as (select file_id, lang, scope_id, line_no, rhs, unnest(string_split(regexp_replace(lhs, '[{{}}\\[\\]()]', '', 'g'), ',')) t from asg),
tgt1 as (select file_id, lang, scope_id, line_no, rhs,
  regexp_replace(regexp_extract(t, '(?:.*:)?\\s*(?:\\.\\.\\.)?\\s*([\\w.$@>-]+)', 1), '^(?:this\\.|self\\.|this->)', '') lhs from tgt0),
tgt as (select * from tgt1 where lhs <> '' and lhs <> '_')"""


def seeds_edges(langs=None) -> str:
    user = case(lambda l: f"({rx('rhs', l.source)} and not {rx('rhs', l.killer)} and not {rx('rhs', l.safe_source)})", langs)
    db = case(lambda l: rx("'= ' || rhs", l.db_source), langs)
    more = "".join(
        f" union all select file_id, scope_id, lhs, '{label}', line_no from tgt where lang = '{name}' and {rx('rhs', p)}"
        for name in (langs or CODE_LANGS) for label, p in LABEL_SEEDS.get(name, {}).items()
    )
    killed = case(lambda l: rx("rhs", l.killer), langs)
    access = case(lambda l: f"regexp_extract(rhs, {quote(ACCESS[l.name])}, 1)", langs)
    return f"""
seed0 as (select file_id, scope_id, lhs as var, 'user' as label, line_no from tgt where {user}
  union all select file_id, scope_id, lhs, 'db', line_no from tgt where {db}{more}),
use0 as (select file_id, scope_id, line_no, lhs dst, 'user' as label, unnest({idents('rhs', langs)}) src from tgt where not {killed}),
acc0 as (select file_id, lang, scope_id, line_no, lhs dst, {access} src from tgt),
edge0 as (select file_id, scope_id, src, dst, label, line_no from use0 where src <> dst
  union all select file_id, scope_id, src, dst, l.label, line_no from acc0, (values ('db'),('json'),('unser')) l(label) where src <> '' and src <> dst and (l.label = 'db' or lang in ({','.join(quote(x) for x in LABEL_SEEDS)})))"""


def functions(langs=None, source: str = "code") -> str:
    grp = lambda n: case(lambda l: f"regexp_extract(text, {quote(l.function)}, {n})", langs)

    def pname(l):
        if l.name in ("python", "javascript", "ruby", "go"):
            return r"regexp_extract(param, '^[*&.]*(\w+)', 1)"
        if l.name == "php":
            return r"regexp_extract(param, '\$(\w+)', 1)"
        return r"regexp_extract(param, '(\w+)(?:\[\])?\s*(?:=.*)?$', 1)"

    tainted = case(lambda l: f"({'true' if l.all_params else rx('param', l.tainted_param)} and not {rx('param', l.safe_param)})", langs)
    return f"""
fn0 as (select file_id, lang, line_no, {grp(1)} as name, {grp(2)} ps from {source}),
fn as (select file_id, lang, line_no scope_id, name, list_filter(list_transform(string_split(ps, ','), lambda p: trim(p, ' ')), lambda p: p <> '') params, line_no start_line
  from fn0 where name <> ''),
par0 as (select file_id, lang, scope_id, name, start_line, unnest(range(0, len(params))) arg_pos, unnest(params) param from fn),
par1 as (select *, {case(pname, langs)} as var from par0),
par as (select *, {tainted} as tainted from par1 where var <> '')"""


def closure(seeds: str = "seed", edges: str = "edge", name: str = "taint") -> str:
    return f"""
e_{name} as (select distinct file_id, scope_id, src, dst, label from {edges}),
{name}_walk(file_id, scope_id, var, label) as (
  select distinct file_id, scope_id, var, label from {seeds}
  union
  select w.file_id, w.scope_id, e.dst, w.label from {name}_walk w
    join e_{name} e on e.file_id = w.file_id and e.scope_id = w.scope_id and e.src = w.var and e.label = w.label),
{name} as (select * from {name}_walk)"""


BUILD_SQL = lambda langs: f"""
bld0 as (select file_id, lang, line_no, regexp_extract(text, {quote(tnt.BUILDERS)}, 1) dst, regexp_extract(text, {quote(tnt.BUILDERS)}, 2) arg from code),
bld1 as (select file_id, 0 scope_id, line_no, dst, unnest({idents('arg', langs)}) src from bld0 where dst <> ''),
bld as (select file_id, scope_id, src, dst, 'user' as label, line_no from bld1 where src <> dst)"""

WRAP_SQL = r"""
wr0 as (select file_id, scope_id, line_no, lhs dst, unnest(list_distinct(regexp_extract_all(regexp_replace(
    regexp_extract(rhs, '^\s*new\s+[\w.<>]+\s*\((.*)\)', 1), '"[^"]*"', '""', 'g'), '([A-Za-z_]\w*)', 1))) src from tgt where regexp_matches(rhs, '^\s*new\s+\w+')),
wrp as (select file_id, scope_id, src, dst, 'user' as label, line_no from wr0 where src <> 'new' and src <> dst)"""

LAMBDA_SQL = r"""
lb0 as (select file_id, regexp_extract(text, '(\w+)\s*=\s*\(?([\w\s,]*)\)?\s*->', 1) holder,
  unnest(string_split(regexp_extract(text, '(\w+)\s*=\s*\(?([\w\s,]*)\)?\s*->', 2), ',')) p from code where contains(text, '->')),
lb as (select distinct file_id, holder, regexp_extract(p, '(\w+)\s*$', 1) dst from lb0 where holder <> '' and regexp_extract(p, '(\w+)\s*$', 1) <> ''),
inv as (select file_id, line_no, regexp_extract(text, '(\w+)\s*\.\s*(?:accept|apply|test)\s*\(\s*([^)]+)\)', 1) holder,
  unnest(regexp_extract_all(regexp_extract(text, '(\w+)\s*\.\s*(?:accept|apply|test)\s*\(\s*([^)]+)\)', 2), '([A-Za-z_]\w*)', 1)) src from code),
hnd0 as (select file_id, line_no, list_transform(string_split(regexp_extract(text, '\w+\s*\(\s*([^()]+)\)', 1), ','), lambda x: trim(x, ' ')) parts from code where not contains(text, '->')),
hnd as (select file_id, line_no, parts, unnest(list_distinct(parts)) holder from hnd0 where len(parts) >= 2),
bes as (select h.file_id, h.line_no, h.holder, dst, unnest(parts) src from hnd h join lb on lb.file_id = h.file_id and lb.holder = h.holder),
lam as (select i.file_id, 0 scope_id, src, dst, 'user' as label, line_no from inv i join lb on lb.file_id = i.file_id and lb.holder = i.holder where i.holder <> '' and src <> dst
  union all select file_id, 0, src, dst, 'user', line_no from bes where holder <> src and src <> dst)"""

LINQ_SQL = f"""
lq0 as (select file_id, line_no, regexp_extract(text, {quote(tnt.LINQ)}, 1) src, unnest([regexp_extract(text, {quote(tnt.LINQ)}, 2), regexp_extract(text, {quote(tnt.LINQ)}, 3)]) dst from code where contains(text, '=>')),
lnq as (select file_id, 0 scope_id, src, dst, 'user' as label, line_no from lq0 where src <> '' and dst <> '' and src <> dst)"""

WILD_SQL = r"""
wld as (select file_id, 0 scope_id, '*' as var, 'user' as label, line_no from code where lang = 'php'
  and regexp_matches(text, '\bextract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)\b|\bparse_str\s*\(\s*[^,)]+\)'))"""

SCAN_SQL = r"""
scn0 as (select file_id, line_no, unnest(regexp_extract_all(text, '&(\w+)', 1)) as var,
  case when regexp_matches(text, '\.Scan\s*\(') then 'db' when regexp_matches(text, '\b(?:Decode|Unmarshal|ShouldBind(?:JSON)?|BindJSON|Bind|BodyParser)\s*\(') then 'user' end as label
  from code where lang = 'go'),
scn as (select file_id, 0 scope_id, var, label, line_no from scn0 where label is not null)"""

SANITIZED_SQL = "san as (select distinct file_id, scope_id, lhs as var, category from (" + " union all ".join(
    f"select file_id, scope_id, lhs, '{c}' category from tgt where lang = '{l}' and {rx('rhs', p)}"
    for l, by in CATEGORY_SANITIZERS.items() for c, p in by.items()
) + "))"

TABLE_SQL = """
tb0 as (select file_id, scope_id, line_no, lhs, unnest({idents}) as var from tgt where regexp_matches(lhs, '(?i)table|tbl|entity')),
tbl as (select t.file_id, t.scope_id, lhs as var, 'table' as label, min(line_no) line_no from tb0 t
  where exists (select 1 from taint x where x.file_id = t.file_id and x.scope_id = t.scope_id and x.var = t.var and x.label in ('db','json')) group by t.file_id, t.scope_id, lhs)"""


GATE_SQL = r"""
pat0 as (select file_id, lhs as pv, arg_max(regexp_extract(rhs, '^["''](.+)["'']$', 1), line_no) lit from tgt where regexp_matches(rhs, '^["''](.+)["'']$') and lang = 'php' group by file_id, lhs),
chk as (select file_id, line_no, regexp_extract(text, 'if\s*\(\s*!\s*preg_match\s*\(\s*\$(\w+)\s*,\s*\$(\w+)\s*\)', 1) pv,
  regexp_extract(text, 'if\s*\(\s*!\s*preg_match\s*\(\s*\$(\w+)\s*,\s*\$(\w+)\s*\)', 2) as var from lines where lang = 'php'),
gat as (select distinct c.file_id, c.var from chk c join pat0 p on p.file_id = c.file_id and p.pv = c.pv
  where c.var <> '' and regexp_matches(lit, '^/\^.*\$/[a-z]*$')
  and exists (select 1 from lines x where x.file_id = c.file_id and x.line_no > c.line_no and x.line_no <= c.line_no + 10 and regexp_matches(x.text, '\b(?:exit|die|return)\b')
     and not exists (select 1 from lines b where b.file_id = c.file_id and b.line_no > c.line_no and b.line_no < x.line_no and trim(b.text, ' ') = '}')))"""


def full_taint(langs=None) -> str:
    """Everything that feeds file-level taint of the given languages."""
    names = langs or CODE_LANGS
    parts = [code_lines(langs), assigns(langs), seeds_edges(langs), functions(langs), BUILD_SQL(langs)]
    seed = "select file_id, scope_id, var, label, line_no from seed0 union all select file_id, 0, var, 'user', start_line from par where tainted"
    edge = "select * from edge0 union all select * from bld"
    if "java" in names:
        parts += [WRAP_SQL, LAMBDA_SQL]
        edge += " union all select * from wrp union all select * from lam"
    if "csharp" in names:
        parts += [LINQ_SQL]
        edge += " union all select * from lnq"
    if "php" in names:
        parts += [WILD_SQL]
        seed += " union all select * from wld"
    if "go" in names:
        parts += [SCAN_SQL]
        seed += " union all select * from scn"
    parts += [f"seed as ({seed})", f"edge as ({edge})", closure()]
    last = "select file_id, scope_id, var, label from taint"
    if "php" in names:
        parts += [TABLE_SQL.format(idents=idents("rhs", ("php",))), GATE_SQL]
        last += " union all select file_id, scope_id, var, label from tbl"
        last = f"select * from ({last}) q where not (label = 'user' and exists (select 1 from gat g where g.file_id = q.file_id and g.var = q.var))"
    parts += [SANITIZED_SQL, f"marks as (select distinct * from ({last}))"]
    return ",".join(parts)


def rules_values(rules) -> str:
    rows = []
    opt = lambda x: "null" if x is None else quote(x)
    for r in rules:
        s, c = r.grade.split("/")
        s0, c0 = r.plain.split("/") if r.plain else (None, None)
        rows.append(
            f"({quote(r.rule_id)},{quote(r.category)},{opt(r.label)},{quote(s)},{quote(c)},{opt(s0)},{opt(c0)},{r.priority})"
        )
    return f"rule(rule_id, category, wanted, s1, c1, s0, c0, priority) as (values {','.join(rows)})"


def pack_hits(lang: str, rules, with_taint: bool) -> str:
    """Rule hits on lines of one language, graded, before suppression."""
    source = "code" if lang in CODE_LANGS else "lines"
    arms = []
    for r in rules:
        cond = rx("text", r.pattern)
        if r.unless:
            cond += f" and not {rx('text', r.unless)}"
        for p, (lo, hi), neg in ((r.near, r.near_frame, ""), (r.absent, r.absent_frame, "not ")):
            if p:
                cond += (
                    f" and {neg}exists (select 1 from lines x where x.file_id = l.file_id and x.line_no between l.line_no + ({lo})"
                    f" and l.line_no + ({hi}) and {rx('x.text', p)})"
                )
        arms.append(f"select file_id, lang, line_no, text as code, {quote(r.rule_id)} rule_id from {source} l where {cond}")
    out = f"{rules_values(rules)}, hit as ({' union all '.join(arms)})"
    if not with_taint:
        return out + ", flagged as (select h.*, false as tainted from hit h)"
    rhs = rhs_sql("code")
    direct = rx("part", LANGUAGES[lang].direct)
    star = "list_append(" + idents("part", (lang,)) + ", '*')" if lang == "php" else idents("part", (lang,))
    return out + f""",
hp as (select h.*, {rhs} part, category, wanted from hit h join rule using (rule_id)),
hu as (select file_id, line_no, rule_id, category, wanted, unnest({star}) as var from hp where wanted is not null),
ht as (select distinct u.file_id, u.line_no, u.rule_id from hu u join marks m on m.file_id = u.file_id and m.scope_id = 0 and m.var = u.var
  and list_contains(string_split(u.wanted, ','), m.label)
  where not exists (select 1 from san s where s.file_id = u.file_id and s.scope_id = 0 and s.var = u.var and s.category = u.category)),
flagged as (select h.file_id, h.lang, h.line_no, h.code, h.rule_id,
  (ht.rule_id is not null) or ({direct} and list_contains(string_split(coalesce(wanted, ''), ','), 'user')) as tainted
  from hp h left join ht on ht.file_id = h.file_id and ht.line_no = h.line_no and ht.rule_id = h.rule_id)"""


GRADED = """
graded as (select f.file_id, f.lang, f.line_no, f.rule_id, r.category, f.code, r.priority, f.tainted,
  case when wanted is null or tainted then s1 else s0 end severity, case when wanted is null or tainted then c1 else c0 end confidence
  from flagged f join rule r using (rule_id)),
kept as (select * from graded where severity is not null and not regexp_matches(code, '(?://|#|/\\*|--|%)\\s*nosec\\b') and not regexp_matches(code, '\\bscan:ignore\\b')),
best as (select file_id, line_no, category, severity, confidence, rule_id from (select *, row_number() over (partition by file_id, line_no, category order by
  case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end desc,
  case confidence when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end desc, priority desc, rule_id) rn from kept) where rn = 1)"""


def query(ctes: list[str], select: str) -> str:
    return "with recursive " + ",".join(ctes) + "\n" + select


def pack_query(lang: str, rules, with_taint: bool) -> str:
    ctes = [base((lang,))]
    if with_taint:
        ctes.append(full_taint((lang,)))
    elif lang in CODE_LANGS:
        ctes.append(code_lines((lang,)))
    ctes += [pack_hits(lang, rules, with_taint), GRADED]
    return query(ctes, "select * from best")
