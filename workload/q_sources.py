"""Sources, sinks and projections of file tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepline.functions import text as tx
from seepline.operators import brackets, facts, findings as fnd, joins
from seepline.plans.durable import cut
from seepline.rules.languages import EXTENSIONS, QUOTED
from seepline.sources import advisories, config, files as src, reports

from . import sqlfacts as sf
from .corpus import LINES_SQL, files, files_sql, quote, tables
from .registry import query

W = "with " + files_sql()


@query("scan_source_files", W + " select file_id, path from files where regexp_matches(path, '\\.(?:py|js|php)$')")
def scan_source_files(spark, d):
    return files(spark, d).filter(src.extension(F.col("path")).isin(".py", ".js", ".php")).select("file_id", "path")


# Texts of Latin-1 characters only: written in two encodings they must all come back whole.
@query(
    "decode_content",
    r"select doc_id, md5(text) as digest, (doc_id % 2 = 0 or not regexp_matches(text, '[\x{80}-\x{FF}]')) as utf8 from documents"
    r" where regexp_matches(text, '\A[\x{00}-\x{FF}]*\z') and (doc_id % 2 = 0 or not regexp_matches(text, '[\x{C2}-\x{DF}][\x{80}-\x{BF}]'))",
)
def decode_content(spark, d):
    docs = tables(spark, d, "documents").filter(
        F.col("text").rlike(r"\A[\x00-\xFF]*\z") & ((F.col("doc_id") % 2 == 0) | ~F.col("text").rlike(r"[\xC2-\xDF][\x80-\xBF]"))
    )
    raw = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")).alias("bytes"))
    return src.decode_content(raw).select("doc_id", F.md5("content").alias("digest"), "utf8")


EXT_ROWS = ",".join(f"({quote(e)},{quote(l)})" for e, l in EXTENSIONS.items())


@query("detect_language", W + f", m(ext, lang2) as (values {EXT_ROWS}) select file_id, ext, lang2 as lang from files join m on m.ext = lower(regexp_extract(path, '(\\.\\w+)$', 1))")
def detect_language(spark, d):
    return src.with_language(files(spark, d)).select("file_id", "ext", "lang")


@query("exclude_directories", W + " select file_id, path from files where not list_has_any(string_split(path, '/'), [" + ",".join(quote(x) for x in src.EXCLUDED_DIRS) + "])")
def exclude_directories(spark, d):
    return src.exclude_dirs(files(spark, d)).select("file_id", "path")


@query("exclude_vendor_files", W + ", v(n) as (values " + ",".join(f"({quote(x)})" for x in src.VENDOR_NAMES) + ") select file_id, path from files f where not exists (select 1 from v where contains(lower(regexp_extract(f.path, '([^/]*)$', 1)), n))")
def exclude_vendor_files(spark, d):
    return src.exclude_vendor(files(spark, d)).select("file_id", "path")


@query("exclude_globs", W + " select file_id, path from files where not path glob '*/tests/*' and not path glob 'r1?/*.js' and not list_contains(string_split(path, '/'), 'api')")
def exclude_globs(spark, d):
    return src.exclude_globs(files(spark, d), ["*/tests/*", "r1?/*.js", "api/"]).select("file_id", "path")


@query("drop_unreadable", "select doc_id as file_id from documents where case when doc_id % 7 = 0 then '' when doc_id % 11 = 0 then null else text end <> ''")
def drop_unreadable(spark, d):
    content = F.expr("case when doc_id % 7 = 0 then '' when doc_id % 11 = 0 then null else text end")
    docs = tables(spark, d, "documents").select(F.col("doc_id").alias("file_id"), content.alias("content"))
    return src.drop_unreadable(docs).select("file_id")


CONFIG = (
    "concat('{\"sources\":{\"python\":[\"src', o_custkey, '\"],\"java\":[\"in', o_custkey, '\",\"get\"]},\"sinks\":{\"php\":{\"SQL_INJECTION\":[\"q', o_orderkey,"
    " '\"]}},\"sanitizers\":{\"go\":{\"XSS\":[\"esc\",\"clean', o_orderkey % 3, '\"]}},\"min_confidence\":\"MEDIUM\"}')"
)


@query(
    "load_rules",
    "with o as (select 'd' || o_orderkey dir, o_custkey c, o_orderkey k from orders)"
    " select dir, 'source' as kind, 'python' as lang, cast(null as varchar) as category, 'src' || c as pattern from o"
    " union all select dir, 'source', 'java', null, unnest(['in' || c, 'get']) from o"
    " union all select dir, 'sink', 'php', 'SQL_INJECTION', 'q' || k from o"
    " union all select dir, 'sanitizer', 'go', 'XSS', unnest(['esc', 'clean' || (k % 3)]) from o",
)
def load_rules(spark, d):
    docs = tables(spark, d, "orders").selectExpr("concat('d', o_orderkey) as dir", f"{CONFIG} as doc")
    return config.config_rules(docs)


@query(
    "nearest_config",
    W + ", c as (select distinct dir from (select 'r' || (o_custkey % 20) dir, o_custkey % 20 n from orders union all select 'r' || (o_custkey % 20) || '/app', 1 from orders"
    " union all select 'r' || (o_custkey % 20) || '/api/v1', 0 from orders) q where n % 2 = 0 or dir like '%/app')"
    " select file_id, arg_max(dir, length(dir)) as dir from files f join c on starts_with(f.path, c.dir || '/') group by file_id",
)
def nearest_config(spark, d):
    o = tables(spark, d, "orders").select((F.col("o_custkey") % 20).alias("n")).distinct()
    repo = F.concat(F.lit("r"), F.col("n").cast("string"))
    dirs = (
        o.filter("n % 2 = 0").select(repo.alias("dir"))
        .unionByName(o.select(F.concat(repo, F.lit("/app")).alias("dir")))
        .unionByName(o.select(F.concat(repo, F.lit("/api/v1")).alias("dir")))
    )
    return config.nearest_config(files(spark, d), dirs)


REPORT = (
    "concat('{\"auditReportVersion\":2,\"vulnerabilities\":{\"pkg', user_id, '\":{\"severity\":\"', {sev}, '\",\"range\":\"<', user_id, '\",\"fixAvailable\":', {fix},"
    " ',\"via\":[\"other\",{\"title\":\"T', event_id, '\",\"url\":\"https://x.example/', event_id, '\"}]}}}')"
)
SEV = "element_at(array('low','moderate','high','critical'), int(event_id % 4) + 1)"


@query(
    "flatten_advisories",
    "select event_id, 'pkg' || user_id as package, ['LOW','MEDIUM','HIGH','CRITICAL'][event_id % 4 + 1] as severity, 'HIGH' as confidence, 'VULNERABLE_DEPENDENCY' as category,"
    " 'T' || event_id || '; https://x.example/' || event_id || '; Fix available: ' || case when event_id % 3 = 0 then 'no' else 'yes' end || '; Affected range: <' || user_id as description from events",
)
def flatten_advisories(spark, d):
    fix = "case when event_id % 3 = 0 then 'false' when event_id % 3 = 1 then 'true' else '{\"name\":\"x\"}' end"
    docs = tables(spark, d, "events").selectExpr("event_id", f"{REPORT.replace('{sev}', SEV).replace('{fix}', fix)} as doc")
    return advisories.flatten_advisories(docs, "event_id", "doc")


# ---- projections -------------------------------------------------------------------

LW = "with " + sf.base()
CW = LW + "," + sf.code_lines()


def lines(spark, d, langs=None):
    return facts.explode_lines(files(spark, d, langs))


def code(spark, d, langs=None):
    return facts.drop_comments(lines(spark, d, langs).filter("lang <> 'webconfig'"), langs)


@query("explode_lines", LW + " select file_id, line_no, text from lines")
def explode_lines(spark, d):
    return lines(spark, d).select("file_id", "line_no", "text")


@query("explode_lines_documents", r"with s as (select doc_id, string_split_regex(regexp_replace(text, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r') p from documents) select doc_id as file_id, unnest(range(1, len(p) + 1)) as line_no, md5(unnest(p)) as digest from s")
def explode_lines_documents(spark, d):
    docs = tables(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "lang", F.col("text").alias("content"))
    return facts.explode_lines(docs).select("file_id", "line_no", F.md5("text").alias("digest"))


@query("drop_comment_lines", CW + " select file_id, line_no from code where lang <> 'webconfig'")
def drop_comment_lines(spark, d):
    return code(spark, d).select("file_id", "line_no")


STRIP_SQL = sf.case(lambda l: f"regexp_replace(text, {quote(l.literal.replace("*+", "*"))}, '\"\"', 'g')")


@query("strip_string_literals", LW + f" select file_id, line_no, {STRIP_SQL} as bare from lines where lang <> 'webconfig'")
def strip_string_literals(spark, d):
    return lines(spark, d).filter("lang <> 'webconfig'").select("file_id", "line_no", tx.strip_literals(F.col("text"), F.col("lang")).alias("bare"))


AW = CW + "," + sf.assigns()


@query("extract_assignments", AW + " select file_id, line_no, lhs, rhs from asg where lang <> 'webconfig'")
def extract_assignments(spark, d):
    return facts.extract_assignments(code(spark, d)).select("file_id", "line_no", "lhs", "rhs")


@query("explode_destructuring", AW + " select file_id, line_no, lhs as var, rhs from tgt where lang <> 'webconfig'")
def explode_destructuring(spark, d):
    return facts.explode_targets(facts.extract_assignments(code(spark, d))).select("file_id", "line_no", F.col("lhs").alias("var"), "rhs")


def _bindings_sql():
    arms = []
    for lang, patterns in facts.BINDINGS.items():
        rows = []
        for p in patterns:
            g1, g2 = f"regexp_extract(text, {quote(p)}, 1)", f"regexp_extract(text, {quote(p)}, 2)"
            before = r"regexp_extract(text, '^(.*?)(?:\bas\b|\.then\b|\.each\b)', 1)"
            rows.append(f"case when regexp_matches(text, {quote(p)}) and {g1} <> '' then [{g1}, trim(case when {g2} <> '' then {g2} else {before} end, ' ')] end")
        arms.append(f"when {quote(lang)} then coalesce({', '.join(rows)})")
    return CW + f", b as (select file_id, line_no, case lang {' '.join(arms)} end b from code) select file_id, line_no, b[1] as lhs, b[2] as rhs from b where b is not null"


@query("extract_resources", _bindings_sql())
def extract_resources(spark, d):
    return facts.extract_bindings(code(spark, d)).select("file_id", "line_no", "lhs", "rhs")


RHS_SQL = sf.rhs_sql("text")


@query("rhs_only", LW + f" select file_id, line_no, {RHS_SQL} as part from lines")
def rhs_only(spark, d):
    return lines(spark, d).select("file_id", "line_no", tx.right_hand_side(F.col("text")).alias("part"))


@query("tokenize_identifiers", AW + f" select file_id, line_no, lhs, unnest({sf.idents('rhs')}) as var from tgt where lang <> 'webconfig'")
def tokenize_identifiers(spark, d):
    a = facts.explode_targets(facts.extract_assignments(code(spark, d)))
    return facts.explode_tokens(a, "rhs").select("file_id", "line_no", "lhs", "var")


@query("extract_interpolations", LW + f" select file_id, line_no, unnest({sf.case(lambda l: f'regexp_extract_all(text, {quote(l.interpolation)}, 1)' if l.interpolation else 'cast([] as varchar[])')}) as expr from lines where lang <> 'webconfig'")
def extract_interpolations(spark, d):
    return lines(spark, d).filter("lang <> 'webconfig'").select("file_id", "line_no", F.explode(tx.interpolations(F.col("text"), F.col("lang"))).alias("expr"))


@query("qualified_names", LW + f" select file_id, line_no, unnest(list_distinct(regexp_extract_all(text, {quote(tx.QUALIFIED)}, 1))) as name from lines")
def qualified_names(spark, d):
    return lines(spark, d).select("file_id", "line_no", F.explode(tx.qualified_names(F.col("text"))).alias("name"))


SAFE_VALUE = r"""^(?:"[^"]*"|''[^'']*''|[0-9.]+|true|false|null|(?:String|Number|parseInt|parseFloat|Boolean|ObjectId)\(.*)$"""


@query(
    "safe_object_literal",
    r"with " + sf.base(("javascript",)) + r", o as (select file_id, line_no, regexp_extract(text, '\{([^{}]*)\}', 1) i from lines where contains(text, '.find('))"
    r" select file_id, line_no, i <> '' and len(list_filter(string_split(i, ','), lambda p: not regexp_matches(trim(regexp_replace(p, '^[^:]*:', ''), ' '), '" + SAFE_VALUE + r"'))) = 0 as safe from o",
)
def safe_object_literal(spark, d):
    return lines(spark, d, ("javascript",)).filter(F.col("text").contains(".find(")).select("file_id", "line_no", joins.safe_object(F.col("text")).alias("safe"))


PIECE = quote(brackets.PIECE.replace("++", "+").replace("*+", "*"))
BLANKED = quote(QUOTED.replace("*+", "*"))
CALLS_SQL = CW + f""", pa as (select file_id, line_no, regexp_extract_all(text, {PIECE}, 1) pl, regexp_extract_all(text, {PIECE}, 2) mk from code where contains(text, '(') and lang <> 'webconfig'),
pb as (select file_id, line_no, unnest(range(len(mk))) as at_no, unnest(pl) plain, unnest(mk) mark from pa),
pc as (select *, mark in ('(', '[', '{{') opens, mark in (')', ']', '}}') closes, case when mark = '(' then nullif(regexp_extract(plain, {quote(brackets.HEAD)}, 1), '') end as name from pb where mark <> ''),
pd as (select *, sum(case when opens then 1 when closes then -1 else 0 end) over (partition by file_id, line_no order by at_no) + case when closes then 1 else 0 end lv,
  count(name) over (partition by file_id, line_no order by at_no) - 1 call_no from pc),
pe as (select *, max(case when opens then at_no end) over (partition by file_id, line_no, lv order by at_no rows unbounded preceding) own from pd),
pf as (select *, lag(at_no) over (partition by file_id, line_no, own order by at_no) prev from pe),
ar as (select p.file_id, p.line_no, p.own, p.at_no, trim(coalesce(string_agg(x.plain || x.mark, '' order by x.at_no), '') || any_value(p.plain), ' ') arg
  from pf p left join pf x on x.file_id = p.file_id and x.line_no = p.line_no and x.at_no > p.prev and x.at_no < p.at_no where p.own is not null and p.prev is not null group by all),
ag as (select file_id, line_no, own, count(*) n_args, string_agg(regexp_replace(arg, {BLANKED}, '""', 'g'), ' | ' order by at_no) args from ar where arg <> '' group by all)"""


@query(
    "extract_calls",
    CALLS_SQL + r""" select h.file_id, h.line_no, call_no, regexp_extract(name, '^(.*?)(?:\.|->)?(\w+)$', 1) as receiver, regexp_extract(name, '([\w$]+)$', 1) as callee,
 coalesce(n_args, 0)::int as n_args, coalesce(args, '') as args from pf h left join ag on ag.file_id = h.file_id and ag.line_no = h.line_no and ag.own = h.at_no
 where name is not null and regexp_extract(name, '([\w$]+)$', 1) not in (""" + ",".join(quote(x) for x in facts.CONTROL) + ")",
)
def extract_calls(spark, d):
    return facts.extract_calls(cut(code(spark, d))).select(
        "file_id", "line_no", "call_no", "receiver", "callee", F.size("args").alias("n_args"), F.array_join("args", " | ").alias("args")
    )


@query(
    "assemble_statements",
    LW + r""", b as (select *, length(regexp_replace(regexp_replace(text, '"[^"]*"|''[^'']*''', '', 'g'), '[^(\[]', '', 'g')) - length(regexp_replace(regexp_replace(text, '"[^"]*"|''[^'']*''', '', 'g'), '[^)\]]', '', 'g')) dl from lines),
c as (select *, sum(dl) over (partition by file_id order by line_no) bal from b),
s as (select *, coalesce(max(case when bal - dl <= 0 then line_no end) over (partition by file_id order by line_no), 1) st from c)
select file_id, cast(min(line_no) as int) as line_no, cast(max(line_no) as int) as end_line, string_agg(trim(text, ' '), ' ' order by line_no) as text from s group by file_id, st""",
)
def assemble_statements(spark, d):
    return facts.file_statements(files(spark, d)).select("file_id", "line_no", "end_line", "text")


FW = CW + "," + sf.functions()


@query("extract_functions", FW + " select file_id, name, array_to_string(params, '|') as params, start_line from fn where lang <> 'webconfig'")
def extract_functions(spark, d):
    return facts.extract_functions(code(spark, d)).select("file_id", "name", F.array_join("params", "|").alias("params"), "start_line")


@query("tag_parameters", FW + " select file_id, start_line, arg_pos, var, tainted from par where lang <> 'webconfig'")
def tag_parameters(spark, d):
    from seepline.operators import taint as tnt

    return tnt.tag_parameters(facts.explode_parameters(facts.extract_functions(code(spark, d)))).select("file_id", "start_line", "arg_pos", "var", "tainted")


@query(
    "resolve_aliases",
    CW + r""", al as (
 select file_id, line_no, regexp_extract(text, '^\s*import\s+([\w.]+)\s+as\s+(\w+)', 2) alias, regexp_extract(text, '^\s*import\s+([\w.]+)\s+as\s+(\w+)', 1) target from code where regexp_matches(text, '^\s*import\s+([\w.]+)\s+as\s+(\w+)')
 union all select file_id, line_no, regexp_extract(n, '(\w+)\s*$', 1), m || '.' || regexp_extract(n, '^\s*(\w+)', 1) from (select file_id, line_no, regexp_extract(text, '^\s*from\s+([\w.]+)\s+import\s+(.+)$', 1) m, unnest(string_split(regexp_extract(text, '^\s*from\s+([\w.]+)\s+import\s+(.+)$', 2), ',')) n from code where regexp_matches(text, '^\s*from\s+([\w.]+)\s+import\s+(.+)$')) q
 union all select file_id, line_no, regexp_extract(text, '\b(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]', 1), regexp_extract(text, '\b(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]', 2) from code where regexp_matches(text, '\b(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*[''"]([^''"]+)[''"]')
 union all select file_id, line_no, regexp_extract(text, '^\s*import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+[''"]([^''"]+)[''"]', 1), regexp_extract(text, '^\s*import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+[''"]([^''"]+)[''"]', 2) from code where regexp_matches(text, '^\s*import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+[''"]([^''"]+)[''"]'))
select file_id, line_no, alias, target from al where alias <> ''""",
)
def resolve_aliases(spark, d):
    return facts.extract_aliases(code(spark, d))


@query(
    "locate_match",
    "with m as (select doc_id, text, instr(text, 'the') hit_at from documents where instr(text, 'the') > 0)"
    " select doc_id, length(substr(text, 1, hit_at - 1)) - length(replace(substr(text, 1, hit_at - 1), chr(10), '')) + 1 as line_no,"
    " length(regexp_extract(substr(text, 1, hit_at - 1), '([^\\n]*)\\z', 1)) + 1 as col_no from m",
)
def locate_match(spark, d):
    docs = tables(spark, d, "documents").withColumn("at", F.instr("text", "the")).filter("at > 0")
    line, col = facts.locate(F.col("text"), F.col("at"))
    return docs.select("doc_id", line.alias("line_no"), col.alias("col_no"))


@query("flag_dynamic_string", LW + f" select file_id, line_no from lines where regexp_matches(text, {quote(tx.DYNAMIC)})")
def flag_dynamic_string(spark, d):
    return lines(spark, d).filter(tx.is_dynamic(F.col("text"))).select("file_id", "line_no")


PARAM_RX = r"""["'`][^"'`]*(?:""" + tx.PLACEHOLDER + r""")[^"'`]*["'`]\s*,\s*[\[(\w$]"""


@query("flag_parameterised", LW + f" select file_id, line_no from lines where regexp_matches(text, {quote(PARAM_RX)})")
def flag_parameterised(spark, d):
    return lines(spark, d).filter(tx.is_parameterised(F.col("text"))).select("file_id", "line_no")


@query(
    "classify_format_specifiers",
    LW + r", s as (select file_id, line_no, regexp_extract_all(text, '%[-+0 #]*[0-9.]*([a-zA-Z])', 1) sp from lines)"
    r" select file_id, line_no, case when len(list_filter(sp, lambda x: x not in ('d','i','u','x','o','f','e','g'))) = 0 then 'NUMERIC' else 'STRING' end as risk from s where len(sp) > 0",
)
def classify_format_specifiers(spark, d):
    return lines(spark, d).select("file_id", "line_no", tx.format_risk(F.col("text")).alias("risk")).filter("risk is not null")


TIMEOUT = r"(?i)timeout\s*=\s*[\"'](\d+)[\"']"


@query("threshold_attribute", "with " + sf.base(("webconfig",)) + f" select file_id, line_no, cast(regexp_extract(text, {quote(TIMEOUT)}, 1) as int) as value from lines where try_cast(regexp_extract(text, {quote(TIMEOUT)}, 1) as int) > 60")
def threshold_attribute(spark, d):
    return facts.attribute_over(lines(spark, d, ("webconfig",)), "timeout", 60)


SH = ",".join(quote(x) for x in joins.SHELLS)
FL = ",".join(quote(x) for x in joins.FLAGS)


@query(
    "match_shell_argv",
    CW + f""", a as (select file_id, line_no, list_transform(string_split(regexp_extract(text, {quote(joins.ARGV)}, 1), ','), lambda x: regexp_replace(trim(x, ' '), '^["'']|["'']$', '', 'g')) v from code where lang <> 'webconfig')
select file_id, line_no, regexp_extract(v[1], '([^/]*)$', 1) as shell, array_to_string(v[3:], ' ') as command from a where len(v) >= 2 and regexp_extract(v[1], '([^/]*)$', 1) in ({SH}) and v[2] in ({FL})""",
)
def match_shell_argv(spark, d):
    return joins.shell_argv(code(spark, d)).select("file_id", "line_no", "shell", F.array_join("command", " ").alias("command"))


QARG = r"""\s*\(\s*b?["']([^"']*)["']"""
CODES = lambda subject, p: f"array_to_string(list_transform(regexp_extract_all({subject}, {quote(p)}, 1), lambda c: chr(cast(c as int))), '')"
CONCAT_RX = r"""^\s*["'][^"']*["'](?:\s*[+.]\s*["'][^"']*["'])*\s*$"""
FOLD_SQL = f"""case
 when regexp_matches(rhs, '\\bfromhex\\s*\\(|\\bhex2bin\\s*\\(') then decode(unhex(regexp_extract(rhs, {quote(r'\b(?:fromhex|hex2bin)' + QARG)}, 1)))
 when regexp_matches(rhs, '\\b(?:b64decode|base64_decode|atob)\\s*\\(') then decode(from_base64(regexp_extract(rhs, {quote(r'\b(?:b64decode|base64_decode|atob)' + QARG)}, 1)))
 when regexp_matches(rhs, '\\bcodecs\\.decode\\s*\\(.*rot|\\bstr_rot13\\s*\\(') then translate(regexp_extract(rhs, {quote(r'\b(?:codecs\.decode|str_rot13)' + QARG)}, 1), '{tx.LETTERS}', '{tx.ROTATED}')
 when regexp_matches(rhs, '\\bstrrev\\s*\\(') then reverse(regexp_extract(rhs, {quote(r'\bstrrev' + QARG)}, 1))
 when regexp_matches(rhs, '\\bchr\\s*\\(') then {CODES('rhs', r'\bchr\s*\(\s*(\d+)\s*\)')}
 when regexp_matches(rhs, '\\bfromCharCode\\s*\\(') then {CODES("regexp_extract(rhs, 'fromCharCode\\s*\\(([^)]*)\\)', 1)", r'(\d+)')}
 when regexp_matches(rhs, {quote(CONCAT_RX)}) then array_to_string(regexp_extract_all(rhs, '["'']([^"'']*)["'']', 1), '')
 when regexp_matches(rhs, '["'']\\s*\\.join\\s*\\(\\s*\\[') then array_to_string(regexp_extract_all(regexp_extract(rhs, 'join\\s*\\(\\s*\\[([^\\]]*)\\]', 1), '["'']([^"'']*)["'']', 1), '')
 end"""


@query("fold_constants", AW + f", fd as (select file_id, line_no, lhs as var, {FOLD_SQL} as value from tgt where lang <> 'webconfig') select * from fd where value is not null")
def fold_constants(spark, d):
    return joins.constants(facts.explode_targets(facts.extract_assignments(code(spark, d)))).select("file_id", "line_no", "var", "value")


@query(
    "detect_minified",
    r"""with x as (select doc_id as file_id, source as path, text as content, list_transform(string_split_regex(regexp_replace(text, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r'), lambda l: length(l)) ls from documents)
 select file_id, regexp_matches(lower(path), '[.-]min\.') or list_sum(ls) > 500 * len(ls) or list_max(ls) > 1000
  or (length(content) - length(replace(content, ';', '')) >= 3 * len(ls) and 10 * len(regexp_extract_all(content, '[ \t\r\n]')) < length(content)) as minified from x""",
)
def detect_minified(spark, d):
    docs = tables(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"), F.col("text").alias("content"))
    return facts.detect_minified(docs).select("file_id", "minified")


@query(
    "extract_inline_scripts",
    r"""with p as (select page_id, string_split_regex(html, '(?i)<script[^>]*>') pc, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) bd from pages),
 s as (select page_id, pc, unnest(range(0, len(bd))) script_no, unnest(bd) body from p),
 t as (select *, 1 + list_sum(list_transform(pc[1:script_no + 1], lambda x: length(x) - length(replace(x, chr(10), '')))) st from s)
 select page_id, script_no, cast(st as int) as start_line, cast(st + length(body) - length(replace(body, chr(10), '')) as int) as end_line, body from t""",
)
def extract_inline_scripts(spark, d):
    return facts.extract_scripts(tables(spark, d, "pages"), "page_id", "html")
