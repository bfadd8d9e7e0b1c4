"""Filters, windows, aggregates, orderings over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepline.functions import frames
from seepline.operators import detect as det, facts, findings as fnd
from seepline.plans import scan
from seepline.rules import rules_for
from seepline.sources import config, reports

from . import sqlfacts as sf
from .corpus import LINES_SQL, files, files_sql, quote, tables
from .q_joins import PY_SQL, python_hits
from .q_sources import LW, lines
from .registry import query

CFG = rules_for("webconfig")
CFG_SQL = "with recursive " + ",".join([sf.base(("webconfig",)), sf.pack_hits("webconfig", CFG, False), sf.GRADED])


def config_hits(spark, d):
    return scan.scan_language(lines(spark, d, ("webconfig",)), "webconfig")


def best(spark, d):
    return fnd.dedup_findings(fnd.suppress_inline(python_hits(spark, d)))


RANK = "case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"
CRANK = "case confidence when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"


@query("match_rules", CFG_SQL + " select file_id, line_no, rule_id from hit")
def match_rules(spark, d):
    return config_hits(spark, d).select("file_id", "line_no", "rule_id")


@query("suppress_inline", PY_SQL + " select file_id, line_no, rule_id from kept")
def suppress_inline(spark, d):
    return fnd.suppress_inline(python_hits(spark, d)).select("file_id", "line_no", "rule_id")


@query("min_severity", CFG_SQL + f" select file_id, line_no, rule_id from graded where {RANK} >= 3")
def min_severity(spark, d):
    return fnd.min_severity(config_hits(spark, d), "HIGH").select("file_id", "line_no", "rule_id")


@query("min_confidence", CFG_SQL + f" select file_id, line_no, rule_id from graded where {CRANK} >= 3")
def min_confidence(spark, d):
    return fnd.min_confidence(config_hits(spark, d), None, None).select("file_id", "line_no", "rule_id")


@query("rank_levels", CFG_SQL + f" select file_id, line_no, rule_id, {RANK} as severity_rank, {CRANK} as confidence_rank from graded")
def rank_levels(spark, d):
    return fnd.with_rank(config_hits(spark, d)).select("file_id", "line_no", "rule_id", "severity_rank", "confidence_rank")


@query("name_heuristics", LW + f" select distinct file_id, name from (select file_id, unnest(regexp_extract_all(text, '([A-Za-z_]\\w*)', 1)) as name from lines) where regexp_matches(name, {quote(fnd.SECRET_NAME)}) or regexp_matches(name, {quote(fnd.TABLE_NAME)})")
def name_heuristics(spark, d):
    names = lines(spark, d).select("file_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), F.lit(1))).alias("name"))
    return fnd.named(names).distinct()


@query("negative_guards", LW + r" select file_id, line_no from lines where lang = 'python' and regexp_matches(text, '(?:^|\W)(?:eval|exec|compile)\s*\(') and not regexp_matches(text, '\bre\.compile\s*\(') and not regexp_matches(text, '^\s*#')")
def negative_guards(spark, d):
    rule = [r for r in rules_for("python") if r.rule_id == "py-eval"]
    return det.match_rules(lines(spark, d), rule).select("file_id", "line_no")


@query("lookup_remediation", CFG_SQL + " select file_id, line_no, rule_id, cwe as cwe_id, advice as remediation from graded g join (values " + ",".join(
    f"({quote(c)},{quote(w)},{quote(a)})" for c, (w, a) in det.REMEDIATION.items()) + ") r(category, cwe, advice) on r.category = g.category")
def lookup_remediation(spark, d):
    return config_hits(spark, d).select("file_id", "line_no", "rule_id", "cwe_id", "remediation")


@query("format_messages", CFG_SQL + ", msg(rule_id, m) as (values " + ",".join(f"({quote(r.rule_id)},{quote(r.message)})" for r in CFG) + ") select file_id, line_no, m || ' [' || category || '] at line ' || line_no as message from graded join msg using (rule_id)")
def format_messages(spark, d):
    return config_hits(spark, d).select("file_id", "line_no", fnd.message().alias("message"))


SUMMARY = """ select dimension, value, cast(n as bigint) as n from (
 select 'severity' as dimension, severity as value, count(*) as n from best group by severity union all select 'category', category, count(*) from best group by category
 union all select 'confidence', confidence, count(*) from best group by confidence)"""


@query("summarize_findings", PY_SQL + SUMMARY)
def summarize_findings(spark, d):
    return fnd.summarize_findings(best(spark, d))


@query("findings_per_file", PY_SQL + f" select file_id, count(*) as n, min(line_no) as first_line, max({RANK}) as worst from best group by file_id")
def findings_per_file(spark, d):
    return fnd.findings_per_file(best(spark, d))


@query("distinct_files", PY_SQL + " select count(distinct file_id) as n_files from best")
def distinct_files(spark, d):
    return best(spark, d).agg(F.count_distinct("file_id").alias("n_files"))


@query("scan_statistics", CFG_SQL + " select (select count(*) from files) as files_scanned, (select count(*) from files where content is null or content = '') as unreadable, (select count(*) from best) as total_findings")
def scan_statistics(spark, d):
    found = fnd.dedup_findings(fnd.suppress_inline(config_hits(spark, d)))
    return fnd.scan_statistics(files(spark, d, ("webconfig",)), found)


@query("severity_gate", CFG_SQL + " select regexp_extract(path, '^([^/]*)', 1) as repo, bool_or(severity in ('CRITICAL','HIGH')) as failed from best join files using (file_id) group by 1")
def severity_gate(spark, d):
    found = fnd.dedup_findings(fnd.suppress_inline(config_hits(spark, d)))
    repo = F.regexp_extract("path", r"^([^/]*)", 1).alias("repo")
    return fnd.severity_gate(found.join(files(spark, d, ("webconfig",)).select("file_id", repo), "file_id"), "repo")


@query("file_profile", LW + " select file_id, count(*) as n_lines, cast(sum(length(text)) as bigint) as total_length, max(length(text)) as max_length, cast(sum(length(text) - length(replace(text, ';', ''))) as bigint) as semicolons from lines group by file_id")
def file_profile(spark, d):
    return fnd.file_profile(lines(spark, d)).select("file_id", "n_lines", "total_length", "max_length", "semicolons")


@query("dedup_findings", PY_SQL + " select * from best")
def dedup_findings(spark, d):
    return best(spark, d)


@query("context_window", LW + " select file_id, line_no, bool_or(contains(text, 'exec')) over (partition by file_id order by line_no range between 9 preceding and current row) as near_exec, bool_or(contains(text, 'return')) over (partition by file_id order by line_no range between 2 preceding and 10 following) as near_return from lines")
def context_window(spark, d):
    text = F.col("text")
    return frames.framed(
        lines(spark, d).select("file_id", "line_no", text.contains("exec").alias("e"), text.contains("return").alias("r")), ["file_id"], "line_no",
        {"near_exec": (F.bool_or("e"), -9, 0), "near_return": (F.bool_or("r"), -2, 10)},
    ).select("file_id", "line_no", "near_exec", "near_return")


@query("context_window_documents", r"with s as (select doc_id, string_split_regex(regexp_replace(text, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r') p from documents), l as (select doc_id as file_id, unnest(range(1, len(p) + 1)) as line_no, unnest(p) as text from s) select file_id, line_no, count_if(contains(text, 'the')) over (partition by file_id order by line_no range between 3 preceding and 3 following) as n from l")
def context_window_documents(spark, d):
    ls = facts.explode_lines(tables(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "lang", F.col("text").alias("content")))
    flag = ls.select("file_id", "line_no", F.col("text").contains("the").cast("long").alias("t"))
    return frames.framed(flag, ["file_id"], "line_no", {"n": (F.sum("t"), -3, 3)}, block=16).select("file_id", "line_no", "n")


@query("code_snippet", LW + " select file_id, line_no, string_agg(text, chr(10)) over (partition by file_id order by line_no rows between 2 preceding and 2 following) as snippet from lines")
def code_snippet(spark, d):
    return fnd.code_snippet(lines(spark, d)).select("file_id", "line_no", "snippet")


@query("block_state", LW + " select file_id, line_no, cast(sum(length(regexp_replace(text, '[^{]', '', 'g')) - length(regexp_replace(text, '[^}]', '', 'g'))) over (partition by file_id order by line_no) as bigint) as depth from lines")
def block_state(spark, d):
    return fnd.block_depth(lines(spark, d)).select("file_id", "line_no", "depth")


@query("order_findings", PY_SQL + " select file_id, line_no, category, rule_id from best order by file_id, line_no, category")
def order_findings(spark, d):
    return fnd.order_findings(best(spark, d)).select("file_id", "line_no", "category", "rule_id")


@query("top_categories", PY_SQL + " select category, count(*) as n from best group by category order by n desc, category limit 5")
def top_categories(spark, d):
    return fnd.top_categories(best(spark, d), 5)


@query("truncate_code", PY_SQL + " select file_id, line_no, rule_id, substr(trim(code, ' '), 1, 100) as code from kept")
def truncate_code(spark, d):
    return fnd.suppress_inline(python_hits(spark, d)).select("file_id", "line_no", "rule_id", fnd.truncate_code(F.col("code")).alias("code"))


@query("union_findings", CFG_SQL + ", adv as (select event_id, ['LOW','MEDIUM','HIGH','CRITICAL'][event_id % 4 + 1] as severity from events) select file_id, category, severity, rule_id from best union all select null, 'VULNERABLE_DEPENDENCY', severity, null from adv")
def union_findings(spark, d):
    from .q_sources import flatten_advisories

    found = fnd.dedup_findings(fnd.suppress_inline(config_hits(spark, d))).select("file_id", "category", "severity", "rule_id")
    return fnd.union_findings(found, flatten_advisories(spark, d).select("category", "severity"))


@query("union_rules", "with o as (select o_custkey c from orders) select 'sink' as kind, 'python' as lang, pattern from (select 'run' || (c % 40) as pattern from o union select 'run' || (c % 60) from o)")
def union_rules(spark, d):
    o = tables(spark, d, "orders")
    row = lambda n: o.select(F.lit("sink").alias("kind"), F.lit("python").alias("lang"), F.concat(F.lit("run"), (F.col("o_custkey") % n).cast("string")).alias("pattern"))
    return config.union_rules(row(40), row(60))


JSON = """ select 'finding' as section, '{"category":"' || category || '","confidence":"' || confidence || '","file_id":' || file_id || ',"line_no":' || line_no || ',"rule_id":"' || rule_id || '","severity":"' || severity || '"}' as json from best
 union all select 'summary', '{"dimension":"' || dimension || '","value":"' || value || '","n":' || n || '}' from (""" + SUMMARY + ")"


@query("write_json_report", CFG_SQL + JSON)
def write_json_report(spark, d):
    return reports.json_report(fnd.dedup_findings(fnd.suppress_inline(config_hits(spark, d))))


@query("write_text_report", CFG_SQL + " select file_id, line_no, file_id || ':' || line_no || ' [' || severity || '/' || confidence || '] ' || category || ' (' || rule_id || ')' as text from best")
def write_text_report(spark, d):
    return reports.text_report(fnd.dedup_findings(fnd.suppress_inline(config_hits(spark, d))))
