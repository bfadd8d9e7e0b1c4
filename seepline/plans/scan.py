"""End-to-end plans: files to facts to taint to findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import detect as det, evidence, facts, findings as fnd, joins, scopes, taint as tnt
from ..rules import rules_for
from ..rules.model import PROTO, Rule
from .durable import by_key, cut


@dataclass(frozen=True)
class Taint:
    """Tainted variables (file, scope, var, label) and category-wise sanitized ones."""

    marks: DataFrame
    sanitized: DataFrame


def taint_inputs(lines: DataFrame, langs: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(code lines, assignments, seeds, edges) of the languages, file-level."""
    # read by each kind of seed and edge
    code = cut(facts.drop_comments(lines, langs))
    assigns = cut(facts.explode_targets(facts.extract_assignments(code, langs)))
    params = facts.explode_parameters(facts.extract_functions(code, langs), langs)
    seeds = tnt.seed_sources(assigns, langs).unionByName(tnt.seed_parameters(params, langs))
    edges = tnt.def_use_edges(assigns, langs).unionByName(tnt.builder_edges(code, langs))
    if "java" in langs:
        edges = edges.unionByName(tnt.wrapper_edges(assigns)).unionByName(tnt.lambda_edges(code))
    if "csharp" in langs:
        edges = edges.unionByName(tnt.linq_edges(code))
    if "php" in langs:
        seeds = seeds.unionByName(tnt.wildcard_seeds(code))
    if "go" in langs:
        seeds = seeds.unionByName(tnt.seed_scans(code))
    return code, assigns, seeds, edges


def file_taint(lines: DataFrame, langs: Sequence[str]) -> Taint:
    """File-level taint of the languages, with validation gates and table names applied."""
    code, assigns, seeds, edges = taint_inputs(lines, langs)
    marks = tnt.propagate(seeds, edges).select(*tnt.KEY)
    if "php" in langs:
        tables = tnt.table_name_taint(assigns, marks).select(*tnt.KEY)
        marks = joins.subtract_validated(marks.unionByName(tables), joins.validation_gates(lines, assigns))
    return Taint(marks, facts.sanitized_vars(assigns))


def write_taint(taint: Taint) -> Taint:
    """Write taint once so that several rule packs can read it."""
    return Taint(cut(taint.marks), cut(taint.sanitized))


def scan_language(
    lines: DataFrame, lang: str, rules: Sequence[Rule] | None = None, taint: Taint | None = None
) -> DataFrame:
    """Graded hits of one language's rules; taint is computed only if a rule asks for it and
    none was handed over."""
    rules = rules_for(lang) if rules is None else rules
    lines = lines.filter(F.col("lang") == lang)
    if any(r.label for r in rules):
        t = taint or file_taint(lines, [lang])
        return det.detect(lines, rules, t.marks, t.sanitized)
    return det.detect(lines, rules)


def scan(files: DataFrame, rules: Sequence[Rule], keyword: str = "nosec") -> DataFrame:
    """Files to de-duplicated findings over all languages of the rules, in one plan."""
    lines = facts.explode_lines(files)
    langs = sorted({r.lang for r in rules if r.label})
    if langs:
        lines = cut(lines)
        t = file_taint(lines.filter(F.col("lang").isin(*langs)), langs)
        hits = det.detect(lines, rules, t.marks, t.sanitized)
    else:
        hits = det.detect(lines, rules)
    return fnd.dedup_findings(fnd.suppress_inline(hits, keyword))


@dataclass(frozen=True)
class FunctionTaint:
    """What is known by function. In edges and reached, a variable is owner:name with scope_id 0, which is one variable in the file."""

    scoped: DataFrame
    found: DataFrame
    params: DataFrame
    declared: DataFrame
    edges: DataFrame
    reached: DataFrame
    sanitized: DataFrame

    def marks(self) -> DataFrame:
        place = F.split("var", ":", 2)
        return self.reached.select("file_id", F.get(place, F.lit(0)).cast("int").alias("scope_id"), F.get(place, F.lit(1)).alias("var"), "label")

    def resolve(self, uses: DataFrame) -> DataFrame:
        """Used variables (file_id, scope_id, var) with the scope that owns them."""
        return scopes.resolve(uses, scopes.owners(uses, self.declared, self.found))


def function_taint(lines: DataFrame, langs: Sequence[str]) -> FunctionTaint:
    """Taint by function of the languages.

    Calls of the file's own functions carry taint both ways: to the parameters that take a tainted argument, and, by summaries
    of parameters, to the variable that takes the result.
    """
    code = cut(facts.drop_comments(lines.filter(F.col("lang").isin(*langs)), langs))
    found = cut(scopes.functions(code))
    scoped = cut(scopes.assign(code, found))
    assigns = cut(facts.explode_targets(facts.extract_assignments(scoped, langs)))
    params = cut(facts.explode_parameters(found, langs))
    calls = cut(tnt.call_assignments(assigns, found))
    summaries = tnt.summarize_functions(scoped, found, calls, assigns)
    own_calls = calls.select("file_id", "scope_id", "line_no", F.col("lhs").alias("dst")).distinct()
    direct = tnt.def_use_edges(assigns, langs).unionByName(tnt.builder_edges(scoped, langs))
    if "java" in langs:
        direct = direct.unionByName(tnt.wrapper_edges(assigns)).unionByName(tnt.lambda_edges(scoped))
    if "csharp" in langs:
        direct = direct.unionByName(tnt.linq_edges(scoped))
    edges = cut(direct.join(by_key(own_calls), ["file_id", "scope_id", "line_no", "dst"], "left_anti").unionByName(tnt.summary_edges(calls, summaries)))
    given = cut(evidence.argument_edges(scoped, params))
    seeds = tnt.seed_sources(assigns, langs).unionByName(tnt.seed_parameters(params, langs, file_level=False))
    if "php" in langs:
        seeds = seeds.unionByName(tnt.wildcard_seeds(scoped))
    if "go" in langs:
        seeds = seeds.unionByName(tnt.seed_scans(scoped))
    seeds = cut(seeds)

    declared = cut(assigns.select("file_id", "scope_id", F.col("lhs").alias("var")).unionByName(params.select("file_id", "scope_id", "var")).distinct())
    names = [edges.select("file_id", "scope_id", F.col(c).alias("var")) for c in ("src", "dst")]
    names += [given.select("file_id", "scope_id", F.col("src").alias("var")), seeds.select("file_id", "scope_id", "var")]
    owned = cut(scopes.owners(fnd.union_findings(*names), declared, found))

    def qualified(df: DataFrame, name: str) -> DataFrame:
        """`name` as owner:name, which is one variable in the whole file."""
        kept = df.columns
        owner = owned.select("file_id", "scope_id", F.col("var").alias(name), "owner")
        return df.join(by_key(owner), ["file_id", "scope_id", name], "left").withColumn(name, F.concat_ws(":", F.coalesce("owner", "scope_id"), name)).select(*kept)

    file_wide = lambda df: df.withColumn("scope_id", F.lit(0))
    into = qualified(given, "src").select("file_id", "scope_id", "src", F.concat_ws(":", "callee_scope", "dst").alias("dst"), F.lit("user").alias("label"), "line_no")
    all_edges = cut(file_wide(qualified(qualified(edges, "src"), "dst").unionByName(into.select(*edges.columns))))
    reached = cut(tnt.propagate(file_wide(qualified(seeds, "var")), all_edges))
    return FunctionTaint(scoped, found, params, declared, all_edges, reached, cut(facts.sanitized_vars(assigns)))


def _by_function(lines: DataFrame, t: FunctionTaint, rules: Sequence[Rule], keyword: str) -> DataFrame:
    hits = cut(det.match_rules(lines, rules))
    placed = hits.join(by_key(t.scoped.select("file_id", "line_no", "scope_id")), ["file_id", "line_no"], "left").withColumn("scope_id", F.coalesce("scope_id", F.lit(0)))
    graded = det.grade(det.join_taint(cut(placed), rules, t.marks(), t.sanitized, t.resolve), rules)
    if any(r.category == PROTO and r.lang == "javascript" for r in rules):
        graded = fnd.union_findings(graded, evidence.parameter_keys(t.scoped, t.params, t.resolve))
    return fnd.dedup_findings(fnd.suppress_inline(graded, keyword))


def _with_evidence(rules: Sequence[Rule]) -> list[Rule]:
    """The rules and those over calls that hold for the same language and category."""
    asked = {(r.lang, r.category) for r in rules}
    return [*rules, *(r for r in evidence.WRAPPERS if (r.lang, r.category) in asked)]


def scan_functions(files: DataFrame, rules: Sequence[Rule], keyword: str = "nosec") -> DataFrame:
    """Findings with taint by function: variables of the same name in different functions are different ones.

    Functions nest; a variable belongs to the innermost function around its use in which it is assigned or a parameter,
    so what an inner function captures stays tainted. Calls of the file's own functions carry taint into their parameters and, by
    summaries, out of them. An assignment to a captured variable counts as one of its own.
    """
    rules = _with_evidence(rules)
    lines = cut(facts.explode_lines(files))
    t = function_taint(lines, sorted({r.lang for r in rules if r.label}))
    return _by_function(lines, t, rules, keyword)


def scan_described(files: DataFrame, rules: Sequence[Rule], keyword: str = "nosec") -> DataFrame:
    """Findings by function with path, column, code, message, weakness, advice and the whole way of the tainted value."""
    rules = _with_evidence(rules)
    lines = cut(facts.explode_lines(files))
    t = function_taint(lines, sorted({r.lang for r in rules if r.label}))
    findings = cut(_by_function(lines, t, rules, keyword))
    ways = evidence.readable_chains(tnt.chains(t.reached, t.edges))
    other = lines.join(by_key(t.scoped.select("file_id", "line_no", "scope_id")), ["file_id", "line_no"], "left").withColumn("scope_id", F.coalesce("scope_id", F.lit(0)))
    return evidence.described(findings, files, other, [*rules, evidence.PARAMETER_KEY], ways, t.resolve)
