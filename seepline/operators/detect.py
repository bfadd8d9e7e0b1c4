"""Evaluation of rule rows over lines.

All rules of a run are one generated projection over the lines: each line is scanned once
and leaves the scan only if a rule matched it or a context pattern occurs on it. Context
patterns travel as bits of one long, tainted labels likewise, so every shuffle is narrow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..functions.text import required_literals
from ..plans.durable import by_key, cut
from ..rules.languages import LANGUAGES, NEVER
from ..rules.model import REMEDIATION, WHOLE, Rule

#: The column that holds a line in lower case while it is matched.
LOWERED = "_lowered"
LABEL_BITS = {"user": 1, "db": 2, "json": 4, "unser": 8, "table": 16}


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    # ${name} would be taken for a session variable, so its $ is written as a code point.
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"


def matches_sql(text: str, pattern: str, lowered: str | None = None) -> str:
    """``rlike`` behind its literal prefilter, as SQL text; ``lowered``: the text in lower case, where it is there already.

    Rules are compiled to SQL text because a pack is hundreds of small expressions, which
    are parsed in one call but would be one driver round trip each as column objects.
    """
    like = f"{text} rlike {sql_text(pattern)}"
    if pattern.startswith("(?i)"):
        subject, literals = lowered or f"lower({text})", required_literals(pattern[4:].lower())
    else:
        subject, literals = text, required_literals(pattern)
    if not literals:
        return f"({like})"
    return "((" + " or ".join(f"contains({subject}, {sql_text(x)})" for x in dict.fromkeys(literals)) + f") and {like})"


def case_sql(subject: str, arms: dict[int, str], default: str) -> str:
    """``case`` over rule numbers."""
    if not arms:
        return default
    return f"case {subject} " + " ".join(f"when {k} then {v}" for k, v in arms.items()) + f" else {default} end"


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a dimension table, one row per rule; its size is the number of rules."""
    ordered = sorted(rules, key=lambda r: r.rule_id)
    rows = []
    for i, r in enumerate(ordered):
        sev, conf = r.grade.split("/")
        sev0, conf0 = r.plain.split("/") if r.plain else (None, None)
        cwe, advice = REMEDIATION.get(r.category, (None, None))
        rows.append((i, r.rule_id, r.lang, r.category, r.label, sev, conf, sev0, conf0, r.priority, r.message, r.cwe or cwe, advice))
    return spark.createDataFrame(
        rows,
        "rule_no int, rule_id string, rule_lang string, category string, label string, severity_tainted string,"
        " confidence_tainted string, severity_plain string, confidence_plain string, priority int,"
        " vulnerability string, cwe_id string, remediation string",
    )


def match_rules(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Lines x pattern rules to (file_id, lang, line_no, rule_no, code), contexts applied."""
    ordered = sorted(rules, key=lambda r: r.rule_id)
    langs = sorted({r.lang for r in ordered})
    arms: dict[str, list[str]] = {l: [] for l in langs}
    for i, r in enumerate(ordered):
        cond = matches_sql("text", r.pattern, LOWERED)
        if r.unless:
            cond += f" and not text rlike {sql_text(r.unless)}"
        arms[r.lang].append(f"case when {cond} then {i} else -1 end")
    comments = {l: LANGUAGES[l].comment for l in langs if l in LANGUAGES and not LANGUAGES[l].comment.startswith(NEVER)}
    comment = " or ".join(f"(lang = '{l}' and text rlike {sql_text(p)})" for l, p in comments.items()) or "false"

    def of_language(values: dict[str, str], other: str) -> str:
        """A line asks for its own language's patterns only."""
        if not values:
            return other
        return "case " + " ".join(f"when lang = '{l}' then {v}" for l, v in values.items()) + f" else {other} end"

    found = of_language({l: f"array_remove(array({', '.join(a)}), -1)" for l, a in arms.items()}, "cast(array() as array<int>)")
    hits = F.expr(f"case when {comment} then cast(array() as array<int>) else {found} end").alias("hits")

    contexts: dict[str, int] = {}
    asked_by: dict[str, set[str]] = {l: set() for l in langs}
    for r in ordered:
        for p in (r.near, r.absent):
            if p:
                contexts.setdefault(p, len(contexts))
                asked_by[r.lang].add(p)
    banks = (len(contexts) + 61) // 62
    masks = []
    for b in range(banks):
        bits = {l: [f"if({matches_sql('text', p, LOWERED)}, {1 << (n % 62)}L, 0L)" for p, n in contexts.items() if n // 62 == b and p in asked_by[l]] for l in langs}
        masks.append(F.expr(of_language({l: " | ".join(x) for l, x in bits.items() if x}, "0L")).alias(f"mask{b}"))

    # Only lines that matter for some rule are shuffled. They are picked from an array, as a filter would match all rules a second time.
    matters = F.size("hits") > 0
    for b in range(banks):
        matters = matters | (F.col(f"mask{b}") != 0)
    names = ["hits", *(f"mask{b}" for b in range(banks))]
    # Lower case is asked for by each literal of many patterns, and made once a line. A projection with a function over arrays is compiled
    # by itself, in many small methods; within its whole stage the rules would be one method, too long for the JVM to compile it.
    apart = F.exists(F.array("text"), lambda t: t.isNotNull()).alias("_read")
    matched = lines.filter(F.col("lang").isin(*langs)).withColumn(LOWERED, F.lower("text")).select("file_id", "lang", "line_no", "text", hits, *masks, apart)
    rows = matched.select("file_id", "lang", "line_no", "text", F.explode(F.when(F.col("_read") & matters, F.array(F.struct(*names)))).alias("m"))
    if not contexts:
        return rows.select("file_id", "lang", "line_no", F.explode("m.hits").alias("rule_no"), F.col("text").alias("code"))
    rows = rows.select("file_id", "lang", "line_no", "m.hits", F.when(F.size("m.hits") > 0, F.col("text")).alias("code"), *(f"m.mask{b}" for b in range(banks)))
    near_file = {i: contexts[r.near] for i, r in enumerate(ordered) if r.near and r.near_frame == WHOLE}
    absent_file = {i: contexts[r.absent] for i, r in enumerate(ordered) if r.absent and r.absent_frame == WHOLE}
    near = {i: (contexts[r.near], *r.near_frame) for i, r in enumerate(ordered) if r.near and i not in near_file}
    absent = {i: (contexts[r.absent], *r.absent_frame) for i, r in enumerate(ordered) if r.absent and i not in absent_file}
    if near_file or absent_file:
        # Read once more for the files that hold a context.
        rows = cut(rows)
    hits = _in_frames(rows, near, absent) if near or absent else rows.select("file_id", "lang", "line_no", F.explode("hits").alias("rule_no"), "code")
    for of_rule, kept in ((near_file, "held"), (absent_file, "held is null")):
        if of_rule:
            bits = [f"if((mask{n // 62} & {1 << (n % 62)}L) <> 0, {n}, null)" for n in sorted(set(of_rule.values()))]
            holders = rows.select("file_id", F.expr(f"explode(array_compact(array({', '.join(bits)})))").alias("context")).distinct()
            asked = hits.withColumn("context", F.expr(case_sql("rule_no", {i: str(n) for i, n in of_rule.items()}, "cast(null as int)")))
            hits = (
                asked.join(by_key(holders.withColumn("held", F.lit(True))), ["file_id", "context"], "left")
                .filter(case_sql("rule_no", {i: kept for i in of_rule}, "true"))
                .select("file_id", "lang", "line_no", "rule_no", "code")
            )
    return hits


#: Lines of a block whose contexts lie in one row.
NEAR = 128


def _in_frames(rows: DataFrame, near: dict[int, tuple[int, int, int]], absent: dict[int, tuple[int, int, int]]) -> DataFrame:
    """(file_id, lang, line_no, rule_no, code) of the hits that have a context of `near` in their frame, and none of `absent`: number of a context, first and last line of its frame, by rule.

    The distinct contexts of `NEAR` lines and of the frames' lines around them stand beside each of these lines, so one pass over the lines serves all frames.
    """
    masks = [c for c in rows.columns if c.startswith("mask")]
    frames_ = [*near.values(), *absent.values()]
    lo, hi = min(0, *(f[1] for f in frames_)), max(0, *(f[2] for f in frames_))
    line, block = F.col("line_no"), lambda p: F.floor(p / F.lit(NEAR)).cast("long")
    holds = reduce(or_, (F.col(m) != 0 for m in masks))
    home = F.array(F.col("_home"))
    blocks = F.when(holds, F.array_union(home, F.sequence(block(line - F.lit(hi)), block(line - F.lit(lo))))).otherwise(home)
    dealt = rows.withColumn("_home", block(line)).withColumn("_block", F.explode(blocks))
    around = F.collect_set(F.when(holds, F.struct(F.col("line_no").alias("at"), *masks))).over(Window.partitionBy("file_id", "_block"))
    met = dealt.withColumn("around", around).filter("_block = _home and size(hits) > 0").withColumn("rule_no", F.explode("hits"))

    def seen(of_rule: dict[int, tuple[int, int, int]]) -> Column:
        """Does the rule's context stand in its frame? Null for rules that ask for none."""
        if not of_rule:
            return F.lit(None).cast("boolean")
        of = lambda value, kind: F.get(F.lit([value(*of_rule[i]) if i in of_rule else None for i in range(max(of_rule) + 1)]).cast(f"array<{kind}>"), F.col("rule_no"))
        begin, end = line + of(lambda n, a, b: a, "int"), line + of(lambda n, a, b: b, "int")
        bits = {m: of(lambda n, a, b, k=k: 1 << (n % 62) if n // 62 == k else 0, "bigint") for k, m in enumerate(masks)}
        asks = of(lambda n, a, b: 1, "int").isNotNull()
        there = F.exists("around", lambda c: (c["at"] >= begin) & (c["at"] <= end) & reduce(or_, (c[m].bitwiseAND(v) != 0 for m, v in bits.items())))
        return F.when(asks, F.coalesce(there, F.lit(False)))

    judged = met.filter(F.coalesce(seen(near), F.lit(True)) & ~F.coalesce(seen(absent), F.lit(False)))
    return judged.select("file_id", "lang", "line_no", "rule_no", "code")


def label_masks(taint: DataFrame) -> DataFrame:
    """Labels of each variable as bits."""
    bit = None
    for name, value in LABEL_BITS.items():
        bit = F.when(F.col("label") == name, value) if bit is None else bit.when(F.col("label") == name, value)
    return taint.groupBy("file_id", "scope_id", "var").agg(F.bit_or(bit.otherwise(0)).alias("labels"))


def join_taint(
    hits: DataFrame, rules: Sequence[Rule], taint: DataFrame, sanitized: DataFrame | None = None,
    resolve: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``tainted``: does the hit line use a variable with a label its rule asks for?

    Hits with a scope_id look in that scope, others in the file's; ``resolve`` may put each used variable (file_id,
    scope_id, var) into the scope that owns it.

    Identifiers of the line meet tainted variables in an equi-join; variables cleared for
    the rule's category drop out; a source expression on the line itself counts as user.
    """
    ordered = sorted(rules, key=lambda r: r.rule_id)
    langs = sorted({r.lang for r in ordered if r.label})
    if not langs:
        return hits.withColumn("tainted", F.lit(False))
    wanted = F.expr(case_sql(
        "rule_no", {i: str(sum(LABEL_BITS[x] for x in r.label.split(","))) for i, r in enumerate(ordered) if r.label}, "0"))
    category = F.expr(case_sql("rule_no", {i: sql_text(r.category) for i, r in enumerate(ordered)}, "null"))
    lang, code = F.col("lang"), F.col("code")
    part = tx.right_hand_side(code)
    direct = tx.by_language(lang, lambda l: tx.matches(part, l.direct), langs)
    hits = hits.withColumn("wanted", wanted).withColumn(
        "direct", F.coalesce(direct, F.lit(False)) & (F.col("wanted").bitwiseAND(F.lit(1)) != 0)
    )
    names = tx.identifiers(part, lang, langs)
    if "php" in langs:
        names = F.when(lang == "php", F.array_append(names, F.lit("*"))).otherwise(names)
    uses = (
        hits.filter("wanted <> 0")
        .select("file_id", (F.col("scope_id") if "scope_id" in hits.columns else F.lit(0)).alias("scope_id"), "line_no", "rule_no", "wanted", F.explode(names).alias("var"))
    )
    uses = resolve(uses) if resolve else uses
    used = uses.join(by_key(label_masks(taint)), ["file_id", "scope_id", "var"]).filter("(wanted & labels) <> 0")
    if sanitized is not None:
        used = used.withColumn("category", category).join(by_key(sanitized), ["file_id", "scope_id", "var", "category"], "left_anti")
    flagged = used.select("file_id", "line_no", "rule_no").distinct().withColumn("flag", F.lit(True))
    return (
        hits.join(by_key(flagged), ["file_id", "line_no", "rule_no"], "left")
        .withColumn("tainted", F.coalesce("flag", F.lit(False)) | F.col("direct"))
        .drop("flag", "direct", "wanted")
    )


def grade(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Join the rule dimension and pick the grade; labelled rules without a plain grade drop
    untainted hits."""
    dim = F.broadcast(rule_table(hits.sparkSession, rules))
    strong = F.col("label").isNull() | F.col("tainted")
    return (
        hits.join(dim, "rule_no")
        .withColumn("severity", F.when(strong, F.col("severity_tainted")).otherwise(F.col("severity_plain")))
        .withColumn("confidence", F.when(strong, F.col("confidence_tainted")).otherwise(F.col("confidence_plain")))
        .filter("severity is not null")
        .select(
            "file_id", "lang", "line_no", "rule_id", "category", "severity", "confidence", "priority", "tainted",
            "vulnerability", "cwe_id", "remediation", "code",
        )
    )


def detect(
    lines: DataFrame, rules: Sequence[Rule], taint: DataFrame | None = None, sanitized: DataFrame | None = None
) -> DataFrame:
    """Graded hits of all rules, before suppression and de-duplication."""
    hits = match_rules(lines, rules)
    if taint is None:
        return grade(hits.withColumn("tainted", F.lit(False)), rules)
    # Hits are a small share of the lines and are read twice: scan and match only once.
    return grade(join_taint(cut(hits), rules, taint, sanitized), rules)
