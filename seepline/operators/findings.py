"""Suppression, grading filters, de-duplication, summaries, ordering of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import frames, ranks


def suppress_inline(findings: DataFrame, keyword: str = "nosec") -> DataFrame:
    """Drop findings whose line carries the keyword in a comment of any language."""
    return findings.filter(~F.col("code").rlike(r"(?://|#|/\*|--|%)\s*" + keyword + r"\b") & ~F.col("code").rlike(r"\bscan:ignore\b"))


def min_severity(findings: DataFrame, level: str | None) -> DataFrame:
    if level is None:
        return findings
    return findings.filter(ranks.severity_rank(F.col("severity")) >= ranks.SEVERITY[level])


def min_confidence(findings: DataFrame, level: str | None = None, config: str | None = None) -> DataFrame:
    """Explicit level, else the configured one, else HIGH; the level ``ALL`` keeps everything."""
    level = level or config or "HIGH"
    if level == "ALL":
        return findings
    return findings.filter(ranks.confidence_rank(F.col("confidence")) >= ranks.CONFIDENCE[level])


def with_rank(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_rank", ranks.severity_rank(F.col("severity"))).withColumn(
        "confidence_rank", ranks.confidence_rank(F.col("confidence"))
    )


def dedup_findings(findings: DataFrame) -> DataFrame:
    """Best finding per (file, line, category): severity, confidence, priority, then rule id.

    An aggregate rather than a window: partial results combine before the shuffle, so
    many findings on one line cost one row per task. Only keys and grades travel.
    """
    order = F.struct(
        (-ranks.severity_rank(F.col("severity"))).alias("s"),
        (-ranks.confidence_rank(F.col("confidence"))).alias("c"),
        (-F.col("priority")).alias("p"),
        F.col("rule_id").alias("r"),
        "severity", "confidence",
    )
    return (
        findings.groupBy("file_id", "line_no", "category").agg(F.min(order).alias("best"))
        .select("file_id", "line_no", "category", F.col("best.severity").alias("severity"),
                F.col("best.confidence").alias("confidence"), F.col("best.r").alias("rule_id"))
    )


def summarize_findings(findings: DataFrame) -> DataFrame:
    """Counts by severity, by category and by confidence in one pass."""
    sets = findings.groupingSets([["severity"], ["category"], ["confidence"]], "severity", "category", "confidence")
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").otherwise("confidence").alias("dimension"),
        F.coalesce("severity", "category", "confidence").alias("value"),
        "n",
    )


def findings_per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_id").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line"),
        F.max(ranks.severity_rank(F.col("severity"))).alias("worst"),
    )


def severity_gate(findings: DataFrame, by: str) -> DataFrame:
    """Does a repository fail: any CRITICAL or HIGH finding?"""
    return findings.groupBy(by).agg((F.count_if(F.col("severity").isin("CRITICAL", "HIGH")) > 0).alias("failed"))


def scan_statistics(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files scanned, files without readable text, findings: two aggregates of one row each, added up."""
    zero = F.lit(0).cast("long")
    scanned = files.agg(
        F.count("*").alias("files_scanned"),
        F.count_if(F.col("content").isNull() | (F.length("content") == 0)).alias("unreadable"),
    ).withColumn("total_findings", zero)
    found = findings.agg(F.count("*").alias("total_findings")).select(zero.alias("files_scanned"), zero.alias("unreadable"), "total_findings")
    return scanned.unionByName(found).agg(*(F.sum(c).alias(c) for c in scanned.columns))


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file_id", "line_no", "category")


def top_categories(findings: DataFrame, k: int | None = None) -> DataFrame:
    out = findings.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
    return out if k is None else out.limit(k)


def truncate_code(code: Column, width: int = 100) -> Column:
    return F.substring(F.trim(code), 1, width)


def code_snippet(lines: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Lines around each line, joined; the frame bounds the list."""
    around = frames.framed(lines, ["file_id"], "line_no", {"around": (F.collect_list("text"), -before, after)})
    return around.withColumn("snippet", F.array_join("around", "\n")).drop("around")


def file_profile(lines: DataFrame) -> DataFrame:
    """Line statistics per file; plain partial aggregation."""
    length = F.length("text")
    return lines.groupBy("file_id").agg(
        F.count("*").alias("n_lines"),
        F.sum(length).alias("total_length"),
        F.avg(length).alias("avg_length"),
        F.max(length).alias("max_length"),
        F.sum(length - F.length(F.replace("text", F.lit(";"), F.lit("")))).alias("semicolons"),
    )


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def taint_chain(taint: DataFrame) -> DataFrame:
    """Readable origin of each tainted variable."""
    return taint.withColumn("chain", F.format_string("%s <- %s source (line %d)", "var", "label", "origin_line"))


def message() -> Column:
    """Message of a finding from its rule and place."""
    return F.format_string("%s [%s] at line %d", "vulnerability", "category", "line_no")


# Identifier shapes that hint at secrets and at table names.
SECRET_NAME = r"(?i)passw(?:or)?d|secret|token|api_?key|credential"
TABLE_NAME = r"(?i)table|tbl|entity"


def named(df: DataFrame, col: str = "name") -> DataFrame:
    """Rows whose identifier looks like a secret or a table name."""
    return df.filter(F.col(col).rlike(SECRET_NAME) | F.col(col).rlike(TABLE_NAME))


def block_depth(lines: DataFrame) -> DataFrame:
    """Open braces up to and including each line."""
    delta = F.length(F.regexp_replace("text", r"[^{]", "")) - F.length(F.regexp_replace("text", r"[^}]", ""))
    return frames.running_sum(lines, ["file_id"], "line_no", delta, "depth")
