"""Report sinks. Findings are written row by row; nothing is gathered in one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.findings import summarize_findings


def json_report(findings: DataFrame) -> DataFrame:
    """(section, json): one JSON row per finding and one per summary count."""
    rows = findings.select(F.lit("finding").alias("section"), F.to_json(F.struct(*sorted(findings.columns))).alias("json"))
    counts = summarize_findings(findings).select(
        F.lit("summary").alias("section"), F.to_json(F.struct("dimension", "value", "n")).alias("json")
    )
    return rows.unionByName(counts)


def write_json_report(findings: DataFrame, path: str) -> None:
    json_report(findings).write.mode("overwrite").partitionBy("section").text(path)


def text_report(findings: DataFrame) -> DataFrame:
    """One text line per finding."""
    return findings.select(
        "file_id", "line_no",
        F.format_string("%d:%d [%s/%s] %s (%s)", "file_id", "line_no", "severity", "confidence", "category", "rule_id").alias("text"),
    )


def write_text_report(findings: DataFrame, path: str) -> None:
    """Sorted text files: ranges of files, in file and line order inside each."""
    (
        text_report(findings).repartitionByRange("file_id", "line_no").sortWithinPartitions("file_id", "line_no")
        .select("text").write.mode("overwrite").text(path)
    )
