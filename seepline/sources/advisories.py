"""Dependency-audit documents to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SCHEMA = "map<string,struct<severity:string,`range`:string,fixAvailable:string,via:array<string>>>"


def flatten_advisories(reports: DataFrame, key: str, doc: str) -> DataFrame:
    """One finding per package; ``via`` entries that are plain names carry no text."""
    info = F.col("info")
    via = F.transform(F.coalesce(info["via"], F.array().cast("array<string>")), lambda v: F.from_json(v, "title string, url string"))
    texts = F.flatten(F.transform(via, lambda v: F.array(v["title"], v["url"])))
    fix = F.coalesce(info["fixAvailable"], F.lit("false")) != "false"
    version = F.coalesce(info["range"], F.lit("unknown"))
    level = F.coalesce(info["severity"], F.lit("low"))
    return (
        reports.select(key, F.explode(F.from_json(F.get_json_object(doc, "$.vulnerabilities"), SCHEMA)).alias("package", "info"))
        .select(
            key, "package",
            F.when(level == "critical", "CRITICAL").when(level == "high", "HIGH").when(level == "moderate", "MEDIUM").otherwise("LOW").alias("severity"),
            F.lit("HIGH").alias("confidence"),
            F.lit("VULNERABLE_DEPENDENCY").alias("category"),
            F.concat_ws(
                "; ", F.filter(texts, lambda t: t.isNotNull() & (t != "")),
                F.when(fix, "Fix available: yes").otherwise("Fix available: no"), F.concat(F.lit("Affected range: "), version),
            ).alias("description"),
        )
    )
