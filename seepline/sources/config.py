"""Rule configuration: documents to rule rows, and the configuration that governs a file."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = (
    "sources map<string,array<string>>, sinks map<string,map<string,array<string>>>,"
    " sanitizers map<string,map<string,array<string>>>, exclude_paths array<string>,"
    " suppression_keyword string, min_confidence string"
)


def read_config(path: str) -> str:
    """One configuration file as a JSON document; YAML needs the yaml module."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        import yaml

        return json.dumps(yaml.safe_load(text) or {})


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows of one (small) configuration file."""
    return config_rules(spark.createDataFrame([("", read_config(path))], "dir string, doc string"))


def parse_configs(docs: DataFrame) -> DataFrame:
    """(dir, doc) to one row of settings; malformed sections become null, with defaults."""
    return docs.select("dir", F.from_json("doc", SCHEMA).alias("c")).select(
        "dir", "c.sources", "c.sinks", "c.sanitizers", "c.exclude_paths",
        F.coalesce("c.suppression_keyword", F.lit("nosec")).alias("suppression_keyword"),
        F.coalesce("c.min_confidence", F.lit("HIGH")).alias("min_confidence"),
    )


def config_rules(docs: DataFrame) -> DataFrame:
    """Configuration documents to rows (dir, kind, lang, category, pattern)."""
    conf = parse_configs(docs)
    flat = conf.select("dir", F.lit("source").alias("kind"), F.explode("sources").alias("lang", "items")).select(
        "dir", "kind", "lang", F.lit(None).cast("string").alias("category"), F.explode("items").alias("pattern")
    )
    for kind in ("sink", "sanitizer"):
        flat = flat.unionByName(
            conf.select("dir", F.lit(kind).alias("kind"), F.explode(kind + "s").alias("lang", "by"))
            .select("dir", "kind", "lang", F.explode("by").alias("category", "items"))
            .select("dir", "kind", "lang", "category", F.explode("items").alias("pattern"))
        )
    return flat


def union_rules(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in and custom rows, each once."""
    return builtin.unionByName(custom).dropDuplicates()


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Nearest ancestor directory with a configuration, per file: (file_id, dir).

    Resolved once per distinct folder, so that the files of a repository don't meet in the key of its root.
    """
    placed = files.select("file_id", F.regexp_extract("path", "^(.*)/", 1).alias("folder")).filter("folder <> ''")
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nearest = (
        placed.select("folder").distinct().select("folder", F.posexplode(ancestors).alias("depth", "dir"))
        .join(configs.select("dir").distinct(), "dir")
        .groupBy("folder").agg(F.max_by("dir", "depth").alias("dir"))
    )
    return placed.join(nearest, "folder").select("file_id", "dir")
