"""Discovery, decoding and selection of source files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..rules.languages import EXTENSIONS

# Directories and file names that hold third-party or generated code.
EXCLUDED_DIRS = (
    "node_modules", ".git", "__pycache__", "venv", "env", ".venv", "vendor", "dist", "build", ".tox",
    ".pytest_cache", "site-packages", ".eggs", ".egg-info", "htmlcov", ".mypy_cache", "bower_components",
    "jspm_packages", ".nuget", "packages", "lib", "libs", "third_party", "third-party", "external", "externals",
    ".bundle", "Pods",
)
VENDOR_NAMES = (
    ".min.js", ".min.css", ".bundle.js", ".chunk.js", "-min.js", "-min.css", ".prod.js", ".production.js",
    "jquery", "bootstrap", "angular", "react", "vue", "ember", "backbone", "lodash", "underscore", "moment", "axios",
    "popper", "d3", "chart", "highcharts", "three", "socket.io", "knockout", "polymer", "mootools", "prototype",
    "dojo", "ext-all", "sencha", "kendo", "telerik", "tinymce", "ckeditor", "codemirror", "ace-builds",
    "select2", "chosen", "datatables", "fullcalendar", "sweetalert", "toastr", "bootbox", "magnific-popup",
    "slick", "owl.carousel", "swiper", "photoswipe", "leaflet", "mapbox", "google-maps", "openlayers",
    "hammer", "modernizr", "respond", "html5shiv", "normalize.css", "reset.css", "sanitize.css",
    "fontawesome", "font-awesome", "ionicons", "material-icons", "glyphicons", "feather", "bootstrap-icons",
    "polyfill", "core-js", "babel-polyfill", "es5-shim", "es6-shim", "webpack-runtime", "runtime~", "vendors~", "vendor.",
)


def read_files(spark: SparkSession, root: str, extensions: Iterable[str] = tuple(EXTENSIONS)) -> DataFrame:
    """(path, length, bytes) of every file below ``root`` with one of the extensions.

    The glob prunes the listing; ``bytes`` is read only by plans that use it.
    """
    glob = "{" + ",".join("*" + e for e in extensions) + "}"
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(root).select("path", "length", F.col("content").alias("bytes"))
    )


def with_file_id(files: DataFrame) -> DataFrame:
    """Stable 64-bit id of the path."""
    return files.withColumn("file_id", F.xxhash64("path"))


def decode_content(df: DataFrame, col: str = "bytes") -> DataFrame:
    """Bytes to text: UTF-8 where valid, ISO-8859-1 otherwise, with a flag."""
    valid = F.is_valid_utf8(F.col(col).cast("string"))
    return df.withColumn("utf8", valid).withColumn(
        "content", F.when(F.col("utf8"), F.decode(col, "UTF-8")).otherwise(F.decode(col, "ISO-8859-1"))
    ).drop(col)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.\w+)$", 1))


def with_language(files: DataFrame) -> DataFrame:
    """Keep files of known extensions and add their language family."""
    dim = files.sparkSession.createDataFrame(list(EXTENSIONS.items()), "ext string, lang string")
    return files.drop("lang").withColumn("ext", extension(F.col("path"))).join(F.broadcast(dim), "ext")


def exclude_dirs(files: DataFrame, names: Sequence[str] = EXCLUDED_DIRS, substring: bool = False) -> DataFrame:
    """Drop files below an excluded directory; ``substring`` also drops partial names."""
    parts = F.split("path", "/")
    if substring:
        pattern = "|".join(re.escape(n) for n in names)
        return files.filter(~F.exists(parts, lambda p: p.rlike(pattern)))
    return files.filter(~F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names])))


def exclude_vendor(files: DataFrame, names: Sequence[str] = VENDOR_NAMES) -> DataFrame:
    """Drop minified, bundled and well-known library files by name."""
    pattern = "|".join(re.escape(n) for n in names)
    return files.filter(~F.lower(F.substring_index("path", "/", -1)).rlike(pattern))


def glob_pattern(glob: str) -> str:
    """Shell glob to a regular expression over the whole path."""
    out = ""
    for part in re.split(r"(\*|\?|\[[^\]]+\])", glob):
        out += {"*": "(?s:.*)", "?": "."}.get(part) or ("[" + part[1:-1].replace("!", "^", 1) + "]" if part[:1] == "[" and len(part) > 2 else re.escape(part))
    return f"^{out}$"


def exclude_globs(files: DataFrame, globs: Sequence[str]) -> DataFrame:
    """Drop paths that match a glob; ``name/`` also drops any path below such a directory."""
    out = files
    for g in globs:
        out = out.filter(~F.col("path").rlike(glob_pattern(g)))
        if g.endswith("/"):
            out = out.filter(~F.array_contains(F.split("path", "/"), g.rstrip("/")))
    return out


def drop_unreadable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("content").isNotNull() & (F.length("content") > 0))
