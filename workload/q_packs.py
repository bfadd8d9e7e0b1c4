"""Detector packs: every rule of a language over all of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seepline.operators import findings as fnd
from seepline.plans import scan
from seepline.plans.durable import cut
from seepline.rules import rules_for

from . import sqlfacts as sf
from .corpus import LANGS, LINES_SQL
from .q_sources import lines
from .registry import query


_TAINT: dict[tuple, tuple[DataFrame, scan.Taint]] = {}


def language_taint(spark, d, lang) -> tuple[DataFrame, scan.Taint]:
    """Lines of a language's files and their taint, written once per session and read by all its packs."""
    key = (spark.sparkContext.applicationId, d, lang)
    if key not in _TAINT:
        written = cut(lines(spark, d, (lang,)))
        _TAINT[key] = written, scan.write_taint(scan.file_taint(written, [lang]))
    return _TAINT[key]


def _register(lang: str, category: str, rules) -> None:
    labelled = any(r.label for r in rules)

    def run(spark, d):
        read, taint = language_taint(spark, d, lang) if labelled else (lines(spark, d, (lang,)), None)
        return fnd.dedup_findings(fnd.suppress_inline(scan.scan_language(read, lang, rules, taint)))

    query(f"pack_{lang}_{category.lower()}", sf.pack_query(lang, rules, labelled))(run)


for _lang in LANGS:
    _rules = rules_for(_lang)
    for _category in sorted({r.category for r in _rules}):
        _register(_lang, _category, tuple(r for r in _rules if r.category == _category))


# Markup rules run over the pages, each with one of the rules' own samples appended.
from seepline.operators import detect as det, facts  # noqa: E402

from .corpus import pick, quote, samples, tables  # noqa: E402

MARKUP = rules_for("markup")
SAMPLES = samples("markup")
PAGES_SQL = f"""
 files as (select page_id as file_id, 'markup' as lang, html || chr(10) || [{",".join(quote(x) for x in SAMPLES)}][page_id % {len(SAMPLES)} + 1] as content from pages),""" + LINES_SQL


@query("pack_markup", sf.query([PAGES_SQL, sf.pack_hits("markup", MARKUP, False), sf.GRADED], "select * from best"))
def pack_markup(spark, d):
    content = F.concat("html", F.lit("\n"), F.expr(pick(SAMPLES, f"page_id % {len(SAMPLES)}")))
    pages = tables(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.lit("markup").alias("lang"), content.alias("content"))
    return fnd.dedup_findings(fnd.suppress_inline(det.detect(facts.explode_lines(pages), MARKUP)))
