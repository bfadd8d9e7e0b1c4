"""The flagship over all languages."""

import __spark_entry__ as contract
from seepline.operators import facts, findings as fnd
from seepline.plans import scan
from workload.corpus import LANGS, files


def test_entry_counts_findings_of_all_languages(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    lines = facts.explode_lines(files(spark, contract.SMOKE_DIR))
    own = {l: fnd.dedup_findings(fnd.suppress_inline(scan.scan_language(lines, l))).count() for l in LANGS}
    assert min(own.values()) > 0
    for dimension in ("severity", "category", "confidence"):
        assert sum(r.n for r in contract.entry(spark).where(f"dimension = '{dimension}'").collect()) == sum(own.values())
