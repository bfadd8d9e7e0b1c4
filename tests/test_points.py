"""Points and assignments over code lines that were written once."""

from collections import Counter

from workload import q_joins
from workload.q_sources import code

SF = "/root/testdata/sf0.001"


def test_points_of_written_lines(spark):
    want = q_joins.points(spark, SF)
    got = q_joins.points(spark, SF, of=q_joins.cut(code(spark, SF)))
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
