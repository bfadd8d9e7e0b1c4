"""Whole ways of taint against a walk from key to key."""

from seepline.operators import taint as tnt


def table(spark, seeds, edges):
    s = spark.createDataFrame([(1, 0, v, "user", n) for v, n in seeds], "file_id long, scope_id int, var string, label string, line_no int")
    e = spark.createDataFrame([(1, 0, a, b, "user", 1) for a, b in edges], "file_id long, scope_id int, src string, dst string, label string, line_no int")
    return s, e


def chains(spark, seeds, edges):
    s, e = table(spark, seeds, edges)
    return {r["var"]: (r.chain, r.origin_line) for r in tnt.chains(tnt.propagate(s, e), e).collect()}


def test_long_ways_come_whole(spark):
    edges = [(f"v{k}", f"v{k + 1}") for k in range(21)]
    got = chains(spark, [("v0", 7)], edges)
    assert got == {f"v{k}": ([f"v{j}" for j in range(k + 1)], 7) for k in range(22)}


def test_shortest_way_and_least_predecessor(spark):
    edges = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"), ("a", "x"), ("x", "d"), ("d", "a"), ("q", "r")]
    got = chains(spark, [("a", 1), ("b", 2)], edges)
    assert got["d"][0] == ["a", "c", "d"] and got["c"][0] == ["a", "c"] and got["a"][0] == ["a"] and "r" not in got


def test_no_seeds(spark):
    assert chains(spark, [], [("a", "b")]) == {}
