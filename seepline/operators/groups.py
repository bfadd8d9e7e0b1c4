"""Closures of small groups in one row each.

Nearly all files are small, and what taint does in one scope of one file needs nothing from elsewhere. So all edges and seeds of a
group (a file's scope, and a label where edges have one) meet once, under one exchange, and a group of at most `IN_ROW` rows is closed in its own
row, however many hops that takes. A larger group is never gathered: of its rows only `IN_ROW` and one more are kept, its keys are
handed back, and the caller's hops over tables, which are dealt by the whole key, close it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a group that is closed in its own row; the work there grows with their square at most.
IN_ROW = 512


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out one time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gather(parts: dict[str, DataFrame], on: Sequence[str], needed: str) -> DataFrame:
    """One row for each group that has rows of the part `needed`: on, an array of structs by part, n (all of its rows).

    Arrays of groups of more than `IN_ROW` rows aren't whole. Rows with a null key belong to no group, as in a join.
    """
    columns = {name: [c for c in df.columns if c not in on] for name, df in parts.items()}
    both = None
    for name, df in parts.items():
        rows = df.select(*on, *(F.struct(*columns[name]).alias(name) if name == n else F.lit(None).cast(parts[n].select(F.struct(*columns[n]).alias("s")).schema["s"].dataType).alias(n) for n in parts))
        both = rows if both is None else both.unionByName(rows)
    group = Window.partitionBy(*on)
    here = both.filter(" and ".join(f"{c} is not null" for c in on)).withColumn("_nth", F.row_number().over(group.orderBy(*on)))
    kept = [F.collect_list(F.when(F.col("_nth") <= IN_ROW + 1, F.col(n))).alias(n) for n in parts]
    return here.groupBy(*on).agg(*kept, F.max("_nth").alias("n"), F.max(F.col(needed).isNotNull()).alias("_asks")).filter("_asks").drop("_asks")


def rounds(rows: Column, start: Column, step: Callable[[Column, Column], Column], most: int | None = None) -> Column:
    """What `step(state, round)` makes of start, as many times (at most `most`) as there are rows."""
    turns = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)))
    turns = turns if most is None else F.filter(turns, lambda h: h <= most)
    return F.aggregate(turns, start, step)


def firsts(found: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Of each run of equals in the sorted array the first."""
    return once(F.array_sort(found), lambda a: F.filter(a, lambda x, i: (i == 0) | ~same(x, F.get(a, i - 1))))
