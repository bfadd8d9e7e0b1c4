"""Windows over line positions that never put a whole file in one task.

Positions are cut in blocks. A bounded frame is evaluated inside a block that also
received the few rows just outside its borders; a running value is evaluated inside a
block and completed with what the earlier blocks of the same key left behind. Both are
exact. A window is therefore partitioned by (key, block), so a file that holds a large
share of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.durable import cut

BLOCK = 4096


def _block(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def _one_block(rows: DataFrame) -> bool:
    """Do all rows of a written table lie in one block of positions? Then no block leaves anything to another."""
    ends = rows.agg(F.min("_block").alias("a"), F.max("_block").alias("b")).first()
    return ends["a"] == ends["b"]


def framed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    aggregates: Mapping[str, tuple[Column, int, int]],
    block: int = BLOCK,
) -> DataFrame:
    """Add aggregates over the rows whose position lies within [pos+lo, pos+hi]."""
    lo = min(a[1] for a in aggregates.values())
    hi = max(a[2] for a in aggregates.values())
    p = F.col(pos)
    home = _block(p, block)
    seen_from = F.array_distinct(
        F.concat(
            F.array(home),
            F.sequence(_block(p - F.lit(max(hi, 0)), block), _block(p - F.lit(min(lo, 0)), block)),
        )
    )
    rows = df.withColumn("_home", home).withColumn("_block", F.explode(seen_from))
    base = Window.partitionBy(*keys, "_block").orderBy(pos)
    cols = [agg.over(base.rangeBetween(a, b)).alias(name) for name, (agg, a, b) in aggregates.items()]
    return rows.select("*", *cols).filter("_block = _home").drop("_block", "_home")


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: Column,
    out: str,
    tie: Sequence[str] = (),
    inclusive: bool = True,
    block: int = BLOCK,
    written: bool = False,
) -> DataFrame:
    """Last non-null value at or before (``inclusive``) or strictly before each row.

    ``tie`` orders rows that share a position; a strict lookup skips the whole position. The rows are written once, as
    what the blocks leave behind is read from them again, unless they are ``written`` tables as they are.
    """
    keys = list(keys)
    rows = df.withColumn("_value", value).withColumn("_block", _block(F.col(pos), block))
    rows = rows if written else cut(rows)
    w = Window.partitionBy(*keys, "_block")
    if inclusive:
        within = w.orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, 0)
        local = F.last("_value", ignorenulls=True).over(within)
    else:
        within = w.orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
        local = F.last("_value", ignorenulls=True).over(within)
    if _one_block(rows):
        return rows.withColumn(out, local).drop("_value", "_block")
    # What earlier blocks of the key leave behind. Only rows with a value and rows beyond
    # the first block take part; both conditions are pushed below whatever made the rows.
    last = F.max_by("_value", F.struct(pos, *tie))
    ends = rows.filter("_value is not null").groupBy(*keys, "_block").agg(last.alias("_end"))
    later = rows.filter(F.col(pos) >= block).select(*keys, "_block").distinct()
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        later.join(ends, [*keys, "_block"], "full")
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
        .filter("_block > 0 and _carry is not null")
        .drop("_end")
    )
    return (
        rows.withColumn("_local", local)
        .join(carried, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_value", "_block", "_local", "_carry")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, block: int = BLOCK, written: bool = False
) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including each row; the rows are written once, unless they are ``written``."""
    keys = list(keys)
    rows = df.withColumn("_value", value).withColumn("_block", _block(F.col(pos), block))
    rows = rows if written else cut(rows)
    within = Window.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(Window.unboundedPreceding, 0)
    if _one_block(rows):
        return rows.withColumn(out, F.sum("_value").over(within)).drop("_value", "_block")
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        totals.withColumn("_carry", F.sum("_sum").over(before)).filter("_block > 0").drop("_sum")
    )
    return (
        rows.withColumn("_local", F.sum("_value").over(within))
        .join(carried, [*keys, "_block"], "left")
        .withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .drop("_value", "_block", "_local", "_carry")
    )
