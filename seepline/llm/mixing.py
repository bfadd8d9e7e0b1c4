"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations alone.

Each source is a queue: its documents in a shuffled order that only their ids and a seed decide, `most`
times over. A document's virtual finish time is the number of words its source has served when it is
through, divided by the source's weight. All queues together are range-sorted by that time and cut
where the running total reaches the budget, so every source advances in proportion to its weight, and
one that runs dry leaves its share to the others.

No task holds a source: running sums are taken inside parts of the shuffled order and cells of virtual
time, and completed with what earlier parts and cells hold. Only the table of sources is ordered whole.

Null text has size 0; null source is a source of its own, the last. Documents without words take no part
in the queue and are returned with 0. Rows with equal ids keep apart; rows equal in everything may
swap places, which no result shows. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: Hexadecimal digits of the shuffled order that name a part, and cells for each doubling of virtual time.
DIGITS, CELLS = 3, 8192
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """sizes: none, name, source_size. Adds weight, budget and target: `share` of all words dealt by weight, none above `most` times its size."""
    place = F.row_number().over(Window.orderBy("none", "name")) - 1
    given = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    whole = Window.partitionBy(F.lit(0))
    fill = Window.orderBy("full", "none", "name")
    dealt = (
        given.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("full", F.col("cap") / F.col("weight"))
        .withColumn("before", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    )
    level = F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True)
    stop = level.over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * stop, F.col("cap").cast("double")))
    return dealt.select("none", "name", "source_size", "weight", "budget", target.alias("target"))


def queue(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = "",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mixed stream, one row per document and round (documents without words: one row).

    doc_id, source, key (a hash of the text), part and place (which tell rows apart), size, source_size, weight,
    target, round, finish (virtual time), begin (words of the stream before it), taken (words of it within the budget).
    """
    shown = F.col(doc_id).cast("string")
    narrow = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.col(source).isNull().alias("none"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
            words(F.col(text)).alias("size"),
            F.xxhash64(F.col(text).cast("string")).alias("key"),
            F.md5(F.concat(F.lit(seed), F.coalesce(shown, F.lit("null")))).alias("turn"),
        ).withColumn("part", F.substring("turn", 1, DIGITS)),
        "mix",
    )
    parts = narrow.groupBy("none", "name", "part").agg(F.sum("size").alias("part_size"))
    inner = Window.partitionBy("none", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = parts.withColumn("part_start", F.sum("part_size").over(inner) - F.col("part_size")).drop("part_size")
    targets = _targets(parts.groupBy("none", "name").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    own = Window.partitionBy("none", "name", "part").orderBy("turn", "doc_id", "size", "key")
    served = (
        narrow.join(starts.join(targets, ["none", "name"]), ["none", "name", "part"])
        .withColumn("place", F.row_number().over(own))
        .withColumn("served", F.col("part_start") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    )
    rounds = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(most - 1))).otherwise(F.array(F.lit(0)))
    queued = served.withColumn("round", F.explode(rounds)).withColumn(
        "finish", (F.col("served") + F.col("source_size") * F.col("round")) / F.col("weight")
    )
    cell = F.floor(F.log2("finish") * CELLS)
    queued = queued.withColumn("cell", F.when(F.col("size") > 0, cell).otherwise(-(1 << 40) - F.conv(F.col("part"), 16, 10).cast("long")))
    cells = queued.groupBy("cell").agg(F.sum("size").alias("cell_size"), F.max("budget").alias("cell_budget"))
    coarse = F.floor(F.col("cell") / 512)
    upper = cells.groupBy(coarse.alias("coarse")).agg(F.sum("cell_size").alias("coarse_size"))
    upto = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, 0)
    upper = upper.withColumn("coarse_start", F.sum("coarse_size").over(upto) - F.col("coarse_size")).drop("coarse_size")
    within = Window.partitionBy("coarse").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        cells.withColumn("coarse", coarse)
        .join(upper, "coarse")
        .withColumn("cell_start", F.col("coarse_start") + F.sum("cell_size").over(within) - F.col("cell_size"))
        .select("cell", "cell_start")
    )
    order = Window.partitionBy("cell").orderBy("finish", "none", "name", "turn", "doc_id", "size", "key", "round")
    begin = F.col("cell_start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    left = F.floor("budget") - F.col("begin")
    return (
        queued.join(cells, "cell")
        .withColumn("begin", begin)
        .withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
        .select("doc_id", "source", "key", "part", "place", "size", "source_size", "weight", "target", "round", "finish", "begin", "taken")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, key, size, source_size, target, copies (rounds that the budget reaches), taken (words)."""
    same = ["doc_id", "source", "key", "part", "place", "size", "source_size", "target"]
    reached = F.sum((F.col("taken") > 0).cast("int"))
    return queue(docs, **how).groupBy(*same).agg(reached.alias("copies"), F.sum("taken").alias("taken")).drop("part", "place")


SQL = r"""
with d as (
  select doc_id, source, source is null as none, coalesce(source, '') as name,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, 'null')) as turn
  from documents),
s as (select none, name, sum(size)::bigint as source_size from d group by all),
w as (select *, [5, 2, 1][((row_number() over (order by none, name) - 1) % 3 + 1)::int] as weight from s),
c as (select *, (sum(source_size) over ())::double * 1.5 as budget, source_size * 2 as cap, source_size * 2 / weight::double as filled from w),
l as (select *, (budget - (sum(cap) over up - cap)::double) / (sum(weight) over down)::double as level from c
      window up as (order by filled, none, name rows unbounded preceding),
             down as (order by filled, none, name rows between current row and unbounded following)),
t as (select *, least(cap::double, coalesce(weight * (select arg_min(level, (filled, none, name)) from l where level <= filled), cap::double)) as target from l),
q as (select d.*, t.source_size, t.weight, t.budget, t.target,
             sum(size) over (partition by d.none, d.name order by turn, doc_id rows unbounded preceding) as served
      from d join t on d.none = t.none and d.name = t.name),
r as (select *, round, ((served + source_size * round)::double / weight) as finish from q, (values (0), (1)) v(round) where size > 0),
g as (select *, sum(size) over (order by finish, none, name, turn, doc_id, round rows unbounded preceding) - size as start from r),
k as (select doc_id, sum(greatest(0, least(size, floor(budget) - start)))::bigint as taken from g group by doc_id)
select q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::bigint as taken from q left join k on q.doc_id = k.doc_id
"""
