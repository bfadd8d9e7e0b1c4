"""Exact top-k search: exhaustive term-at-a-time accumulation.

A dimension is a term. In a block of candidates it has postings, the candidates with another value than 0
there; a query row scatters its weight times those values into a dense array of scores, term after term.
Each block gives a query's k best by partition selection, and a last step merges the blocks.

Blocks of queries meet blocks of candidates; nothing is held whole by a task or sent to all of them.
Vectors that are null, hold null, NaN or infinite components (also once scaled), or have a null id take no
part. Vectors of unequal length are compared over the places that both have. A query's candidates are the
rows with another id, equal ones too, each taking a place of its own (they travel as one with a count). Equal query rows
(id and scaled vector) are one query; rows with one id and unequal vectors are queries of their own. Ties go to smaller ids.
Scores are exact; those beyond 64 bits are returned as the last number of that range. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import free_name
from .store import Written

#: Bytes of a block's vectors, least rows of one, queries scored together.
BYTES, ROWS, AT_ONCE = 16 << 20, 512, 64


def scaled(vectors: DataFrame, scale: float, vec_id: str, vector: str, *more: str) -> DataFrame:
    """id, v and more columns: the rows that take part, each component floor(scale * x) as a double (no negative zero)."""
    v = F.col(vector).cast("array<double>")
    big = F.lit(float("inf"))
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < big))
    floor = F.transform(v, lambda x: (x * scale) - F.pmod(x * scale, F.lit(1.0)) + F.lit(0.0))
    return vectors.where(F.col(vec_id).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), floor.alias("v"), *more)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims))
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
    return out


def _longest(column: pa.ChunkedArray) -> int:
    return max((len(x) for x in column), default=0)


def accumulate(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Scores (candidates x queries) by scattering each query's weights over the postings of each term."""
    scores = np.zeros((len(values), len(weights)), weights.dtype)
    for term in range(weights.shape[1]):
        at = np.flatnonzero(values[:, term])
        if not len(at) or not weights[:, term].any():
            continue
        product = values[at, term][:, None] * weights[:, term][None, :]
        if len(at) == len(values):
            scores += product
        else:
            scores[at] += product
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the front, in order. scores: one query's, masked where none."""
    there = np.flatnonzero(~np.ma.getmaskarray(scores))
    values = scores.data[there]
    if len(values) > k:
        least = np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]
        over = np.flatnonzero(values > least)
        there = there[np.sort(np.concatenate([over, np.flatnonzero(values == least)[: k - len(over)]]))]
        values = scores.data[there]
    return there[np.argsort(-values, kind="stable")]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest integer inner products."""
    given = vectors.withColumn(flag := free_name(vectors, "asks"), F.coalesce(is_query, F.lit(False)))
    rows = scaled(given, scale, vec_id, vector, flag).groupBy("id", "v").agg(F.count("*").alias("copies"), F.max(flag).alias("asks"))
    rows = Written(rows.withColumn("key", F.xxhash64("id", "v")), "vectors").df
    sizes = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n, asking, width = int(sizes[0]), int(sizes[1]), max(1, int(sizes[2])) * 8
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n * width // BYTES), min(tasks, -(-n // ROWS)), 1)
    query_blocks = max(-(-asking * width // BYTES), 1)
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    places = F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int")))
    here = rows.withColumn("place", places).select("id", "v", F.pmod("key", F.lit(blocks)).alias("block")).withColumn("query_block", numbers(query_blocks))
    here = here.toDF(*here.columns)  # both sides come from one table
    there = rows.where("asks").select("id", "key", "v", F.pmod("key", F.lit(query_blocks)).alias("query_block")).withColumn("block", numbers(blocks))

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, query_ids, keys = rows.column("id").to_numpy(), asked.column("id").to_numpy(), asked.column("key").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        dims = max(_longest(rows.column("v")), _longest(asked.column("v")))
        values, weights = _matrix(rows.column("v"), dims)[order], _matrix(asked.column("v"), dims)
        exact = np.abs(values).max(initial=0) * np.abs(weights).max(initial=0) * max(dims, 1) < 2.0**62
        kind = np.vectorize(int, otypes=[object]) if not exact and dims else (lambda x: x.astype(np.int64))
        values, weights = kind(values), kind(weights)
        out = {"query_id": [], "key": [], "vec_id": [], "score": []}
        for a in range(0, len(weights), AT_ONCE):
            scores = accumulate(weights[a : a + AT_ONCE], values)
            for j, (q, key) in enumerate(zip(query_ids[a : a + AT_ONCE], keys[a : a + AT_ONCE], strict=True)):
                won = best(np.ma.masked_array(scores[:, j], ids == q), k)
                out["query_id"].append(np.full(len(won), q))
                out["key"].append(np.full(len(won), key))
                out["vec_id"].append(ids[won])
                out["score"].append(np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores[won, j].tolist()], np.int64))
        none = np.zeros(0, np.int64)
        return pa.table({n: pa.array(np.concatenate([none, *x]), pa.int64()) for n, x in out.items()})

    found = (
        there.groupBy("query_block", "block")
        .cogroup(here.groupBy("query_block", "block"))
        .applyInArrow(search, "query_id long, key long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
  where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select *, row_number() over () as query from (select distinct vec_id, e from v where vec_id % 50 = 0)),
s as (
  select query, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from q join v c on q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
