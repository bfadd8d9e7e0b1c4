"""Importance resampling towards a target distribution: hashed bags of word runs, by length-bucketed CRC matrices.

A feature, a run of consecutive words, falls into the bucket of its CRC. For a slice of texts, the distinct features are
grouped by their length in bytes; those of one length form a two-dimensional array of bytes, all of whose CRCs advance
together, column by column, and the buckets are scattered back to where the features stand. A feature longer than LONG
bytes, of which few share a length, has its CRC taken by itself.

Tasks add up the features of each bucket over all whole texts, of the corpus and of the target texts; only these sums, one
number a bucket, come to the driver. From them each bucket has a gain, a document the mean gain of its features, rounded
down, and a score that adds Gumbel noise from a hash of its id, so that the highest scores are a draw without replacement.
Ranks are given along one global sort in ranges; no task holds more than its range.

Null and empty texts have no features, weight 0, and count as documents of no words. A null id draws its noise from the
seed and an empty id, and stands after all other ids among ties. Repeated rows are documents of their own: equal
in weight and score, they take consecutive ranks. Texts of any length are read whole, a long one by itself. Other columns
aren't read. An empty table gives no rows; without target texts the target's counts are all 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import range_hashes
from .rows import slices
from .store import Written
from .wordspans import ALPHANUMERIC, encoded, words

LONG = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    """What the CRC of the polynomial 0xEDB88320 becomes by each byte value."""
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & 1, np.uint32(0xEDB88320) ^ (at >> 1), at >> 1).astype(np.uint32)
    return at


_TABLE = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[s:e] for each range."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    out = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return out
    sizes, first = np.unique(lengths[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        if size > LONG:
            whole = [zlib.crc32(data[starts[k] : ends[k]]) for k in rows]
            out[rows] = whole
            continue
        matrix = data[starts[rows][None, :] + np.arange(size)[:, None]]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def features(texts: list[str], runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, text by text; the number of features and of words of each text."""
    data, edges = encoded(texts)
    data = _LOWER[data]
    starts, ends, first = words(data, edges, ALPHANUMERIC)
    # the words of all texts again, with one blank after each
    lengths = ends - starts
    to = np.cumsum(lengths + 1)
    at = to - lengths - 1
    joined = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[to - 1] = False
    joined[inside] = data[ALPHANUMERIC[data]]
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(texts)), n_words)
    parts = []
    for k in range(runs):
        begin = np.flatnonzero(text[k:] == text[: len(text) - k]) if k else np.arange(len(text))
        parts.append((begin, begin + k))
    head, tail = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(head, kind="stable")
    head, tail = head[order], tail[order]
    a, b = at[head], to[tail] - 1
    _, one, back = np.unique(range_hashes(joined, a, b), return_index=True, return_inverse=True)
    bucket = (crc32s(joined, a[one], b[one]) % np.uint32(buckets)).astype(np.int64)[back]
    return bucket, np.bincount(text[head], minlength=len(texts)), n_words


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            given = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(given):
                total += np.bincount(features(given[a:b], runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths by which a bucket is likelier in the target, smoothed by one for each bucket, rounded down."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(given):
                bucket, n, n_words = features(given[a:b], runs, len(gain))
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                end = np.cumsum(n)
                weight = (total[end] - total[end - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with `name`, the place of each in the given order, from 1: places in a range of the global sort, after all that earlier ranges hold."""
    placed = Written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked").df
    part = F.shiftright("_at", 33)
    ranges = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each range, so as many as the sort has partitions
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside + 1).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = 10_000, seed: str = "2024", doc_id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (of those drawn: percent of the documents of at least `least_words` words; else null)."""
    gain = gains(bucket_counts(docs, runs, buckets, text), bucket_counts(target, runs, buckets, target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = Written(weigh(docs, gain, runs, doc_id, text).withColumn("score", F.col("weight") + noise), "scored").df
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    own = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    own = own.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return own.unionByName(rest)


#: The CRC of each distinct word is folded byte by byte over a table that is made by the same eight steps.
SQL = r"""
with recursive steps as (
  select i::bigint as byte, i::bigint as c, 0 as k from range(256) r(i)
  union all select byte, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from steps where k < 8),
crc_table as (select list(c order by byte) as t from steps where k = 8),
texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
target as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
corpus as (select doc_id, unnest(words) as w from texts),
distinct_words as (select w from corpus union select w from target),
folded as (
  select w, 0 as k, 4294967295::bigint as c, hex(encode(w)) as h from distinct_words
  union all
  select w, k + 1, xor(t[(xor(c & 255, (position(h[2 * k + 1] in '0123456789ABCDEF') - 1) * 16 + position(h[2 * k + 2] in '0123456789ABCDEF') - 1))::bigint + 1], c >> 8), h
  from folded, crc_table where 2 * k < length(h)),
buckets as (select w, xor(c, 4294967295) % 10000 as b from folded where 2 * k = length(h)),
s as (select b, count(*) as s from corpus join buckets using (w) group by b),
t as (select b, count(*) as t from target join buckets using (w) group by b),
totals as (select (select count(*) from corpus)::double as s_all, (select count(*) from target)::double as t_all),
gains as (
  select i as b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((coalesce(s, 0) + 1)::double * (t_all + 10000))))::bigint as gain
  from range(10000) r(i) left join s on s.b = i left join t on t.b = i, totals),
weights as (select doc_id, count(*) as n, floor(sum(gain) / count(*)::double)::bigint as weight from corpus join buckets using (w) join gains using (b) group by doc_id),
scored as (
  select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((list_sum([(position(c in '0123456789abcdef') - 1) * 16 ** (8 - i) for c, i in string_split(left(sha256('2024:' || doc_id), 8), '')]) + 0.5) / 4294967296)))::bigint as score
  from texts left join weights using (doc_id)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= n * 10 // 100 then place end as rank from placed
"""
