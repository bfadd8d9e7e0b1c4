"""Substring dedup by difference-cover anchors.

A passage is removed where a window of `least` consecutive words stands in the corpus before. Words are hashed by anchors:
runs of w words that begin at a place whose remainder by a period lies in a difference cover of that period. For any two
places there is a shift, smaller than the period, after which both stand in the cover; so with w = least - period + 1, two
equal windows share an anchor at the same distance from their beginnings.

Anchors that occur once are dropped. One that occurs again is extended by all words that a window around it may take:
occurrences with equal surroundings are a class, of which all but the first have only windows that stand before.
Where an anchor has several classes, the first of each extends to its windows, and equal windows are brought
together by their own hashes: all but the first are repeats. Nothing is paired: a group, however large, is known by its
first occurrence, found by partial aggregation, and joined back to its members. Windows are told apart by 128 bits.

Order is that of the ids, null last, then of a hash of the text, then of places. Rows with equal id and text are one
document: none stands before another, and each is returned with the same result. Null, empty and blank texts have no
words; texts of fewer words than a window keep all of theirs. Texts of any length are read whole, a long one by itself;
its repeats are gathered in one row, at most a few for each window. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices
from .store import Written, release
from .wordspans import Runs, encoded, words

#: Covers of a period in which each difference occurs once (and of 1): fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Rows that go to Spark at once.
BATCH = 1 << 16


def period_of(least: int) -> int:
    """The longest period whose anchors have a third of a window at least."""
    return max(p for p in COVERS if p == 1 or 3 * p <= 2 * (least + 1))


class Texts:
    """Words of some texts: where each stands in its text, and how many its text has."""

    def __init__(self, texts: list[str]):
        data, edges = encoded(texts)
        self.starts, self.ends, self.first = words(data, edges)
        self.runs = Runs(data, self.starts, self.ends)
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.n)
        self.place = np.arange(len(self.text)) - self.first[self.text]


def anchors(texts: list[str], least: int) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words; the word at which each anchor begins, and how many words of its surroundings stand left and right of it."""
    period = period_of(least)
    w, around = least - period + 1, period - 1
    t = Texts(texts)
    in_cover = np.zeros(period, bool)
    in_cover[list(COVERS[period])] = True
    n = t.n[t.text]
    at = np.flatnonzero(in_cover[t.place % period] & (t.place + w <= n) & (n >= least))
    return t, at, np.minimum(around, t.place[at]), np.minimum(around, n[at] - t.place[at] - w)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _in_batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for k in range(0, len(whole), BATCH):
        yield whole.slice(k, BATCH)


def _own(batch: pa.RecordBatch, a: int, rows: np.ndarray) -> dict[str, pa.Array]:
    at = pa.array(a + rows)
    return {c: batch.column(c).take(at) for c in ("doc_id", "key")}


def _anchor_hashes(docs: DataFrame, least: int) -> DataFrame:
    w = least - period_of(least) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                t, at, _, _ = anchors(texts[a:b], least)
                yield from _in_batches({"anchor": _signed(t.runs.hashes(at, at + w, 1))})

    return docs.select("text").mapInArrow(run, "anchor long")


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """anchor, around (hash of the surroundings), doc_id, key, at: its place, and the words left and right of it (8 bits each)."""
    w = least - period_of(least) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                t, at, left, right = anchors(texts[a:b], least)
                around = t.runs.hashes(at - left, at + w + right, 2) + (left * 256 + right).astype(np.uint64)
                packed = t.place[at] << 16 | left << 8 | right
                own = _own(batch, a, t.text[at])
                yield from _in_batches({"anchor": _signed(t.runs.hashes(at, at + w, 1)), "around": _signed(around), **own, "at": pa.array(packed)})

    return docs.mapInArrow(run, "anchor long, around long, doc_id long, key long, at long")


def _windows(docs: DataFrame, least: int) -> DataFrame:
    """window, check (two hashes), doc_id, key, at of the windows around anchors. docs: doc_id, key, text, anchors (array of `at`)."""
    around = period_of(least) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = batch.column("text").to_pylist(), batch.column("anchors")
            for a, b in slices(texts):
                t = Texts(texts[a:b])
                lists = held.slice(a, b - a)
                packed = lists.flatten().to_numpy()
                first = t.first[np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))]
                low = first + (packed >> 16) - (packed >> 8 & 255)
                high = first + (packed >> 16) + (packed & 255) - around
                change = np.zeros(len(t.text) + 2, np.int64)
                np.add.at(change, low, 1)
                np.add.at(change, high + 1, -1)
                at = np.flatnonzero(np.cumsum(change) > 0)
                own = _own(batch, a, t.text[at])
                hashes = (_signed(t.runs.hashes(at, at + least, salt)) for salt in (3, 4))
                yield from _in_batches({**dict(zip(("window", "check"), hashes, strict=True)), **own, "at": pa.array(t.place[at])})

    return docs.select("doc_id", "key", "text", "anchors").mapInArrow(run, "window long, check long, doc_id long, key long, at long")


def _first(by: list[str], rows: DataFrame) -> DataFrame:
    """by, n, first of the groups of several rows."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")).alias("first"))
    return found


def _others(rows: DataFrame, firsts: DataFrame, by: list[str]) -> DataFrame:
    """doc_id, key, at of the rows that aren't the first of their group."""
    repeated = firsts.where("n > 1").select(*by, F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")) & (F.col("at") == F.col("first_at"))
    return rows.join(repeated.hint("shuffle_hash"), by).where(~is_first).select("doc_id", "key", "at")


def _of_documents(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs beside the list of their row (doc_id, key, another column)."""
    other = lists.withColumnRenamed("doc_id", "list_id").withColumnRenamed("key", "list_key")
    same = (docs["key"] == other["list_key"]) & docs["doc_id"].eqNullSafe(other["list_id"])
    return docs.join(other.hint("shuffle_hash"), same, how).drop("list_id", "list_key")


def repeats(given: DataFrame, least: int) -> DataFrame:
    """doc_id, key, spans (array of first word << 32 | number of words): the windows that stand before. given: doc_id, key, text."""
    spark = given.sparkSession
    w, around = least - period_of(least) + 1, period_of(least) - 1
    again = Written(_anchor_hashes(given, least).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    release(spark)
    found = Written(_occurrences(given, least).join(again.df.hint("shuffle_hash"), "anchor"), "occurrences")
    release(spark)
    classes = Written(_first(["anchor", "around"], found.df), "classes")
    again.drop()
    extended = _others(found.df, classes.df, ["anchor", "around"])
    left, right = F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    span = F.shiftleft(F.shiftright("at", 16) - left, 32).bitwiseOR(left + right + w)
    whole = Written(extended.select("doc_id", "key", span.alias("span")), "extended")
    release(spark)

    several = classes.df.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1").select("anchor")
    firsts = classes.df.select("anchor", "first.*").join(several.hint("shuffle_hash"), "anchor")
    asked = firsts.groupBy("doc_id", "key").agg(F.collect_list("at").alias("anchors"))
    windows = Written(_windows(_of_documents(given, asked, "inner"), least), "windows")
    release(spark)
    same = _others(windows.df, _first(["window", "check"], windows.df), ["window", "check"])
    single = Written(same.select("doc_id", "key", F.shiftleft("at", 32).bitwiseOR(F.lit(least)).alias("span")), "repeated")
    for done in (found, classes, windows):
        done.drop()
    release(spark)
    return whole.df.unionByName(single.df).groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, least: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by blanks) of each row."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = batch.column("text").to_pylist(), batch.column("spans")
            for a, b in slices(texts):
                data, edges = encoded(texts[a:b])
                starts, ends, first = words(data, edges)
                lists = held.slice(a, b - a).fill_null([])
                packed = lists.flatten().to_numpy()
                at = first[np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))] + (packed >> 32)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + (packed & 0xFFFFFFFF), -1)
                stays = np.cumsum(change[:-1]) == 0
                # bytes of kept words and one blank behind each
                bytes_kept = np.zeros(len(data) + 1, np.int64)
                np.add.at(bytes_kept, starts[stays], 1)
                np.add.at(bytes_kept, ends[stays] + 1, -1)
                inside = np.cumsum(bytes_kept[:-1]) > 0
                blank = np.zeros(len(data), bool)
                blank[ends] = True
                out = np.where(blank, np.uint8(32), data)
                kept = [out[x:y][inside[x:y]].tobytes()[:-1].decode("utf-8", "surrogatepass") for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                n = np.diff(first)
                left = np.concatenate([[0], np.cumsum(stays)])
                removed = n - (left[first[1:]] - left[first[:-1]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    marked = _of_documents(given, repeats(given, least), "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p from d),
windows as (
  select doc_id, p, list(word) over (partition by doc_id order by p rows between current row and 19 following) as win from w),
ranked as (
  select doc_id, p, row_number() over (partition by array_to_string(win, ' ') order by doc_id, p) as nth from windows where len(win) = 20),
marked as (
  select w.doc_id, w.p, word, coalesce(max(case when nth > 1 then 1 else 0 end) over (partition by w.doc_id order by w.p rows between 19 preceding and current row), 0) as gone
  from w left join ranked r on r.doc_id = w.doc_id and r.p = w.p),
kept as (select doc_id, sum(gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by p) filter (where gone = 0), '') as kept from marked group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)
"""
