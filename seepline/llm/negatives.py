"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Rows are dealt into blocks, anchors into others; a task holds one of each. For a threshold, a block gets an inverted
index: a row's leading components are omitted as long as their norm times the anchor's stays below the threshold, as
rows that share no indexed term with the anchor can't reach it then. Rows are sorted by what they omit, so the posting list of a
term is the front of that order. An anchor's weights are accumulated term after term, from the last one on; a row is
dropped once its partial score and what the norms of the remaining components allow stay below the threshold, and what is left is
verified by whole products.

An anchor asks with windows: bounds of the score, and the same label or another one. Its threshold starts at the top
of its windows and is lowered, to an index that omits less, until each window holds k rows of the block or the threshold
is at the window's bottom. This is done in the block where the anchor itself lies; the least score of the k rows found
there is the threshold in all blocks. Positives are searched first; their scores are the windows of the negatives.

Rows with a null id, label or vector, or with null or non-finite components (also once scaled), take no part. Vectors of
unequal length are compared over the places that both have. Another row is one with another id. Equal rows travel as one with a
count: as positives and negatives they take as many places as they have rows, as anchors they ask once; rows with one id
and unequal vectors or labels are anchors of their own. Ties go to smaller ids. Scores are exact; those beyond 64 bits are the ends of that
range. An anchor without positives has no rows; neither has a positive with an empty window, as one with a score below 0 has.
Other columns aren't read. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Written

#: Bytes of the vectors of a block, least rows of one, terms between two prunings, levels of thresholds without a bottom.
BYTES, ROWS, STEP, LEVELS = 16 << 20, 512, 8, 8
_LARGE = 2**63 - 1


def members(vectors: DataFrame, label: Column, is_anchor: Column, scale: float, vec_id: str, vector: str) -> DataFrame:
    """id, label, v (floor of scale times each component), copies, asks, key of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # + 0.0: no negative zero
    floor = F.transform("v", lambda x: (x * scale) - F.pmod(x * scale, F.lit(1.0)) + F.lit(0.0))
    kept = given.where("sound and id is not null and label is not null").select("id", "label", floor.alias("v"), "asks")
    return kept.groupBy("id", "label", "v").agg(F.count("*").alias("copies"), F.max("asks").alias("asks")).withColumn("key", F.xxhash64("id", "label", "v"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims))
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
    return out


def head_norms(values: np.ndarray) -> np.ndarray:
    """The norm of the first j components of each row, for j from 0 on, rounded up."""
    squares = np.zeros((len(values), values.shape[1] + 1))
    with np.errstate(over="ignore"):
        np.cumsum(values * values, axis=1, out=squares[:, 1:])
    return np.sqrt(squares) * (1 + 1e-9)


class Index:
    """Posting lists of the components that an anchor of norm 1 needs to find every row that reaches `threshold`."""

    def __init__(self, values: np.ndarray, heads: np.ndarray, threshold: float):
        omitted = (heads[:, 1:] < threshold).sum(axis=1)
        self.order = np.argsort(omitted, kind="stable")
        self.omitted = omitted[self.order]
        self.counts = np.searchsorted(self.omitted, np.arange(values.shape[1]), "right")
        self.lists = np.ascontiguousarray(values[self.order].T)
        self.heads = heads[self.order]
        self.top = float(heads[:, -1].max(initial=0.0))

    def reach(self, weights: np.ndarray, norms: np.ndarray, threshold: float) -> np.ndarray:
        """The rows that may reach the threshold. norms: head_norms of the weights."""
        dims = len(weights)
        live = np.arange(int(self.counts[-1]) if dims else len(self.order))
        scores, room, all_live = np.zeros(len(live)), np.empty(len(live)), True
        with np.errstate(invalid="ignore", over="ignore"):
            least = threshold - 1e-9 * norms[-1] * self.top
            for term in range(dims - 1, -1, -1):
                held = int(self.counts[term])
                if not all_live:
                    held = int(np.searchsorted(live, held))
                if held and weights[term]:
                    scores[:held] += np.multiply(self.lists[term, :held] if all_live else self.lists[term].take(live[:held]), weights[term], out=room[:held])
                if term % STEP == 0 and len(live):
                    left = np.maximum(term, self.omitted[live])  # the leading components that aren't in the score
                    able = ~(scores + self.heads[live, left] * norms[left] < least)
                    # rows leave once they are many: a few are cheaper to carry on than to step around
                    if able.sum() < 0.75 * len(live) or term == 0:
                        live, scores, all_live = live[able], scores[able], False
        return self.order[live]


@dataclass
class Ask:
    """Rows wanted by an anchor: k with scores from low to high (None: open), with its label or with another one. filled: low is where its threshold starts."""

    low: int | None
    high: int | None
    same: bool
    k: int
    filled: bool = False


def steps(low: float | None, high: float | None, top: float) -> list[float]:
    """Thresholds from high to low; the last one finds all that there is."""
    if low is None:
        return [top * (1 - (k + 1) / LEVELS) for k in range(LEVELS)] + [-np.inf]
    if high is None:
        return [float(low)]
    return [high - (high - low) * part for part in (0.125, 0.25, 0.5)] + [float(low)]


class Block:
    """The rows of a block, searched by anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, copies: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.copies, self.values = ids[order], labels[order], copies[order], values[order]
        self.heads = head_norms(self.values)
        self.top = float(self.heads[:, -1].max(initial=0.0))

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact inner products, within 64 bits."""
        if np.abs(self.values[rows]).max(initial=0) * np.abs(weights).max(initial=0) * max(len(weights), 1) < 2.0**53:
            return (self.values[rows] @ weights).astype(np.int64)
        whole = [int(w) for w in weights.tolist()]
        return np.array([min(max(sum(int(x) * w for x, w in zip(row, whole, strict=True)), -_LARGE - 1), _LARGE) for row in self.values[rows].tolist()], np.int64)

    def _fill(self, found: np.ndarray, scores: np.ndarray, own: int, label: int, ask: Ask) -> tuple[np.ndarray, np.ndarray, bool]:
        fits = (self.ids[found] != own) & ((self.labels[found] == label) == ask.same)
        fits &= scores >= ask.low if ask.low is not None else True
        fits &= scores <= ask.high if ask.high is not None else True
        rows, scores = found[fits], scores[fits]
        best = np.lexsort((self.ids[rows], -scores.astype(np.float64))) if np.abs(scores).max(initial=0) < 2**53 else np.array(sorted(range(len(rows)), key=lambda j: (-int(scores[j]), self.ids[rows[j]])), np.int64)
        rows, scores = rows[best], scores[best]
        taken = np.cumsum(self.copies[rows])
        n = int(np.searchsorted(taken, ask.k)) + 1
        return rows[:n], scores[:n], len(taken) > 0 and taken[-1] >= ask.k

    def search(self, anchors: list[tuple[int, int, np.ndarray, list[Ask]]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Rows and scores for each ask of each anchor (id, label, vector, asks), the best k of the block (with more copies: fewer rows)."""
        out: list[list] = [[None] * len(asks) for _, _, _, asks in anchors]
        norms = [head_norms(v[None, :])[0] for _, _, v, _ in anchors]
        waiting: list[tuple[float, int, list[float]]] = []
        for j, (_, _, _, asks) in enumerate(anchors):
            for a, ask in enumerate(asks):
                if ask.low is not None and ask.high is not None and ask.low > ask.high:
                    out[j][a] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            asks = [ask for ask, known in zip(asks, out[j], strict=True) if known is None]
            if asks:
                low = None if any(a.low is None for a in asks) else min(a.low for a in asks)
                high = None if any(a.high is None for a in asks) else min(a.high for a in asks)
                high = low if high is not None and low is not None and high < low else high
                rest = [float(low)] if all(a.filled for a in asks) else steps(low, high, self.top * float(norms[j][-1]))
                waiting.append((*self._next(rest, norms[j]), j))
        while waiting:
            # the anchors with the highest thresholds, relative to their norms, share an index
            level = max(x[0] for x in waiting)
            index = Index(self.values, self.heads, level if np.isfinite(level) else -np.inf)
            again = []
            for at, rest, j in waiting:
                if at < level:
                    again.append((at, rest, j))
                    continue
                own, label, vector, asks = anchors[j]
                found = index.reach(vector, norms[j], rest[0])
                exact = self.scores(found, vector)
                if len(rest) > 1:  # below the threshold, not all rows are known
                    found, exact = found[exact >= rest[0]], exact[exact >= rest[0]]
                for a, ask in enumerate(asks):
                    if out[j][a] is None:
                        rows, scores, full = self._fill(found, exact, own, label, ask)
                        if full or len(rest) == 1:
                            out[j][a] = (rows, scores)
                if any(known is None for known in out[j]):
                    again.append((*self._next(rest[1:], norms[j]), j))
            waiting = again
        return out

    def _next(self, rest: list[float], norms: np.ndarray) -> tuple[float, list[float]]:
        """The level of index for the first threshold (a sixteenth of the largest norm, rounded down), and the thresholds."""
        norm, sixteenth = float(norms[-1]), self.top / 16
        if not np.isfinite(rest[0]) or rest[0] <= 0 or not norm or not sixteenth or not np.isfinite(norm * self.top):
            return -np.inf, rest
        return min(np.floor(rest[0] / norm / sixteenth), 16.0) * sixteenth, rest


def _asks(windows: list[dict] | None, floor: int | None, k: int, window: tuple[int, int, int] | None, last: bool) -> list[Ask]:
    """Of positives: one, from the floor on. Of negatives: one for each window (a positive's score and its own floor). last: thresholds start at the bottom."""
    if window is None:
        return [Ask(floor, None, True, k, floor is not None)]
    low, high, whole = window
    out = []
    for w in windows or []:
        least, most = -(-low * w["score"] // whole), high * w["score"] // whole
        known = w["floor"] is not None
        out.append(Ask(max(least, w["floor"]) if known else least, most, False, k, last))
    return out


def _search(asked: DataFrame, rows: DataFrame, by: list[str], k: int, window: tuple[int, int, int] | None, last: bool = False) -> DataFrame:
    """key, positive_score (null for positives), found, score, copies. asked: by, key, id, label, v, windows (array of score, floor), floor; rows: by, id, label, v, copies."""
    schema = pa.schema([("key", pa.int64()), ("positive_score", pa.int64()), ("found", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        dims = max((len(x) for t in (asked, rows) for x in t.column("v")), default=0)
        block = Block(*(rows.column(c).to_numpy() for c in ("id", "label", "copies")), _matrix(rows.column("v"), dims))
        weights = _matrix(asked.column("v"), dims)
        given = zip(*(asked.column(c).to_pylist() for c in ("key", "id", "label", "windows", "floor")), strict=True)
        anchors = [(key, own, label, _asks(windows, floor, k, window, last), windows) for key, own, label, windows, floor in given]
        found = block.search([(own, label, weights[j], asks) for j, (_, own, label, asks, _) in enumerate(anchors)])
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for (key, _, _, _, windows), answers in zip(anchors, found, strict=True):
            for a, (at, got) in enumerate(answers):
                own = (np.full(len(at), key), np.full(len(at), windows[a]["score"] if window else 0), block.ids[at], got, block.copies[at])
                for part, column in zip(parts, own, strict=True):
                    part.append(column)
        return pa.table([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], schema=schema)

    # both come from one table, so the columns of one side get new identities
    rows = rows.toDF(*rows.columns)
    return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, "key long, positive_score long, found long, score long, copies long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each group, equal rows one by one, with their rank."""
    each = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int")))).drop("_copy", "copies")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int, int] = (80, 100, 100), scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best positives, the best rows of other labels with low * positive_score <= whole * score <= high * positive_score (window: low, high, whole)."""
    spark = vectors.sparkSession
    rows = Written(members(vectors, label, is_anchor, scale, vec_id, vector), "vectors").df
    sizes = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n, asking, width = int(sizes[0]), int(sizes[1]), max(1, int(sizes[2])) * 8
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n * width // BYTES), min(tasks, -(-n // ROWS)), 1)
    ask_blocks = max(-(-asking * width // BYTES), 1)
    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks)))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    none = F.lit(None).cast("long")
    open_ = dealt.where("asks").withColumn("windows", F.lit(None).cast("array<struct<score:long,floor:long>>"))
    here = dealt.drop("key", "asks")

    def last(found: DataFrame, by: list[str], k: int) -> DataFrame:
        """The least of k scores that are there for sure."""
        return _best(found, by, k).where(F.col("rank") == k).select(*by, F.col("score").alias("floor"))

    floors = last(_search(open_.withColumn("floor", none), here, ["block"], positives, None), ["key"], positives)
    spread = here.withColumn("ask_block", numbers(ask_blocks))
    by = ["ask_block", "block"]

    def everywhere(asked: DataFrame) -> DataFrame:
        return asked.withColumn("ask_block", F.pmod(F.xxhash64("key"), F.lit(ask_blocks))).drop("block").withColumn("block", numbers(blocks))

    best = _best(_search(everywhere(open_.join(floors, "key", "left")), spread, by, positives, None), ["key"], positives)
    best = Written(best.select("key", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives").df

    def asking_with(windows: DataFrame) -> DataFrame:
        each = windows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.col("positive_score").alias("score"), F.col("floor")))).alias("windows"))
        return dealt.where("asks").join(each, "key").withColumn("floor", none)

    wanted = best.select("key", "positive_score").distinct()
    at_home = _search(asking_with(wanted.withColumn("floor", none)), here, ["block"], negatives, window)
    windows = wanted.join(last(at_home, ["key", "positive_score"], negatives), ["key", "positive_score"], "left")
    found = _best(_search(everywhere(asking_with(windows)), spread, by, negatives, window, True), ["key", "positive_score"], negatives)
    named = best.join(dealt.where("asks").select("key", F.col("id").alias("anchor_id")), "key")
    return named.join(found, ["key", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as e, row_number() over () as line from embeddings
  where embedding is not null and vec_id is not null and label is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
a as (select distinct vec_id, label, e from v where vec_id % 100 = 0),
numbered as (select *, row_number() over (order by vec_id) as anchor from a),
s as (
  select anchor, a.vec_id as anchor_id, b.vec_id, b.line, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from numbered a join v b on a.vec_id <> b.vec_id),
p as (
  select * from (select *, row_number() over (partition by anchor order by score desc, vec_id) as place from s where same) where place <= 5),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor, p.place order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor = p.anchor and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
