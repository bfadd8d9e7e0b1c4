"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on what toxic texts hold more often than chance allows, one on what
ordinary texts hold. A window, one word between fixed carriers, is compressed with each; its length, how
much longer it is with the ordinary dictionary, and how long with the toxic one, are the window's cell. Each cell
has a threshold-like weight, calibrated on texts whose words the dictionaries haven't seen (by folds), and a
document's score is a logistic function of its highest weight and its number of windows.

Learning takes a bounded sample: at most `most` labelled rows of each class, in the order of a hash of their ids, each with
its whole text: tasks take its distinct words and the number of its windows, one task learns from these, and the model comes to the driver. Scoring
reads every window of every whole text. Both cut windows by one function: a word longer than a window is cut in windows that
overlap by half, so no expression of up to 32 bytes is parted. A window compressed once is remembered by the worker process.

Texts of any length are read whole, one of over a million characters by itself. What stays of a text in learning is its
distinct windows, so the learning task's memory grows with `most` and the vocabulary of the sampled texts, not with the table.

Null text is empty; empty texts get the score that no window gives. Without labels of both classes every score is the
share of toxic labels (0 without any). Null ids are scored and never held out; rows are scored one by one, so
repeated rows agree; other columns are left as they are. An empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import Known, range_hashes
from .rows import free_name, slices, with_text_columns

WINDOW, STEP = 64, 32  # bytes of a window (up to three more end a character), and between windows of a long word
FOLDS, LEAST, LEVEL = 5, 8.0, 12
#: Characters of each dictionary at most, unless `learn` is told otherwise.
SIZE = 8000
CARRIER = b"<<0123456789abcdefghij>>"
EDGE = ".,;:!?|*#$%&\"'()[]"
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case as bytes, where each window begins and ends there, and how many windows each text has."""
    raw = [t.lower().encode("utf-8", "ignore") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
    pieces = np.maximum(-(-(ends - starts - WINDOW) // STEP), 0) + 1
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(starts, pieces) + step * STEP
    to = np.minimum(at + WINDOW, np.repeat(ends, pieces))
    for _ in range(3):  # no window parts a character
        at, to = at + (data[at] >> 6 == 2), to + (data[to] >> 6 == 2)
    return data, at, to, np.diff(np.searchsorted(at, edges))


def _surplus(a: int, n: int, b: int, m: int) -> float:
    """The log-likelihood ratio of a in n against b in m, negative if the first is the lower share."""

    def likelihood(k: int, of: int, p: float) -> float:
        return k * math.log(max(p, 1e-12)) + (of - k) * math.log(max(1 - p, 1e-12))

    p = (a + b) / (n + m)
    g = 2 * (likelihood(a, n, a / n) + likelihood(b, m, b / m) - likelihood(a, n, p) - likelihood(b, m, p))
    return g if a / n > b / m else -g


def dictionaries(texts: list[set[str]], toxic: list[bool], size: int = SIZE) -> tuple[bytes, bytes]:
    """The contents of the ordinary and the toxic dictionary: words and beginnings of words, what tells most last, and of
    each the last `size` characters."""
    held = (Counter(), Counter())
    for words, is_toxic in zip(texts, toxic, strict=True):
        parts = {f" {w} " for w in words if len(w) >= 3}
        parts.update(f" {w[:k]}" for w in words for k in (5, 6, 7, 8) if len(w) > k)
        held[is_toxic].update(parts)
    n, m = sum(toxic), len(toxic) - sum(toxic)
    told = {p: _surplus(held[1][p], n, held[0][p], m) for p in sorted(set(held[0]) | set(held[1]))}
    high = sorted((p for p in told if told[p] >= LEAST), key=told.get)
    low = sorted((p for p in told if held[0][p] >= 2 and told[p] < LEAST / 2), key=held[0].get)
    return tuple("".join(x)[-size:].encode("utf-8", "ignore") for x in (low, high))


class Windows:
    """Cells of windows, by their compressed lengths under both dictionaries.

    The carrier ends each dictionary, so that it costs the same to match however long the content is (a distance over another power of
    two would shift all cells), and so that the content's last words, which tell most, can be matched: zstandard doesn't index a
    dictionary's last bytes.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        def compressor(content: bytes):
            book = z.ZstdCompressionDict(content + b" " + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(
                LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS, min_match=4
            )
            return z.ZstdCompressor(dict_data=book, compression_params=how).compress

        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.least = len(self.ordinary(CARRIER + b"  " + CARRIER))

    def cell(self, window: bytes) -> int:
        """16 lengths x 10 differences x 10 lengths under the toxic dictionary, as one number."""
        window = window.strip(EDGE.encode())
        whole = CARRIER + b" " + window + b" " + CARRIER
        a, b = len(self.ordinary(whole)), len(self.toxic(whole))
        return min(len(window), 15) * 100 + min(max(a - b, 0), 9) * 10 + min(max(b - self.least, 0), 9)


@dataclass(frozen=True)
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = field(default=())
    slopes: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of 1, the highest weight, log(1 + windows)
    share: float = 0.0


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's steps."""
    at = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (w * (p - y)) + 1e-2 * at
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(at))
        step = np.linalg.solve(bend, slope)
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return at


def read(text: str) -> tuple[set[str], int]:
    """The distinct windows of a whole text without what edges them, and the number of all its windows."""
    data, at, to, _ = cut([text])
    whole = data.tobytes()
    return {whole[a:b].decode().strip(EDGE) for a, b in zip(at.tolist(), to.tolist(), strict=True)} - {""}, len(at)


def fit(words: list[set[str]], windows: list[int], toxic: list[bool], share: float, size: int = SIZE) -> Model:
    """words, windows: of the sample's texts, by `read`; share: of toxic rows among all labelled ones that may be learnt from."""
    if not any(toxic) or all(toxic):
        return Model(share=float(share))
    cells: list[set[int]] = [set()] * len(words)
    for k in range(FOLDS):
        rest = [j for j in range(len(words)) if j % FOLDS != k]
        flags = [toxic[j] for j in rest]
        if not any(flags) or all(flags):
            rest, flags = list(range(len(words))), toxic
        book = Windows(*dictionaries([words[j] for j in rest], flags, size))
        known: dict[str, int] = {}
        for j in range(k, len(words), FOLDS):
            for w in words[j] - known.keys():
                known[w] = book.cell(w.encode())
            cells[j] = {known[w] for w in words[j]}
    held = (Counter(), Counter())
    for own, is_toxic in zip(cells, toxic, strict=True):
        held[is_toxic].update(own)
    n, m = sum(toxic), len(toxic) - sum(toxic)
    weights = np.zeros(1600)
    for c in set(held[0]) | set(held[1]):
        weights[c] = math.log((held[1][c] + 0.5) / (n + 1)) - math.log((held[0][c] + 0.5) / (m + 1))
    x = np.array([[1, max((weights[c] for c in own), default=0.0), math.log1p(c)] for own, c in zip(cells, windows, strict=True)])
    y = np.array(toxic, float)
    slopes = _logistic(x, y, np.where(y == 1, share / n, (1 - share) / m) * len(y))
    return Model(*dictionaries(words, toxic, size), tuple(weights), tuple(slopes), float(share))


def _read_texts(rows: DataFrame) -> DataFrame:
    """id, toxic, words (distinct, between blanks), windows. rows: id, toxic, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                found = [read(t) for t in texts[a:b]]
                words, windows = pa.array([" ".join(w) for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())
                own = (batch.column(c).slice(a, b - a) for c in ("id", "toxic"))
                yield pa.RecordBatch.from_arrays([*own, words, windows], names=["id", "toxic", "words", "windows"])

    kinds = rows.schema
    return rows.mapInArrow(run, f"id {kinds['id'].dataType.simpleString()}, toxic {kinds['toxic'].dataType.simpleString()}, words string, windows long")


def _fitted(rows: DataFrame, share: float, size: int) -> DataFrame:
    """One row, the fields of the model. rows: of `_read_texts`, a sample of bounded size, so one task learns from it and the driver gets the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, toxic = [], [], []
        for batch in batches:
            for w, n, t in zip(*(batch.column(c).to_pylist() for c in ("words", "windows", "toxic")), strict=True):
                words.append({sys.intern(x) for x in w.split(" ")} - {""})  # a word of many texts is held once
                windows.append(n)
                toxic.append(t == 1)
        m = fit(words, windows, toxic, share, size)
        yield pa.RecordBatch.from_pydict({
            "ordinary": pa.array([m.ordinary], pa.binary()), "toxic": pa.array([m.toxic], pa.binary()),
            "weights": pa.array([[float(x) for x in m.weights]], pa.list_(pa.float64())), "slopes": pa.array([[float(x) for x in m.slopes]], pa.list_(pa.float64())),
            "share": pa.array([m.share], pa.float64()),
        })

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    return one.mapInArrow(run, "ordinary binary, toxic binary, weights array<double>, slopes array<double>, share double")


def learn(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, most: int = 1000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SIZE) -> Model:
    """A model from at most 2 * most labelled rows, with dictionaries of at most `size` characters. learnable: over labels' id
    column, which rows may be learnt from."""
    given = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    given = given.where(learnable) if learnable is not None else given
    given = given.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model()
    parts = [given.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(most) for t in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    model = _fitted(_read_texts(whole), counts.get(1, 0) / total, size).first()
    if model is None:
        return Model(share=counts.get(1, 0) / total)
    return Model(bytes(model["ordinary"]), bytes(model["toxic"]), tuple(model["weights"]), tuple(model["slopes"]), model["share"])


_BOOKS: dict = {}


class _Scorer:
    def __init__(self, model: Model, most: int = 1_500_000):
        self.model, self.most = model, most
        self.windows = Windows(model.ordinary, model.toxic)
        self.weights = np.array(model.weights)
        self._forget()

    def _forget(self) -> None:
        self.known, self.weight = Known(), np.zeros(1 << 16)

    def weight_of(self, window: bytes) -> float:
        """A window of nothing but edges tells nothing, as in learning."""
        return self.weights[self.windows.cell(window)] if window.strip(EDGE.encode()) else -np.inf

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The highest weight of each text's windows (0 without any that tells something), and their number."""
        if self.known.size > self.most:
            self._forget()
        data, at, to, n = cut(texts)
        high = np.zeros(len(texts))
        if len(at):
            keys = range_hashes(data, at, to)
            rows = self.known.find(keys)
            gaps = np.flatnonzero(rows < 0)
            if len(gaps):
                fresh, first = np.unique(keys[gaps], return_index=True)
                whole, gap = data.tobytes(), gaps[first]
                made = np.array([self.weight_of(whole[a:b]) for a, b in zip(at[gap].tolist(), to[gap].tolist(), strict=True)])
                size = self.known.size
                while size + len(made) > len(self.weight):
                    self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)])
                self.weight[size : size + len(made)] = made
                self.known.add(fresh, np.arange(size, size + len(made), dtype=np.int32))
                rows[gaps] = self.known.find(keys[gaps])
            some = np.flatnonzero(n)
            high[some] = np.maximum.reduceat(self.weight[rows], (np.cumsum(n) - n)[some])
            high[np.isneginf(high)] = 0
        return high, n


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """docs with a column `name` (must be free), the score from 0 to 1."""

    def make(texts: list[str]) -> dict[str, pa.Array]:
        if not model.weights:
            return {name: pa.array([model.share] * len(texts), pa.float64())}
        if model not in _BOOKS:
            _BOOKS.clear()
            _BOOKS[model] = _Scorer(model)
        high, n = _BOOKS[model].features(texts)
        a, b, c = model.slopes
        return {name: pa.array(1 / (1 + np.exp(-np.clip(a + b * high + c * np.log1p(n), -30, 30))))}

    return with_text_columns(docs, text, make, f"`{name}` double")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    name = free_name(docs, "toxicity")
    return score(docs, model, name, text).where(F.col(name) < threshold).drop(name)
