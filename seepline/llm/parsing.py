"""Document fingerprints by locally consistent parsing.

A text's characters are grouped into phrases by deterministic coin tossing: a symbol's label is the lowest bit in which it
differs from its left neighbour, and that bit's value; taking labels of labels leaves six of them, and a phrase
begins where a label stands above both neighbours. Runs of one symbol count as one. A phrase's name is a hash of its
symbols, and names are parsed again, level by level. Where a phrase begins depends on a few symbols around it alone,
so equal substrings get equal names inside, wherever they stand.

A fingerprint is the smallest hashes of the names of two levels (phrases of about 9 and 27 characters), as text; two of
them tell what share of phrases their texts have in common.

Equal texts have equal fingerprints; the empty text's is the empty string. Other columns aren't read; an empty table gives
no rows. For the neighbours: null text is empty; rows with equal ids are ordered by a hash of their text; rows with a
null id stand in no order and have no next document (their edited text ends at its first half, `near_next` is null).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix
from .rows import CHARACTERS

LEVELS, KEPT = (2, 3), 64
PER_BIN, BINS = 500, 1 << 16

_C = np.uint64(0x9E3779B97F4A7C15)
_LABELS = np.zeros((128, 128), np.uint8)
for _b in range(7):
    # lowest differing bit: higher bits first, so that lower ones overwrite them
    _k = 6 - _b
    _own = np.arange(128)[None, :] >> _k & 1
    _differ = (np.arange(128)[:, None] ^ np.arange(128)[None, :]) >> _k & 1
    _LABELS = np.where(_differ == 1, 2 * _k + _own, _LABELS).astype(np.uint8)
_LABELS = _LABELS.ravel()


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases, and where each text's first one stands. names: 64-bit, of all texts; first: places of the texts' first symbols (no text is empty)."""
    begins = np.zeros(len(names), bool)
    begins[first] = True
    new = begins.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(names)))
    x, begins = names[at], begins[at]
    many = runs > 1
    x[many] = mix(x[many] + runs[many].astype(np.uint64) * _C)
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[begins] = ~x[begins]  # differs in the lowest bit
    differ = x ^ before
    k = np.bitwise_count((differ & -differ) - np.uint64(1))
    label = (2 * k + ((x >> k.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8) & 127
    for _ in range(3):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[begins] = label[begins] ^ 1
        label = _LABELS[left.astype(np.uint16) * 128 + label]
    top = begins.copy()
    inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(begins[1:], True)  # the right neighbour is another text's
    top[1:-1] |= inner & ~last[1:-1]
    starts = np.flatnonzero(top)
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    named = np.add.reduceat(mix(x + (place + 1).astype(np.uint64) * _C), starts)
    return mix(named), np.flatnonzero(begins[starts])


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Each text's smallest hashes, ascending 32-bit numbers."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    if not some:
        return out
    lengths = np.array([len(texts[k]) for k in some])
    names = np.frombuffer("".join(texts[k] for k in some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    parts = []
    for level in range(1, max(LEVELS) + 1):
        names, first = parse(names, first)
        if level in LEVELS:
            parts.append(((mix(names + np.uint64(level)) >> np.uint64(32)).astype(np.uint32), np.append(first, len(names))))
    for j, k in enumerate(some):
        own = np.unique(np.concatenate([h[b[j] : b[j + 1]] for h, b in parts]))
        out[k] = own[:KEPT]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of phrases that two texts have in common (0 to 1), from their fingerprints: 2j / (1 + j) of the resemblance j."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:KEPT]
    both = np.intersect1d(np.intersect1d(a, b, True), least, True)
    j = len(both) / len(least)
    return 2 * j / (1 + j)


def shown(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row."""
    from .rows import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                made = pa.array([shown(f) for f in fingerprints(texts[a:b])], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), made], names=["doc_id", "fingerprint"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text, whose last half comes from the next document by descending id (after the last: the first).

    Documents are dealt into ranges of ids; a range also gets the document that comes next after its last. Bounds are ids
    of the table, at most BINS of them. Texts travel compressed, once.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n, most = given.agg(F.count("doc_id"), F.max("doc_id")).first()
    bins = max(1, min(BINS, n // PER_BIN))
    shares = F.array(*[F.lit((k + 1) / bins) for k in range(bins - 1)]) if bins > 1 else None
    found = given.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] if bins > 1 else []
    bounds = np.array(sorted({*found, *([most] if n else [])}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column("doc_id")
            for a in range(0, len(batch), 1024):
                own, texts = ids.slice(a, 1024), batch.column("text").slice(a, 1024)
                null = own.is_null().to_numpy(zero_copy_only=False)
                values = own.fill_null(0).to_numpy()
                raw = [t.as_py().encode("utf-8", "surrogatepass") for t in texts]
                packed = [squeeze(r) for r in raw]
                place = np.searchsorted(bounds, values)
                place[null] = -1 - (np.flatnonzero(null) + a) % 4096
                head = np.flatnonzero(~null & (bounds[np.clip(place, 0, max(0, len(bounds) - 1))] == values)) if len(bounds) else np.zeros(0, int)
                rows = np.concatenate([np.arange(len(own)), head])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([place, (place[head] + 1) % max(1, len(bounds))])),
                        pa.array(np.repeat([False, True], [len(own), len(head)])),
                        own.take(pa.array(rows)),
                        pa.array([int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raw], pa.int64()).take(pa.array(rows)),
                        pa.array([packed[r] for r in rows], pa.binary()),
                    ],
                    names=["bin", "ahead", "doc_id", "tie", "packed"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def unpack(raw: bytes) -> str:
            return zstandard.ZstdDecompressor().decompress(raw).decode("utf-8", "surrogatepass")

        held: list[tuple[int | None, str]] = []
        size, now, closed = 0, None, False

        def flush(final: bool) -> pa.RecordBatch | None:
            """The held rows that have a next one; without, if there is none to come."""
            nonlocal held, size
            alone = now is not None and now < 0
            count = len(held) if alone else len(held) - 1
            texts = [t for _, t in held]
            ids = [i for i, _ in held[: max(count, 0)]]
            if count <= 0:
                held, size = ([], 0) if final else (held, size)
                return None
            halves = [len(t) // 2 for t in texts[:count]]
            edited = [t[: len(t) - h] + ("" if alone else texts[k + 1][:h]) for k, (t, h) in enumerate(zip(texts[:count], halves, strict=True))]
            prints = fingerprints([*texts, *edited])
            own, other = prints[: len(texts)], prints[len(texts) :]
            rows = {
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:count]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": [shown(f) for f in own[:count]],
                "edited_fingerprint": [shown(f) for f in other],
                "near_edited": [likeness(a, b) for a, b in zip(own[:count], other, strict=True)],
                "near_next": pa.array([None if alone else likeness(own[k], own[k + 1]) for k in range(count)], pa.float64()),
            }
            held = [] if final or alone else held[-1:]
            size = sum(len(t) for _, t in held)
            return pa.RecordBatch.from_pydict(rows)

        for batch in batches:
            columns = (batch.column(c) for c in ("bin", "ahead", "doc_id", "packed"))
            for place, ahead, own, packed in zip(*columns, strict=True):
                place, ahead = place.as_py(), ahead.as_py()
                if place != now:
                    if held and (out := flush(True)):
                        yield out
                    held, size, now, closed = [], 0, place, False
                if closed:
                    continue
                closed = ahead
                text = unpack(packed.as_py())
                held.append((own.as_py(), text))
                size += len(text)
                if size > CHARACTERS and not ahead and (out := flush(False)):
                    yield out
        if held and (out := flush(True)):
            yield out

    dealt = given.mapInArrow(deal, "bin long, ahead boolean, doc_id long, tie long, packed binary")
    placed = dealt.repartition("bin").sortWithinPartitions("bin", "ahead", F.desc("doc_id"), "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.mapInArrow(compare, schema)
