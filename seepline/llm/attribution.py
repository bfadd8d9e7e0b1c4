"""Token counts by offset-mapped attribution.

A document's fields are joined, in order, each closed by a line feed, and the whole is encoded once with a byte-level
vocabulary, whose tokens tile the text's bytes. Token spans and section spans are then two sorted lists of
intervals over one text, joined by merging. Every token is allocated, whole or in shares, by the rule given:

* `start`: to the section that holds its first byte;
* `end`: to the section that holds its last byte;
* `most`: to the section that holds most of it, the first of equals;
* `share`: to each in proportion to its bytes there (fractions that sum to the number of tokens).

A section is a field or, for those named in `cut`, a line of it; the closing line feed belongs to it. Null fields are
empty and hold their line feed alone. Rows are taken one by one: null or repeated ids and repeated rows give rows of
their own, an empty table none; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "most", "share")
_VOCABULARIES: dict = {}


def byte_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary(file: str):
    """The encoding and each id's number of bytes."""
    if file not in _VOCABULARIES:
        import public_tokenizers
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, k in ranks.items():
            lengths[k] = len(word)
        _VOCABULARIES[file] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _VOCABULARIES[file]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens allocated to each section. ends: where each token ends; bounds: where each section begins, and the end of all."""
    starts = np.concatenate([[0], ends[:-1]])
    first, last = np.searchsorted(bounds, starts, "right") - 1, np.searchsorted(bounds, ends - 1, "right") - 1
    n = len(bounds) - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float)
    whole = first == last
    out = np.bincount(first[whole], minlength=n).astype(float)
    for a, b, f, g in zip(starts[~whole], ends[~whole], first[~whole], last[~whole], strict=True):
        own = np.minimum(bounds[f + 1 : g + 2], b) - np.maximum(bounds[f : g + 1], a)
        if rule == "share":
            out[f : g + 1] += own / (b - a)
        else:
            out[f + int(np.argmax(own))] += 1
    return out


def attribute(docs: DataFrame, fields: Sequence[str] = ("source", "lang", "text"), cut: Sequence[str] = ("text",), rule: str = "start", file: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """One row per section: doc_id, field, section (from 0 within its field), start (characters before it), n_chars, n_tokens, crossing (tokens that begin before it and end in or after it), doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    file, names, cuts = file or byte_file(), list(fields), set(cut)

    def sections(values: list[str | None]) -> tuple[str, list[int], list[int], list[int]]:
        """The whole text, and the field, number and bytes of each section."""
        parts, of, number, size = [], [], [], []
        for k, value in enumerate(values):
            lines = (value or "").split("\n") if names[k] in cuts else [value or ""]
            for i, line in enumerate(lines):
                parts.append(line)
                of.append(k)
                number.append(i)
                size.append(len(line.encode("utf-8", "surrogatepass")) + 1)
        return "\n".join(parts) + "\n", of, number, size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = vocabulary(file)
        for batch in batches:
            columns = [batch.column(f"f{k}").to_pylist() for k in range(len(names))]
            rows, of, number, start, chars, tokens, crossing, total = [], [], [], [], [], [], [], []
            for row, values in enumerate(zip(*columns, strict=True)):
                text, own, numbers, size = sections(list(values))
                ids = np.fromiter(encoding.encode_ordinary(text), np.int64)
                ends, bounds = np.cumsum(lengths[ids]), np.concatenate([[0], np.cumsum(size)])
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                letters = np.add.reduceat((data & 0xC0) != 0x80, bounds[:-1], dtype=np.int64)
                over = np.searchsorted(ends, bounds[:-1], "right")  # the token that holds each section's first byte
                begins = ends[over] - lengths[ids[over]]
                rows.append(np.full(len(own), row))
                of += own
                number += numbers
                start.append(np.cumsum(letters) - letters)
                chars.append(letters)
                tokens.append(allocate(ends, bounds, rule))
                crossing.append((begins < bounds[:-1]).astype(np.int64))
                total.append(np.full(len(own), len(ids)))
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(np.concatenate(rows))),
                    pa.array(names).take(pa.array(of, pa.int32())),
                    pa.array(number, pa.int64()),
                    *(pa.array(np.concatenate(x)) for x in (start, chars, tokens, crossing, total)),
                ],
                names=["doc_id", "field", "section", "start", "n_chars", "n_tokens", "crossing", "doc_tokens"],
            )

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(names)))
    return given.mapInArrow(count, "doc_id long, field string, section long, start long, n_chars long, n_tokens double, crossing long, doc_tokens long")
