"""Packing by power-of-two decomposition.

A document of n ids is cut into its binary parts: as many pieces of the longest length as fit, then
one piece for each bit of what is left, longest first. Each piece is a sequence of its own, pieces of
equal length form a bucket, and no sequence crosses documents. No sequence holds padding.

Null text is an empty text, which is one end id. Null and repeated document ids, repeated rows and
extra columns are kept apart or ignored: pieces are made row by row, and rows equal in all they
return are told from each other by their sequence alone. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import encoder, word_file

#: Parts of each bucket that are numbered on their own; a sequence's number holds bucket, part and rank.
PART_BITS, RANK_BITS = 16, 42


def binary_parts(n: int, longest: int) -> list[int]:
    """The lengths of n's pieces: powers of two, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(docs: DataFrame, longest: int = 4096, end_id: int = 2, file: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, bucket (log2 of the length), sequence_id, offset (0: a piece is a whole sequence)."""
    if longest & (longest - 1):
        raise ValueError("the longest length is a power of two")
    file = file or word_file()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(file)
        for batch in batches:
            flat, bounds = words.encode(batch.column("text").to_pylist(), end_id)
            tokens = np.diff(bounds)
            parts = [binary_parts(n, longest) for n in tokens.tolist()]
            rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            lengths = np.array([n for p in parts for n in p], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            for a in range(0, len(rows), 4096):
                b = min(a + 4096, len(rows))
                raw = flat[offsets[a] : offsets[b]].astype("<u4")
                own = pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32) * 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows[a:b])),
                        pa.array(offsets[a:b] - bounds[rows[a:b]]),
                        pa.array(lengths[a:b]),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, own.buffers()[1], pa.py_buffer(raw)]),
                        pa.array(tokens[rows[a:b]]),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = given.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).withColumn("bucket", F.log2("length").cast("int"))
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(1 << PART_BITS))
    ranked = pieces.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    )
    number = F.shiftleft(F.col("bucket").cast("long"), PART_BITS + RANK_BITS) + F.shiftleft(F.col("part"), RANK_BITS) + F.col("rank") - 1
    return ranked.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long")).drop("part", "rank")


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Writes the sequences, one folder for each length: a reader takes batches of equal length."""
    pieces.repartition("length", F.pmod("sequence_id", F.lit(64))).write.partitionBy("length").parquet(folder)
