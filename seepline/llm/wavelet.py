"""Token ids in wavelet matrices, one file for each shard of documents in ascending order.

A wavelet matrix holds one plane of bits for each bit of an id, highest first; after a plane, ids
with a 0 there come first, in order, then those with a 1. Planes are stored in compressed blocks
beside the number of ones before each block, so that a reader opens only the blocks on its way:
`access` gives the id at a place, `count` the occurrences in a range, `select` the place of the
k-th occurrence.

Files are written under a name of their own and then renamed, so a lost or repeated task leaves no
half file; the manifest names those that count. Null text is an empty text, null ids come first,
rows with equal ids stand beside each other in no given order, an empty table has no shard.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vocabulary import encoder, word_file

MAGIC, BLOCK = b"WVM1", 1 << 13  # bytes of a plane in a block
SHARD_TOKENS, SHARD_BYTES = 1 << 22, 16 << 20


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard. doc_ids: masked where null."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    now, zeros, ones, blocks = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
    for b in range(bits - 1, -1, -1):
        bit = (now >> b & 1).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        at = 0
        for k in range(0, len(plane), BLOCK):
            ones.append(at)
            at += int(bit[8 * k : 8 * (k + BLOCK)].sum())
            blocks.append(pack(plane[k : k + BLOCK].tobytes()))
        zeros.append(len(now) - at)
        now = np.concatenate([now[~bit], now[bit]])
    sections = [
        pack(np.ma.filled(doc_ids, 0).astype("<i8").tobytes()),
        pack(np.packbits(np.ma.getmaskarray(doc_ids)).tobytes()),
        pack(lengths.astype("<i8").tobytes()),
        np.array(ones, "<i8").tobytes(),
        np.cumsum([0] + [len(x) for x in blocks]).astype("<i8").tobytes(),
        b"".join(blocks),
    ]
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "docs": len(lengths), "sections": [len(x) for x in sections]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(sections)


class Shard:
    """A shard's file, opened from its bytes."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self._open = zstandard.ZstdDecompressor().decompress
        size = struct.unpack("<I", data[4:8])[0]
        head = json.loads(data[8 : 8 + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        ends = np.cumsum([8 + size, *head["sections"]])
        part = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        null = np.unpackbits(np.frombuffer(self._open(part[1]), np.uint8))[: head["docs"]].astype(bool)
        self.doc_ids = np.ma.masked_array(np.frombuffer(self._open(part[0]), "<i8"), null)
        self.lengths = np.frombuffer(self._open(part[2]), "<i8")
        self._ones, self._at, self._blocks = np.frombuffer(part[3], "<i8"), np.frombuffer(part[4], "<i8"), part[5]
        self._per = -(-self.n // (8 * BLOCK))  # blocks of a plane
        self._held: dict[int, np.ndarray] = {}

    def _bits(self, level: int, block: int) -> np.ndarray:
        k = level * self._per + block
        if k not in self._held:
            if len(self._held) > 256:
                self._held.clear()
            raw = self._open(self._blocks[self._at[k] : self._at[k + 1]])
            self._held[k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self._held[k]

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block, rest = divmod(i, 8 * BLOCK)
        return int(self._ones[level * self._per + block]) + int(self._bits(level, block)[:rest].sum())

    def _select(self, level: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        ones = self._ones[level * self._per : (level + 1) * self._per]
        before = ones if one else np.arange(self._per) * 8 * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = self._bits(level, block)[: self.n - block * 8 * BLOCK]
        return block * 8 * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def access(self, i: int) -> int:
        token = 0
        for level in range(self.bits):
            block, rest = divmod(i, 8 * BLOCK)
            bit, ones = int(self._bits(level, block)[rest]), self._rank(level, i)
            token, i = token << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences among places lo to hi lie after the last plane."""
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, min(lo, self.n), self.n if hi is None else min(hi, self.n))
        return b - a

    def select(self, token: int, k: int) -> int | None:
        """The place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return None
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def document(self, place: int) -> int:
        """The number, in this shard, of the document that holds a place."""
        return int(np.searchsorted(np.cumsum(self.lengths), place, "right"))

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        now = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            own = range(level * self._per, (level + 1) * self._per)
            raw = b"".join(self._open(self._blocks[self._at[k] : self._at[k + 1]]) for k in own)
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(now)
            up[~bit] = now[: self.zeros[level]]
            up[bit] = now[self.zeros[level] :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = up
        return now.astype("<u4")


def write_shards(docs: DataFrame, folder: str, end_id: int = 2, file: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents below `folder`, which executors share: shard files, and a table `manifest` of them, which is returned.

    manifest: file, first_doc, docs, tokens, before (tokens of all earlier shards). A task holds one shard of
    about SHARD_TOKENS ids at a time, or one document.
    """
    file, files = file or word_file(), f"{folder}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        words, task = encoder(file), TaskContext.get()
        store, path = fs.FileSystem.from_uri(files if "://" in files or files.startswith("/") else f"file://{files}")
        store.create_dir(path)
        ids, names, lengths, size, part = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, lengths, size, part
            own = pa.chunked_array(names).combine_chunks()
            masked = np.ma.masked_array(own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False))
            name = f"{task.partitionId():06d}-{part:06d}.wvm"
            with store.open_output_stream(f"{path}/.{name}.{task.taskAttemptId()}") as out:
                out.write(build(np.concatenate(ids), masked, np.concatenate(lengths)))
            store.move(f"{path}/.{name}.{task.taskAttemptId()}", f"{path}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "first_doc": own[:1], "docs": [len(own)], "tokens": [size]})
            ids, names, lengths, size, part = [], [], [], 0, part + 1
            return row

        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                flat, bounds = words.encode(some.column("text").to_pylist(), end_id)
                ids.append(flat)
                names.append(some.column("doc_id"))
                lengths.append(np.diff(bounds))
                size += len(flat)
                if size >= SHARD_TOKENS:
                    yield flush()
        if names:
            yield flush()

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    placed = given.repartitionByRange(max(1, size // SHARD_BYTES), "doc_id").sortWithinPartitions("doc_id")
    placed.mapInArrow(write, "file string, first_doc long, docs long, tokens long").write.parquet(f"{folder}/listed")
    listed = docs.sparkSession.read.parquet(f"{folder}/listed")
    before = F.sum("tokens").over(Window.orderBy("first_doc", "file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    listed.withColumn("before", before).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard: those of the manifest, with `content`, the file."""
    found = spark.read.format("binaryFile").load(f"{folder}/shards/*.wvm").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return found.join(spark.read.parquet(f"{folder}/manifest"), "file")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column("before").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py())
                raw, ends = shard.ids(), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                for a in range(0, len(ends), 256):
                    b = min(a + 256, len(ends))
                    own = pa.array(np.append(starts[a:b], ends[b - 1]) - starts[a]).cast(pa.int32())
                    own = pa.array(own.to_numpy() * 4, pa.int32())
                    data = pa.py_buffer(raw[starts[a] : ends[b - 1]].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids.data[a:b], mask=np.ma.getmaskarray(shard.doc_ids)[a:b]),
                            pa.array(starts[a:b] + before),
                            pa.array(shard.lengths[a:b]),
                            pa.Array.from_buffers(pa.binary(), b - a, [None, own.buffers()[1], data]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    shards = read_shards(spark, folder).select("before", "content")
    return shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """Each place of a token: doc_id, place (among all ids), by rank and select in the files."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column("before").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py())
                places = [shard.select(token, k) for k in range(shard.count(token))]
                docs = [shard.doc_ids[shard.document(p)] for p in places]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([None if d is np.ma.masked else int(d) for d in docs], pa.int64()), "place": pa.array([before + p for p in places], pa.int64())}
                )

    return read_shards(spark, folder).select("before", "content").mapInArrow(find, "doc_id long, place long")


