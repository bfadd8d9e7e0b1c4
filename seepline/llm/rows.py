"""Columns computed in tasks from whole texts, beside a table's own columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and characters of text that are worked on at once (a longer text is alone).
ROWS, CHARACTERS = 1024, 1 << 20


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows that are worked on at once."""
    at = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and (size + n > CHARACTERS or k - at >= ROWS):
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_text_columns(docs: DataFrame, text: str, make: Callable[[list[str]], dict[str, pa.Array]], fields: str) -> DataFrame:
    """docs with the columns that `make` gives for some texts (null: empty). fields: their names and types, names free in docs."""
    own = StructType.fromDDL(fields)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in slices(texts):
                made = make([t or "" for t in texts[a:b]])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(made[f.name] for f in own)], names=[*part.schema.names, *own.names])

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, StructType([*docs.withColumn(text, F.col(text).cast("string")).schema, *own]))
