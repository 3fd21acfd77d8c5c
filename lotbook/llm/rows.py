"""What the operators share: words, row keys, columns that ride along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of other characters; the bytes of ``bytes.split()`` with no argument.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def row_key(*columns: str) -> Column:
    """A 64-bit key that any scan of the same row gives again, also after a lost executor.

    Equal rows share a key, which is harmless: they get equal results.
    """
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def carried(docs: DataFrame) -> Column:
    """All columns in one struct, so that no column of the input can clash with one of a result."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def text_column(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    """Whole texts; null counts as empty."""
    for value in batch.column(name):
        yield value.as_py() or ""


def with_results(
    batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema, measure: Callable[[str], tuple]
) -> Iterator[pa.RecordBatch]:
    """Each row without its text column, and behind it the columns that ``measure`` gives for the text."""
    for batch in batches:
        results = [measure(value) for value in text_column(batch, text)]
        kept = [i for i, name in enumerate(batch.schema.names) if name != text]
        columns = [batch.column(i) for i in kept]
        values = list(zip(*results)) if results else [()] * len(schema)
        columns += [pa.array(v, type=f.type) for v, f in zip(values, schema)]
        names = [batch.schema.names[i] for i in kept] + schema.names
        yield pa.RecordBatch.from_arrays(columns, names=names)
