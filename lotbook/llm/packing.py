"""Best-fit packing of tokenized documents into sequences of bounded length.

Bulk-synchronous best fit: the pieces are range-sorted by length, longest first, and numbered; gaps (free
places at the end of sequences) are kept sorted by size in runs of equal gaps. A sweep takes all pieces of
one length and gives them to their successors among the gaps, the smallest that hold them; pieces that want
the same gaps are dealt out by rank, the gaps shrink, and the next sweep follows. As pieces and gaps of equal
size are interchangeable, a sweep moves whole runs: what the driver sees is one count a length, and its work
depends on the length of a sequence, not on the number of documents. Pieces find their place by their rank.

Nulls and odd input: a null or empty text is the end mark alone, one piece of length 1. Repeated rows are
packed once each. An empty table gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.llm.token_ids import token_ids
from lotbook.operators.rows import with_row_id
from lotbook.session import staged

CAPACITY = 2048
END = b"\0\0\0\0"  # id 0, after every document
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    ids = token_ids(tokenizer_path)
    step = 4 * capacity
    for batch in batches:
        rows = []
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), ids.of_all(batch.column("text"))):
            data += END
            for piece, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. The tokenizer's file must be at this path on every executor."""
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return wanted.mapInArrow(lambda batches: cut_pieces(batches, tokenizer_path, capacity), PIECES)


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """(number of the first piece, its sequence, offset) of each run of pieces in order of their numbers.

    Pieces are numbered by falling length. Piece ``first + i`` of a run goes to sequence ``sequence + i``.
    """
    runs: list[tuple[int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, how many)
    sizes: list[int] = []  # sizes with gaps, sorted
    number = opened = 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} for sequences of {capacity}")
        left = counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # no gap holds it: as many new sequences as these pieces fill
                fresh = -(-left // (capacity // length))
                size, taken, rest = capacity, (opened, fresh), None
                opened += fresh
            else:
                size = sizes[at]
                taken = gaps[size].pop()
                rest = None
                if taken[1] > left:
                    rest, taken = (taken[0] + left, taken[1] - left), (taken[0], left)
            if rest:
                gaps[size].append(rest)
            elif size in gaps and not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            runs.append((number, taken[0], capacity - size))
            number += taken[1]
            left -= taken[1]
            if size > length:
                if size - length not in gaps:
                    gaps[size - length] = []
                    insort(sizes, size - length)
                gaps[size - length].append(taken)
    return runs


def _placed(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number = batch.column("_number").to_numpy(zero_copy_only=False)
        at = np.searchsorted(runs[:, 0], number, side="right") - 1
        first, sequence, offset = (runs[at, i] for i in range(3))
        keep = [n for n in batch.schema.names if n != "_number"]
        columns = [batch.column(n) for n in keep] + [pa.array(sequence + number - first), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "sequence_id", "offset"])


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``pieces`` and sequence_id, offset."""
    falling = staged(parts.withColumn("_falling", -F.col("length")), "pieces")  # a range sort reads its input twice
    numbered = with_row_id(falling, ["_falling", "doc_id", "piece"], "_number").drop("_falling")
    # one row a length: at most ``capacity``
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sweeps(counts, capacity), dtype=np.int64).reshape(-1, 3)
    schema = f"{PIECES}, sequence_id bigint, offset bigint"
    return numbered.mapInArrow(lambda batches: _placed(batches, runs), schema)
