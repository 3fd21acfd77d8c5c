"""Token ids of a corpus in files that are searched without being unpacked: one wavelet matrix per shard.

Documents are range-sorted by number; each range is cut into shards of whole documents, about ``SHARD`` ids each. A
shard is one file. Its ids are kept as bit-planes, highest bit first: a plane holds one bit of every id, and the ids with a 0 go
before those with a 1 (each in their order) on the next plane. With the number of ones before a place (rank) and
the place of a one (select) this gives the id at a place, the number of times an id occurs before a place, and
where it occurs, each from one block of every plane. Planes are cut into blocks that are compressed one by one,
beside a directory of ones before each block, so a lookup unpacks as many blocks as there are planes.

File, all numbers little-endian: ``HEADER``; the documents (length as u64, then zstd: a byte a document for "has a number",
numbers as i64, ids of each document as i64); for each plane the number of zeros (u64), ones before each block (u64 each), ends of
the blocks' payloads (u64 each) and the payloads (zstd, or raw where that is no longer). A line feed ends the file.
Spark's writer commits the files, so a task that runs twice leaves one.

Nulls and odd input: a null or empty text is the end mark alone. A null number comes first and is read back as null.
Rows of one number are in order of their text's length and hash; equal rows are written once each. A document with more ids than a
shard holds makes a shard of its own. An empty table gives no file and no row. Extra columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.llm.token_ids import token_ids
from lotbook.session import staged

END = 1  # the id behind every document
SHARD = 1 << 22
MAGIC = b"LWM1"
#: magic, planes, ids, documents, range of the sort, ids of that range before this shard
HEADER = "<4sIQQqq"
BLOCK = 8192  # bytes of a plane that are compressed at a time
READ_BACK = "part bigint, local_start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


# --- one shard ------------------------------------------------------------------------------------


def to_file(ids: np.ndarray, doc_ids: Sequence[int | None], lengths: Sequence[int], part: int = 0, start: int = 0) -> bytes:
    """The file of a shard; ``lengths`` says how many of the ``ids`` each document has."""
    planes = max(int(ids.max(initial=0)).bit_length(), 1)
    level = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    packer = zstandard.ZstdCompressor(level=1)
    valid = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    documents = valid.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    packed = packer.compress(documents)
    out = [struct.pack(HEADER, MAGIC, planes, len(ids), len(doc_ids), part, start), struct.pack("<Q", len(packed)), packed]
    for bit in reversed(range(planes)):
        payloads, before, zeros, ones = [], [0], [], []
        for at in range(0, len(level), 8 * BLOCK):  # a block at a time, which stays in the processor's cache
            block = level[at : at + 8 * BLOCK]
            bits = (block & level.dtype.type(1 << bit)).astype(bool)
            plane = np.packbits(bits).tobytes()
            payloads.append(min(plane, packer.compress(plane), key=len))  # raw if they are as long
            zeros.append(block.take(np.flatnonzero(~bits)))
            ones.append(block.take(np.flatnonzero(bits)))
            before.append(before[-1] + len(ones[-1]))
        ends = np.cumsum([len(p) for p in payloads], dtype="<u8")
        out += [struct.pack("<Q", len(level) - before[-1]), np.array(before[:-1], "<u8").tobytes(), ends.tobytes(), *payloads]
        level = np.concatenate([*zeros, *ones, level[:0]])
    return b"".join(out)


class Shard:
    """A shard's file: the ids at places, how often an id occurs, and where, without unpacking it all."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        magic, self.planes, self.n, documents, self.part, self.start = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("no token file")
        at = struct.calcsize(HEADER)
        (size,) = struct.unpack_from("<Q", data, at)
        unpacked = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size])
        valid = np.frombuffer(unpacked, np.uint8, documents)
        numbers = np.frombuffer(unpacked, "<i8", documents, documents)
        self.doc_ids = [int(d) if v else None for d, v in zip(numbers, valid)]
        self.lengths = np.frombuffer(unpacked, "<i8", documents, 9 * documents)
        at += 8 + size
        self._blocks = -(-self.n // (8 * BLOCK))
        self._zeros, self._before, self._ends, self._payloads = [], [], [], []
        for _ in range(self.planes):
            self._zeros.append(struct.unpack_from("<Q", data, at)[0])
            self._before.append(np.frombuffer(data, "<u8", self._blocks, at + 8).astype(np.int64))
            ends = np.frombuffer(data, "<u8", self._blocks, at + 8 + 8 * self._blocks).astype(np.int64)
            self._ends.append(ends)
            at += 8 + 16 * self._blocks
            self._payloads.append(at)
            at += int(ends[-1]) if self._blocks else 0
        self._unpacked: dict[tuple[int, int], np.ndarray] = {}

    def _packed(self, plane: int, block: int) -> bytes:
        first = int(self._ends[plane][block - 1]) if block else 0
        base = self._payloads[plane]
        payload = self.data[base + first : base + int(self._ends[plane][block])]
        size = min(BLOCK, -(-self.n // 8) - block * BLOCK)
        return payload if len(payload) == size else zstandard.ZstdDecompressor().decompress(payload)

    def _bits(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self._unpacked:
            left = min(8 * BLOCK, self.n - 8 * BLOCK * block)
            self._unpacked[plane, block] = np.unpackbits(np.frombuffer(self._packed(plane, block), np.uint8), count=left)
        return self._unpacked[plane, block]

    def _rank(self, plane: int, place: int) -> int:
        """Ones of the plane before the place."""
        if place >= self.n:
            return self.n - self._zeros[plane]
        block, within = divmod(place, 8 * BLOCK)
        return int(self._before[plane][block]) + int(np.count_nonzero(self._bits(plane, block)[:within]))

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of the plane."""
        before = self._before[plane]
        if not bit:
            before = 8 * BLOCK * np.arange(self._blocks) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        hits = np.flatnonzero(self._bits(plane, block) == bit)
        return 8 * BLOCK * block + int(hits[k - int(before[block])])

    def token(self, place: int) -> int:
        found = 0
        if not 0 <= place < self.n:
            raise IndexError(place)
        for plane in range(self.planes):
            block, within = divmod(place, 8 * BLOCK)
            bit, ones = int(self._bits(plane, block)[within]), self._rank(plane, place)
            place = self._zeros[plane] + ones if bit else place - ones
            found = found << 1 | bit
        return found

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of the id at places lo..hi-1 stand behind the last plane."""
        if token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._rank(plane, lo), self._rank(plane, hi)
            if token >> (self.planes - 1 - plane) & 1:
                lo, hi = self._zeros[plane] + a, self._zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
            if lo == hi:
                return 0, 0
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id occurs at places lo..hi-1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def find(self, token: int, first: int = 0, most: int | None = None) -> list[int]:
        """Places of the id in order, from its occurrence number ``first`` on."""
        a, b = self._range(token, 0, self.n)
        b = b if most is None else min(b, a + first + most)
        places = range(a + first, b)
        for plane in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - plane) & 1
            places = [self._select(plane, bit, p - self._zeros[plane] if bit else p) for p in places]
        return list(places)

    def tokens(self) -> np.ndarray:
        """All ids in order, plane by plane from the last."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        level = np.zeros(self.n, kind)
        for plane in reversed(range(self.planes)):
            above, value = np.empty(self.n, kind), kind(1 << (self.planes - 1 - plane))
            zero, one = 0, self._zeros[plane]
            for block in range(self._blocks):
                part = above[8 * BLOCK * block : 8 * BLOCK * (block + 1)]
                ones = np.unpackbits(np.frombuffer(self._packed(plane, block), np.uint8), count=len(part)).view(bool)
                at = np.flatnonzero(ones)
                part[np.flatnonzero(~ones)] = level[zero : zero + len(part) - len(at)]
                part[at] = level[one : one + len(at)] | value
                zero, one = zero + len(part) - len(at), one + len(at)
            level = above
        return level


# --- a corpus -------------------------------------------------------------------------------------


def _write_shards(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end: int, shard: int) -> Iterator[pa.RecordBatch]:
    ids, part = token_ids(tokenizer_path), TaskContext.get().partitionId()
    mark, done = struct.pack("<I", end), 0
    doc_ids: list[int | None] = []
    kept: list[bytes] = []

    def full() -> pa.RecordBatch:
        nonlocal done, doc_ids, kept
        lengths = [len(k) // 4 for k in kept]
        tokens = np.frombuffer(b"".join(kept), "<u4")
        kept = []
        file = to_file(tokens, doc_ids, lengths, part, done)
        done += len(tokens)
        doc_ids = []
        return pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], names=["file"])

    held = 0
    for batch in batches:
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), ids.of_all(batch.column("text"))):
            found += mark
            if held and held + len(found) > 4 * shard:
                yield full()
                held = 0
            doc_ids.append(doc_id)
            kept.append(found)
            held += len(found)
    if held:
        yield full()


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int = END, shard: int = SHARD) -> None:
    """Files of the documents' ids in ascending order of their numbers. The tokenizer must be at this path on every executor.

    Texts are shuffled once, by ranges; they are tokenized where they arrive.
    """
    keys = ["doc_id", "_length", "_hash"]
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keyed = wanted.withColumns({"_length": F.coalesce(F.length("text"), F.lit(0)), "_hash": F.xxhash64("text")})
    in_order = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = in_order.mapInArrow(lambda batches: _write_shards(batches, tokenizer_path, end, shard), "file binary")
    # one row a file, its bytes as they are
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content"""
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5
    names = ["part", "local_start", "doc_id", "n_tokens", "ids_crc32"]
    for batch in batches:
        for content in batch.column("content"):
            shard = Shard(content.as_py())
            data = shard.tokens().astype("<u4").tobytes()
            ends = shard.lengths.cumsum()
            starts = ends - shard.lengths
            sums = [zlib.crc32(memoryview(data)[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            columns = [[shard.part] * len(sums), starts + shard.start, shard.doc_ids, shard.lengths, sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, from the files alone."""
    found = staged(files(spark, folder).mapInArrow(_read_shards, READ_BACK), "tokens-read")
    # one row a range of the sort: as many as there are shuffle partitions
    sizes = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part bigint, _before bigint")
    placed = found.join(F.broadcast(offsets), "part")
    return placed.select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(spark: SparkSession, folder: str, tokens: Sequence[int]) -> DataFrame:
    """token, n: occurrences of each of the given ids in all files; a few blocks of each file are unpacked."""
    wanted = sorted(set(tokens))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_py())
                yield pa.RecordBatch.from_pydict({"token": wanted, "n": [shard.count(t) for t in wanted]})

    return files(spark, folder).mapInArrow(counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """doc_id, place (in the document, from 0) of every occurrence of an id."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_py())
                places = np.array(shard.find(token), dtype=np.int64)
                ends = shard.lengths.cumsum()
                at = np.searchsorted(ends, places, side="right")
                inside = places - (ends - shard.lengths)[at]
                numbers = pa.array([shard.doc_ids[i] for i in at], pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, pa.array(inside, pa.int64())], names=["doc_id", "place"])

    return files(spark, folder).mapInArrow(found, "doc_id bigint, place bigint")
