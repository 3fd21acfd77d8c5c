"""Nearest neighbours by inner product: multi-index hashing of learned binary codes, then floats.

Codes are signs of rotated vectors; the rotations are learned on a bounded sample so that the signs lose little (iterated
quantization), ``ROTATIONS`` of them from different starts side by side. Vectors are put on a sphere first by one more
coordinate that fills up their length, so that the nearest direction is the largest inner product. A code is cut into
substrings of 16 bits, each with an index of its own. Two codes within a Hamming radius agree in at least one substring up to
radius / number of substrings, so looking up the buckets that close finds every code within the radius; those are
compared as whole codes, and what lies within the radius is ranked by the original vectors in double precision.

The radius is learned on the sample: it holds ``WANTED`` of the true neighbours there. In a larger table the
neighbours are closer, so the share found only grows. Queries that find too few vectors are searched again over
everything.

Equal vectors are one entry with the smallest ``k + 1`` of their numbers, which is all that a result can show of them.
Blocks of queries meet blocks of entries, both of bounded size, wherever Spark puts them.

Nulls and odd input: vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or as
candidate; nor do rows without a vec_id and vectors of another length than most of the sample. Ties go to the smaller
vec_id. Repeated rows (equal vec_id and vector) are one. Fewer candidates than asked: all of them. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotbook.session import staged

SAMPLE, QUERY_SAMPLE = 16_384, 256
ROTATIONS, TURNS, WANTED = 4, 20, 0.97
PART = 16  # bits of a substring
INDEX_BLOCK, QUERY_BLOCK = 8_192, 1_024
FLUSH = 50_000


@dataclass
class Codes:
    size: int  # components of a vector
    longest: float
    middle: np.ndarray
    turns: np.ndarray  # [size + 1, bits]
    radius: int

    @property
    def bits(self) -> int:
        return self.turns.shape[1]

    def on_sphere(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """With one more coordinate: vectors filled up to the longest, queries scaled to its length."""
        length = np.sqrt((x * x).sum(1, keepdims=True))
        if query:
            return np.hstack([x / length, np.zeros((len(x), 1))])
        fill = np.sqrt(np.maximum(self.longest**2 - length**2, 0))
        return np.hstack([x, fill]) / self.longest

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as words of 64 bits."""
        signs = (self.on_sphere(x, query) - self.middle) @ self.turns > 0
        return np.packbits(signs, axis=1).view(np.uint64)


def learn(x: np.ndarray, longest: float, k: int) -> Codes:
    """Rotations and radius from a sample of vectors."""
    draw = np.random.default_rng(5)
    codes = Codes(x.shape[1], longest, np.zeros(x.shape[1] + 1), np.zeros((x.shape[1] + 1, 0)), 0)
    sphere = codes.on_sphere(x)
    codes.middle = sphere.mean(0)
    centred = sphere - codes.middle
    _, _, axes = np.linalg.svd(centred[: 4 * SAMPLE // 4], full_matrices=False)
    width = -(-min(len(axes), 64) // 64) * 64  # whole words of 64 bits
    projected = centred @ axes.T
    turns = []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(draw.normal(size=(max(len(axes), width), width)))[0][: len(axes)]
        if len(axes) >= width:
            for _ in range(TURNS):
                left, _, right = np.linalg.svd(projected.T @ np.sign(projected @ turn), full_matrices=False)
                turn = left @ right
        turns.append(axes.T @ turn)
    codes.turns = np.hstack(turns)
    asked = draw.permutation(len(x))[:QUERY_SAMPLE]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    all_codes, query_codes = codes.of(x), codes.of(x[asked], True)
    distances = [np.bitwise_count(all_codes[t] ^ q).sum(1) for t, q in zip(top, query_codes)]
    codes.radius = int(np.quantile(np.concatenate(distances), WANTED)) if top.size else codes.bits
    return codes


class MultiIndex:
    """One index for each substring of the codes of a block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.parts = codes.view(np.uint16)
        self.tables = []
        for part in self.parts.T:
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, code: np.ndarray, radius: int, masks: np.ndarray | None) -> np.ndarray:
        """Rows of the block whose code lies within the radius of ``code``.

        ``masks`` are all 16-bit words with few enough bits, if looking them up is less work than comparing all
        values of the index; both find the same buckets.
        """
        reach = radius // self.parts.shape[1]
        found = np.zeros(len(self.codes), dtype=bool)
        for value, (values, ends, order) in zip(code.view(np.uint16), self.tables):
            if masks is None:
                hits = np.flatnonzero(np.bitwise_count(values ^ value) <= reach)
            else:
                probes = masks ^ value
                at = np.searchsorted(values, probes)
                at[at == len(values)] = 0
                hits = at[values[at] == probes]
            if len(hits) == len(values):
                found[:] = True
                break
            lengths = ends[hits + 1] - ends[hits]
            total = int(lengths.sum())
            if total:
                first = np.repeat(ends[hits] - np.cumsum(lengths) + lengths, lengths)
                found[order[first + np.arange(total)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def few_bits(reach: int, limit: int = 1_024) -> np.ndarray | None:
    """All words of 16 bits with at most ``reach`` of them set, if there are not more than ``limit``."""
    masks = [0]
    for bits in range(1, min(reach, PART) + 1):
        masks += [sum(1 << b for b in some) for some in combinations(range(PART), bits)]
        if len(masks) > limit:
            return None
    return np.array(masks, dtype=np.uint16)


def _entries(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    """vec, ids: equal vectors of a task with their smallest numbers."""
    held: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        ids = [sorted(set(v))[: k + 1] for v in held.values()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.binary()), pa.array(ids, type=pa.list_(pa.int64()))], names=["vec", "ids"])
        held.clear()
        return batch

    for batch in batches:
        for number, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            if len(vector) != size:
                continue
            ids = held.setdefault(np.array(vector, dtype=np.float64).tobytes(), [])
            ids.append(number)
            if len(ids) > 4 * k + 64:
                ids[:] = sorted(set(ids))[: k + 1]
        if len(held) >= FLUSH:
            yield out()
    yield out()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles): vectors that take part."""
    numbers = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), numbers.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, size)


def _best(rows: dict[str, list], k: int) -> pa.Table:
    return pa.table(rows, schema=pa.schema([("query", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def _searched(entries: pa.Table, queries: pa.Table, codes: Codes, radius: int, k: int) -> pa.Table:
    """The k + 1 best numbers of one block for each query of another."""
    out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
    if not entries.num_rows or not queries.num_rows:
        return _best(out, k)
    x, q = _matrix(entries["vec"], codes.size), _matrix(queries["vec"], codes.size)
    ids = entries["ids"].to_pylist()
    index, asked = MultiIndex(codes.of(x)), codes.of(q, True)
    masks = few_bits(radius // (codes.bits // PART))
    for i, name in enumerate(queries["vec"].to_pylist()):
        rows = index.within(asked[i], radius, masks)
        scores = x[rows] @ q[i]
        if len(rows) > k + 1:  # all that tie with the last stay
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            keep = scores >= least
            rows, scores = rows[keep], scores[keep]
        found = sorted((-s, number) for r, s in zip(rows.tolist(), scores.tolist()) for number in ids[r])[: k + 1]
        out["query"] += [name] * len(found)
        out["vec_id"] += [number for _, number in found]
        out["score"] += [-s for s, _ in found]
    return _best(out, k)


def _search(entries: DataFrame, queries: DataFrame, n_entries: int, n_queries: int, codes: Codes, radius: int, k: int) -> DataFrame:
    """query, vec_id, score: for each query vector its k + 1 best over all blocks."""
    blocks, asked = -(-n_entries // INDEX_BLOCK), -(-n_queries // QUERY_BLOCK)
    place = lambda n, salt: F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("vec", "ids", place(blocks, "entry").cast("int").alias("e"), every(asked).alias("q"))
    right = queries.select("vec", place(asked, "query").cast("int").alias("q"), every(blocks).alias("e"))
    found = left.groupBy("e", "q").cogroup(right.groupBy("e", "q")).applyInArrow(
        lambda a, b: _searched(a, b, codes, radius, k), "query binary, vec_id bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``.

    The codes are learned on about ``sample`` vectors, chosen by a hash, which come to the driver.
    """
    rows = usable(vectors)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    session = vectors.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.mode(F.size("embedding")).alias("size")).first()
    if not facts["n"]:
        return session.createDataFrame([], schema)
    size = facts["size"]
    share = int(min(1.0, sample / facts["n"]) * 2**30)
    chosen = rows.where((F.size("embedding") == size) & (F.pmod(F.xxhash64("vec_id"), F.lit(2**30)) < share)).toArrow()
    if not chosen.num_rows:
        chosen = rows.where(F.size("embedding") == size).limit(1).toArrow()
    at = np.argsort(chosen["vec_id"].to_numpy(), kind="stable")
    codes = learn(np.array(chosen["embedding"].to_pylist())[at], float(facts["longest"]), k)

    partial = rows.mapInArrow(lambda batches: _entries(batches, size, k), "vec binary, ids array<bigint>")
    # a vector has at most k + 1 numbers from each task
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    entries = staged(partial.groupBy("vec").agg(merged.alias("ids")), "entries")
    asked = rows.where((F.pmod("vec_id", F.lit(every)) == 0) & (F.size("embedding") == size))
    asked = staged(asked.select("vec_id", "embedding").mapInArrow(lambda batches: _named(batches), "vec_id bigint, vec binary").distinct(), "asked")
    queries = staged(asked.select("vec").distinct(), "queries")
    n_entries, n_queries = entries.count(), queries.count()
    if not n_queries:
        return session.createDataFrame([], schema)
    found = staged(_search(entries, queries, n_entries, n_queries, codes, codes.radius, k), "found")
    enough = min(k + 1, entries.agg(F.sum(F.size("ids"))).first()[0])
    full = found.groupBy(F.col("query").alias("vec")).agg(F.count("*").alias("c")).where(F.col("c") >= enough)
    short = staged(queries.join(full, "vec", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        again = _search(entries, short, n_entries, n_short, codes, codes.bits, k)
        found = found.join(short.select(F.col("vec").alias("query")), "query", "left_anti").unionAll(again)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("best"))  # k + 1 a query
    own = asked.join(lists, asked.vec == lists.query).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.array(v, dtype=np.float64).tobytes() for v in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, type=pa.binary())], names=["vec_id", "vec"])
