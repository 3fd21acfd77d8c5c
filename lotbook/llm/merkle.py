"""A manifest of a data set as a tree of SHA-256 digests whose parents keep their hash states.

Rows are leaves, in groups. A digest enters its parent as 64 hexadecimal characters, which is one block of SHA-256,
so the state of the parent's hash before a child is eight words. A parent keeps a copy of that state for each of its
child slots. To see what root a changed leaf would give, the state before its slot is taken up again and fed the new
digest and the siblings to its right: what stands to the left is never read.

The rows are range-sorted and numbered within their group, and each run of ``BLOCK`` leaves at most is built by one
task; its roots are the leaves of the next round, so a round divides the rows by ``BLOCK``. The groups' roots are the leaves
of one more tree. A round's blocks (nodes and states, about 100 bytes a row) are written down; going
back, every block gets the part of the way to the root that lies above it, and rows are folded block by block. No group
of rows is larger than a block, whatever the size of its group.

Nulls and odd input: a null field is written as ``-``; a null group is a group of its own, before all others, and a null
number comes first in its group. Rows of one number are in order of their leaf; equal rows are leaves each. A group of one row
has its leaf as root. An empty table gives no rows. Columns with clashing names ride along only if they are selected.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.operators.rows import with_row_id
from lotbook.session import staged

BLOCK = 4096  # leaves that one task builds or folds together
WORDS = 8  # of a state


# --- SHA-256 on many messages at once ---------------------------------------------------------------


def _root(n: int, power: int) -> int:
    """The whole part of the root of n."""
    lo, hi = 0, 1 << (n.bit_length() // power + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**power <= n else (lo, mid - 1)
    return lo


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
#: By the standard's rule: 32 bits behind the point of square roots (start) and cube roots (rounds) of the first primes.
START = np.array([_root(p << 64, 2) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
ROUNDS = np.array([_root(p << 96, 3) & 0xFFFFFFFF for p in _PRIMES[:64]], np.uint32)
_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "little") for b in range(256)], "<u2")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 x n words) after a block (16 x n words) each."""
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        s0 = _turned(a, 7) ^ _turned(a, 18) ^ (a >> np.uint32(3))
        s1 = _turned(b, 17) ^ _turned(b, 19) ^ (b >> np.uint32(10))
        w.append(w[t - 16] + s0 + w[t - 7] + s1)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        s1 = _turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)
        first = h + s1 + ((e & f) ^ (~e & g)) + ROUNDS[t] + w[t]
        s0 = _turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)
        h, g, f, e = g, f, e, d + first
        d, c, b, a = c, b, a, first + s0 + ((a & b) ^ (a & c) ^ (b & c))
    return np.stack([a, b, c, d, e, f, g, h]) + state


def _as_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) as hexadecimal text, one block (16 x n words) each."""
    return _HEX[digests].view(">u4").astype(np.uint32).T


def _digests(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def _closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of so many whole blocks, from the states behind them."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0], end[15] = 0x80000000, blocks * 512
    return _digests(compress(state, end))


def _start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


# --- one block of the tree --------------------------------------------------------------------------


def _levels(n: int, fanout: int) -> int:
    """Rounds until one node is left of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _sizes(count: int, fanout: int) -> np.ndarray:
    """Children of each parent over ``count`` nodes."""
    sizes = np.full(-(-count // fanout), fanout)
    sizes[-1] = count - fanout * (len(sizes) - 1)
    return sizes


def _grow(nodes: np.ndarray, levels: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes of every level up to the root, and for each level the states its parents keep (slots 1 up, parent by parent)."""
    all_nodes, all_states = [nodes], []
    for _ in range(levels):
        sizes = _sizes(len(nodes), fanout)
        state = _start(len(sizes))
        kept = np.zeros((len(sizes), fanout - 1, WORDS), np.uint32)
        for slot in range(fanout):
            has = np.flatnonzero(sizes > slot)
            if slot:
                kept[has, slot - 1] = state[:, has].T
            if len(has):
                state[:, has] = compress(state[:, has], _as_block(nodes[fanout * has + slot]))
        nodes = _closed(state, sizes)
        all_nodes.append(nodes)
        all_states.append(kept)
    return all_nodes, all_states


def _step(
    found: np.ndarray, slot: np.ndarray, size: np.ndarray, state: np.ndarray, run: np.ndarray, fanout: int
) -> np.ndarray:
    """Digests of the parents whose child at ``slot`` is ``found``: from the state before the slot (8 x n), with the
    right siblings of the run (n x fanout x 32)."""
    state = compress(state, _as_block(found))
    for j in range(1, fanout):
        has = np.flatnonzero((j > slot) & (j < size))
        if len(has):
            state[:, has] = compress(state[:, has], _as_block(run[has, j]))
    return _closed(state, size)


def _packed(levels: list[np.ndarray]) -> bytes:
    return b"".join([x.tobytes() for x in levels])


def _unpacked(nodes: bytes, states: bytes, count: int, levels: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    all_nodes, all_states, at, at_state = [], [], 0, 0
    for level in range(levels + 1):
        all_nodes.append(np.frombuffer(nodes, np.uint8, 32 * count, at).reshape(-1, 32))
        at += 32 * count
        count = -(-count // fanout)
        if level < levels:
            words = count * (fanout - 1) * WORDS
            all_states.append(np.frombuffer(states, np.uint32, words, at_state).reshape(-1, fanout - 1, WORDS))
            at_state += 4 * words
    return all_nodes, all_states


def _way(fanout: int) -> np.dtype:
    """One step of the way from a node to the root."""
    return np.dtype([("slot", "<u4"), ("size", "<u4"), ("state", "<u4", (WORDS,)), ("run", "u1", (fanout, 32))])


def _steps(nodes: np.ndarray, states: np.ndarray, place: np.ndarray, fanout: int) -> np.ndarray:
    """The step of each of the places of a level."""
    parent, slot = place // fanout, place % fanout
    steps = np.zeros(len(place), _way(fanout))
    steps["slot"], steps["size"] = slot, _sizes(len(nodes), fanout)[parent]
    steps["state"] = np.where((slot == 0)[:, None], START, states[parent, np.maximum(slot - 1, 0)])
    padded = np.zeros((fanout * len(states), 32), np.uint8)
    padded[: len(nodes)] = nodes
    steps["run"] = padded.reshape(-1, fanout, 32)[parent]
    return steps


def _siblings(steps: np.ndarray) -> list[bytes]:
    """The others of each run as hexadecimal text, from left to right."""
    return [
        b"".join([run[j].tobytes().hex().encode() for j in range(size) if j != slot])
        for slot, size, run in zip(steps["slot"], steps["size"], steps["run"])
    ]


def _binary(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


# --- the tree ---------------------------------------------------------------------------------------


@dataclass
class Manifest:
    """``rows`` with _group, _place and _block; ``above``: for each block of rows its nodes and states, its way to the root, its
    subroot; ``root`` in hexadecimal (None without rows)."""

    rows: DataFrame
    above: DataFrame | None
    root: str | None
    leaf: str
    fanout: int


def field(column: Column) -> Column:
    """The length in bytes and the value, or ``-``."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    """The digest of a row, as hexadecimal text."""
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _rounds(nodes: DataFrame, fanout: int, largest: int, label: str) -> list[DataFrame]:
    """Blocks of every round, written down: _group, _block, _count, _levels, _left, _nodes, _states, _digest (its root).

    ``nodes``: _group, _place, _digest, _left (levels still to build, or, at first, null and _size).
    """
    depth = max(_levels(BLOCK + 1, fanout) - 1, 1)
    width = fanout**depth

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        left, count = table.column("_left")[0].as_py(), table.num_rows
        levels = min(depth, left)
        grown, states = _grow(_binary(table.column("_digest")), levels, fanout)
        row = (table.column("_group")[0].as_py(), table.column("_place")[0].as_py() // width, count, levels, left - levels,
               _packed(grown), _packed(states), grown[-1][0].tobytes())
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    names = ["_group", "_block", "_count", "_levels", "_left", "_nodes", "_states", "_digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    schema = ("_group bigint, _block bigint, _count int, _levels int, _left int, _nodes binary, _states binary, _digest binary")
    rounds: list[DataFrame] = []
    left = _levels(largest, fanout)
    while True:
        keyed = nodes.withColumn("_block", F.floor(F.col("_place") / width)).select("_group", "_block", "_place", "_digest", "_left")
        blocks = staged(keyed.groupBy("_group", "_block").applyInArrow(build, schema), label)
        rounds.append(blocks)
        left -= depth
        if left <= 0:
            return rounds
        nodes = blocks.where("_left > 0").select("_group", F.col("_block").alias("_place"), "_digest", "_left")


def _ways(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """_group, _place, _way, _subroot of every leaf of the blocks. ``above``: _group, _block, _way, _subroot, one row a block."""

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes, states = _unpacked(row["_nodes"], row["_states"], row["_count"], row["_levels"], fanout)
                place = np.arange(row["_count"])
                steps = []
                for level in range(row["_levels"]):
                    steps.append(_steps(nodes[level], states[level], place, fanout))
                    place = place // fanout
                ways = [b"".join([s[i].tobytes() for s in steps]) + row["_way"] for i in range(row["_count"])]
                first = row["_block"] * width
                columns = [[row["_group"]] * len(ways), range(first, first + len(ways)), ways, [row["_subroot"]] * len(ways)]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    width = fanout ** max(_levels(BLOCK + 1, fanout) - 1, 1)
    names = ["_group", "_place", "_way", "_subroot"]
    both = blocks.drop("_digest").join(above, ["_group", "_block"])
    return both.mapInArrow(spread, "_group bigint, _place bigint, _way binary, _subroot binary")


def build(rows: DataFrame, group: str, order: str, leaf: str, fanout: int = 2) -> Manifest:
    """The tree over ``rows``, whose column ``leaf`` holds their digests in hexadecimal."""
    if not 2 <= fanout <= BLOCK:
        raise ValueError(f"a fan-out of 2 to {BLOCK}")
    spark = rows.sparkSession
    # the leaves are read by the sort (twice) and by what follows: whole rows are hashed once
    numbered = with_row_id(staged(rows, "leaves"), [group, order, leaf], "_number")
    firsts = numbered.groupBy(group).agg(F.min("_number").alias("_first"), F.count("*").alias("_size"))
    groups = staged(with_row_id(firsts, [group], "_group"), "groups")
    n_groups, largest = groups.agg(F.count("*"), F.max("_size")).first()
    depth = max(_levels(BLOCK + 1, fanout) - 1, 1)
    placed = numbered.join(groups.withColumnRenamed(group, "_of"), F.col(group).eqNullSafe(F.col("_of"))).drop("_of")
    placed = placed.withColumn("_place", F.col("_number") - F.col("_first"))
    placed = placed.withColumn("_block", F.floor(F.col("_place") / fanout**depth)).drop("_number", "_first")
    if not n_groups:
        return Manifest(placed, None, None, leaf, fanout)
    nodes = placed.withColumns({"_digest": F.unhex(leaf), "_left": _levels_of("_size", largest, fanout)})
    rounds = _rounds(nodes, fanout, largest, "blocks")
    done = reduce(DataFrame.unionAll, [
        b.where("_left = 0").select("_group", "_digest", F.lit(i).alias("_round")) for i, b in enumerate(rounds)
    ])
    subroots = staged(done, "subroots")
    # one more tree over the roots of the groups
    tops = subroots.select(F.lit(0).cast("bigint").alias("_group"), F.col("_group").alias("_place"), "_digest",
                           F.lit(_levels(n_groups, fanout)).alias("_left"))
    top_rounds = _rounds(tops, fanout, n_groups, "top")
    root = top_rounds[-1].select("_digest").first()[0]
    ways = spark.createDataFrame([(0, 0, b"", None)], "_group bigint, _block bigint, _way binary, _subroot binary")
    for blocks in reversed(top_rounds):
        ways = staged(_ways(blocks, ways, fanout), "ways").withColumnRenamed("_place", "_block")
    to_root = ways.select(F.col("_block").alias("_group"), "_way")
    ends = subroots.join(to_root, "_group").select(
        "_group", F.lit(0).cast("bigint").alias("_block"), "_way", F.col("_digest").alias("_subroot"), "_round")
    above = None
    for i in reversed(range(len(rounds))):
        here = ends.where(F.col("_round") == i).drop("_round")
        if above is not None:
            upper = staged(_ways(rounds[i + 1], above, fanout), "ways")
            here = here.unionByName(upper.withColumnRenamed("_place", "_block"))
        above = here
    leaf_blocks = rounds[0].drop("_digest", "_left").join(above, ["_group", "_block"])
    return Manifest(placed.drop("_size"), staged(leaf_blocks, "manifest"), root.hex(), leaf, fanout)


def _levels_of(size: str, largest: int, fanout: int) -> Column:
    """As ``_levels``, for a column."""
    levels, reach = F.lit(0), 1
    for level in range(_levels(largest, fanout)):
        levels = F.when(F.col(size) > F.lit(reach).cast("bigint"), level + 1).otherwise(levels)
        reach *= fanout
    return levels


def fold(manifest: Manifest, candidate: str) -> DataFrame:
    """Each row with subroot, root, proof_sha256 (of its siblings up to the root), folded_root (the root that the digest in
    ``candidate`` would give in the row's place) and verified."""
    fanout, root = manifest.fanout, manifest.root
    more = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    own = [f for f in manifest.rows.schema.fields if f.name not in ("_group", "_place", "_block")]
    schema = T.StructType([*own, *T.StructType.fromDDL(more).fields])
    if manifest.above is None:
        return manifest.rows.sparkSession.createDataFrame([], schema)
    names, kept = [f.name for f in schema.fields], [f.name for f in own]

    def folded(rows: pa.Table, block: pa.Table) -> pa.Table:
        (top,) = block.to_pylist()
        nodes, states = _unpacked(top["_nodes"], top["_states"], top["_count"], top["_levels"], fanout)
        place = rows.column("_place").to_numpy() % width
        found = _binary(rows.column(candidate))
        proofs = [[] for _ in place]
        for level in range(top["_levels"]):
            steps = _steps(nodes[level], states[level], place, fanout)
            found = _step(found, steps["slot"], steps["size"], steps["state"].T.copy(), steps["run"], fanout)
            for proof, part in zip(proofs, _siblings(steps)):
                proof.append(part)
            place = place // fanout
        way = np.frombuffer(top["_way"], _way(fanout))
        rest = b"".join(_siblings(way))
        # above the block all rows go the same way, so equal digests are folded once
        different, which = np.unique(found.view("V32").ravel(), return_inverse=True)
        found = different.view(np.uint8).reshape(-1, 32)
        for step in way:
            one = np.repeat(step[None], len(found))
            found = _step(found, one["slot"], one["size"], one["state"].T.copy(), one["run"], fanout)
        roots = [f.tobytes().hex() for f in found]
        folds = [roots[i] for i in which.ravel()]
        n = rows.num_rows
        columns = [rows.column(c) for c in kept]
        columns += [[top["_subroot"].hex()] * n, [root] * n,
                    [hashlib.sha256(b"".join([*p, rest])).hexdigest() for p in proofs], folds, [f == root for f in folds]]
        kinds = [*[c.type for c in columns[: len(kept)]], *[pa.string()] * 4, pa.bool_()]
        columns = [c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds)]
        columns[kept.index(candidate)] = pa.array([f.hex() for f in rows.column(candidate).to_pylist()], pa.string())
        return pa.table(columns, names=names)

    width = fanout ** max(_levels(BLOCK + 1, fanout) - 1, 1)
    rows = manifest.rows.withColumn(candidate, F.unhex(candidate))
    return rows.groupBy("_group", "_block").cogroup(manifest.above.groupBy("_group", "_block")).applyInArrow(folded, schema)


def verify_documents(docs: DataFrame, every: int = 7, fanout: int = 2) -> DataFrame:
    """doc_id, leaf and the columns of ``fold``, with the rows tampered whose number's crc32 ``every`` divides."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    told = {c: F.col(c) for c in fields}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    other = told | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    leaf = leaf_of(*told.values())
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", leaf.alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_of(*other.values())).otherwise(leaf).alias("candidate"),
    )
    return fold(build(rows, "lang", "doc_id", "leaf", fanout), "candidate").drop("lang", "candidate")
