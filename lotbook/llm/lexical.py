"""Ranked search for the terms of items among all documents, by branch and bound over document FP-trees.

Each document is cut down to the terms that some item holds, in the order of how many documents hold a term,
most first. Documents of a chunk whose cut vectors begin alike share a path of a trie; paths without a fork are one node.
A node keeps for its subtree the greatest count of each term and the least length measure m; as a score grows with the counts and falls
with m, these bound the scores below the node. The trie is walked depth first for all items at once: a node is
left for an item as soon as its bound is below the item's last place so far, and what reaches a leaf is scored exactly. A bound
that equals the last place is followed, as a smaller number wins a tie. Each task ends with its best documents of each
item; their best are found in two steps, first within parts of an item's rows.

The items are the stated queries: their terms travel to the tasks in parts of ``ITEM_BYTES`` of text (found by a sum
before anything is collected); for more text than that, the search runs once for each part. A task works on as many items at a time
as make ``CELLS`` weights, so its memory depends neither on the number of items nor on that of documents.

Nulls and odd input: a document without terms (null, empty, marks only) counts nowhere; an item without terms has no rows.
A null document number loses every tie. Repeated documents take a place each, and so do repeated items. Texts of any length are
counted in stretches. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotbook.llm.rows import text_column
from lotbook.session import staged

BEST = 50
ITEM_BYTES = 16 << 20
CELLS = 4_000_000
CHUNK, ENTRIES = 4096, 1_000_000  # documents, and terms in them, of one trie
STRETCH = 1 << 20
PARTS = 64  # parts of an item's rows in the first step of the ranking
FEW = 4  # documents below a node for which a bound is no gain
EXACT = 1 << 53

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII; only A-Z are made small.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def _stretches(text: str) -> Iterator[list[bytes]]:
    data = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def terms_of(text: str | None) -> set[bytes]:
    return {t for words in _stretches(text or "") for t in words}


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _restricted(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Documents with a term: how many they have, and how often each of the items' terms."""
    get = number.get
    for batch in batches:
        doc_ids, sizes, terms, counts = [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_column(batch, "text")):
            n, found = 0, Counter()
            for words in _stretches(text):
                n += len(words)
                found.update(map(get, words))
            if n:
                found.pop(None, None)
                doc_ids.append(doc_id)
                sizes.append(n)
                terms.append(np.fromiter(found.keys(), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
        columns = [pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(terms), _lists(counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])


def _document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the items' terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["term", "df"])

    found = np.zeros(size, np.int64)
    parts = vectors.select("terms").mapInArrow(counted, "term int, df bigint")
    for row in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the items
        found[row["term"]] = row["df"]
    return found


# --- the tree ---------------------------------------------------------------------------------------


@dataclass
class Node:
    """Terms with their greatest counts and the least m of the documents below; ``document`` for a leaf."""

    terms: np.ndarray
    counts: np.ndarray
    m: int
    size: int
    document: int = -1
    children: list[Node] = field(default_factory=list)


def _joined(children: list[Node]) -> Node:
    if len(children) == 1:
        return children[0]
    terms = np.concatenate([c.terms for c in children])
    counts = np.concatenate([c.counts for c in children])
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    firsts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    greatest = np.maximum.reduceat(counts[order], firsts)
    return Node(terms[firsts], greatest, min(c.m for c in children), sum(c.size for c in children), children=children)


def tree(leaves: list[Node]) -> Node:
    """The trie over leaves whose ``terms`` ascend in the order of the tree; a fork is where vectors part."""
    leaves = sorted(leaves, key=lambda leaf: leaf.terms.astype(">u4").tobytes())
    open_nodes: list[tuple[int, list[Node]]] = [(0, [])]
    for leaf, after in zip(leaves, [*leaves[1:], None]):
        alike = 0
        if after is not None:
            least = min(len(leaf.terms), len(after.terms))
            apart = np.flatnonzero(leaf.terms[:least] != after.terms[:least])
            alike = int(apart[0]) if len(apart) else least
        done = leaf
        while open_nodes[-1][0] > alike:
            _, children = open_nodes.pop()
            done = _joined([*children, done])
        if open_nodes[-1][0] < alike:
            open_nodes.append((alike, []))
        open_nodes[-1][1].append(done)
    return _joined(open_nodes[0][1])


def _shares(counts: np.ndarray, m: int) -> np.ndarray:
    """What a term of weight 1 adds to a score."""
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


class Search:
    """The best documents so far of each of some items."""

    def __init__(self, weights: np.ndarray, best: int) -> None:
        self.weights, self.best = weights, best  # terms x items
        items = weights.shape[1]
        self.least = np.ones(items, weights.dtype)  # below this, a document has no place
        self.places: list[list[tuple]] = [[] for _ in range(items)]

    def _scores(self, node: Node, items: np.ndarray) -> np.ndarray:
        weights = self.weights[node.terms]
        if len(items) < weights.shape[1]:
            weights = weights[:, items]
        return _shares(node.counts, node.m).astype(weights.dtype) @ weights

    def walk(self, root: Node, doc_ids: list) -> None:
        left = [(root, np.arange(self.weights.shape[1]))]
        while left:
            node, items = left.pop()
            if node.children and node.size < FEW:
                left += [(c, items) for c in reversed(node.children)]
                continue
            scores = self._scores(node, items)
            kept = scores >= self.least[items]
            items = items[kept]
            if not len(items):
                continue
            if node.children:
                left += [(c, items) for c in reversed(node.children)]
                continue
            number = doc_ids[node.document]
            tie = -math.inf if number is None else -number
            for item, score in zip(items.tolist(), scores[kept].tolist()):
                places = self.places[item]
                if len(places) < self.best:
                    heappush(places, (int(score), tie))
                elif (score, tie) > places[0]:
                    heapreplace(places, (int(score), tie))
                if len(places) == self.best:
                    self.least[item] = places[0][0]


@dataclass
class Group:
    """Items that are searched for together: their numbers, the place of each of the items' terms in the tree's order (-1: in
    none of them), and the weights in that order."""

    items: list[int]
    place: np.ndarray
    weights: np.ndarray


def _groups(items: list[list[int]], df: np.ndarray, weight: np.ndarray) -> list[Group]:
    order = np.lexsort((np.arange(len(df)), -df))  # terms by falling number of documents
    groups, members, terms = [], [], set()

    def close() -> None:
        held = [t for t in order.tolist() if t in terms]
        place = np.full(len(df), -1, np.int32)
        place[held] = np.arange(len(held))
        # sums of whole numbers are exact in doubles up to 2^53, and much faster than in integers
        most = max(len(items[i]) for i in members) * int(weight.max(initial=1)) * 1_000_000
        weights = np.zeros((len(held), len(members)), np.float64 if most < EXACT else np.int64)
        for column, item in enumerate(members):
            weights[place[items[item]], column] = weight[items[item]]
        groups.append(Group(list(members), place, weights))

    for item, own in enumerate(items):
        if members and len(terms.union(own)) * (len(members) + 1) > CELLS:
            close()
            members, terms = [], set()
        members.append(item)
        terms.update(own)
    if members:
        close()
    return groups


def _searched(batches: Iterator[pa.RecordBatch], groups: list[Group], totals: tuple[int, int], best: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each item among those of the task."""
    n_documents, all_terms = totals
    searches = [Search(g.weights, best) for g in groups]

    def search(rows: list[tuple]) -> None:
        doc_ids = [r[0] for r in rows]
        for group, found in zip(groups, searches):
            leaves = []
            for at, (_, m, terms, counts) in enumerate(rows):
                place = group.place[terms]
                own = place >= 0
                order = np.argsort(place[own])
                if len(order):
                    leaves.append(Node(place[own][order], counts[own][order], m, 1, at))
            if leaves:
                found.walk(tree(leaves), doc_ids)

    rows, entries = [], 0
    for batch in batches:
        m = 50 + 50 * batch.column("n").to_numpy() * n_documents // all_terms
        ends = batch.column("terms").offsets.to_numpy()
        terms, counts = (batch.column(c).values.to_numpy() for c in ("terms", "counts"))
        for doc_id, own_m, a, b in zip(batch.column("doc_id").to_pylist(), m.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            rows.append((doc_id, own_m, terms[a:b], counts[a:b]))
            entries += b - a
            if len(rows) >= CHUNK or entries >= ENTRIES:
                search(rows)
                rows, entries = [], 0
    search(rows)
    out = [
        (item, None if tie == -math.inf else -tie, score)
        for group, found in zip(groups, searches) for item, places in zip(group.items, found.places) for score, tie in places
    ]
    columns = list(zip(*out)) if out else [()] * 3
    kinds = (pa.int32(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_item", "doc_id", "score"])


def _search_part(docs: DataFrame, items: DataFrame, best: int) -> DataFrame:
    rows = [(r["item_id"], sorted(terms_of(r["text"]))) for r in items.collect()]  # at most about ITEM_BYTES of text
    rows = [r for r in rows if r[1]]
    vocabulary = sorted({t for _, terms in rows for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    vectors = staged(wanted.mapInArrow(lambda batches: _restricted(batches, number), VECTORS), "vectors")
    n_documents, all_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ids = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"_item int, item_id {dict(items.dtypes)['item_id']}")
    df = _document_counts(vectors, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    groups = _groups([[number[t] for t in terms] for _, terms in rows], df, weight)
    totals = (n_documents, max(all_terms, 1))
    local = vectors.mapInArrow(lambda batches: _searched(batches, groups, totals, best), "_item int, doc_id bigint, score bigint")
    return local.join(F.broadcast(ids), "_item")  # as many rows as items were collected


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0."""
    items = items.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = size // ITEM_BYTES + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = reduce(DataFrame.unionAll, [
        _search_part(docs, items.where(part == i), best).withColumn("_part", F.lit(i)) for i in range(parts)
    ])
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    first = Window.partitionBy("_part", "_item", "_salt").orderBy(*order)
    second = Window.partitionBy("_part", "_item").orderBy(*order)
    shortened = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    ranked = shortened.withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")
