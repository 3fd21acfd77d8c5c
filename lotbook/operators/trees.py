"""Forests, boosted trees and class trees for tables of any size, on rows of coded bytes.

Spark's own trainer keeps some 330 bytes of objects for each row, and a dense row of all slots for one-hot features. Here a row is one
byte for each column (two or four where a column has more than 256 values) and its label, in blocks of rows. Candidate splits, order of
categories, gains, stopping rules and pruning are those of Spark's trainer, and the result is a model of Spark's; without a
bootstrap it is the same model but for the order of sums. A level of all trees is one Spark job: tasks walk their rows down and count what lies in
which bin, the sums of a node meet in one group, which finds its best split, and the driver gets one row a node.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.session import scratch_path

NUMBER, CATEGORY, ONE_HOT = "number", "category", "one_hot"
BLOCK, FILE_BLOCKS = 1 << 17, 8  # rows of a block, blocks of a file and of an Arrow batch
CELLS = 16_000_000  # sums that a task keeps at a time; more nodes than fit are dealt with in further passes
SENT = 64  # nodes whose sums a task hands over at a time
SPLIT_ROWS = 10_000  # rows that candidate splits of numbers are taken from, as in Spark's trainer
PURE = 2.0**-52

NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, "
    "split struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>"
)
BEST = "slot int, column int, feature int, gain double, goes binary, split binary, total binary, left binary, right binary"


@dataclass(frozen=True)
class Column:
    """A coded column. ``first``: number of its (first) feature; ``thresholds``: between the bins of a number."""

    name: str
    kind: str
    bins: int
    first: int
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass(frozen=True)
class Coded:
    """``rows``: blocks of id, n, codes and label. ``classes``: 0 for a number as label."""

    rows: DataFrame
    columns: list[Column]
    classes: int
    unordered: int  # categories of all subsets are tried up to this number of them

    @property
    def stats(self) -> int:
        return self.classes or 3

    @property
    def features(self) -> int:
        last = self.columns[-1]
        return last.first + (last.bins if last.kind == ONE_HOT else 1)


def fits(model: Estimator) -> bool:
    """Whether ``fit`` does what this estimator asks for."""
    plain = {"minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "subsamplingRate": 1.0, "bootstrap": True, "lossType": "squared", "leafCol": ""}
    if not isinstance(model, (RandomForestRegressor, GBTRegressor, DecisionTreeClassifier)):
        return False
    if any(model.hasParam(n) and model.getOrDefault(n) != v for n, v in plain.items()):
        return False
    if any(model.hasParam(n) and model.isSet(n) for n in ("weightCol", "validationIndicatorCol", "thresholds")):
        return False
    if isinstance(model, RandomForestRegressor) and model.getNumTrees() > 1 and model.getFeatureSubsetStrategy() != "all":
        return False
    return not isinstance(model, GBTRegressor) or model.getFeatureSubsetStrategy() == "all"


# --- coding ---------------------------------------------------------------------------------------------


def thresholds(values: np.ndarray, splits: int) -> np.ndarray:
    """Midpoints between all values if these are no more than ``splits``, else between about equally full parts."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= splits:
        return middles
    stride = len(values) / (splits + 1)
    target, up_to, kept = stride, counts.cumsum(), []
    for i, middle in enumerate(middles):
        if abs(up_to[i] - target) < abs(up_to[i + 1] - target):
            kept.append(middle)
            target += stride
    return np.array(kept)


def code(rows: DataFrame, inputs: Sequence[tuple[str, str, int]], label: str, max_bins: int, seed: int, classes: int = 0) -> Coded:
    """``rows``: a written table. ``inputs``: (column, kind, number of categories) in the order of the features."""
    total = rows.count()
    bins = min(max_bins, total)
    numbers = [name for name, kind, _ in inputs if kind == NUMBER]
    share = max(bins**2, SPLIT_ROWS) / max(total, 1)
    seen = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers])
    seen = (seen.sample(False, share, seed) if share < 1 else seen).toArrow() if numbers else None
    columns, first = [], 0
    for name, kind, size in inputs:
        if kind == CATEGORY and size > bins:
            raise ValueError(f"{name} has {size} categories, more than {bins} bins")
        cuts = np.zeros(0)
        if kind == NUMBER:
            values = seen[name].drop_null().to_numpy()
            cuts, size = thresholds(values[~np.isnan(values)], bins - 1), 1
        columns.append(Column(name, kind, len(cuts) + 1 if kind == NUMBER else size, first, cuts))
        first += size if kind == ONE_HOT else 1
    dtype = _dtype(columns)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        codes, labels, kept = [], [], 0

        def out(c: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            cells = [pa.array([(part << 32) + made]), pa.array([len(y)], type=pa.int32()),
                     *[pa.array([a.tobytes()], type=pa.binary()) for a in (c, y)]]
            return pa.RecordBatch.from_arrays(cells, names=["id", "n", "codes", "label"])

        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if any(np.isnan(v).any() for v in values) or not np.isfinite(values[-1]).all():
                raise ValueError("features and labels must not be null, and labels must be finite")
            if classes and not np.isin(values[-1], np.arange(classes)).all():
                raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
            codes.append(np.array([np.searchsorted(c.thresholds, v) if c.kind == NUMBER else v for c, v in zip(columns, values)]).astype(dtype))
            labels.append(values[-1])
            kept += len(values[-1])
            if kept >= BLOCK:
                c, y = np.concatenate(codes, axis=1), np.concatenate(labels)
                for at in range(0, kept - BLOCK + 1, BLOCK):
                    yield out(c[:, at : at + BLOCK], y[at : at + BLOCK])
                whole = kept // BLOCK * BLOCK
                codes, labels, kept = [c[:, whole:]], [y[whole:]], kept - whole
        if kept:
            yield out(np.concatenate(codes, axis=1), np.concatenate(labels))

    wide = rows.select(*[F.col(f"`{c.name}`").cast("double") for c in columns], F.col(label).cast("double"))
    blocks = wide.mapInArrow(coded, "id bigint, n int, codes binary, label binary")
    unordered = int(math.log2(bins // 2 + 1) + 1) if classes > 2 else 0
    return Coded(_written(blocks), columns, classes, unordered)


def _written(blocks: DataFrame) -> DataFrame:
    """Blocks in files of a few each, read a few at a time; these are settings of a session of its own over the same context."""
    path, spark = scratch_path(blocks.sparkSession, "tree-rows"), blocks.sparkSession
    blocks.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    reader = spark.newSession()
    few = {"execution.arrow.maxRecordsPerBatch": str(FILE_BLOCKS), "inMemoryColumnarStorage.batchSize": str(FILE_BLOCKS)}
    for name, value in {**few, "shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        reader.conf.set(f"spark.sql.{name}", value)
    return reader.read.schema(blocks.schema).parquet(path)


# --- growing --------------------------------------------------------------------------------------------


@dataclass
class Node:
    depth: int
    stats: np.ndarray | None = None
    valid: bool = True
    gain: float = -1.0
    column: int = 0
    feature: int = -1
    split: np.ndarray | None = None  # threshold, or categories that go left
    goes: np.ndarray | None = None  # by code (one-hot: by whether the code is that of the slot): 1 for left
    children: tuple[int, int] | None = None


def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Variance, or entropy of class counts, along the last axis; 0 without rows."""
    stats = np.asarray(stats, dtype=np.float64)
    if not classes:
        n, s, q = stats[..., 0], stats[..., 1], stats[..., 2]
        some = np.where(n == 0, 1, n)
        return np.where(n == 0, 0.0, (q - s * s / some) / some)
    n = stats.sum(axis=-1, keepdims=True)
    share = stats / np.where(n == 0, 1, n)
    return -(share * np.log(np.where(share == 0, 1, share)) / math.log(2)).sum(axis=-1)


def prediction(stats: np.ndarray, classes: int) -> float:
    if classes:
        return float(np.argmax(stats))
    return float(stats[1] / stats[0]) if stats[0] else 0.0


def _rows_of(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=-1) if classes else stats[..., 0]


def _centroids(stats: np.ndarray, classes: int) -> np.ndarray:
    """What categories are ordered by; those without rows come last."""
    n = _rows_of(stats, classes)
    by = impurity(stats, classes) if classes > 2 else stats[..., 1] / (1 if classes else np.where(n == 0, 1, n))
    return np.where(n == 0, np.inf, by)


def best_split(sums: np.ndarray, columns: Sequence[Column], classes: int, unordered: int, least: int) -> tuple:
    """(gain, column, feature, goes, split, total, left, right) of the best split of a node; ``sums``: stats of all bins of all columns."""
    total = sums[: columns[0].bins].sum(axis=0)
    whole, best, at = float(impurity(total, classes)), None, 0
    for c, column in enumerate(columns):
        bins, at = sums[at : at + column.bins], at + column.bins
        order = np.arange(column.bins)
        if column.kind == ONE_HOT:
            one, rest = bins, bins.sum(axis=0) - bins
            first = np.zeros(len(bins), bool) if unordered >= 2 else _centroids(one, classes) < _centroids(rest, classes)
            left, right = np.where(first[:, None], one, rest), np.where(first[:, None], rest, one)
        elif column.bins < 2:
            continue
        elif column.kind == CATEGORY and column.bins <= unordered:
            subsets = (np.arange(1, 1 << (column.bins - 1))[:, None] >> order) & 1
            left = subsets @ bins
            right = total - left
        else:
            if column.kind == CATEGORY:
                order = np.argsort(_centroids(bins, classes), kind="stable")
            up_to = bins[order].cumsum(axis=0)
            left, right = up_to[:-1], up_to[-1] - up_to[:-1]
        n_left, n_right = _rows_of(left, classes), _rows_of(right, classes)
        n = np.maximum(n_left + n_right, 1)
        gains = whole - n_left / n * impurity(left, classes) - n_right / n * impurity(right, classes)
        gains[(np.minimum(n_left, n_right) < least) | (gains < 0)] = -np.inf
        i = int(np.argmax(gains))
        if best is None or gains[i] > best[0]:
            feature = column.first + (i if column.kind == ONE_HOT else 0)
            if column.kind == ONE_HOT:
                goes = np.array([not first[i], first[i]])
            elif column.kind == CATEGORY and column.bins <= unordered:
                goes = subsets[i].astype(bool)
            else:
                goes = np.isin(np.arange(column.bins), order[: i + 1])
            split = column.thresholds[i : i + 1] if column.kind == NUMBER else np.flatnonzero(goes).astype(np.float64)
            best = float(gains[i]), c, feature, goes, split, total, left[i], right[i]
    none = np.zeros(0)
    return best or (-math.inf, -1, -1, none.astype(bool), none, total, np.zeros_like(total), np.zeros_like(total))


@dataclass(frozen=True)
class Walker:
    """A tree as arrays: from a node, the code in ``column`` (or whether it is ``key``, where that is not negative) leads to ``to``."""

    column: np.ndarray
    key: np.ndarray
    to: np.ndarray
    steps: int
    inner: np.ndarray | None  # where columns of one-hot slots are among the features: whether a node has children

    @staticmethod
    def of(nodes: Sequence[Node], columns: Sequence[Column]) -> Walker:
        width = max([2, *[c.bins for c in columns if c.kind != ONE_HOT]])
        column, key = np.zeros(len(nodes), np.intp), np.full(len(nodes), -1)
        to = np.repeat(np.arange(len(nodes), dtype=np.intp)[:, None], width, axis=1)
        for i, node in enumerate(nodes):
            if node.children:
                column[i] = node.column
                to[i, : len(node.goes)] = np.where(node.goes, *node.children)
                if columns[node.column].kind == ONE_HOT:
                    key[i] = node.feature - columns[node.column].first
        hot = any(c.kind == ONE_HOT for c in columns)
        return Walker(column, key, to, max(n.depth for n in nodes), np.array([bool(n.children) for n in nodes]) if hot else None)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node each row ends in. A leaf leads to itself by every code below the width; those of one-hot slots may be above it."""
        n, flat, to = codes.shape[1], codes.ravel(), self.to.ravel()
        node, each = np.zeros(n, np.intp), np.arange(n)
        for _ in range(self.steps):
            found = flat.take(self.column.take(node) * n + each)
            if self.inner is not None:
                key = self.key.take(node)
                found = np.where(key >= 0, found == key, np.where(self.inner.take(node), found, 0))
            node = to.take(node * self.to.shape[1] + found)
        return node


def _blocks(batches: Iterator[pa.RecordBatch], columns: int, dtype: type) -> Iterator[tuple]:
    """id, codes, label, score (None before the first tree)."""
    for batch in batches:
        for cells in zip(*[batch.column(c) for c in range(batch.num_columns)]):
            got = dict(zip(batch.schema.names, cells))
            n, score = got["n"].as_py(), got.get("score")
            codes = np.frombuffer(got["codes"].as_buffer(), dtype).reshape(columns, n)
            yield got["id"].as_py(), codes, np.frombuffer(got["label"].as_buffer()), None if score is None else np.frombuffer(score.as_buffer())


def _dtype(columns: Sequence[Column]) -> type:
    widest = max(c.bins for c in columns)
    return np.uint8 if widest <= 1 << 8 else np.uint16 if widest <= 1 << 16 else np.int32


def _add_sums(sums: list[np.ndarray], codes: np.ndarray, slot: np.ndarray, y: np.ndarray, weight: np.ndarray | None, columns: Sequence[Column],
              classes: int) -> None:
    """Adds rows to ``sums``, one array (slots, bins, stats) a column. ``slot``: -1 for rows of other nodes."""
    used = slot >= 0 if weight is None else (slot >= 0) & (weight > 0)
    if not used.all():
        at = np.flatnonzero(used)
        codes, slot, y, weight = codes.take(at, axis=1), slot.take(at), y.take(at), None if weight is None else weight.take(at)
    if not classes:
        first = y if weight is None else weight * y
        parts = [weight, first, first * y]
    for column, code, into in zip(columns, codes, sums):
        cell = slot * column.bins + code
        if classes:
            cell = cell * classes + y.astype(np.intp)
            into += np.bincount(cell, weight, into.size).reshape(into.shape)
        else:
            for i, part in enumerate(parts):
                into[..., i] += np.bincount(cell, part, into.shape[0] * column.bins).reshape(into.shape[:2])


def _best(coded: Coded, rows: DataFrame, trees: Sequence[list[Node]], group: Sequence[tuple[int, int]], seed: int | None, least: int) -> list:
    """The best split of each node (tree, number) of ``group``, in their order, from one job. ``seed``: of a bootstrap."""
    columns, classes, n_stats, unordered, dtype = coded.columns, coded.classes, coded.stats, coded.unordered, _dtype(coded.columns)
    work: list[tuple] = []
    for t in dict.fromkeys(t for t, _ in group):
        slots = np.full(len(trees[t]), -1)
        mine = [i for i, (tree, _) in enumerate(group) if tree == t]
        for i in mine:
            slots[group[i][1]] = i - mine[0]
        work.append((t, Walker.of(trees[t], columns), slots, mine[0], len(mine)))
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(work)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, work = TaskContext.get().partitionId(), shared.value
        sums = [[np.zeros((k, c.bins, n_stats)) for c in columns] for *_, k in work]
        some = False
        for block, codes, label, score in _blocks(batches, len(columns), dtype):
            some = True
            y = label if score is None else 2.0 * (label - score)
            for (t, walker, slots, _, _), into in zip(work, sums):
                drawn = None if seed is None else np.random.default_rng([seed & (1 << 63) - 1, t, block]).poisson(1.0, len(y)).astype(np.float64)
                _add_sums(into, codes, slots.take(walker.nodes(codes)), y, drawn, columns, classes)
        for (*_, start, k), into in zip(work, sums) if some else ():
            for i in range(0, k, SENT):
                cut = np.concatenate([s[i : i + SENT] for s in into], axis=1)
                here = np.flatnonzero(cut.any(axis=(1, 2)))
                cells = [pa.array((here + start + i).astype(np.int32)), pa.array([part] * len(here), type=pa.int32()),
                         pa.array([cut[j].tobytes() for j in here], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["slot", "part", "sums"])

    def chosen(table: pa.Table) -> pa.Table:
        total = 0.0
        for i in np.argsort(table["part"].to_numpy(), kind="stable"):  # always in this order, so that a fit repeats
            total = total + np.frombuffer(table["sums"][int(i)].as_buffer()).reshape(-1, n_stats)
        gain, column, feature, *arrays = best_split(total, columns, classes, unordered, least)
        cells = [[table["slot"][0].as_py()], [column], [feature], [gain], *[[a.tobytes()] for a in arrays]]
        types = [pa.int32()] * 3 + [pa.float64()] + [pa.binary()] * 5
        return pa.table({n.split()[0]: pa.array(c, type=k) for n, c, k in zip(BEST.split(", "), cells, types)})

    sums = rows.mapInArrow(summed, "slot int, part int, sums binary")
    found = {r["slot"]: r for r in sums.groupBy("slot").applyInArrow(chosen, BEST).toArrow().to_pylist()}
    shared.unpersist()
    return [found.get(i) for i in range(len(group))]


def grow(coded: Coded, rows: DataFrame, n_trees: int, depth: int, seed: int | None, least: int = 1) -> list[list[Node]]:
    """Trees, level by level; ``rows`` are those of ``coded``, maybe with scores."""
    trees = [[Node(0)] for _ in range(n_trees)]
    active = [(t, 0) for t in range(n_trees)]
    fit_in = max(1, CELLS // (sum(c.bins for c in coded.columns) * coded.stats))
    while active:
        below: list[tuple[int, int]] = []
        for at in range(0, len(active), fit_in):
            group = active[at : at + fit_in]
            for (t, i), best in zip(group, _best(coded, rows, trees, group, seed, least)):
                node = trees[t][i]
                if best is None:  # no row was drawn
                    node.stats, node.valid = np.zeros(coded.stats), False
                    continue
                total, left, right = (np.frombuffer(best[k]) for k in ("total", "left", "right"))
                node.stats = total if node.stats is None else node.stats
                node.valid = math.isfinite(best["gain"])
                if not best["gain"] > 0 or node.depth == depth:
                    continue
                node.gain, node.column, node.feature = best["gain"], best["column"], best["feature"]
                node.goes, node.split = np.frombuffer(best["goes"], bool), np.frombuffer(best["split"])
                node.children = len(trees[t]), len(trees[t]) + 1
                for stats in (left, right):
                    trees[t].append(Node(node.depth + 1, stats))
                    if node.depth + 1 < depth and not abs(impurity(stats, coded.classes)) < PURE:
                        below.append((t, len(trees[t]) - 1))
        active = sorted(below)
    return trees


def _scored(rows: DataFrame, coded: Coded, tree: list[Node], weight: float) -> DataFrame:
    """``rows`` with the prediction of one more tree added to their scores."""
    walker, columns, dtype = Walker.of(tree, coded.columns), len(coded.columns), _dtype(coded.columns)
    values = np.array([prediction(n.stats, 0) for n in tree]) * weight

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, codes, label, score in _blocks(batches, columns, dtype):
            more = values.take(walker.nodes(codes))
            cells = [pa.array([block]), pa.array([len(label)], type=pa.int32()),
                     *[pa.array([a.tobytes()], type=pa.binary()) for a in (codes, label, more if score is None else score + more)]]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "n", "codes", "label", "score"])

    return rows.mapInArrow(added, "id bigint, n int, codes binary, label binary, score binary")


def boost(coded: Coded, rounds: int, depth: int, rate: float, least: int = 1, written_every: int = 10) -> list[list[Node]]:
    """Trees of squared error, each on what is left by those before it. The rows with their scores lie on the executors'
    disks from one round to the next, where they take none of the memory that tasks need, and are written now and then."""
    rows, trees, held = coded.rows, [], None
    for i in range(rounds):
        trees += grow(coded, rows, 1, depth, None, least)
        if held is not None:  # what the rows of this round were made from
            held.unpersist()
        if i + 1 < rounds:
            held, rows = rows, _scored(rows, coded, trees[-1], rate if i else 1.0)
            rows = _written(rows) if (i + 1) % written_every == 0 else rows.persist(StorageLevel.DISK_ONLY)
            if (i + 1) % written_every == 0:
                held.unpersist()
    rows.unpersist()
    return trees


# --- models ---------------------------------------------------------------------------------------------


def _model_nodes(tree: list[Node], coded: Coded) -> list[tuple]:
    """Nodes in preorder, as models store them. Two leaves of the same prediction become one."""
    columns, classes, merged = coded.columns, coded.classes, set()
    values = [prediction(n.stats, classes) for n in tree]
    for i in reversed(range(len(tree))):  # children stand behind their parents
        if tree[i].children:
            left, right = tree[i].children
            if all(not tree[c].children or c in merged for c in (left, right)) and values[left] == values[right]:
                merged.add(i)
                values[i] = values[left]
    found: list[list] = []

    def add(i: int) -> int:
        node, me = tree[i], len(found)
        found.append([])
        inner = node.children and i not in merged
        left, right = [add(c) for c in node.children] if inner else (-1, -1)
        own = float(impurity(node.stats, classes)) if node.valid else -1.0
        split = (-1, [], -1)
        if inner:
            column = columns[node.column]
            sizes = {NUMBER: -1, ONE_HOT: 2, CATEGORY: column.bins}
            split = node.feature, [float(v) for v in node.split], sizes[column.kind]
        found[me] = [me, values[i], own, [float(v) for v in node.stats], int(_rows_of(node.stats, classes)),
                     node.gain if inner else -1.0, left, right, split]
        return me

    add(0)
    return [tuple(n) for n in found]


def _loaded(model: Estimator, kind: type, coded: Coded, trees: list[list[Node]], weights: Sequence[float] | None) -> Model:
    """A model of Spark's, by way of its file format. ``weights``: of the trees of an ensemble."""
    spark = coded.rows.sparkSession
    path = scratch_path(spark, "trees")
    model.write().save(f"{path}-estimator")
    about = json.loads(spark.read.text(f"{path}-estimator/metadata").first()[0])
    package = about["class"].rsplit(".", 1)[0]
    about["class"] = f"{package}.{kind.__name__}"
    about["numFeatures"] = coded.features
    about |= {"numClasses": coded.classes} if weights is None else {"numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    nodes = [(t, n) for t, tree in enumerate(trees) for n in _model_nodes(tree, coded)]
    if weights is None:
        spark.createDataFrame([n for _, n in nodes], NODE).coalesce(1).write.parquet(f"{path}/data")
    else:
        one = {k: about[k] for k in ("timestamp", "sparkVersion")} | {"class": f"{package}.DecisionTreeRegressionModel", "paramMap": {}, "defaultParamMap": {}}
        rows = [(t, json.dumps({**one, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), float(w)) for t, w in enumerate(weights)]
        spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(nodes, f"treeID int, nodeData struct<{NODE}>").write.parquet(f"{path}/data")
    return kind.load(path)


def fit(model: Estimator, coded: Coded) -> Model:
    """What ``model.fit`` gives, from coded rows. The draws of a forest follow from the seed, the number of the tree and the block."""
    depth, least = model.getMaxDepth(), model.getMinInstancesPerNode()
    if isinstance(model, GBTRegressor):
        rounds, rate = model.getMaxIter(), model.getStepSize()
        trees = boost(coded, rounds, depth, rate, least, max(model.getCheckpointInterval(), 1))
        return _loaded(model, GBTRegressionModel, coded, trees, [rate if i else 1.0 for i in range(rounds)])
    if isinstance(model, RandomForestRegressor):
        trees = grow(coded, coded.rows, model.getNumTrees(), depth, model.getSeed(), least)
        return _loaded(model, RandomForestRegressionModel, coded, trees, [1.0] * len(trees))
    return _loaded(model, DecisionTreeClassificationModel, coded, grow(coded, coded.rows, 1, depth, None, least), None)
