"""Dense networks with sigmoid layers, fitted by L-BFGS on rows that stay as small as they are stored.

Spark's own trainer keeps a dense row of all slots for every listing and multiplies all of them in every pass. Here a row is
one number for each group of text columns (the place of its values in all combinations of these, ``GROUP`` at most) and its numbers, so a pass
looks up and adds as many rows of weights as there are groups, not slots. Objective, start,
search and stopping rules are those of Spark's trainer (cross-entropy, averaged in blocks of rows and over these, its initial weights, ten
corrections, strong Wolfe steps); the result is a model of Spark's. A pass is one Spark job that sums losses and gradients; the driver holds weights and gradients only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORRECTIONS, SEARCHES, ZOOMS = 10, 10, 10
SUFFICIENT, CURVATURE = 1e-4, 0.9
TOLERANCE, REMEMBERED = 1e-6, 20
CHUNK = 4096  # rows that a task works on at a time
GROUP = 1 << 14  # combinations of values that a group of text columns has at most, unless one column has more
LOSS, BLOCKS = -1, -2  # numbers of these sums among those of the gradient


def blocks(rows: DataFrame, slots: Sequence[str], numbers: Sequence[str], label: str, classes: int, block: int) -> DataFrame:
    """n, slots, numbers, label: whole blocks of ``block`` rows, about an Arrow batch of them at a time; the last one of a
    partition may be shorter. ``slots``: columns of numbers of text values, or of combinations of them.

    A label that is no whole number below ``classes`` is an error.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((len(slots) + len(numbers) + 1, 0))

        def out(values: np.ndarray) -> pa.RecordBatch:
            parts = values[: len(slots)].astype(np.int32), values[len(slots) : -1], values[-1].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([values.shape[1]], type=pa.int32()), *[pa.array([p.tobytes()], type=pa.binary()) for p in parts]],
                names=["n", "slots", "numbers", "label"])

        for batch in batches:
            values = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)], dtype=np.float64)
            if not np.isin(values[-1], np.arange(classes)).all():
                raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
            values = np.concatenate([left, values], axis=1)
            whole = values.shape[1] // block * block
            left = values[:, whole:]
            if whole:
                yield out(values[:, :whole])
        if left.shape[1]:
            yield out(left)

    wide = rows.select(*[F.col(f"`{c}`").cast("double") for c in (*slots, *numbers, label)])
    return wide.mapInArrow(packed, "n int, slots binary, numbers binary, label binary")


def layers_of(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs by outputs) and bias of each layer, in the order Spark keeps them."""
    found, at = [], 0
    for n_in, n_out in zip(sizes, sizes[1:]):
        found.append((weights[at : at + n_in * n_out].reshape(n_in, n_out), weights[at + n_in * n_out : at + (n_in + 1) * n_out]))
        at += (n_in + 1) * n_out
    return found


def grouped(sizes: Sequence[int], most: int = GROUP) -> list[list[int]]:
    """Columns with so many values each, put together as long as a group has no more than ``most`` combinations; the widest first."""
    groups: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = (g for g in groups if np.prod([float(sizes[j]) for j in g]) * sizes[i] <= most)
        into = next(fitting, None)
        if into is None:
            groups.append(into := [])
        into.append(i)
    return groups


class Pass:
    """Weighted sums of loss and gradient over rows. Features are ``scale * slot + shift``; the numbers of a row hold the first slots.

    ``groups``: (first slot, number of values) of the text columns of each group. The number of a row in it runs fastest over the last one.
    """

    def __init__(self, weights: np.ndarray, sizes: Sequence[int], groups: Sequence[Sequence[tuple[int, int]]], scale: np.ndarray, shift: np.ndarray):
        self.groups, self.scale, self.shift = groups, scale, shift
        (first, bias), *self.layers = layers_of(weights, sizes)
        self.scaled, self.bias = first * scale[:, None], bias + shift @ first
        self.tables, self.joint = [], []
        for group in groups:
            table = np.zeros((1, first.shape[1]))
            for start, n in group:
                table = (table[:, None] + self.scaled[None, start : start + n]).reshape(-1, first.shape[1])
            self.tables.append(table)
            self.joint.append(np.zeros((first.shape[1], len(table))))
        self.loss, self.total = 0.0, np.zeros(first.shape[1])
        self.sums = np.zeros_like(first)
        self.rest = [np.zeros(m.size + b.size) for m, b in self.layers]

    def add(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """``at``: the numbers of the rows in each group."""
        z = x.T @ self.scaled[: len(x)]
        z += self.bias
        for table, code in zip(self.tables, at):
            z += table.take(code, axis=0)
        outputs = []
        for matrix, bias in self.layers:
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            outputs.append(np.reciprocal(z, out=z))
            z = outputs[-1] @ matrix
            z += bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        each = np.arange(len(y))
        self.loss -= (weight * np.log(np.maximum(z[each, y], 1e-300))).sum()
        delta = z
        delta[each, y] -= 1
        delta *= weight[:, None]
        for (matrix, _), out, into in zip(reversed(self.layers), reversed(outputs), reversed(self.rest)):
            into += np.concatenate([(out.T @ delta).ravel(), delta.sum(axis=0)])
            delta = delta @ matrix.T
            delta *= out
            np.subtract(1, out, out=out)
            delta *= out
        self.sums[: len(x)] += x @ delta
        by_output = np.ascontiguousarray(delta.T)
        self.total += by_output.sum(axis=1)
        for into, code in zip(self.joint, at):
            for sums, d in zip(into, by_output):
                sums += np.bincount(code, d, len(sums))

    def gradient(self) -> np.ndarray:
        sums = self.sums.copy()
        for group, joint in zip(self.groups, self.joint):
            cube = joint.reshape(len(joint), *[n for _, n in group])
            for axis, (start, n) in enumerate(group, 1):
                sums[start : start + n] += cube.sum(axis=tuple(i for i in range(1, cube.ndim) if i != axis)).T
        return np.concatenate([(sums * self.scale[:, None] + np.outer(self.shift, self.total)).ravel(), self.total, *self.rest])


def objective(rows: DataFrame, sizes: Sequence[int], groups: Sequence[Sequence[tuple[int, int]]], scale: np.ndarray, shift: np.ndarray,
              block: int) -> Callable:
    """weights -> loss and its gradient, the mean of the means of all ``blocks``, by one job. ``groups`` as in ``Pass``."""

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = rows.sparkSession.sparkContext.broadcast(weights)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, count = Pass(shared.value, sizes, groups, scale, shift), 0
            for batch in batches:
                for cells in zip(*[batch.column(c) for c in ("n", "slots", "numbers", "label")]):
                    n = cells[0].as_py()
                    slots, numbers, label = (c.as_buffer() for c in cells[1:])
                    code = np.frombuffer(slots, np.int32).reshape(-1, n).astype(np.intp)
                    x, y = np.frombuffer(numbers, np.float64).reshape(-1, n), np.frombuffer(label, np.int32)
                    whole = n // block * block
                    share = np.full(n, 1 / block)
                    share[whole:] = 1 / max(n - whole, 1)
                    for i in range(0, n, CHUNK):
                        cut = slice(i, i + CHUNK)
                        sums.add(code[:, cut], x[:, cut], y[cut], share[cut])
                    count += -(-n // block)
            gradient = sums.gradient()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[LOSS, BLOCKS, np.arange(len(gradient))].astype(np.int32)), pa.array(np.r_[sums.loss, count, gradient])], names=["i", "v"])

        sums = rows.mapInArrow(summed, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        shared.unpersist()
        values = sums["v"].to_numpy()[np.argsort(sums["i"].to_numpy())]
        count, loss, gradient = values[0], values[1], values[2:]
        return loss / count, gradient / count

    return at


class SearchFailed(ArithmeticError):
    """No step of sufficient decrease, or a direction that does not descend."""


def _direction(gradient: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Newton's direction with the inverse Hessian of the last steps, newest first."""
    down = gradient.copy()
    if not steps:
        return -down
    curved = steps[0] @ changes[0]
    if not curved >= 0:
        raise SearchFailed("negative curvature")
    products = [s @ c for s, c in zip(steps, changes)]
    shares = []
    for step, change, product in zip(steps, changes, products):
        shares.append(step @ down / product)
        down -= shares[-1] * change
    down *= curved / (changes[0] @ changes[0])
    for step, change, product, share in reversed(list(zip(steps, changes, products, shares))):
        down += (share - change @ down / product) * step
    return -down


def _between(left: tuple, right: tuple) -> float:
    """Minimum of the cubic through two points (place, value, slope), not too near to either."""
    (a, fa, da), (b, fb, db) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = np.sqrt(d1 * d1 - da * db)
    place = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if place < low else high if place > high else place


def _step(phi: Callable[[float], tuple], start: tuple, first: float) -> float:
    """A step that satisfies the strong Wolfe conditions. ``phi``: place -> (place, value, slope)."""
    _, value, slope = start
    if slope > 0:
        raise SearchFailed("no descent")
    low_enough = lambda c: c[1] <= value + SUFFICIENT * c[0] * slope
    flat_enough = lambda c: abs(c[2]) <= CURVATURE * abs(slope)

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(ZOOMS):
            c = phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if not low_enough(c) or c[1] >= low[1]:
                high = c
                continue
            if flat_enough(c):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed("zoom")

    low, place = start, first
    for i in range(SEARCHES):
        c = phi(place)
        if not np.isfinite(c[1]):
            place /= 2
            continue
        if not low_enough(c) or (c[1] >= low[1] and i):
            return zoom(low, c)
        if flat_enough(c):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, place = c, place * 1.5
    raise SearchFailed("search")


def minimize(objective: Callable, weights: np.ndarray, rounds: int) -> np.ndarray:
    """L-BFGS from ``weights``, for so many rounds at most."""
    value, gradient = objective(weights)
    first, values = abs(value), [value]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    failed, done = False, 0
    while done < rounds and np.linalg.norm(gradient) > max(TOLERANCE * abs(value), 1e-8):
        seen: dict[float, tuple[float, np.ndarray]] = {}
        try:
            down = _direction(gradient, steps, changes)

            def phi(t: float) -> tuple:
                seen[t] = objective(weights + t * down)
                return t, seen[t][0], seen[t][1] @ down

            t = _step(phi, (0.0, value, gradient @ down), 1.0 if done else 1 / np.linalg.norm(down))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed("step too small")
        except SearchFailed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        value, new = seen[t]
        steps, changes = [t * down, *steps][:CORRECTIONS], [new - gradient, *changes][:CORRECTIONS]
        weights, gradient, done, failed = weights + t * down, new, done + 1, False
        values = [*values, value][-REMEMBERED:]
        if abs(value - max(values)) <= TOLERANCE * first:
            break
    return weights
