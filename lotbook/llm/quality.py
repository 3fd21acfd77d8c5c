"""Quality rules: boosted trees over document statistics, scored as flat node arrays.

The trees are fitted on a bounded sample of labelled documents with a logistic loss over binned
statistics; on chosen statistics they may only fall (or only rise). A fitted model is five small numpy
arrays, so scoring walks all rows and trees at once, one step a level.

Nulls and odd input: a null text counts as empty. A text with no word fails the base rules. Repeated rows
are judged alike. Without labels (none given, or of one class only) the model accepts everything and the
base rules alone decide. All columns of the input ride along in ``row``, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.llm.rows import carried, text_column

WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20  # base rules: words at least, per cent of repeated words at most
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), b"0123456789", b".!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "spread_word", "symbols", "upper", "digits", "exclaims", "bars", "stops", "distinct",
    "dup_lines", "repeated", "words_per_line", "short_words",
)
#: More symbols, copied lines or repeated windows never make a document better.
FALLING = ("symbols", "bars", "exclaims", "dup_lines", "repeated")
SAMPLE = 20_000  # labelled documents that a model is fitted on, at most about this many
TREES, DEPTH, RATE, BINS, LAMBDA, MIN_CHILD = 60, 3, 0.2, 32, 1.0, 5.0
FALSE_REJECTS = 0.002  # share of good held-out documents that the threshold may cost


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in windows of five found twice or more. Equal windows get equal numbers step by step,
    without hashing, so the count is exact."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    one = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    two = np.unique(one[:-1] * n + one[1:], return_inverse=True)[1]
    if two.max() + 1 == len(two):
        return 0
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    if four.max() + 1 == len(four):
        return 0
    _, five, times = np.unique(four[:-1] * n + one[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[five] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """The five counts and the statistics of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / word_chars

    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    copied = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = [n, word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), copied, repeated]
    return counts, [
        float(np.log1p(n)), word_chars / n, float(lengths.std()), share(SYMBOLS), share(UPPER), share(DIGITS),
        share(b"!"), share(b"|"), share(STOPS), len(set(words)) / n, copied / len(lines), repeated / n,
        n / len(lines), float((lengths < 4).mean()),
    ]


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])


@dataclass
class Trees:
    """Full binary trees as arrays [tree, node]; a leaf that ends early is repeated below itself."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.start)
        trees = np.arange(len(self.feature))
        out = np.empty(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.zeros((len(part), len(trees)), dtype=np.int64)
            rows = np.arange(len(part))[:, None]
            while node[0, 0] < self.feature.shape[1]:
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            out[lo : lo + 4096] = self.start + self.value[trees, node].sum(axis=1)
        return out

    def accepts(self, x: np.ndarray) -> np.ndarray:
        return self.margin(x) >= self.threshold


ACCEPT_ALL = Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), 0.0, -np.inf)


def _grow(binned, cuts, grad, hess, signs):
    """One tree: the best cut of each node by histograms, values kept within the bounds that the signs set."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    value, node = np.zeros(2 * inner + 1), np.zeros(len(grad), dtype=np.int64)
    low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)

    def worth(g, h, k):
        return np.clip(-g / (h + LAMBDA), low[k], high[k])

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + LAMBDA) * w * w)

    value[0] = worth(grad.sum(), hess.sum(), 0)
    for k in range(inner):
        mine = np.flatnonzero(node == k)
        left, right = 2 * k + 1, 2 * k + 2
        value[left] = value[right] = value[k]
        low[left] = low[right] = low[k]
        high[left] = high[right] = high[k]
        g, h = grad[mine], hess[mine]
        best, found = 1e-6, None
        for f, sign in enumerate(signs):
            width = len(cuts[f]) + 1
            if width < 2 or not len(mine):
                continue
            gl = np.cumsum(np.bincount(binned[mine, f], g, width))[:-1]
            hl = np.cumsum(np.bincount(binned[mine, f], h, width))[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            wl, wr = worth(gl, hl, k), worth(gr, hr, k)
            gains = gain(gl, hl, wl) + gain(gr, hr, wr) - gain(g.sum(), h.sum(), value[k])
            gains[(hl < MIN_CHILD / 4) | (hr < MIN_CHILD / 4) | (sign * (wr - wl) < 0)] = -np.inf
            if gains.max() > best:
                at = int(gains.argmax())
                best, found = gains[at], (f, at, wl[at], wr[at], sign)
        if found:
            f, at, wl, wr, sign = found
            feature[k], cut[k], value[left], value[right] = f, cuts[f][at], wl, wr
            middle = (wl + wr) / 2
            if sign < 0:
                low[left], high[right] = max(low[k], middle), min(high[k], middle)
            elif sign > 0:
                high[left], low[right] = min(high[k], middle), max(low[k], middle)
            node[mine] = np.where(binned[mine, f] > at, right, left)
        else:
            node[mine] = left
    return feature, cut, value, node


def fit_trees(x: np.ndarray, good: np.ndarray, held: np.ndarray) -> Trees:
    """Fit on the rows that are not ``held``; these set the threshold."""
    train = ~held
    if len(set(good[train].tolist())) < 2:
        return ACCEPT_ALL
    signs = [-1 if name in FALLING else 0 for name in FEATURES]
    xt, yt = x[train], good[train].astype(float)
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, xt[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    start = float(np.log(yt.mean() / (1 - yt.mean())))
    margin, trees = np.full(len(xt), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        feature, cut, value, node = _grow(binned, cuts, p - yt, p * (1 - p), signs)
        margin = margin + RATE * value[node]
        trees.append((feature, cut, RATE * value))
    feature, cut, value = (np.stack(part) for part in zip(*trees))
    model = Trees(feature, cut, value, start, 0.0)
    judged = model.margin(x[held & good.astype(bool)])
    if len(judged):  # never above even odds, lower if that would cost too many good documents
        model.threshold = float(min(0.0, np.quantile(judged, FALSE_REJECTS)))
    return model


def _measured(batches: Iterator[pa.RecordBatch], model: Trees | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(text) for text in text_column(batch, "_text")]
        counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
        stats = np.array([s for _, s in found], dtype=float).reshape(-1, len(FEATURES))
        row = batch.column("row")
        if model is None:
            columns = [row, pa.array(list(stats), type=pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "stats"])
            continue
        failed = base_failed(counts)
        margin = model.margin(stats)
        columns = [row, *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed),
                   pa.array(~failed & (margin >= model.threshold)), pa.array(margin)]
        names = ["row", *COUNTS, "base_failed", "kept", "margin"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on about ``sample`` labelled documents, chosen by a hash of their number. These alone come to the
    driver, as ``len(FEATURES)`` numbers each; a fifth of them only sets the threshold."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    total = labels.count()
    if not total:
        return ACCEPT_ALL
    share = int(min(1.0, sample / total) * 2**20)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**20))
    chosen = labels.where(place < share).select(F.col("doc_id").alias("_id"), "good")
    # at most about ``sample`` rows of two numbers: bounded
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_text", F.struct("doc_id", "good").alias("row"))
    schema = "row struct<doc_id: bigint, good: int>, stats array<double>"
    rows = rows.withColumn("row", F.col("row").cast("struct<doc_id: bigint, good: int>"))
    found = rows.mapInArrow(lambda batches: _measured(batches, None), schema).toArrow().to_pydict()
    if not found["row"]:
        return ACCEPT_ALL
    order = np.argsort([r["doc_id"] for r in found["row"]], kind="stable")
    x = np.array(found["stats"])[order]
    good = np.array([r["good"] > 0 for r in found["row"]])[order]
    return fit_trees(x, good, np.arange(len(x)) % 5 == 4)


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """row, the five counts, base_failed, kept, margin: one row a document, without a shuffle."""
    wide = docs.select(carried(docs), F.col("text").alias("_text"))
    kind = wide.schema["row"].dataType.simpleString()
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    schema = f"row {kind}, {counts}, base_failed boolean, kept boolean, margin double"
    return wide.mapInArrow(lambda batches: _measured(batches, model), schema)
