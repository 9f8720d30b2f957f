"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (lengths, shares of character kinds, repetition of words, word pairs and lines, entropy, how well it
compresses) are computed in numpy from its bytes. Training bins each statistic at quantiles and grows trees level by level
from histograms of gradients; a fitted model is four arrays (feature, threshold, leaf value of each heap slot, and the
intercept), and scoring walks all trees and rows at once, one vectorised step a level.

Learnt from at most ``max_labels`` labelled rows (those of the least id hash); every row is scored, from its whole text.

Defined results: a null text counts as empty, whose statistics are zeros; a null label or id teaches nothing; with one
class labelled the score is that class's smoothed share, with none 0.5; repeated rows are scored alike; a very long text is measured
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, pieces
from .toxicity import labelled

MAX_LABELS = 40_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 120, 4, 0.1, 64, 20, 1.0
SYMBOLS = b"*%&$#!|<>{}[]()@=/\\_+~^"


def statistics(text: str | None) -> list[float]:
    """The statistics of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * N_STATISTICS
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count / n
    some = share[share > 0]
    words = raw.split()
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    m = max(1, len(lines))
    distinct = set(words)
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    widths = np.fromiter(map(len, lines), float, len(lines)) if lines else np.zeros(1)
    upper, lower = share[65:91].sum(), share[97:123].sum()
    two = set(zip(words, words[1:]))
    three = set(zip(words, words[1:], words[2:]))
    titled = sum(w[:1].isupper() for w in words)
    alone = sum(w.isalpha() for w in words)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        sizes.mean(), sizes.std(), sizes.max(), widths.mean(), widths.std(), np.log1p(widths.max()),
        upper, lower, share[48:58].sum(), share[128:].sum(), count[32] / n, upper / (upper + lower + 1e-9),
        *(share[list(SYMBOLS)]), share[46], share[44], share[58] + share[59], share[34] + share[39], share[63],
        -(some * np.log(some)).sum(),
        len(distinct) / k, len(two) / k, len(three) / k, len(set(lines)) / m, titled / k, alone / k,
        (sizes <= 2).mean(), (sizes >= 12).mean(), (widths < 20).mean(),
        len(zlib.compress(raw, 1)) / n,
    ]


N_STATISTICS = 0
N_STATISTICS = len(statistics("x"))


@dataclass
class Trees:
    """Heap-ordered trees: node i has children 2i+1 and 2i+2; feature -1 keeps going left."""

    feature: np.ndarray  # trees x (2^DEPTH - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^DEPTH leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > self.threshold[trees, at]))
        z = self.start + self.value[trees, at - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on binned statistics."""
    inner, n_features = 2**DEPTH - 1, x.shape[1] if x.ndim == 2 else N_STATISTICS
    share = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return Trees(np.full((1, inner), -1), np.zeros((1, inner)), np.zeros((1, inner + 1)), start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    z = np.full(len(y), start)
    feature, threshold, value = [], [], []
    offsets = np.arange(n_features) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, t = np.full(inner, -1), np.zeros(inner)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (n_features * BINS) + offsets[None, :] + binned).ravel()
            shape = (width, n_features, BINS)
            sums = [np.bincount(slot, np.repeat(w, n_features), width * n_features * BINS).reshape(shape).cumsum(2) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(nl < LEAST_ROWS) | (na - nl < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + i], t[first + i] = j, cuts[j][b]
            own = f[node]
            node = 2 * node + 1 + ((own >= 0) & (x[np.arange(len(y)), np.maximum(own, 0)] > t[node]))
        leaf = node - inner
        v = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        z += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(np.array(feature), np.array(threshold), np.array(value), start)


def measure(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns in ``keep`` and the statistics of the text."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = [list(map(float, statistics(t))) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*keep, "_x"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", _x array<double>"
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labels: int = MAX_LABELS) -> Trees:
    got = measure(labelled(docs, labels, label_col, max_labels, balanced=False), ["label"], "text").toArrow()
    return fit(np.array(got.column("_x").to_pylist()).reshape(-1, N_STATISTICS), got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, N_STATISTICS)
            yield pa.record_batch([b.column(0), pa.array(sent.value.score(x))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
