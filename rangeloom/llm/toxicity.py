"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word with its edges marked; its likelihood in a class is the product over its bytes of an interpolated
Kneser-Ney estimate given up to ``ORDER`` bytes before, so spellings never seen whole are judged by their stems:

    P_c(x | h) = (max(n_c(h x) - D, 0) + (sum_y min(n_c(h y), D) + TRUST) * P_c(x | h without its first byte)) / (n_c(h) + TRUST)

Contexts longer than ``SHARED`` bytes are counted in each class with the discount ``RARE``, which takes all weight from
what few documents hold; the shorter ones, which smooth what is rare, hold continuation counts that both
classes share, with the usual ``DISCOUNT``. A document is compared by its
length-normalised difference of log-likelihoods (toxic minus ordinary) over the whole text and over its strongest window
of each width in WINDOWS (short insults in a long text), and by the share and number of its words whose difference
exceeds each of LEVELS; a logistic function of these, fitted on labelled rows that the counts have not seen, is the score.

Bounds: contexts are hashed into CONTEXTS and continuations into PAIRS, so the model that is sent to the executors has one
size whatever the text. It is learnt from at most ``max_labels`` labelled rows, half of each class (those of the least id
hash); a word counts once a document; counting is distributed. Scoring covers every row and whole texts.

Defined results: a null text counts as empty; a text without words has zero features, so its score is the logistic function of
the fitted intercept; a null label or id teaches nothing; if the calibration rows hold only one class, every score is near that
class's share, and 0.5 without any; repeated rows are scored alike; a very long text is scored whole; an empty table gives an
empty result; other columns, of whatever names, pass through ``reject`` unchanged and are ignored by ``report``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, free_name, pieces

ORDER, SHARED = 6, 2
CONTEXTS, PAIRS = 1 << 21, 1 << 23
DISCOUNT, RARE = 0.75, 3.0
#: Documents' worth of backing off that every context gets, so that a rare context says little by itself.
TRUST = 25.0
#: A word's difference is held between these, so that one long word doesn't outweigh a document.
LEAST, MOST = -3.0, 6.0
#: No byte is taken for less likely than this.
FLOOR = 1e-12
WINDOWS = (1, 4, 16)
LEVELS = (1.5, 3.0, 5.0)
N_FEATURES = 2 + len(WINDOWS) + 2 * len(LEVELS)
MAX_LABELS = 24_000
MANY = 65535
#: Edge characters that are no part of a word.
EDGES = b".,;:!?\"'()[]{}|*%&$#+-"


def words(text: str | None) -> list[bytes]:
    out = [w.strip(EDGES) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]
    return [w for w in out if w]


def contexts(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: positions, hashed context, hashed continuation, hashed longer context (for distinct left sides)."""
    n = len(flat)
    edge = flat == 10
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(edge, at, 0))
    start = np.concatenate([[0], start[:-1]])  # the mark that opens the word of each position
    h = np.zeros(n, np.uint64)
    long = flat.astype(np.uint64) + np.uint64(1)
    ok = at > 0
    mix = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, ORDER + 1):
        back = at - k
        ok = ok & (back >= start)
        p = at[ok]
        if not len(p):
            return
        h[p] = (h[p] ^ (long[p - k] * np.uint64(2 * k + 1))) * mix
        h[p] ^= h[p] >> np.uint64(29)
        pair = (h[p] ^ (long[p] * np.uint64(0xD6E8FEB86659FD93))) * mix
        more = np.where(back[p] - 1 >= start[p], flat[np.maximum(p - k - 1, 0)].astype(np.int64), 256)
        yield k, p, (h[p] >> np.uint64(40)).astype(np.int64) % CONTEXTS, (pair >> np.uint64(40)).astype(np.int64) % PAIRS, more


def flatten(vocabulary: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n" + b"\n".join(vocabulary) + b"\n", np.uint8)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (label, text) to (label, word, n): the documents of the batch that hold each word."""
    for b in pieces(batches):
        found: tuple[dict, dict] = ({}, {})
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w in set(words(text)):
                found[label][w] = found[label].get(w, 0) + 1
        for label, own in enumerate(found):
            if own:
                yield pa.record_batch([pa.array([label] * len(own), pa.int32()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["label", "word", "n"])


class Counts:
    """Hashed counts, added a part of the vocabulary at a time in memory of a fixed size."""

    PART, SEEN = 20_000, 1 << 24

    def __init__(self):
        self.raw = np.zeros((2, PAIRS), np.int32)
        self.context = np.zeros(PAIRS, np.int32)
        self.low = np.zeros(PAIRS, bool)
        self.seen = np.zeros(self.SEEN, bool)

    def add(self, label: int, vocabulary: list[bytes], n: np.ndarray) -> None:
        for i in range(0, len(vocabulary), self.PART):
            self._add(label, vocabulary[i : i + self.PART], n[i : i + self.PART])

    def _add(self, label: int, vocabulary: list[bytes], n: np.ndarray) -> None:
        flat = flatten(vocabulary)
        weight = np.concatenate([[0], np.repeat(n, [len(w) + 1 for w in vocabulary])])
        for k, p, context, pair, more in contexts(flat):
            if k <= SHARED:  # distinct left sides, in both classes together
                keys, first = np.unique((pair * 257 + more) % self.SEEN, return_index=True)
                first = first[~self.seen[keys]]
                self.seen[keys] = True
                kinds, total = np.unique(pair[first], return_counts=True)
                self.raw[:, kinds] += total.astype(np.int32)
                self.low[kinds] = True
            else:
                kinds, which = np.unique(pair, return_inverse=True)
                self.raw[label, kinds] += np.bincount(which, weight[p]).astype(np.int32)
            self.context[pair] = context

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Continuation counts, and each context's total and discounted weight, by class; a slice at a time. Ends the counting."""
        del self.seen
        total, taken = (np.zeros((2, CONTEXTS), np.float32) for _ in range(2))
        for i in range(0, PAIRS, 1 << 20):
            at = slice(i, i + (1 << 20))
            low = np.where(self.low[at], DISCOUNT, RARE)
            for c in (0, 1):
                some = np.flatnonzero(self.raw[c, at])
                context, n = self.context[at][some], self.raw[c, at][some].astype(float)
                total[c] += np.bincount(context, n, CONTEXTS)
                taken[c] += np.bincount(context, np.minimum(n, low[some]), CONTEXTS)
        del self.context, self.low
        return self.raw, total, taken


class Model:
    """Both classes' models as arrays of a fixed size, and the differences of words met so far."""

    def __init__(self, counts: Counts):
        raw, self.hist, self.follow = counts.finish()
        #: Counts as 16 bits; those that don't fit are MANY there, and whole in the short sorted tables (place, count).
        self.place = np.flatnonzero(raw.ravel() >= MANY)
        self.count = raw.ravel()[self.place]
        self.pair = np.minimum(raw, MANY, out=raw).astype(np.uint16)
        self.known: dict[bytes, float] = {}

    def counted(self, c: int, pair: np.ndarray) -> np.ndarray:
        """Continuation counts of hashed pairs in a class."""
        n = self.pair[c][pair].astype(np.float32)
        many = np.flatnonzero(n == MANY)
        if len(many):
            n[many] = self.count[np.searchsorted(self.place, pair[many] + c * PAIRS)]
        return n

    def __getstate__(self) -> dict:
        """Compressed, as most of the tables' entries are zeros or small."""
        return {n: (zlib.compress(x.tobytes() if x.size < 1000 else memoryview(x).cast("B"), 1), x.shape, x.dtype.str) for n, x in vars(self).items() if n != "known"}

    def __setstate__(self, state: dict) -> None:
        for n, (raw, shape, kind) in state.items():
            setattr(self, n, np.frombuffer(zlib.decompress(raw), kind).reshape(shape))
        self.known = {}

    def differences(self, vocabulary: list[bytes]) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word, its end included."""
        flat = flatten(vocabulary)
        p = np.full((2, len(flat)), 1 / 256)
        for k, at, context, pair, _ in contexts(flat):
            low = DISCOUNT if k <= SHARED else RARE
            for c in (0, 1):
                h = self.hist[c][context]
                n = np.maximum(self.counted(c, pair) - np.float32(low), 0)
                p[c][at] = (np.minimum(n, h) + (np.minimum(self.follow[c][context], h) + TRUST) * p[c][at]) / (h + TRUST)
        d = np.log(np.maximum(p[1], FLOOR)) - np.log(np.maximum(p[0], FLOOR))
        ends = np.cumsum([len(w) + 1 for w in vocabulary])
        return np.clip(np.diff(np.concatenate([[0], np.cumsum(d[1:])[ends - 1]])), LEAST, MOST)

    def features(self, texts: list[str | None]) -> np.ndarray:
        split = [words(t) for t in texts]
        new = list(set().union(*split) - self.known.keys()) if split else []
        if len(self.known) + len(new) > 500_000:
            self.known.clear()
            new = list(set().union(*split))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.known.update(zip(part, self.differences(part).tolist()))
        look = self.known.__getitem__
        rows = [self._row(np.fromiter(map(look, w), float, len(w)), np.fromiter(map(look, own := set(w)), float, len(own))) for w in split]
        return np.array(rows).reshape(-1, N_FEATURES)

    @staticmethod
    def _row(d: np.ndarray, distinct: np.ndarray) -> list[float]:
        if not len(d):
            return [0.0] * N_FEATURES
        run = np.concatenate([[0], np.cumsum(d)])
        out = [run[-1] / len(d)]
        for k in WINDOWS:
            k = min(k, len(d))
            out.append((run[k:] - run[:-k]).max() / k)
        for x in LEVELS:
            out += [np.sqrt((d > x).mean()), np.log1p((distinct > x).sum())]
        return [*out, np.log(1 + len(d)) / 10]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, max_labels: int, balanced: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label, fold and text of at most ``max_labels`` labelled rows outside fold 0; one label an id (the largest)."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)")
    own = own.withColumn("fold", fold(F.col("_id"))).where("fold <> 0")
    own = own.groupBy("_id", "fold").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64("_id"))
    if balanced:
        parts = [own.where(F.col("label") == c).orderBy("_h", "_id").limit(max_labels // 2) for c in (0, 1)]
        own = parts[0].unionByName(parts[1])
    else:
        own = own.orderBy("_h", "_id").limit(max_labels)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "_id").select("label", "fold", "text")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labels: int = MAX_LABELS) -> tuple[Broadcast, np.ndarray]:
    """The counted model (folds 1 to 3), as a broadcast, and the weights of its features (fitted on fold 4)."""
    rows = labelled(docs, labels, label_col, max_labels)
    counted = rows.where("fold <> 4").select("label", "text").mapInArrow(count_batches, "label int, word binary, n long")
    counted = counted.groupBy("label", "word").agg(F.sum("n").alias("n"))
    counts = Counts()
    for label, word, n in _groups(counted):
        counts.add(label, word, n)
    sent = docs.sparkSession.sparkContext.broadcast(Model(counts))  # the driver keeps no copy
    del counts

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = sent.value.features(b.column(2).to_pylist()).tolist()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["label", "fold", "x"])

    seen = rows.where("fold = 4").mapInArrow(look, "label int, fold long, x array<double>").toArrow()
    y = seen.column("label").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return sent, np.array([0.0] * N_FEATURES + [np.log(share / (1 - share))])
    x = np.array(seen.column("x").to_pylist())
    return sent, fit_logistic(x, y)


def _groups(counted: DataFrame) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """The sample's words, a part at a time; their number is bounded with the sample."""
    table = counted.toArrow().sort_by([("label", "ascending"), ("word", "ascending")])  # one order, one result
    for i in range(0, table.num_rows, Counts.PART):
        part = table.slice(i, Counts.PART)
        label, word, n = part.column("label").to_numpy(), part.column("word").to_pylist(), part.column("n").to_numpy()
        for c in (0, 1):
            at = np.flatnonzero(label == c)
            if len(at):
                yield c, [word[i] for i in at], n[at]


def score(docs: DataFrame, sent: Broadcast, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "_score") -> DataFrame:
    """The columns in ``keep`` (the id by default) and the score of each row, under a name that ``keep`` doesn't have."""
    keep = keep or [id_col]
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{name}` double"
    at = keep.index(text_col) if text_col in keep else len(keep)  # a kept text is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = sent.value, weights
        for b in pieces(batches):
            z = m.features(b.column(at).to_pylist()) @ w[:-1] + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(p)], [*keep, name])

    columns = [F.col(f"`{c}`") for c in keep] + ([] if text_col in keep else [F.col(text_col).alias(name)])
    return docs.select(*columns).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    out = score(docs, *train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    name = free_name(docs, "_score")
    return score(docs, *train(docs, labels), keep=docs.columns, name=name).where(F.col(name) < threshold).select(*(f"`{c}`" for c in docs.columns))
