"""Scoring by a gated recurrent language model with a class-factored output.

Counting covers every training document: each distinct token's count, their sum N and number V. The ``OWN`` most frequent
tokens have a vector each and form classes of ``GROUP`` by rank; all other tokens fall into ``SPELLED`` classes by the
hash of their last two bytes. A token's probability is P(class | state) * P(token | class, state), where the second
factor is a softmax over the class's vectors for frequent tokens and the token's share (c + 0.5) / mass of its class for
the others; an unseen token has c = 0, and each spelled class keeps 0.5 for one such token, so probabilities sum to 1.

The model is trained by truncated backpropagation in numpy on every training document: one shard of documents first, then rounds
of shards whose weights are averaged by tokens. Documents are dealt by a hash of id and text and learnt in its order, so the
scores don't depend on the partitioning.
Scoring walks whole documents in windows of ``STEPS`` tokens and carries the state from window to window.

Lookups: the ``HEAD`` most frequent tokens and their counts go to every executor (a fixed number); tokens beyond it, of
which none is frequent, meet their counts in a shuffle join, so any vocabulary size works and every count is exact.

Defined results: a null text counts as empty, whose only token is the end; without training documents N and V are 0;
rows are scored one by one, so repeated ids keep a row each; a null id falls into fold crc32('') mod 5 = 0; a very long text is
counted, learnt and scored whole, in bounded memory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, pieces

OWN, GROUP, SPELLED, HEAD = 1024, 16, 32, 1 << 18
CLASSES, INPUTS = OWN // GROUP + SPELLED, OWN + SPELLED + 1  # the last input opens a document
HIDDEN, STEPS, LANES, SPAN, BATCH = 24, 32, 128, 256, 512
ROWS = 1024  # of class logits at a time
TEXT_BYTES = 1 << 24  # of texts cut into words at once
WARM_TOKENS, SMALL_TOKENS, SHARD_TOKENS, ROUNDS, MOST_SHARDS = 600_000, 2_000_000, 1_000_000, 2, 16_384
END = b" "
LN10 = np.log(10)


def spelled(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLED


def spelled_classes(words: pa.Array) -> np.ndarray:
    """As spelled, of all words (none empty): the check sum's steps over the last two bytes, or the only one."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    text, steps = np.frombuffer(words.buffers()[2], np.uint8), np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint32)
    state = np.full(len(words), 0xFFFFFFFF, np.uint32)
    two = np.flatnonzero(np.diff(ends) > 1)
    state[two] = steps[text[ends[1:][two] - 2] ^ 255] ^ 0xFFFFFF
    state = steps[(state ^ text[ends[1:] - 1]) & 255] ^ (state >> 8)
    return ((state ^ 0xFFFFFFFF) % SPELLED).astype(np.int64)


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() treat exactly A-Z and \\x09-\\x0d, \\x20."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts without the ends, and each text's number of them; Arrow's ASCII kernels treat the same bytes as tokens."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = found.flatten().cast(pa.binary()), pc.list_value_length(found).to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at an edge leaves an empty word
    if not pc.all(full).as_py():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(full)
    return words, sizes.astype(np.int64)


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices whose texts have TEXT_BYTES at most, or one row."""
    for b in batches:
        sums, at = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy().astype(np.int64)), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + TEXT_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def count_tokens(docs: DataFrame) -> DataFrame:
    """word, cls, n over all rows; each portion's equal words are counted before Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 0):
            found = pc.value_counts(split(b.column(0))[0])
            words = pa.concat_arrays([found.field(0), pa.array([END], pa.binary())])
            n = np.append(found.field(1).to_numpy(), b.num_rows)
            yield pa.record_batch([words, pa.array(spelled_classes(words).astype(np.int32)), pa.array(n, pa.int64())], ["word", "cls", "n"])

    return docs.select("_text").mapInArrow(run, "word binary, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent tokens, at most so many: those from the least count (in steps of an eighth power of two) that allows it.

    The steps' totals are a few hundred rows, so no task gathers candidates of all partitions.
    """
    step = F.floor(F.log2("n") * 8)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["k"]):
        if r["c"] > left:
            break
        left, least = left - r["c"], r["k"]
    return counts.where(F.lit(False) if least is None else step >= least)


class Lexicon:
    """A token's code: the rank of a head token; for others -1 - spelled class. Holds the head's log10 shares."""

    def __init__(self, words: list[bytes] | pa.Array, counts: np.ndarray, total: int, distinct: int, mass: np.ndarray):
        self.words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        self.counts, self.total, self.distinct, self.mass = counts, total, distinct, mass
        cls, none = spelled_classes(self.words), np.zeros(SPELLED)
        # by code: the negative ones count from the end
        self.base = np.concatenate([np.log10((counts + 0.5) / self.norm), none])
        self.share = np.concatenate([np.log10((counts + 0.5) / mass[cls]), none])
        self.share[: min(OWN, len(counts))] = 0  # these have vectors
        rank = np.arange(len(counts))
        self.unit = np.concatenate([np.where(rank < OWN, rank, OWN + cls), OWN + np.arange(SPELLED)[::-1]])
        end = pc.index(self.words, pa.scalar(END, pa.binary())).as_py()
        self.end = end if end >= 0 else -1 - spelled(END)

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def __reduce__(self):
        return Lexicon, (self.words, self.counts, self.total, self.distinct, self.mass)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Codes of all tokens, text after text, each with its end; the texts' numbers of tokens; texts and tokens beyond the head."""
        words, sizes = split(texts)
        rank = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        far = np.flatnonzero(rank < 0)
        beyond = words.take(pa.array(far))
        rank[far] = -1 - spelled_classes(beyond)
        ends = np.cumsum(sizes)
        rows = np.searchsorted(ends, far, "right")
        if self.end < 0:
            rows, beyond = np.append(rows, np.arange(len(sizes))), pa.concat_arrays([beyond, pa.array([END] * len(sizes), pa.binary())])
        return np.insert(rank, ends, self.end), sizes + 1, rows, beyond

    def units(self, code: np.ndarray) -> np.ndarray:
        """Input and output unit: a frequent token's rank, or OWN + spelled class."""
        return self.unit[code]


class Adam:
    """Steps of adaptive moments, with a short warm-up of the rate."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.i = rate, 0
        self.flat = np.concatenate([v.ravel() for v in p.values()])
        self.one, self.two, self.room = (np.zeros_like(self.flat) for _ in range(3))
        at = 0
        for name, v in p.items():  # the parameters become views of one vector
            p[name] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size

    def __call__(self, g: dict[str, np.ndarray], n: int) -> None:
        self.i += 1
        rate = self.rate * min(1, self.i / 20) / (1 - 0.9**self.i)
        scale = np.float32(1 / np.sqrt(1 - 0.99**self.i))
        d, one, two, room = np.concatenate([v.ravel() for v in g.values()]), self.one, self.two, self.room
        d /= n
        np.subtract(d, one, out=room)
        room *= np.float32(0.1)
        one += room
        d *= d
        d -= two
        d *= np.float32(0.01)
        two += d
        np.sqrt(two, out=room)
        room *= scale
        room += np.float32(1e-6)
        np.multiply(one, np.float32(rate), out=d)
        d /= room
        self.flat -= d


class Network:
    """A gated recurrent unit over input units, with the factored output; parameters in one dictionary."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.seen = 0  # tokens that the averaged weights were trained on

    @classmethod
    def fresh(cls, lex: Lexicon) -> Network:
        rng = np.random.default_rng(7)
        own = np.zeros(OWN)
        own[: min(OWN, len(lex.counts))] = lex.counts[:OWN]
        classes = np.concatenate([own.reshape(-1, GROUP).sum(1), lex.mass]) + 0.1
        r = lambda *s: (rng.normal(size=s) * 0.15).astype(np.float32)
        return cls(
            {
                "x": r(INPUTS, 3 * HIDDEN), "u": r(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
                "c": r(HIDDEN, CLASSES) * 0.3, "cb": np.log(classes / classes.sum()).astype(np.float32),
                "m": r(OWN, HIDDEN) * 0.3, "mb": np.log(own + 0.5).astype(np.float32),
            }
        )

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Inputs, with the bias, and the state's weights by gate (3, rows, HIDDEN), so that each gate's numbers lie together;
        the first two gates' are negated, as their sigmoids want."""
        sign = np.array([-1, -1, 1], np.float32)[:, None, None]
        x, u = (np.multiply(v.reshape(-1, 3, HIDDEN).transpose(1, 0, 2), sign, order="C") for v in (self.p["x"] + self.p["b"], self.p["u"]))
        return x, u

    def walk(self, x: np.ndarray, h: np.ndarray, reset: np.ndarray | None = None):
        """States after each of the inputs x (steps, rows), and what the way back needs."""
        table, u = self.gates()
        reset = np.zeros(x.shape, np.float32) if reset is None else reset
        keep, begins = 1 - reset, reset.any(1)
        a = np.take(table, x, axis=1)
        g, hs, before, n = np.empty((3, *x.shape, HIDDEN), np.float32), *(np.empty((*x.shape, HIDDEN), np.float32) for _ in range(3))
        before[0] = h
        for t in range(len(x)):
            if begins[t]:
                h = h * keep[t][:, None]
            np.matmul(h, u, out=g[:, t])
            both = g[:2, t]
            both += a[:2, t]
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            new = np.multiply(g[2, t], both[1], out=n[t])
            new += a[2, t]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=hs[t])
            h *= both[0]
            h += new
        before[1:] = hs[:-1]
        before[begins] *= keep[begins][:, :, None]
        return hs, h, (before, *g[:2], g[2], n)

    def outputs(self, h: np.ndarray, unit: np.ndarray):
        """log P of the output units' class, and of frequent tokens in their class (0 for others); frequent tokens' rows come by class."""
        p = self.p
        k = np.where(unit < OWN, unit // GROUP, unit - OWN + OWN // GROUP)
        logits = h @ p["c"]
        logits += p["cb"]
        if self._far("c", "cb", 0):
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= np.reciprocal(logits @ np.ones(CLASSES, np.float32))[:, None]
        out = np.log(logits[np.arange(len(k)), k])
        own, edges = self._by_class(unit)
        states = h[own]
        members = self._members(states, edges)
        if self._far("m", "mb", 1):
            members -= members.max(1, keepdims=True)
        np.exp(members, out=members)
        members /= (members @ np.ones(GROUP, np.float32))[:, None]
        out[own] += np.log(members[np.arange(len(own)), unit[own] % GROUP])
        return out, k, logits, own, edges, states, members

    def _far(self, weights: str, bias: str, axis: int) -> bool:
        """Whether logits could leave the range of float32 exponentials; states are within -1 and 1, so that most weights can't."""
        return bool((np.abs(self.p[weights]).sum(axis) + np.abs(self.p[bias])).max() >= 79)

    @staticmethod
    def _by_class(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of frequent tokens, sorted by class, and where each class begins."""
        own = np.flatnonzero(unit < OWN)
        k = (unit[own] // GROUP).astype(np.uint8)
        order = np.argsort(k, kind="stable")
        return own[order], np.searchsorted(k[order], np.arange(OWN // GROUP + 1))

    def _members(self, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Logits of the members of each row's class; rows come by class."""
        out = np.empty((len(h), GROUP), np.float32)
        m = self.p["m"].reshape(-1, GROUP, HIDDEN)
        for c in np.flatnonzero(edges[1:] - edges[:-1]).tolist():
            np.matmul(h[edges[c] : edges[c + 1]], m[c].T, out=out[edges[c] : edges[c + 1]])
        out += np.repeat(self.p["mb"].reshape(-1, GROUP), edges[1:] - edges[:-1], axis=0)
        return out

    def gradients(self, x, y, h, reset, live) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        p = self.p
        hs, last, (before, z, r, gn, n) = self.walk(x, h, reset)
        flat, unit, w = hs.reshape(-1, HIDDEN), y.reshape(-1), live.reshape(-1).astype(np.float32)
        g = {n: np.zeros_like(v) for n, v in p.items()}
        out, dh = self._class_gradients(flat, unit, None if live.all() else w, g)
        own, edges = self._by_class(unit)
        states = np.empty((len(own), HIDDEN + 1), np.float32)  # and a one, for the bias
        states[:, :HIDDEN], states[:, HIDDEN] = flat[own], 1
        members = self._members(states[:, :HIDDEN], edges)
        if self._far("m", "mb", 1):
            members -= members.max(1, keepdims=True)
        np.exp(members, out=members)
        members *= np.reciprocal(members @ np.ones(GROUP, np.float32))[:, None]
        at = np.arange(len(own)), unit[own] % GROUP
        chosen = members[at]
        out[own] += np.log(chosen)
        members[at] = chosen - 1
        if not live.all():
            members *= w[own, None]
        m, gm, to_states = p["m"].reshape(-1, GROUP, HIDDEN), np.zeros((OWN // GROUP, GROUP, HIDDEN + 1), np.float32), np.empty((len(own), HIDDEN), np.float32)
        for c in np.flatnonzero(edges[1:] - edges[:-1]).tolist():
            low, high = edges[c], edges[c + 1]
            d = members[low:high]
            np.matmul(d.T, states[low:high], out=gm[c])
            np.matmul(d, m[c], out=to_states[low:high])
        g["m"], g["mb"] = gm[:, :, :HIDDEN].reshape(OWN, HIDDEN), gm[:, :, HIDDEN].reshape(OWN)
        dh[own] += to_states
        dh = dh.reshape(hs.shape)
        away = 1 - z
        to_z = before - n
        to_z *= z
        to_z *= away
        away *= 1 - n * n
        to_n = away
        to_r = 1 - r
        to_r *= r
        to_r *= gn
        back, way = np.zeros_like(h), np.ascontiguousarray(p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
        dg, dn_all, parts = np.empty((3, *hs.shape), np.float32), np.empty_like(hs), np.empty((3, *h.shape), np.float32)
        keep, begins = 1 - reset, reset.any(1)
        for t in reversed(range(len(x))):
            back += dh[t]
            d = back
            dn = np.multiply(d, to_n[t], out=dn_all[t])
            now = dg[:, t]
            np.multiply(d, to_z[t], out=now[0])
            np.multiply(dn, to_r[t], out=now[1])
            np.multiply(dn, r[t], out=now[2])
            d *= z[t]
            for part in np.matmul(now, way, out=parts):
                back += part
            if begins[t]:
                back *= keep[t][:, None]
        before = before.reshape(-1, HIDDEN)
        g["u"] = np.concatenate([before.T @ d.reshape(-1, HIDDEN) for d in dg], 1)
        rows = np.concatenate([d.reshape(-1, HIDDEN) for d in (dg[0], dg[1], dn_all)], 1)
        g["b"] = np.ones(len(rows), np.float32) @ rows
        order = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")
        inputs = x.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], inputs[1:] != inputs[:-1]]))
        g["x"][inputs[first]] = np.add.reduceat(rows[order], first)
        return g, last, float(-(out * w).sum())

    def _class_gradients(self, h: np.ndarray, unit: np.ndarray, w: np.ndarray | None, g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log P of the units' classes and the loss's slope at the states; adds the class weights' gradients to g. A part of the rows stays in
        a core's cache; w is 0 for rows that don't count."""
        p, far, ones = self.p, self._far("c", "cb", 0), np.ones(max(CLASSES, ROWS), np.float32)
        k = np.where(unit < OWN, unit // GROUP, unit - OWN + OWN // GROUP)
        out, dh, back = np.empty(len(k), np.float32), np.empty_like(h), np.ascontiguousarray(p["c"].T)
        for i in range(0, len(k), ROWS):
            part, at = h[i : i + ROWS], (np.arange(len(k[i : i + ROWS])), k[i : i + ROWS])
            probs = part @ p["c"]
            probs += p["cb"]
            if far:
                probs -= probs.max(1, keepdims=True)
            np.exp(probs, out=probs)
            probs *= np.reciprocal(probs @ ones[:CLASSES])[:, None]
            chosen = probs[at]
            np.log(chosen, out=out[i : i + ROWS])
            probs[at] = chosen - 1
            if w is not None:
                probs *= w[i : i + ROWS, None]
            g["c"] += part.T @ probs
            g["cb"] += ones[: len(part)] @ probs
            np.matmul(probs, back, out=dh[i : i + ROWS])
        return out, dh

    def train(self, docs: Iterable[np.ndarray], rate: float) -> int:
        """One pass of truncated backpropagation over documents given as units; returns the tokens seen.

        Documents are joined and cut into parts of LANES lanes of SPAN steps, so what is held is bounded whatever their length. A
        document resets the state; a lane that begins inside one knows the token before.
        """
        step = Adam(self.p, rate)
        seen, size = 0, LANES * SPAN
        held: list[np.ndarray] = []
        opens: list[np.ndarray] = []
        before = INPUTS - 1

        def part(y: np.ndarray, new: np.ndarray) -> None:
            nonlocal before
            x = np.concatenate([[before], y[:-1]])
            x[new] = INPUTS - 1
            before = y[-1]
            steps = -(-len(y) // LANES)
            live = np.arange(steps * LANES) < len(y)
            shaped = [np.concatenate([v, np.zeros(steps * LANES - len(v), v.dtype)]).reshape(LANES, steps).T for v in (x, y, new)] + [live.reshape(LANES, steps).T]
            h = np.zeros((LANES, HIDDEN), np.float32)
            for a in range(0, steps, STEPS):
                xs, ys, reset, alive = (v[a : a + STEPS] for v in shaped)
                g, h, _ = self.gradients(xs, ys, h, reset.astype(np.float32), alive)
                step(g, max(1, alive.sum()))

        waiting = 0
        for d in docs:
            seen += len(d)
            at = 0
            while at < len(d):
                piece = d[at : at + size - waiting]
                new = np.zeros(len(piece), bool)
                new[:1] = at == 0
                held.append(piece.astype(np.int64))
                opens.append(new)
                at, waiting = at + len(piece), waiting + len(piece)
                if waiting == size:
                    part(np.concatenate(held), np.concatenate(opens))
                    held, opens, waiting = [], [], 0
        if waiting:
            part(np.concatenate(held), np.concatenate(opens))
        return seen

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Sum of log P over each document's units, whole documents, state carried from window to window.

        Documents are dealt over at most BATCH lanes, the longest first, each to the lane that is shortest then; one that begins resets its
        lane's state, so that few steps have few rows.
        """
        order = sorted((j for j in range(len(docs)) if len(docs[j])), key=lambda j: -len(docs[j]))
        lanes: list[list[int]] = [[] for _ in range(min(BATCH, len(order)))]
        loads = [(0, i) for i in range(len(lanes))]
        for j in order:
            load, i = loads[0]
            lanes[i].append(j)
            heapq.heapreplace(loads, (load + len(docs[j]), i))
        if not order:
            return np.zeros(len(docs))
        loads.sort(reverse=True)
        rows = np.array([j for _, i in loads for j in lanes[i]])
        flat = np.concatenate([docs[j] for j in rows]).astype(np.int64)
        sizes, length = np.array([len(docs[j]) for j in rows]), np.array([n for n, _ in loads])
        opens = np.zeros(len(flat), bool)
        opens[np.cumsum(sizes) - sizes] = True
        before = np.where(opens, INPUTS - 1, np.roll(flat, 1))
        start, out = np.cumsum(length) - length, np.empty(len(flat))
        table, u = self.gates()
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        for a in range(0, int(length[0]), STEPS):
            k = int((length > a).sum())  # longest first, so those still running are the first k
            step = np.arange(a, min(a + STEPS, int(length[0])))[:, None]
            at = start[:k] + np.minimum(step, length[:k] - 1)
            hs, h = self.run(table, u, before[at], h[:k], opens[at])
            hs, at, live = hs.reshape(-1, HIDDEN), at.reshape(-1), (step < length[:k]).reshape(-1)
            if not live.all():
                hs, at = hs[live], at[live]
            out[at] = self.log_probabilities(hs, flat[at])
        return np.bincount(np.repeat(rows, sizes), out, len(docs))

    def run(self, table: np.ndarray, u: np.ndarray, x: np.ndarray, h: np.ndarray, reset: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As walk, for scoring only: nothing is kept for a way back."""
        begins = np.zeros(len(x), bool) if reset is None else reset.any(1)
        hs = np.empty((*x.shape, HIDDEN), np.float32)
        a, g = (np.empty((3, x.shape[1], HIDDEN), np.float32) for _ in range(2))
        zr, n = g[:2], g[2]
        for t in range(len(x)):
            if begins[t]:
                h = h.copy()
                h[reset[t]] = 0
            np.take(table, x[t], axis=1, out=a, mode="clip")
            for gate in range(3):
                np.matmul(h, u[gate], out=g[gate])
            zr += a[:2]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n *= zr[1]
            n += a[2]
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=hs[t])
            h *= zr[0]
            h += n
        return hs, h

    def log_probabilities(self, h: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """As the first of outputs, without what only training needs; logits stay small enough for float32 exponentials."""
        p = self.p
        k = np.where(unit < OWN, unit // GROUP, unit - OWN + OWN // GROUP)
        far, out, shares = self._far("c", "cb", 0), np.empty(len(k)), np.exp(p["cb"])
        for i in range(0, len(k), ROWS):  # a part stays in a core's cache
            part = k[i : i + ROWS]
            logits = h[i : i + ROWS] @ p["c"]
            if far:
                logits += p["cb"]
                np.clip(logits, -80, 80, out=logits)
            chosen = logits[np.arange(len(part)), part].astype(float)
            np.exp(logits, out=logits)
            out[i : i + ROWS] = chosen - np.log(logits @ np.ones_like(shares)) if far else chosen + p["cb"][part] - np.log(logits @ shares)
        own, edges = self._by_class(unit)
        z = self._members(h[own], edges)
        if self._far("m", "mb", 1):
            np.clip(z, -80, 80, out=z)
        chosen = z[np.arange(len(own)), unit[own] % GROUP].astype(float)
        np.exp(z, out=z)
        out[own] += chosen - np.log(z @ np.ones(GROUP, np.float32))
        return out


def _average(got: pa.Table, shapes: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], int]:
    """Weights (i, v, n) of all shards, averaged by tokens, in the shapes of the given ones; and the tokens."""
    i, v, n = (got.column(c).to_numpy() for c in ("i", "v", "n"))
    if not len(i) or not n.max():
        return shapes, 0
    flat = np.zeros(len(i))
    flat[i] = v / n
    cuts = np.cumsum([x.size for x in shapes.values()])[:-1]
    return {name: piece.reshape(x.shape).astype(np.float32) for (name, x), piece in zip(shapes.items(), np.split(flat, cuts))}, int(n.max())


def train_network(train_docs: DataFrame, lex: Lexicon, warm_tokens: int = WARM_TOKENS, shard_tokens: int = SHARD_TOKENS, rate: float = 8e-3) -> Network:
    """A network trained on every document once, the same however the documents are partitioned.

    A hash of id and text says in which round and shard a document is learnt, and its place there. Round 0 is one shard of about
    ``warm_tokens`` (a corpus no larger is all in it, and read again up to SMALL_TOKENS); each of ROUNDS rounds then deals its share over
    shards of about ``shard_tokens``, which start from the weights so far; these become the shards' mean by tokens.
    """
    net = Network.fresh(lex)
    spark, space, total = train_docs.sparkSession, 1 << 30, max(1, lex.total)
    first = space if total <= warm_tokens else max(1, space * warm_tokens // total)
    edges = [0, *(first + (space - first) * i // ROUNDS for i in range(ROUNDS + 1))]
    rows = train_docs.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(space)).alias("place"), "_text")
    words = spark.sparkContext.broadcast(lex)
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        if low == high:
            continue
        wanted = total * (high - low) // space
        shards = 1 if number == 0 else max(1, min(MOST_SHARDS, -(-wanted // shard_tokens)))
        again = min(100, SMALL_TOKENS // total) if number == 0 and first == space else 1
        start, speed = spark.sparkContext.broadcast(net.p), rate if number == 0 else rate / 4

        def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = words.value
            for b in portions(batches, 2):
                code, sizes, _, _ = lexicon.codes(b.column(2))
                ends = np.concatenate([[0], np.cumsum(2 * sizes)]).astype(np.int32)
                found = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(lexicon.units(code).astype(np.uint16))])
                yield pa.record_batch([b.column(0), b.column(1), found], ["shard", "place", "units"])

        def learn(batches: Iterator[pa.RecordBatch], again: int = again, start=start, speed: float = speed) -> Iterator[pa.RecordBatch]:
            def documents() -> Iterator[tuple[int, np.ndarray]]:
                for b in pieces(batches):
                    yield from zip(b.column(0).to_pylist(), (np.frombuffer(x, np.uint16) for x in b.column(2).to_pylist()))

            for _, group in itertools.groupby(documents(), key=lambda x: x[0]):
                own = Network({n: v.copy() for n, v in start.value.items()})
                docs: Iterable[np.ndarray] = (d for _, d in group)
                if again > 1:  # a small corpus: at most warm_tokens are held
                    docs = [*docs] * again
                seen = own.train(docs, speed) // again
                flat = np.concatenate([v.ravel() for v in own.p.values()]).astype(float) * seen
                yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat), pa.array(np.full(len(flat), seen), pa.int64())], ["i", "v", "n"])

        part = rows.where((F.col("place") >= low) & (F.col("place") < high)).select(F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"), "place", "_text")
        coded = part.mapInArrow(units, "shard long, place long, units binary").repartition(shards, "shard").sortWithinPartitions("shard", "place", "units")
        got = coded.mapInArrow(learn, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
        net.p, seen = _average(got, net.p)
        net.seen += seen
    return net


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), (fold(F.col(id_col)) == 1).alias("_out"))
    counts = materialize(count_tokens(rows.where("NOT _out")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    mass = np.full(SPELLED, 0.5)
    for cls, m in counts.groupBy("cls").agg(F.sum(F.col("n") + 0.5)).collect():  # SPELLED rows
        mass[cls] += m
    head = frequent(counts, HEAD).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, n = head.column("word").combine_chunks(), head.column("n").to_numpy().astype(float)
    # frequent tokens have vectors of their own: only the others share their class's mass
    np.subtract.at(mass, spelled_classes(words[:OWN]), n[:OWN] + 0.5)
    mass = np.maximum(mass, 0.5)
    lex = Lexicon(words, n, total, distinct, mass)
    net = train_network(rows.where("NOT _out"), lex)
    sent = spark.sparkContext.broadcast((lex, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, p = sent.value
        own, number = Network(p), 0
        task = TaskContext.get().partitionId() << 36
        for b in portions(batches, 1):
            code, sizes, texts, words = lexicon.codes(b.column(1))
            n, starts, first = b.num_rows, np.cumsum(sizes) - sizes, task + number
            number += n
            n_head, base, extra = (np.add.reduceat(v, starts) for v in ((code >= 0).astype(np.int64), lexicon.base[code], lexicon.share[code]))
            score = own.score(np.split(lexicon.units(code), starts[1:])) / LN10 + extra
            keys = pa.array(np.arange(first, first + n), pa.int64())
            null = lambda k, t: pa.nulls(k, t)
            yield pa.record_batch(
                [keys, b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(n_head), pa.array(base), pa.array(score), null(n, pa.binary()), null(n, pa.int64())],
                NAMES,
            )
            if len(words):
                tail = words.dictionary_encode()
                pair, times = np.unique(texts * len(tail.dictionary) + tail.indices.to_numpy(), return_counts=True)
                text, word = np.divmod(pair, len(tail.dictionary))
                m = len(pair)
                yield pa.record_batch(
                    [pa.array(first + text, pa.int64()), null(m, b.column(0).type), null(m, pa.bool_()), null(m, pa.int64()), null(m, pa.int64()), null(m, pa.float64()), null(m, pa.float64()), tail.dictionary.take(pa.array(word)), pa.array(times, pa.int64())],
                    NAMES,
                )

    schema = f"_key long, _id {dict(rows.dtypes)['_id']}, held_out boolean, n_tokens long, n_head long, base double, score double, word binary, k long"
    seen = materialize(rows.select("_id", "_text", "_out").mapInArrow(run, schema), "lm-scores")
    c = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    log_mass = F.get(F.array(*(F.lit(float(np.log10(x))) for x in mass)), F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(SPELLED)).cast("int"))
    tails = seen.where("word IS NOT NULL").select("_key", "word", "k").join(counts.select("word", "n"), "word", "left")
    tails = tails.groupBy("_key").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("_known"),
        F.sum(F.col("k") * (F.log10(c + 0.5) - float(np.log10(lex.norm)))).alias("_base"),
        F.sum(F.col("k") * (F.log10(c + 0.5) - log_mass)).alias("_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return seen.where("word IS NULL").join(tails, "_key", "left").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens",
        plus("n_head", "_known").cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"), plus("score", "_score").alias("score"),
    )


NAMES = ["_key", "_id", "held_out", "n_tokens", "n_head", "base", "score", "word", "k"]
