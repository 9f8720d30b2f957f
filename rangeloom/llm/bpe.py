"""Byte-level BPE encoding and decoding with a tokenization automaton.

The merges are compiled in rank order into a deterministic automaton over token labels. It starts with one state that
loops on every byte. The gadget for a merge (u, v) -> w takes the v arc from the state that u leads to, and adds a w arc
wherever a u arc starts; w leads to what the v state was before. A state is thus fixed by its last label. Arcs are kept
in that symbolic form (who made a label, when, and which arc each merge took away) and expanded into the transition
table when first used, so compiling takes time and memory linear in the merges and the table holds only arcs in use.

The automaton accepts exactly one label path for a byte string, the one BPE yields. Encoding a pre-split word follows
table transitions from position to position: the last label of a prefix is the one label that ends there and has an arc
from the state of the prefix before it; one array a word holds these states, so time and memory are linear in a word of any
length and nothing recurses. Decoding emits the labels' bytes.

Defined results: a null text counts as empty and has no tokens; an added token's string in a text is that token; rows
are treated one by one, so repeated ids, ties and other columns change nothing; a word or text of any length is encoded whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces

#: Fixed value: how the byte-level pre-tokenizer splits a text.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts below this code point are split by the standard library's engine, with the pattern's classes written out.
LATIN = 0x250
#: What a worker keeps of words met (bytes, by estimate) and of transitions; beyond it both start anew.
CACHE_BYTES, MOST_ARCS = 96 << 20, 1_000_000
#: Words of more bytes are encoded anew each time.
SHORT_WORD = 128


def latin_split() -> re.Pattern:
    """PRE_SPLIT for texts below LATIN: the classes are the ranges of code points that the full pattern's classes hold."""

    def ranges(kind: str) -> str:
        inside = [bool(regex.match(kind, chr(i))) for i in range(LATIN)] + [False]
        edges = [i for i in range(LATIN + 1) if inside[i] != (inside[i - 1] if i else False)]
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))

    letter, number, space = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    return re.compile(f"{short}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return out


class MergeAutomaton:
    """Deterministic automaton of correct tokenizations, built gadget by gadget."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: b for b, i in vocab.items()}
        self.ids = vocab
        self.made: dict[int, tuple[int, int, int]] = {}  # label -> (rank, left, right)
        self.taken: dict[tuple[int, int], int] = {}  # (state, label) -> rank of the gadget that took this arc away
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.longest = max(map(len, vocab), default=1)
        self.table: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.size = {i: len(b) for b, i in vocab.items()}
        self.cached = 0

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.taken.setdefault((u, v), rank)
        self.made.setdefault(w, (rank, u, v))

    def _expand(self, state: int, label: int, before: int) -> bool:
        """Whether the arc exists once all gadgets ranked under ``before`` are in."""
        while True:
            if self.taken.get((state, label), before) < before:
                return False
            s, x = self.made.get(state), self.made.get(label)
            if s is None and x is None:
                return True
            if x is not None and (s is None or x[0] >= s[0]):  # the label came later: it started where its left part did
                before, label = x[0] + 1, x[1]
            else:  # the state came later: it is what its right part's state was
                before, state = s[0], s[2]

    def arc(self, state: int, label: int) -> bool:
        key = state << 32 | label
        found = self.table.get(key)
        if found is None:
            found = self.table[key] = self._expand(state, label, 1 << 60)
        return found

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        """A walk over the transitions from position to position, then back along the last labels; linear in the word."""
        if (whole := self.ids.get(word)) is not None and self._reached(whole):
            return (whole,)
        ids, longest, arc, sizes = self.ids, self.longest, self.arc, self.size
        last = [-1]  # of the path to each position, its last label: the state there
        for end in range(1, len(word) + 1):
            found = ids.get(word[:end], -1) if end <= longest else -1
            if found < 0 or not self._reached(found):
                for start in range(max(1, end - longest), end):
                    found = ids.get(word[start:end], -1)
                    if found >= 0 and arc(last[start], found):
                        break
            last.append(found)
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= sizes[out[-1]]
        out.reverse()
        return tuple(out)

    def _reached(self, label: int) -> bool:
        """Labels that no merge makes and that aren't single bytes have no arc."""
        return label in self.made or len(self.label[label]) == 1

    def encode_word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if self.cached >= CACHE_BYTES or len(self.table) >= MOST_ARCS:
                self.words.clear()
                self.table.clear()
                self.cached = 0
            raw = word.encode("utf-8", "surrogatepass")
            found = self.encode_bytes(raw)
            if len(raw) <= SHORT_WORD:
                self.words[word] = found
                self.cached += 150 + len(raw) + 40 * len(found)
        return found


class Tokenizer:
    """A byte-level BPE vocabulary file with its added tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        byte = byte_characters()
        raw = lambda s: bytes(byte[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton({raw(t): i for t, i in spec["model"]["vocab"].items()}, [(raw(a), raw(b)) for a, b in merges])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre_split = regex.compile(PRE_SPLIT)
        self.latin_split, self.beyond = latin_split(), re.compile(f"[^\x00-{chr(LATIN - 1)}]")
        self.labels = dict(self.automaton.label) | {i: s.encode() for s, i in self.added.items()}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, encode_word = self.automaton.words, self.automaton.encode_word
        pieces = self.split_added.split(text) if self.split_added and any(s in text for s in self.added) else [text]
        for piece in pieces:
            if piece in self.added:
                out.append(self.added[piece])
            else:
                split = self.pre_split if self.beyond.search(piece) else self.latin_split
                for word in split.findall(piece):
                    out += known.get(word) or encode_word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer_of(text: str) -> Tokenizer:
    """One compiled tokenizer a process and vocabulary."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(text)
    return _TOKENIZERS[key]


def read_vocabulary(path: str) -> str:
    """The file's text; read on the driver, which sends it to the executors."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ids (array of int)."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(sent.value)
        for b in pieces(batches):
            ids = [t.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(tokens: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: id, text."""
    sent = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(sent.value)
        for b in pieces(batches):
            yield pa.record_batch([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, text string")


def report(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256, decoded_sha256; the digests spare moving the ids."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(sent.value)
        for b in pieces(batches):
            counts, ids_digests, text_digests = [], [], []
            for text in b.column(1).to_pylist():
                ids = t.encode(text or "")
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
