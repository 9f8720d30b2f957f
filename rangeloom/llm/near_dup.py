"""MinHash near-duplicate groups by a multi-index Hamming join.

Every distinct shingle set gets a signature of SLOTS codes of BITS bits. The join finds all signatures that differ in at
most DISTANCE codes: it splits them into CHUNKS; by the pigeonhole principle two such signatures differ in at most ERRORS
codes of some chunk, and enumerating which code of a chunk may err (it is masked) turns that into equal keys. Sets of
Jaccard similarity 0.85 share no key with probability about 2e-5 (at 0.8: 3e-4).

A bucket of equal keys is never expanded into its pairs. Its members within NEAR of each other are linked to a
spanning forest by a search that compares only members not yet reached, so a bucket yields fewer links than members. The
forests' components ("families") hold every pair under the distance. Within a family the full shingle sets are compared
exactly, as bit rows over the family's own shingles, and again only a spanning forest of confirmed links leaves the task.
Buckets over BUCKET rows and families over FAMILY members or WEIGHT shingles are dealt out as pairs of blocks, each pair a
task of its own, which compares everything the undivided group would. Equal sets, however many, are one member.

A shingle is kept as 64 bits of a hash of its words. Members' sets are made again from the texts of just those documents
whose ids are in a fixed-size bit set of family members, so no text is shuffled and no set is stored for single documents.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text of
fewer words than a shingle is one shingle; equal sets are linked; component_id is the smallest id reachable; rows that
repeat an id are each reported (a null id is no smaller than any other, so its row is kept only if it is alone or all ids
of its group are null); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, free_name, materialize, pieces

WORDS, PERCENT = 5, 85
SLOTS, BITS, CHUNKS, ERRORS = 30, 12, 6, 1
WIDTH = SLOTS // CHUNKS
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Signatures that share a key are taken for near up to this distance; up to DISTANCE they are sure to share one.
NEAR = DISTANCE + 4
BUCKET, FAMILY, WEIGHT = 4000, 400, 1_000_000
MEMBER_BITS = 1 << 23
#: So many distinct links at most are sent to the driver (8 MB): rounds of stars would be hundreds of small tasks each.
FEW_LINKS = 500_000
#: A set or node of at least a HOT_GROUPS-th of the rows, and HOT_ROWS of them, goes by broadcast.
HOT_GROUPS, HOT_ROWS = 5000, 1000
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 2**63, SLOTS, dtype=np.uint64) | np.uint64(1)
SUMMANDS = _RNG.integers(1, 2**63, SLOTS, dtype=np.uint64)
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASH = WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ids = np.fromiter(map(_HASH.__getitem__, split), np.uint64, len(split))
    if not len(ids):
        return ids
    k = min(words, len(ids))
    n = len(ids) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ (ids[i : i + n] * P2)) * P1
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """SLOTS codes of BITS bits of a set that is not empty."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        h = s[i : i + 4096, None] * FACTORS + SUMMANDS
        low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(0))
    return (_mix(low) >> np.uint64(64 - BITS)).astype(np.uint16)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, n_shingles, digest of the set (null if empty), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["_id", "n_shingles", "digest", "sig"])

    schema = f"_id {dict(docs.dtypes)[id_col]}, n_shingles long, digest binary, sig binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _codes(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SLOTS)


def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, sig) to (key, member, sig), one row for each chunk and masked code of it."""
    for b in batches:
        code = _codes(b.column(1).to_pylist()).astype(np.int64)
        n = len(code)
        keys = []
        for c in range(CHUNKS):
            for masked in range(WIDTH):
                key = np.full(n, c * WIDTH + masked, np.int64)
                for i in range(WIDTH):
                    if i != masked:
                        key = (key << BITS) | code[:, c * WIDTH + i]
                keys.append(key)
        at = pa.array(np.tile(np.arange(n), len(keys)))
        yield pa.record_batch([pa.array(np.concatenate(keys)), b.column(0).take(at), b.column(1).take(at)], ["key", "member", "sig"])


def forest(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 256) -> list[tuple[int, int]]:
    """Spanning forest of the graph on range(n): near(a, b) says which of a are linked with which of b (a matrix)."""
    left = np.arange(n)
    links: list[tuple[int, int]] = []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:block], frontier[block:]
            hit = near(now, left)
            got = hit.any(0)
            if got.any():
                links += zip(now[hit[:, got].argmax(0)].tolist(), left[got].tolist())
                frontier, left = np.concatenate([frontier, left[got]]), left[~got]
    return links


def runs(batches: Iterator[pa.RecordBatch], n_keys: int, most: int | None) -> Iterator[tuple[bool, pa.Table]]:
    """Rows of equal keys (the first columns) from sorted batches, as (whole, rows): groups of up to ``most`` rows are
    whole, of others every part comes as not whole."""
    open_rows: list[pa.RecordBatch] = []
    size, last, over = 0, None, False
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if key != last:
                if open_rows:
                    yield not over, pa.Table.from_batches(open_rows)
                open_rows, size, last, over = [], 0, key, False
            open_rows.append(b.slice(a, z - a))
            size += z - a
            if most and size > most:
                over = True
                yield False, pa.Table.from_batches(open_rows)
                open_rows = []
    if open_rows:
        yield not over, pa.Table.from_batches(open_rows)


def _signature_links(ids: list, sigs: list[bytes]) -> list[tuple]:
    code = _codes(sigs)
    links = forest(len(ids), lambda a, b: (code[a][:, None, :] != code[b][None, :, :]).sum(2, dtype=np.uint8) <= NEAR, block=16)
    return [(ids[x], ids[y]) for x, y in links]


def link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, member, sig) to links (a, b) and, for buckets over BUCKET rows, their rows as they are."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("sig", pa.binary())])
    links: list[tuple] = []

    def out() -> pa.RecordBatch:
        x = np.array(links, np.int64).reshape(-1, 2)
        links.clear()
        return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())], schema=schema)

    for whole, rows in runs(_without_singles(batches), 1, BUCKET):
        if whole:
            ids = rows.column(1).to_pylist()
            if len(ids) > 1:
                links += _signature_links(ids, rows.column(2).to_pylist())
        else:
            for b in rows.to_batches():
                yield pa.record_batch([b.column(1), pa.nulls(b.num_rows, pa.int64()), b.column(0), b.column(2)], schema=schema)
        if len(links) > 50_000:
            yield out()
    yield out()


def _without_singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows whose neighbours in the same batch have other keys, except at the batch's ends."""
    for b in batches:
        if b.num_rows > 2:
            key = b.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[True], same]) | np.concatenate([same, [True]])
            b = b.filter(pa.array(keep))
        yield b


def link_sets(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Sorted (task, member, shingles) to confirmed links (a, b)."""
    links: list[tuple] = []
    for _, rows in runs(batches, 1, None):
        ids = rows.column(1).to_pylist()
        if len(ids) < 2:
            continue
        column = rows.column(2).combine_chunks()
        flat = column.flatten().to_numpy()
        size = np.diff(column.offsets.to_numpy())
        _, at = np.unique(flat, return_inverse=True)
        width = int(at.max()) // 64 + 1
        bits = np.zeros((len(ids), width), np.uint64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(ids)), size), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

        def near(a: np.ndarray, b: np.ndarray, bits: np.ndarray = bits, size: np.ndarray = size) -> np.ndarray:
            out = np.zeros((len(a), len(b)), bool)
            for i, x in enumerate(a):
                for j in range(0, len(b), 512):
                    other = b[j : j + 512]
                    both = np.bitwise_count(bits[x] & bits[other]).sum(1, dtype=np.int64)
                    out[i, j : j + 512] = 100 * both >= percent * (size[x] + size[other] - both)
            return out

        links += [(ids[x], ids[y]) for x, y in forest(len(ids), near, block=8)]
        if len(links) > 50_000:
            yield _pairs(links)
    yield _pairs(links)


def _pairs(links: list[tuple]) -> pa.RecordBatch:
    x = np.array(links, np.int64).reshape(-1, 2)
    links.clear()
    return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks (of its group's number) that holds its own; task names group and pair."""
    own = F.pmod(F.xxhash64("member"), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", other)
    return rows.withColumn("task", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")


def _with_least(edges: DataFrame, node: str, value: str, hubs: int) -> DataFrame:
    """Each edge with m, the least ``value`` of its ``node``. If ``hubs`` is given, nodes of at least so many edges (a bounded
    number) meet their least by broadcast, as a shuffle would send all of a hub's edges to one task."""
    least = edges.groupBy(node).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("_n"))
    if not hubs:
        return edges.join(least.drop("_n"), node)
    hot, cold = F.broadcast(least.where(F.col("_n") >= hubs).drop("_n")), least.where(F.col("_n") < hubs).drop("_n")
    return edges.join(hot, node).unionByName(edges.join(hot, node, "left_anti").join(cold, node))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) that reach a smaller one, and the smallest that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node and the smallest node that its links (a, b) reach: of up to ``few`` distinct links of long ids on the driver, of
    others by alternating large and small stars."""
    spark = links.sparkSession
    rounds = Rounds(spark, "edges")
    edges = rounds.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if {t for _, t in edges.dtypes} == {"bigint"} and edges.count() <= few:
        got = edges.toArrow()
        node, root = least_reachable(got.column("u").to_numpy(), got.column("v").to_numpy())
        return materialize(spark.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})), "roots")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        degree, *now = nodes.agg(F.coalesce(F.max("n"), F.lit(0)), F.sum("n"), F.bit_xor("x")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        most = max((now[0] or 0) // HOT_GROUPS, HOT_ROWS)
        hubs = most if degree >= most else 0
        large = _with_least(both, "u", "v", hubs).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(large, "u", "v", hubs)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = rounds.write(small.where("u <> v").distinct())


def _member_bits(members: DataFrame) -> np.ndarray:
    """A fixed-size bit set of hashed member ids, folded on the executors."""
    at = F.pmod(F.xxhash64("member"), F.lit(MEMBER_BITS))
    rows = members.select(F.shiftright(at, 6).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(member), {MEMBER_BITS}) & 63 as int))").alias("b"))
    got = rows.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(MEMBER_BITS // 64, np.int64)
    words[got.column("i").to_numpy()] = got.column("b").to_numpy()
    return words.view(np.uint64)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept. Links have a similarity of at least ``percent`` hundredths."""
    spark = docs.sparkSession
    signed = materialize(sign(docs, id_col, text_col), "signed")
    sets = materialize(
        signed.where("digest IS NOT NULL AND _id IS NOT NULL").groupBy("digest").agg(F.min("_id").alias("member"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")), "sets"
    )
    keyed = sets.select("member", "sig").mapInArrow(enumerate_keys, "key long, member long, sig binary")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link_buckets, "a long, b long, key long, sig binary"), "bucket-links")
    links = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL").select("key", F.col("a").alias("member"), "sig")
    counts = materialize(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (BUCKET // 2)).alias("blocks")), "large-buckets")
    if counts.limit(1).count():
        dealt = in_blocks(large.join(counts, "key"), "key", "blocks").select("task", "member", "sig")
        again = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(link_all, "a long, b long")
        links = links.unionByName(again)
    families = components(links)
    families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("member"), F.col("root").alias("family"))
    members = materialize(families.join(sets.select("member", "n"), "member"), "members")
    totals = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / (FAMILY // 2)), F.ceil(F.sum("n") / (WEIGHT // 2))).alias("blocks"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")
    )
    totals = materialize(totals.select("family", F.when((F.col("m") > FAMILY) | (F.col("w") > WEIGHT), F.col("blocks")).otherwise(F.lit(1).cast("long")).alias("blocks")), "families")
    wanted = spark.sparkContext.broadcast(_member_bits(members))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for b in pieces(batches):
            h = b.column(2).to_numpy()
            keep = np.flatnonzero((bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1))
            if len(keep):
                b = b.take(pa.array(keep))
                sets_ = [shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array(sets_, pa.list_(pa.int64()))], ["member", "shingles"])

    made = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("member"), F.col(text_col).alias("_text"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(MEMBER_BITS)).alias("_bit"))
    made = made.mapInArrow(pick, "member long, shingles array<long>")
    dealt = members.join(totals, "family")
    dealt = made.join(in_blocks(dealt, "family", "blocks").select("task", "member"), "member").select("task", "member", "shingles")
    confirmed = materialize(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(partial(link_sets, percent=percent), "a long, b long"), "confirmed")
    roots = components(confirmed)
    # every document learns its set's smallest id, then that id's root
    shared = sets.where("copies > 1").select("digest", "member", "copies")
    whole = signed.count()
    is_hot = F.col("copies") >= F.lit(max(-(-whole // HOT_GROUPS), HOT_ROWS))  # at most HOT_GROUPS sets
    hot = shared.where(is_hot).select("digest", F.col("member").alias("_hot"))
    cold = shared.where(~is_hot).select(F.col("digest").alias("_key"), F.col("member").alias("_cold"))
    rows = signed.select("_id", "n_shingles", "digest").join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("-"), F.xxhash64("_id").cast("string")), "utf-8")))
    rows = rows.join(cold, "_key", "left").withColumn("_member", F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.coalesce("_hot", "_cold", "_id")))
    # members of one hot set share its root: it is looked up by broadcast, the others' by a shuffle on distinct ids
    hot_roots = hot.join(roots, hot["_hot"] == roots["node"], "left").select(F.col("_hot").alias("_h"), F.coalesce("root", "_hot").alias("_hroot"))
    rows = rows.join(F.broadcast(hot_roots), F.col("_hot") == F.col("_h"), "left")
    other = F.when(F.col("_hroot").isNull(), F.col("_member")).otherwise(-F.abs(F.xxhash64("_id")) - 1)
    rows = rows.withColumn("_other", other).join(roots, (F.col("_other") == F.col("node")) & F.col("_hroot").isNull(), "left")
    component = F.coalesce("_hroot", "root", "_member")
    return rows.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def link_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (task, member, sig) to links, for the block pairs of large buckets."""
    links: list[tuple] = []
    for _, rows in runs(batches, 1, None):
        links += _signature_links(rows.column(1).to_pylist(), rows.column(2).to_pylist())
        yield _pairs(links)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One document of each group, with its own columns: the one of the smallest id.

    Documents are told apart by id: an id stays if any of its rows is kept, and rows without an id all stay.
    """
    seen = annotate(docs, id_col, text_col, percent).where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("kept").alias("kept"))
    name = free_name(docs, "_gone")
    gone = seen.where("NOT kept").select(F.col(id_col).alias(name))
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")
