"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over training token windows.

A window of L words always covers a whole block of b = (L + 1) // 2 words that starts at a multiple of b. So documents
are hashed only at every b-th word; a fixed-size bit set of all b-grams of the benchmark (any offset) drops nearly all
of those blocks inside the expression, without an explode. Only windows around surviving blocks are made, tested
against a second bit set, and joined on their words with the benchmark's windows, which verifies each hit. The bit sets
have a fixed size (``BITS``), whatever the benchmark's: when one fills up, more windows reach the join and the result is
the same. The window table is broadcast only if it has at most ``BROADCAST_WINDOWS`` rows; a larger one is shuffled.

Defined results: a null or empty text has no words and is never hit; an item without words has no window; an item
shorter than the window is one window of its own length; rows that repeat both id and text give one result row; an
empty benchmark hits nothing; a very long text is scanned whole; other columns, of whatever names, pass through the removing
functions unchanged and are ignored by the report; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name

WINDOW = 13
BITS = 1 << 20
BROADCAST_WINDOWS = 500_000
NO_HITS = "cast(array() as array<struct<start:int,len:int,window:string>>)"
#: Of lower-cased texts what stands between words, of texts as they are a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _bit_set(hashes: DataFrame) -> str:
    """An array literal of BITS bits, from a table with one column of hashes."""
    bits = [0] * (BITS // 64)
    for (h,) in hashes.select(F.pmod(F.col("h"), F.lit(BITS))).distinct().collect():  # at most BITS values
        bits[h >> 6] |= 1 << (h & 63)
    signed = (x - (1 << 64) if x >> 63 else x for x in bits)
    return f"cast(split('{','.join(map(str, signed))}', ',') as array<bigint>)"


def _has(bits: Column, h: Column) -> Column:
    at = F.pmod(h, F.lit(BITS))
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def windows_of(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row a distinct window: words joined by a space, length, sorted items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_words"))
    items = items.withColumn("_len", F.least(F.size("_words"), F.lit(window))).where("_len > 0")
    starts = F.sequence(F.lit(1), F.size("_words") - F.col("_len") + 1)
    rows = items.select("_item", "_len", "_words", F.explode(starts).alias("_at"))
    rows = rows.select("_item", "_len", F.array_join(F.slice("_words", F.col("_at"), F.col("_len")), " ").alias("_window"))
    return rows.groupBy("_window", "_len").agg(F.collect_set("_item").alias("_items"))


def _hits_of(split: DataFrame, length: int) -> Column:
    """Array of (start, len, window) for the windows of one length in a row's _words that pass both bit sets."""
    b = (length + 1) // 2
    of = split.where(F.col("_len") == length)
    offsets = F.sequence(F.lit(1), F.lit(length - b + 1))
    grams = of.select(F.explode(F.transform(offsets, lambda i: F.xxhash64(F.slice("_w", i, b)))).alias("h"))
    block_bits = F.expr(_bit_set(grams))
    window_bits = F.expr(_bit_set(of.select(F.xxhash64("_w").alias("h"))))
    numbers = F.sequence(F.lit(0), F.expr(f"_n div {b}") - 1)
    blocks = F.filter(numbers, lambda i: _has(block_bits, F.xxhash64(F.slice("_words", i * b + 1, b))))
    around = F.transform(blocks, lambda i: F.sequence(F.greatest(F.lit(0), i * b + b - length), F.least(i * b, F.col("_n") - length)))
    starts = F.filter(
        F.array_distinct(F.flatten(around)), lambda s: _has(window_bits, F.xxhash64(F.slice("_words", s + 1, length)))
    )
    hits = F.transform(
        starts,
        lambda s: F.struct(
            s.cast("int").alias("start"), F.lit(length).alias("len"), F.array_join(F.slice("_words", s + 1, length), " ").alias("window")
        ),
    )
    return F.when(F.col("_n") >= length, hits).otherwise(F.expr(NO_HITS))


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row a document: id, n_words, spans (merged [start, end) word ranges that are hit), n_hit, items (sorted strings)."""
    tests = windows_of(benchmark, window, item_col, item_text)
    split = tests.select("_len", "_window", F.split("_window", " ").alias("_w"))
    lengths = sorted(r[0] for r in tests.select("_len").distinct().collect())  # at most `window` values
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_row"),
        words_of(F.col(text_col)).alias("_words"),
    )
    rows = rows.withColumn("_n", F.size("_words"))
    found = [_hits_of(split, length) for length in lengths]
    if not found:
        found = [F.expr(NO_HITS)]
    rows = rows.select("_id", "_row", "_n", F.explode_outer(F.concat(*found)).alias("_hit"))
    rows = rows.select("_id", "_row", "_n", F.col("_hit.start").alias("_start"), F.col("_hit.len").alias("_hlen"), F.col("_hit.window").alias("_hw"))
    tests = tests.select(F.col("_window").alias("_hw"), F.col("_len").alias("_hlen"), "_items")
    if tests.count() <= BROADCAST_WINDOWS:
        tests = F.broadcast(tests)
    rows = rows.join(tests, ["_hw", "_hlen"], "left")
    hit = F.col("_items").isNotNull()
    per = rows.groupBy("_id", "_row").agg(
        F.max("_n").alias("n_words"),
        F.collect_set(F.when(hit, F.struct(F.col("_start").alias("s"), (F.col("_start") + F.col("_hlen")).alias("e")))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )
    # merge overlapping and touching hits; the spans are ordered by their start
    merged = F.aggregate(
        F.array_sort("_spans"),
        F.expr("cast(array() as array<struct<s:int,e:int>>)"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= x["s"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(a, F.lit(-1))["e"], x["e"]).alias("e"))))
        ).otherwise(F.concat(a, F.array(x))),
    )
    covered = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["e"]))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
    )["n"]
    return per.select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), merged.alias("spans"), covered.cast("long").alias("n_hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame, per_hit: int = 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least one word in ``per_hit`` is hit)."""
    return scan(docs, benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * per_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, hit passages cut out of the text itself: case, punctuation and spacing of the rest stay.

    A passage goes from its first hit word up to the next word behind it.
    """
    spans = scan(docs, benchmark, id_col=id_col, text_col=text_col).where("n_hit > 0").select(F.col(id_col).alias("_id"), "spans")
    spans = spans.groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("_spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).join(spans, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id")), "left")
    text = F.col(f"_row.`{text_col}`")
    words, gaps = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.split(text, WORD)  # gap i stands before word i
    hit = lambda i: F.exists("_spans", lambda s: (s["s"] <= i) & (i < s["e"]))
    inside = lambda i: F.exists("_spans", lambda s: (s["s"] < i) & (i <= s["e"]))
    part = lambda x, i: F.concat(F.when(inside(i) & x["w"].isNotNull(), "").otherwise(x["g"]), F.when(hit(i), "").otherwise(F.coalesce(x["w"], F.lit(""))))
    cut = F.array_join(F.transform(F.arrays_zip(words.alias("w"), gaps.alias("g")), part), "")  # the last gap has no word
    new = F.when(F.col("_spans").isNull(), text).otherwise(cut)
    return rows.select(*(new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def remove_documents(docs: DataFrame, benchmark: DataFrame, per_hit: int = 0, least: int = WINDOW) -> DataFrame:
    """The documents without benchmark passages, with their columns.

    A document goes if it holds ``least`` hit words in a row, so one whole window, however long the document is, or if it is
    contaminated as in report(), which also catches items shorter than a window that make up much of it. ``per_hit`` sets
    the share for the former rule: 20 lets passages of under one word in twenty stay, 0 none. Ids are matched null-safely, so
    rows that share an id go together; Spark broadcasts the rejected ids only if they are few.
    """
    found = scan(docs, benchmark)
    passage = F.exists("spans", lambda s: s["e"] - s["s"] >= least)
    flagged = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    enough = F.col("n_hit") * per_hit >= F.col("n_words") if per_hit else F.lit(True)
    name = free_name(docs, "_bad")
    bad = found.where((passage & enough) | flagged).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
