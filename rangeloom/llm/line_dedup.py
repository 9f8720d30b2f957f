"""Line deduplication by a segment-partition edit join, in DataFrame expressions only.

Lines are the pieces of a text between line feeds, without empty ones. Equal lines are combined first (partial aggregation
leaves one row a line and task, so a line however common moves little). Two different lines of at least LEAST characters
are linked if one edit (insertion, deletion or replacement of a character) turns one into the other.

A line of length n is split into EDITS + 1 = 2 segments. If it is within one edit of a line of length n or n + 1, one of
the segments is in that line unchanged, at its own place counted from the start or, behind the edit, from the end; so the
longer (or equal) line probes an index of (length, segment number, segment) with the few substrings that fit. The rest of
both lines then holds the edit, so its first or its last half is unchanged too, and hashes of these halves travel with
the key as a filter inside the join. Survivors get their texts and are verified by a banded bit-parallel edit automaton:
one word of 2 * EDITS + 1 bits, a bit a diagonal, for each number of errors, advanced over the characters.

links() does the same for any threshold, also one that depends on the length: k + 1 segments for a length that allows k
edits, probed at the shifts that leave enough edits for both sides. report() has one edit, as its SQL fixes it.

Texts of candidates are read again from the documents by a broadcast of the candidates' ids where those are at most
BROADCAST_IDS, else by a shuffle join. Shorter lines are linked with nothing.

deduplicate() keeps each class's first line: classes are the connected components of links(), the first line is that of the
least id (null ids last), then in the order of the rows and of the text. No occurrence of a line meets the others in one task.

Defined results: null and empty texts have no lines; lines count by row, so repeated documents count; a line's own class
is the least of its and its links' first ids, ties by digest; null ids come after all others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .near_dup import components

EDITS, LEAST = 1, 20
#: links() allows an edit for every TENTH characters of the shorter line, MOST at most; lines below TENTH are only equal or not.
TENTH, MOST = 10, 6
BROADCAST_IDS = 1_000_000


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_doc, line for each line that isn't empty."""
    return docs.select(F.col(id_col).alias("_doc"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line")).where("line <> ''")


def _piece(start: Column, length: Column) -> Column:
    return F.substring(F.col("line"), start + 1, length)


def _entry(tag: Column, segment: Column, first: Column, last: Column) -> Column:
    halves = F.shiftleft(F.hash(first).cast("long"), 32).bitwiseOR(F.hash(last).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.struct(F.xxhash64(tag, segment).alias("key"), halves.alias("halves"))


def entries(n: Column) -> tuple[Column, Column]:
    """Index entries of a line of length n, and its probes of lines of length n and n - 1.

    For an indexed length m, the first segment has h = m div 2 characters. If the first segment is unchanged it is at the
    line's start and the rest follows; if the second is, it is at the line's end and the rest comes before. The rest, r
    characters in the shorter line, has q = r div 2 unchanged characters at its start or at its end.
    """

    def of(m: Column, tag: int) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        r2 = (m - h).cast("int")
        q1, q2 = F.floor(r2 / 2).cast("int"), F.floor(h / 2).cast("int")
        # the rest behind the first segment ends with the line; the rest before the second ends where that begins
        first = _entry(m * 2, _piece(F.lit(0), h), _piece(h, q1), _piece(n - q1, q1))
        second = _entry(m * 2 + 1, _piece(n - r2, r2), _piece(F.lit(0), q2), _piece(n - r2 - q2, q2))
        return [first, second]

    return F.array(*of(n, 0)), F.array(*of(n, 0), *of(n - 1, 1))


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two strings is at most ``edits``; a and b are arrays of characters.

    Bit d of word e is set while b's characters so far and a's first (so far + d - edits) match with at most e errors.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    start = [((1 << (edits + e + 1)) - 1) & ~((1 << edits) - 1) & full for e in range(edits + 1)]  # e deletions lead to diagonal e
    state = F.struct(*(F.lit(x).alias(f"e{e}") for e, x in enumerate(start)), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        same = reduce(
            lambda x, y: x.bitwiseOR(y),
            (F.when(F.get(a, s["at"] + (d - edits)) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)),
        )
        new: list[Column] = []
        for e in range(edits + 1):
            word = s[f"e{e}"].bitwiseAND(same)
            if e:
                old = s[f"e{e - 1}"]
                word = word.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(full)))
            new.append(word)
        return F.struct(*(w.alias(f"e{e}") for e, w in enumerate(new)), (s["at"] + 1).alias("at"))

    last = F.aggregate(b, state, step)
    gap = F.size(a) - F.size(b) + edits
    return (gap >= 0) & (gap < width) & (F.call_function("shiftright", last[f"e{edits}"], F.greatest(gap, F.lit(0))).bitwiseAND(F.lit(1)) == 1)


def relative_limit(m: Column) -> Column:
    """Edits allowed between two lines of which the shorter has m characters."""
    return F.least(F.floor(m / TENTH).cast("int"), F.lit(MOST))


def segments(lines: DataFrame, limit: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """id, key of the lines (id, line) as indexed lines, and as lines that probe lengths up to ``most`` below their own.

    A length m with k = limit(m) > 0 has k + 1 segments, the longer ones last. A line with at most k edits, d characters longer,
    holds some segment i with i edits before it and k - i behind at most, so shifted by -i..i and by d - (k - i)..d + (k - i).
    Rows are made step by step, so that each step's numbers are computed once and in generated code.
    """

    def keys(rows: DataFrame, low: Column, high: Column) -> DataFrame:
        rows = rows.withColumn("k", limit(F.col("m"))).where("k > 0 AND k >= d").withColumn("size", F.floor(F.col("m") / (F.col("k") + 1)).cast("int"))
        rows = rows.withColumn("short", F.col("k") + 1 - (F.col("m") - F.col("size") * (F.col("k") + 1)))  # so many segments have size characters, the others one more
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
        start = F.col("i") * F.col("size") + F.greatest(F.lit(0), F.col("i") - F.col("short"))
        rows = rows.select("id", "line", "m", "i", start.alias("start"), (F.col("size") + F.when(F.col("i") >= F.col("short"), 1).otherwise(0)).alias("length"), F.explode(F.sequence(low, high)).alias("s"))
        return rows.select("id", F.xxhash64("m", "i", _piece(F.col("start") + F.col("s"), F.col("length"))).alias("key"))

    n, d, k, i = F.char_length("line"), F.col("d"), F.col("k"), F.col("i")
    index = keys(lines.select("id", "line", n.alias("m"), F.lit(0).alias("d")), F.lit(0), F.lit(0))
    shorter = lines.select("id", "line", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("d"))
    probes = keys(shorter.select("id", "line", (F.col("n") - d).alias("m"), "d"), F.greatest(-i, d - k + i), F.least(i, d + k - i))
    return index, probes


def links(lines: DataFrame, limit: Callable[[Column], Column] = relative_limit, most: int = MOST) -> DataFrame:
    """sa < sb for each two different lines within limit(characters of the shorter) edits, which is nowhere above ``most``.

    ``lines`` has distinct lines with their sha. Pairs are verified by the banded distance that Spark has built in: the bit-parallel
    automaton is an expression that grows with the square of the threshold.
    """
    texts = lines.select("sha", "line", F.xxhash64("line").alias("id"))
    index, probes = segments(texts.select("id", "line"), limit, most)
    left, right = index.toDF("a", "key"), probes.toDF("b", "key")
    pairs = left.join(right, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.distinct(), "line-pairs")
    one, two = (texts.toDF(f"s{x}", f"l{x}", x) for x in "ab")
    allowed = limit(F.least(F.char_length("la"), F.char_length("lb")))
    near = F.levenshtein("la", "lb", most)
    found = pairs.join(one, "a").join(two, "b").where((F.col("sa") != F.col("sb")) & (near >= 0) & (near <= allowed))
    return found.select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb")).distinct()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a distinct line: line_sha256, n_chars, n_rows, first_doc_id, n_links, class_sha256."""
    distinct = lines_of(docs, id_col, text_col).groupBy("line").agg(F.count(F.lit(1)).alias("n_rows"), F.min("_doc").alias("first_doc_id"))
    n = F.char_length("line")
    index, probes = entries(n)
    none = F.expr("cast(array() as array<struct<key:bigint,halves:bigint>>)")
    lines = materialize(
        distinct.select(
            F.sha2(F.col("line"), 256).alias("line_sha256"), F.xxhash64("line").alias("id"), n.alias("n_chars"), "n_rows", "first_doc_id",
            F.when(n >= LEAST, index).otherwise(none).alias("index"),
            F.when(n > LEAST, probes).when(n == LEAST, F.slice(probes, 1, 2)).otherwise(none).alias("probes"),
        ),
        "lines",
    )
    left = lines.select(F.col("id").alias("a"), F.inline("index")).toDF("a", "key", "ha")
    right = lines.select(F.col("id").alias("b"), F.inline("probes")).toDF("b", "key", "hb")
    high = lambda c: F.shiftright(c, 32)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    halves = (high("ha") == high("hb")) | (low("ha") == low("hb"))
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & halves)
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    wanted = pairs.select(F.col("a").alias("_w")).unionByName(pairs.select(F.col("b").alias("_w"))).distinct()
    if pairs.count() <= BROADCAST_IDS // 2:
        wanted = F.broadcast(wanted)
    texts = lines_of(docs, id_col, text_col).select("line", F.xxhash64("line").alias("_id")).join(wanted, F.col("_id") == F.col("_w"), "left_semi").distinct()
    texts = texts.select("_id", F.sha2(F.col("line"), 256).alias("sha"), F.split("line", "").alias("chars"))
    one = texts.select(F.col("_id").alias("a"), F.col("sha").alias("sa"), F.col("chars").alias("ca"))
    two = texts.select(F.col("_id").alias("b"), F.col("sha").alias("sb"), F.col("chars").alias("cb"))
    links = materialize(pairs.join(one, "a").join(two, "b").where((F.col("sa") != F.col("sb")) & within_edits(F.col("ca"), F.col("cb"))).select("sa", "sb").distinct(), "line-links")
    both = links.unionByName(links.select(F.col("sb").alias("sa"), F.col("sa").alias("sb")))
    firsts = lines.select(F.col("line_sha256").alias("sb"), "first_doc_id")
    order = F.struct(F.col("first_doc_id").isNull().alias("n"), F.col("first_doc_id").alias("d"), F.col("sb").alias("s"))
    found = both.join(firsts, "sb").groupBy("sa").agg(F.count(F.lit(1)).alias("_links"), F.min(order).alias("_least"))
    own = F.struct(F.col("first_doc_id").isNull().alias("n"), F.col("first_doc_id").alias("d"), F.col("line_sha256").alias("s"))
    out = lines.drop("id", "index", "probes").join(found, F.col("line_sha256") == F.col("sa"), "left")
    return out.select(
        "line_sha256", F.col("n_chars").cast("long").alias("n_chars"), "n_rows", "first_doc_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.least(own, F.coalesce("_least", own))["s"].alias("class_sha256"),
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, limit: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with a number _row, the linked lines (node, root), and the place (_row, _at) of each class's first line."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "line-rows")
    at = rows.select(F.col(id_col).alias("_id"), "_row", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_at", "line")).where("line <> ''")
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("_row").alias("row"), F.col("_at").alias("at"))
    lines = materialize(at.groupBy("line").agg(F.min(place).alias("first")).select("line", F.sha2("line", 256).alias("sha"), "first"), "lines")
    found = materialize(links(lines, limit, most), "line-links")
    nodes = materialize(components(found.toDF("a", "b")), "line-classes")
    firsts = lines.select("sha", "first").join(nodes, F.col("sha") == F.col("node"), "left").groupBy(F.coalesce("root", "sha").alias("class")).agg(F.min("first").alias("f"))
    return rows, nodes, firsts.select(F.col("f.row").alias("_first_row"), F.col("f.at").alias("_first_at"))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: Callable[[Column], Column] = relative_limit, most: int = MOST
) -> DataFrame:
    """The documents with their columns, without the lines of which an equal or linked one stands earlier; empty lines stay."""
    rows, _, firsts = _classes(docs, id_col, text_col, limit, most)
    kept = firsts.groupBy("_first_row").agg(F.collect_set("_first_at").alias("_kept"))
    rest = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: (x == "") | F.coalesce(F.array_contains("_kept", i), F.lit(False)))
    out = rows.join(kept, F.col("_row") == F.col("_first_row"), "left").withColumn(text_col, F.array_join(rest, "\n"))
    return out.select(*(f"`{c}`" for c in docs.columns))


def members(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: Callable[[Column], Column] = relative_limit, most: int = MOST
) -> DataFrame:
    """One row an occurrence of a line: id, at (its place in the text, from 0), line_sha256, class_sha256 (the least of the class), kept."""
    rows, nodes, firsts = _classes(docs, id_col, text_col, limit, most)
    at = rows.select(F.col(id_col).alias("_id"), "_row", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_at", "line")).where("line <> ''")
    at = at.select("_id", "_row", "_at", F.sha2("line", 256).alias("sha")).join(nodes, F.col("sha") == F.col("node"), "left")
    at = at.join(firsts, (F.col("_row") == F.col("_first_row")) & (F.col("_at") == F.col("_first_at")), "left")
    return at.select(F.col("_id").alias(id_col), F.col("_at").alias("at"), F.col("sha").alias("line_sha256"), F.coalesce("root", "sha").alias("class_sha256"), F.col("_first_row").isNotNull().alias("kept"))
