"""Sequence and string expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """Case kept; letters other than ACGT become N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order, the last included."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def gc(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "GCgc", ""))


def pack(s: Column) -> Column:
    """Base-4 number of up to 31 bases."""
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: a * 4 + F.instr(F.lit("ACGT"), c) - 1)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda n, x: n + x)


def occurrences(s: Column, word: str) -> Column:
    """0-based places of a word, overlapping ones too."""
    at = F.transform(kmers(s, len(word)), lambda x, i: F.when(x == word, i))
    return F.filter(at, lambda i: i.isNotNull())


def count_kmers(sequences: DataFrame, k: int, per_sequence: bool = True) -> DataFrame:
    """kmer, n: sequences that hold each k-mer (or, if not per_sequence, all occurrences)."""
    got = kmers(F.col("seq"), k)
    rows = sequences.select("id", F.explode(F.array_distinct(got) if per_sequence else got).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def merge_strands(counts: DataFrame) -> DataFrame:
    """A k-mer and its reverse complement as one: the more frequent spelling (ties: the lesser) and both counts' sum."""
    rc = reverse_complement(F.col("kmer"))
    rows = counts.withColumn("key", F.least("kmer", rc))
    return rows.groupBy("key").agg(F.max_by("kmer", F.struct(F.col("n"), F.expr("if(kmer = key, 1, 0)"))).alias("kmer"), F.sum("n").alias("n")).drop("key")


def shift_distance(a: Column, b: Column, reach: int) -> Column:
    """Fewest mismatches of two equally long words over shifts of up to ``reach``; bases beyond the other word are mismatches."""

    @F.pandas_udf("int")
    def fewest(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = pd.Series(pd.NA, index=a.index, dtype="Int32")
        if known.any():
            x, y = (np.array(w[known].tolist(), dtype=str) for w in (a, b))
            n, wide = np.char.str_len(x), max(x.itemsize, y.itemsize) // 4
            x, y = (w.astype(f"<U{wide}").view(np.uint32).reshape(len(w), wide) for w in (x, y))
            at = np.arange(wide)
            best = np.zeros(len(n), int)
            for k in range(-min(reach, wide - 1), min(reach, wide - 1) + 1):
                i, j = at[max(0, -k) : wide - max(0, k)], at[max(0, k) : wide - max(0, -k)]
                same = (x[:, i] == y[:, j]) & (i < n[:, None]) & (j < n[:, None])
                best = np.maximum(best, same.sum(1))
            out[known] = n - best
        return out

    return fewest(a, b)


def _is_word(words: list[str]):
    return lambda h: h["word"].isin(words)


def many_occurrences(sequences: DataFrame, words: list[str]) -> DataFrame:
    """id, word, at: all places of all words, overlapping ones too. One pass over a sequence for each length of word; places
    without a word never leave the row."""
    found = []
    for k in sorted({len(w) for w in words}):
        at = F.transform(kmers(F.col("seq"), k), lambda x, i: F.struct(x.alias("word"), i.alias("at")))
        found.append(F.filter(at, _is_word([w for w in words if len(w) == k])))
    return sequences.select("id", F.explode(F.concat(*found)).alias("h")).select("id", "h.word", "h.at")


def word_pairs(places: DataFrame) -> DataFrame:
    """word, other, n: sequences that hold both words (word before other); input as of ``many_occurrences``."""
    held = places.groupBy("id").agg(F.collect_set("word").alias("held"))  # at most the words asked for
    both = held.select(F.explode("held").alias("word"), "held").select("word", F.explode("held").alias("other")).where("word < other")
    return both.groupBy("word", "other").agg(F.count(F.lit(1)).alias("n"))


def position_matrix(sites: DataFrame, background: float = 0.25, pseudo: float = 0.375) -> DataFrame:
    """Log-odds matrix of equally long words (site, weight): pos, base, score, information of the column.

    Every cell gets ``pseudo`` times the mean weight before a column is normalised.
    """
    cells = sites.groupBy("site").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    cells = cells.select("w", "n", F.posexplode(F.split("site", "")).alias("pos", "base"))
    sums = lambda b: F.sum(F.when(F.col("base") == b, F.col("w")).otherwise(0))
    columns = cells.groupBy("pos").agg(*(sums(b).alias(b) for b in "ACGT"), (F.sum("w") / F.sum("n")).alias("mean"))
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T") + 4 * pseudo * F.col("mean")
    columns = columns.select("pos", F.array(*(F.struct(F.lit(b).alias("base"), ((F.col(b) + pseudo * F.col("mean")) / total).alias("f")) for b in "ACGT")).alias("fs"))
    info = F.aggregate("fs", F.lit(0.0), lambda t, c: t + c["f"] * F.log2(c["f"] / background))
    return columns.select("pos", info.alias("information"), F.explode("fs").alias("c")).select("pos", "c.base", F.log2(F.col("c.f") / background).alias("score"), "information")


def _scored(sequences: DataFrame, matrix: list[dict[str, float]]) -> DataFrame:
    """id, _plus, _minus: a position weight matrix's scores at all places of both strands."""
    w = len(matrix)
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    back = [{comp[b]: v for b, v in col.items()} for col in reversed(matrix)]

    def score(m: list[dict[str, float]]):
        tables = [F.array(*(F.lit(float(col[b])) for b in "ACGT")) for col in m]  # folded to literals

        def at(i: Column) -> Column:
            total = F.lit(0.0)
            for j, values in enumerate(tables):
                total = total + F.get(values, F.get("_codes", i + j))
            return total

        return at

    n = F.length("seq") - w
    codes = F.transform(F.split(F.translate("seq", "ACGT", "0123"), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(3)))
    rows = sequences.where(n >= 0).select("id", codes.alias("_codes")).select("id", "_codes", F.sequence(F.lit(0), F.size("_codes") - w).alias("_all"))
    for name, m in (("_plus", matrix), ("_minus", back)):
        rows = rows.withColumn(name, F.transform("_all", score(m)))
    return rows.select("id", "_plus", "_minus")


def scan_matrix(sequences: DataFrame, matrix: list[dict[str, float]]) -> DataFrame:
    """Best score of a position weight matrix on either strand: id, best, strand, at (first maximum, plus before minus)."""
    rows = _scored(sequences, matrix)
    plus, minus = F.array_max("_plus"), F.array_max("_minus")
    return rows.select(
        "id", F.greatest(plus, minus).alias("best"), F.when(plus >= minus, "+").otherwise("-").alias("strand"),
        (F.when(plus >= minus, F.array_position("_plus", plus)).otherwise(F.array_position("_minus", minus)) - 1).alias("at"),
    )


def matrix_hits(sequences: DataFrame, matrix: list[dict[str, float]], cutoff: float) -> DataFrame:
    """All places that score at least ``cutoff``, on both strands: id, at, strand, score."""

    def over(scores: str, strand: str) -> Column:
        hits = F.transform(scores, lambda x, i: F.struct(i.alias("at"), F.lit(strand).alias("strand"), x.alias("score")))
        return F.filter(hits, lambda h: h["score"] >= cutoff)

    return _scored(sequences, matrix).select("id", F.explode(F.concat(over("_plus", "+"), over("_minus", "-"))).alias("h")).select("id", "h.*")


def cutoff_counts(scores: DataFrame, score: str, front: str, cutoffs: list[float]) -> DataFrame:
    """cutoff, fg, fg_all, bg, bg_all: rows that reach each cutoff, of those where ``front`` holds and of the others; rows
    without a score count in neither. Equal scores are counted first, so cutoffs meet distinct scores only."""
    per = scores.groupBy(F.col(score).alias("level"), F.col(front).alias("_front")).agg(F.count(F.lit(1)).alias("n"))
    scored = F.col("level").isNotNull()  # as a condition: a filter would go below the count and score the sequences twice
    per = per.select("level", F.when(scored & F.col("_front"), F.col("n")).otherwise(0).alias("f"), F.when(scored & ~F.col("_front"), F.col("n")).otherwise(0).alias("b"))
    marks = F.array(*(F.lit(float(c)) for c in cutoffs))
    got = F.col("level") >= F.col("cutoff")
    sums = [F.coalesce(F.sum(F.when(got, F.col(x)) if hit else F.col(x)), F.lit(0)).alias(n) for n, x, hit in (("fg", "f", True), ("fg_all", "f", False), ("bg", "b", True), ("bg_all", "b", False))]
    return per.select("*", F.explode(marks).alias("cutoff")).groupBy("cutoff").agg(*sums)
