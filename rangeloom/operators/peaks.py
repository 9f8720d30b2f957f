"""Peak statistics over hits and regions, all from running totals instead of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import intervals as iv


def genome_sizes(regions: DataFrame, margin: int = 1) -> DataFrame:
    """chrom, size: the largest coordinate and a margin."""
    return regions.groupBy("chrom").agg((F.max("end") + margin).alias("size"))


def over_genome(sizes: DataFrame, width: int) -> DataFrame:
    """Every chromosome expanded into windows: chrom, start, end."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1, F.lit(width).cast("long")))
    return sizes.select("chrom", "size", at.alias("start")).select("chrom", "start", F.least(F.col("start") + width, F.col("size")).alias("end")).withColumn("end", F.col("end") - 1)


def random_points(sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """n points a chromosome from a linear congruence of their number; the same on any cluster."""
    i = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))
    step = (F.col("i") * 48271 + F.col("chrom") * 7919 + seed) % 2147483647
    return sizes.select("chrom", "size", i.alias("i")).select("chrom", "i", ((step * 16807) % 2147483647 % F.col("size")).alias("pos"))


def local_rate(regions: DataFrame, points: DataFrame, scales: list[int]) -> DataFrame:
    """The regions with ``expected``: the largest, over windows of these half widths about the middle, of the hits that the
    window's rate would put into the region."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    width = F.col("end") - F.col("start") + 1
    base = regions.withColumn("_width", width)
    out: DataFrame | None = None
    for i, s in enumerate(scales):
        w = base.select("id", "chrom", "_width", (middle - s).alias("start"), (middle + s).alias("end"))
        n = iv.points_within(w, points).select("id", (F.col("n") * F.col("_width") / (2 * s + 1)).alias(f"_r{i}"))
        out = n if out is None else out.join(n, "id")
    rates = [F.col(f"_r{i}") for i in range(len(scales))]
    return regions.join(out.select("id", (F.greatest(*rates) if len(rates) > 1 else rates[0]).alias("expected")), "id")


def gate(regions: DataFrame, points: DataFrame, width: int, step: int, rate: float, most: float) -> DataFrame:
    """The regions of which some window holds so many points that P(X >= n) at the given rate a base is at most ``most``."""
    start = F.col("w_start").alias("start")
    w = iv.sliding(regions.select("chrom", "start", "end").distinct(), width, step).select("chrom", start).distinct().withColumn("end", F.col("start") + width - 1)
    p = stats.poisson_tail(iv.points_within(w, points).withColumn("mean", F.lit(rate * width)), "n", "mean", "p").where(F.col("p") <= most)
    passing = p.select("chrom", "start", "p")  # each window once, however many regions have it
    return iv.sliding(regions, width, step).select("id", "chrom", start).join(passing, ["chrom", "start"]).groupBy("id").agg(F.min("p").alias("p"))


def scaling_slope(one: DataFrame, two: DataFrame, width: int) -> DataFrame:
    """Slope through the origin of two samples' counts over bins in which both have hits."""
    count = lambda h, n: h.groupBy("chrom", F.floor(F.col("pos") / width).alias("b")).agg(F.count(F.lit(1)).alias(n))
    both = count(one, "x").join(count(two, "y"), ["chrom", "b"])
    return both.agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"), F.count(F.lit(1)).alias("bins"))


def near_flags(one: DataFrame, two: DataFrame, radius: int) -> DataFrame:
    """Points (id, chrom, pos) of both lists with whether the other list has one within the radius: side, id, near."""
    at = lambda p: p.withColumns({"start": F.col("pos"), "end": F.col("pos")}).select("id", "chrom", "start", "end")
    a, b = at(one), at(two)
    side = lambda x, y, n: iv.with_flag(x, y, "near", gap=radius).select(F.lit(n).alias("side"), "id", "near")
    return side(a, b, "left").unionByName(side(b, a, "right"))


def in_boxes(points: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """Pairs of a point (chrom, x, y) and a box (chrom, x0, x1, y0, y1) that holds it; they meet by chromosome and square cell."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    b = boxes.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))
    p = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    return p.join(b, ["chrom", "_cx", "_cy"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").drop("_cx", "_cy")


def count_in_boxes(points: DataFrame, boxes: DataFrame, widest: int, by: list[str] | None = None) -> DataFrame:
    """The distinct boxes (by, x0, x1, y0, y1), up to ``widest`` wide in x, with n, the sum of the n of the points (by, x, y, n)
    inside. No pairs are made: a box's width is cut into at most two stretches of each power of two, and in each stretch
    the points up to its upper edge less those below the lower one count, by running totals."""
    by = by or ["chrom"]
    top = widest.bit_length() - 1
    level = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_k")
    p = points.groupBy(*by, "x", "y").agg(F.sum("n").alias("n")).select("*", level)
    p = p.select(*by, "_k", F.expr("shiftright(CAST(x AS BIGINT), _k)").alias("_node"), F.col("y").alias("pos"), "n")
    box = ["x0", "x1", "y0", "y1"]
    first, last = F.expr("shiftright(CAST(x0 AS BIGINT) + shiftleft(1L, _k) - 1, _k)"), F.expr("shiftright(CAST(x1 AS BIGINT) + 1, _k)") - 1
    odd = F.array_compact(F.array(F.when(first % 2 != 0, first), F.when(last % 2 == 0, last)))
    nodes = F.when(first <= last, F.when(F.col("_k") == top, F.sequence(first, last)).otherwise(odd))
    b = boxes.select(*by, *box).distinct().select("*", level).select(*by, *box, "_k", F.explode(nodes).alias("_node"))
    b = b.select("*", F.col("y0").cast("long").alias("start"), F.col("y1").cast("long").alias("end"))
    got = iv.totals_between(b, p, ["n"], [*by, "_k", "_node"]).select(*by, "_k", "_node", "start", "end", (F.col("hi_n") - F.col("lo_n")).alias("_in"))
    return b.join(got, [*by, "_k", "_node", "start", "end"]).groupBy(*by, *box).agg(F.sum("_in").alias("n"))


def filter_alignments(df: DataFrame, by: str, score: str, ties: list[str], passes: Column, most: int, best: bool) -> DataFrame:
    """Alignments that pass, of queries with at most ``most`` of them, and if asked only each query's best (all that tie)."""
    rows = df.where(passes)
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.max(score).alias("_best")).where(F.col("_n") <= most)
    out = rows.join(per, by)
    return (out.where(F.col(score) == F.col("_best")) if best else out).drop("_n", "_best")


def mask(conditions: dict[str, Column]) -> list[Column]:
    """Row masks by name, and all of them as one number, the first condition in the lowest bit."""
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    return [*(F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()), reduce(lambda a, b: a + b, bits).alias("mask")]


def position_errors(reads: DataFrame, cigar: str) -> DataFrame:
    """pos, reads, mismatches (X), insertions (I) and deletions (D, bases before the read's next one) at each 0-based position of
    the reads. Equal CIGAR strings are counted first, and their runs are expanded once."""
    kinds = reads.where(F.col(cigar).isNotNull()).groupBy(F.col(cigar).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.transform(F.regexp_extract_all("_c", F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))
    wide = lambda p: F.when(p["op"].isin("M", "I", "S", "=", "X"), p["len"]).otherwise(0)
    runs = kinds.select("_n", parts.alias("_p")).select("_n", F.posexplode("_p").alias("_i", "r"), "_p")
    runs = runs.select("_n", "r.*", F.aggregate(F.slice("_p", F.lit(1), F.col("_i")), F.lit(0), lambda t, p: t + wide(p)).alias("from"))
    read = runs.where(F.col("op").isin("M", "I", "S", "=", "X") & (F.col("len") > 0))
    bases = read.select(F.explode(F.sequence(F.col("from").cast("long"), F.col("from") + F.col("len") - 1)).alias("pos"), "op", "_n", F.lit(0).alias("_d"))
    gone = runs.where("op = 'D'").select(F.col("from").cast("long").alias("pos"), "op", "_n", (F.col("_n") * F.col("len")).alias("_d"))
    count = lambda *ops: F.sum(F.when(F.col("op").isin(*ops), F.col("_n")).otherwise(0))
    return bases.unionByName(gone).groupBy("pos").agg(count("M", "I", "S", "=", "X").alias("reads"), count("X").alias("mismatches"), count("I").alias("insertions"), F.sum("_d").cast("long").alias("deletions"))
