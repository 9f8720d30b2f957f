"""Range queries on a store of hits (hit, chrom, pos, weight, strand, length). All ranges are closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import CHUNK, carry


def in_range(hits: DataFrame, chrom: int | None = None, start: int | None = None, stop: int | None = None, strand: bool | None = None) -> DataFrame:
    for c, ok in (("chrom", chrom is not None and F.col("chrom") == chrom), ("pos", start is not None and F.col("pos") >= start), ("pos", stop is not None and F.col("pos") <= stop), ("strand", strand is not None and F.col("strand") == strand)):
        if ok is not False:
            hits = hits.where(ok)
    return hits


def count(hits: DataFrame, least: float | None = None, **where) -> DataFrame:
    """Number of hits by chromosome; the least weight counts."""
    rows = in_range(hits, **where)
    rows = rows if least is None else rows.where(F.col("weight") >= least)
    return rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def bin_of(pos: Column, start: int, step: int) -> Column:
    return F.floor((pos - start) / step)


def centre(b: Column, start: int, step: int) -> Column:
    return (start + b * step + step // 2).cast("long")


def histogram(hits: DataFrame, start: int, stop: int, step: int, above: float | None = None, strand: bool | None = None, dedup: int = 0, extend: bool = False, by: str = "chrom", weights: bool = False) -> DataFrame:
    """Hits (or their weights) by bin centre; empty bins are left out; only weights *above* the limit count.

    dedup = d keeps, at each position, the hits up to d places after the first that passes, in the store's order. extend
    also counts a hit in the bins after (before, on the minus strand, but never the first bin) that its length reaches.
    """
    rows = in_range(hits, start=start, stop=stop)
    passes = F.lit(True)
    if above is not None:
        passes &= F.col("weight") > above
    if strand is not None:
        passes &= F.col("strand") == strand
    rows = rows.withColumn("_pass", passes)
    if dedup:
        w = Window.partitionBy(by, "pos").orderBy("hit")
        rows = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_first", F.min(F.when(F.col("_pass"), F.col("_rn"))).over(Window.partitionBy(by, "pos")))
        rows = rows.where(F.col("_pass") & (F.col("_rn") - F.col("_first") < dedup))
    else:
        rows = rows.where("_pass")
    b = bin_of(F.col("pos"), start, step)
    if extend:
        last = (stop - start) // step
        steps = F.floor(F.col("length") / step)
        ahead = F.sequence(b, F.least(b + steps, F.lit(last).cast("long")))
        back = F.sequence(F.greatest(b - steps, F.least(b, F.lit(1).cast("long"))), b)
        rows = rows.withColumn("bin", F.explode(F.when(F.col("strand"), ahead).otherwise(back)))
    else:
        rows = rows.withColumn("bin", b)
    value = F.sum("weight").alias("weight") if weights else F.count(F.lit(1)).alias("n")
    return rows.groupBy(by, "bin").agg(value).select(by, centre(F.col("bin"), start, step).alias("centre"), "weight" if weights else "n")


def bases(hits: DataFrame) -> DataFrame:
    """Weight summed at each 5' base: chrom, strand, pos, weight."""
    return hits.groupBy("chrom", "strand", "pos").agg(F.sum("weight").alias("weight"))


def subtract_control(signal: DataFrame, control: DataFrame, ratio: float) -> DataFrame:
    """Bases of the signal less the scaled control, where that leaves something."""
    c = bases(control).withColumnRenamed("weight", "_c")
    out = bases(signal).join(c, ["chrom", "strand", "pos"], "left").withColumn("weight", F.col("weight") - ratio * F.coalesce("_c", F.lit(0.0)))
    return out.where("weight > 0").drop("_c")


def density(hits: DataFrame, width: int) -> DataFrame:
    """Gaussian kernel sum of the weights at each occupied position, over neighbours up to three widths away.

    Neighbours meet in bins of that reach, so no chromosome is one task.
    """
    reach = 3 * width
    at = hits.groupBy("chrom", "pos").agg(F.sum("weight").alias("weight")).withColumn("_bin", F.floor(F.col("pos") / reach))
    near = at.select("chrom", F.col("pos").alias("_p"), F.col("weight").alias("_w"), F.explode(F.array(F.col("_bin") - 1, "_bin", F.col("_bin") + 1)).alias("_bin"))
    both = at.join(near, ["chrom", "_bin"]).where(F.abs(F.col("pos") - F.col("_p")) <= reach)
    z = (F.col("pos") - F.col("_p")) / F.lit(float(width))
    return both.groupBy("chrom", "pos").agg(F.sum(F.col("_w") * F.exp(-z * z / 2)).alias("density"))


def cap(bases_: DataFrame, most: float) -> DataFrame:
    return bases_.withColumn("weight", F.least("weight", F.lit(float(most))))


def unsorted(hits: DataFrame) -> DataFrame:
    """Chromosomes whose positions fall somewhere in the store's order, with the number of such places."""
    rows = hits.withColumn("_chunk", F.floor(F.col("hit") / CHUNK))
    rows = carry(rows, ["chrom"], "_chunk", ["hit", "pos"], {"_b": (F.max, F.struct("hit", "pos"), False)})
    return rows.where("pos < _b.pos").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
