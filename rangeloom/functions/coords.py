"""Coordinate expressions over the columns chrom, start, end, strand (closed intervals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width() -> Column:
    return F.col("end") - F.col("start") + 1


def midpoint() -> Column:
    return F.floor((F.col("start") + F.col("end")) / 2)


def expand(up: int, down: int, last: int) -> tuple[Column, Column]:
    """Wider by up and down, clamped to the chromosome."""
    return F.greatest(F.col("start") - up, F.lit(0)), F.least(F.col("end") + down, F.lit(last))


def five_prime() -> Column:
    return F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))


def three_prime() -> Column:
    return F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start"))


def at_least(least: int) -> tuple[Column, Column]:
    """Grown on both sides to a least width; an odd remainder goes to the end."""
    lack = F.greatest(F.lit(least) - width(), F.lit(0))
    return F.col("start") - F.floor(lack / 2), F.col("end") + (lack - F.floor(lack / 2))


def location(prefix: str = "chr") -> Column:
    return F.concat(F.lit(prefix), F.col("chrom"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"), F.lit(":"), F.col("strand"))


def number(text: Column) -> Column:
    """12,345 or 12k or 1.5m as a number."""
    plain = F.regexp_replace(F.lower(text), ",", "")
    unit = F.when(plain.endswith("k"), 1000).when(plain.endswith("m"), 1_000_000).otherwise(1)
    return (F.expr("1") * F.regexp_replace(plain, "[km]$", "").cast("double") * unit).cast("int")


def parse(df: DataFrame, column: str) -> DataFrame:
    """chrom:start-end or chrom:start-end:strand, with commas and k or m suffixes; null where the text is no location."""
    pattern = r"^\s*([^:\s]+):([0-9.,]+[kmKM]?)-([0-9.,]+[kmKM]?)(?::([+-]))?\s*$"
    part = lambda i: F.regexp_extract(F.col(column), pattern, i)
    ok = F.col(column).rlike(pattern)
    return df.withColumns(
        {
            "chrom": F.when(ok, part(1)), "start": F.when(ok, number(part(2))), "end": F.when(ok, number(part(3))),
            "strand": F.when(ok & (part(4) != ""), part(4)),
        }
    )


def first_bin(pos: Column) -> Column:
    """Number of the finest bin (128 KiB) that holds a position, in the five-level scheme whose finest level starts at 585."""
    return 585 + F.shiftright(pos, 17)


def bin_of(start: Column, end: Column) -> Column:
    """The smallest bin that holds a half-open range; each level is eight times as wide as the next."""
    out = None
    for offset, shift in ((585, 17), (73, 20), (9, 23), (1, 26), (0, 29)):
        same = F.shiftright(start, shift) == F.shiftright(end - 1, shift)
        value = offset + F.shiftright(start, shift)
        out = F.when(same, value) if out is None else out.when(same, value)
    return out
