"""Read formats of short-read aligners, and the dispatch by format name. Coordinates are closed intervals from 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _chrom, _f, _fields, read_bed, read_bedpe, read_sam


def _reads(rows: DataFrame, name, chrom, start, length, minus) -> DataFrame:
    """Reads with a weight of one over the number of places that their name has."""
    at = rows.select(name.alias("name"), _chrom(chrom).alias("chrom"), start.alias("start"), (start + length - 1).alias("end"), F.when(minus, "-").otherwise("+").alias("strand"))
    places = at.groupBy("name").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return at.join(places, "name").select("name", "chrom", "start", "end", "strand", "weight")


def read_bowtie(spark: SparkSession, path: str) -> DataFrame:
    """Default output: name, strand, reference, offset from 0, sequence, qualities, ..."""
    return _reads(_fields(spark, path, 5, "\t"), _f(0), _f(2), _f(3).cast("int") + 1, F.length(_f(4)), _f(1) == "-")


def read_eland(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, match code, three counts, reference, position, strand F or R, ...; only unique matches (U0, U1, U2) have a place."""
    rows = _fields(spark, path, 9, "\t").where(F.expr("f[2] IN ('U0', 'U1', 'U2')"))
    return _reads(rows, F.regexp_replace(_f(0), "^>", ""), _f(6), _f(7).cast("int"), F.length(_f(1)), _f(8) == "R")


def read_novo(spark: SparkSession, path: str) -> DataFrame:
    """Native output: name, side, sequence, qualities, status, score, quality, reference, offset from 1, strand F or R; unplaced reads go."""
    rows = _fields(spark, path, 10, "\t").where(F.expr("f[4] IN ('U', 'R')"))
    return _reads(rows, F.regexp_replace(_f(0), "^[@>]", ""), F.regexp_replace(_f(7), "^>", ""), _f(8).cast("int"), F.length(_f(2)), _f(9) == "R")


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "BED": read_bed, "BEDPE": read_bedpe, "SAM": read_sam, "TOPSAM": read_sam, "BOWTIE": read_bowtie, "ELAND": read_eland, "NOVO": read_novo,
}


def read_reads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Reads of a named format; an unknown name is an error."""
    if kind.upper() not in FORMATS:
        raise ValueError(f"unknown read format {kind}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[kind.upper()](spark, path)


def write_all(df: DataFrame, sinks: dict[str, Callable[[DataFrame, str], None]]) -> None:
    """One frame to several named sinks (path to writer)."""
    for path, write in sinks.items():
        write(df, path)
