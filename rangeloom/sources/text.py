"""Readers and writers of line formats, as text scans with built-in expressions. Coordinates are closed intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, least: int, sep: str = r"\s+") -> DataFrame:
    """f (fields) of the lines that aren't comments and have at least so many fields."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#') AND NOT startswith(value, 'track') AND NOT startswith(value, 'browser')")
    rows = lines.select(F.split(F.trim("value") if sep != "\t" else F.col("value"), sep).alias("f"))
    return rows.where(F.size("f") >= least)


def _chrom(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^chr", ""), r"\..*$", "")


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Six-field BED: the file's end is exclusive, ours is not."""
    return _fields(spark, path, 6).select(_chrom(_f(0)).alias("chrom"), _f(1).cast("int").alias("start"), (_f(2).cast("int") - 1).alias("end"), _f(3).alias("name"), _f(4).cast("double").alias("score"), _f(5).alias("strand"))


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Ten-field BEDPE; each end keeps its own strand, and the lesser position comes first."""
    end = lambda c, s, e, st: F.struct(_chrom(_f(c)).alias("chrom"), _f(s).cast("int").alias("start"), (_f(e).cast("int") - 1).alias("end"), _f(st).alias("strand"))
    rows = _fields(spark, path, 10).select(end(0, 1, 2, 8).alias("a"), end(3, 4, 5, 9).alias("b"), _f(6).alias("name"))
    return rows.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "name")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped alignments of text SAM with reference span from the CIGAR, and weight 1 / hits where NH says how many."""
    rows = _fields(spark, path, 11, "\t").where("NOT startswith(f[0], '@')").where(F.expr("cast(f[1] as int) & 4") == 0)
    spans = F.expr(r"aggregate(regexp_extract_all(f[5], '(\\d+)[MDN=X]', 1), 0, (a, x) -> a + cast(x as int))")
    nh = F.regexp_extract(F.array_join("f", "\t"), r"\tNH:i:(\d+)", 1)
    return rows.select(
        _f(0).alias("name"), _chrom(_f(2)).alias("chrom"), _f(3).cast("int").alias("start"), (_f(3).cast("int") + spans - 1).alias("end"),
        F.when(F.expr("cast(f[1] as int) & 16") == 0, "+").otherwise("-").alias("strand"), F.when(nh == "", 1.0).otherwise(1.0 / F.greatest(nh.try_cast("double"), F.lit(1.0))).alias("weight"),
    )


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 10).select(
        _chrom(_f(0)).alias("chrom"), _f(1).cast("int").alias("start"), (_f(2).cast("int") - 1).alias("end"), _f(3).alias("name"), _f(6).cast("double").alias("signal"),
        _f(7).cast("double").alias("p"), _f(8).cast("double").alias("q"), (_f(1).cast("int") + _f(9).cast("int")).alias("summit"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    pairs = F.transform(F.filter(F.split(_f(8), r";\s*"), lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    return _fields(spark, path, 9, "\t").select(_chrom(_f(0)).alias("chrom"), _f(1).alias("source"), _f(2).alias("type"), _f(3).cast("int").alias("start"), _f(4).cast("int").alias("end"), _f(5).try_cast("double").alias("score"), _f(6).alias("strand"), F.map_from_entries(pairs).alias("attributes"))


def read_blast8(spark: SparkSession, path: str) -> DataFrame:
    names = ["query", "target", "identity", "length", "mismatches", "gaps", "q_start", "q_end", "t_start", "t_end", "e", "bits"]
    return _fields(spark, path, 12).select(*((_f(i) if i < 2 else _f(i).cast("double" if n in ("identity", "e", "bits") else "int")).alias(n) for i, n in enumerate(names)))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq: records split at '>', so no record is cut by a line."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return rows.select(F.trim(F.substring_index("value", "\n", 1)).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def read_frame(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """White-space separated text with a header; values match the schema's columns from the right; NA is null."""
    names = [x.split()[0] for x in schema.split(",")]
    types = [x.split()[1] for x in schema.split(",")]
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    n = len(names)
    value = lambda i: F.get("f", F.size("f") - n + i)
    rows = lines.where(F.size("f") >= n).where(~F.reduce(F.array(*(value(i) == names[i] for i in range(n))), F.lit(True), lambda a, x: a & x))
    return rows.select(*((F.when(value(i) != "NA", value(i).try_cast(t)) if t != "string" else value(i)).alias(c) for i, (c, t) in enumerate(zip(names, types))))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """JASPAR text: motif, pos, letter, weight; a record is a '>' line and four rows of counts."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\n").alias("l"))
    rows = rows.select(F.trim(F.get("l", F.lit(0))).alias("motif"), F.explode(F.slice("l", 2, 4)).alias("row"))
    nums = F.regexp_extract_all("row", F.lit(r"(-?\d+\.?\d*)"), F.lit(1))
    return rows.select("motif", F.substring(F.trim("row"), 1, 1).alias("letter"), F.posexplode(nums).alias("pos", "w")).select("motif", "pos", "letter", F.col("w").cast("double").alias("weight"))


def write_bed(df: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom")), "start", F.col("end") + 1, F.col("name"), F.col("score"), F.col("strand"))
    df.select(line.alias("value")).write.text(path)


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def write_frame(df: DataFrame, path: str) -> None:
    """Tab-separated with NA for null and a header line in every file."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in df.columns)).write.csv(path, sep="\t", header=True)


def write_wiggle(depths: DataFrame, path: str) -> None:
    """Coverage spans (chrom, start, end, depth) as bedGraph lines."""
    depths.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom")), "start", F.col("end") + 1, "depth").alias("value")).write.text(path)
