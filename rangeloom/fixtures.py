"""Deterministic projections of the generic test tables onto hits, regions, genes, pairs and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "1995-01-01"
CHROMS = 8
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(c: str):
    return F.datediff(F.col(c), F.lit(ORIGIN))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit, chrom, pos, weight, strand, length: one row an order line; hit is its order in the store."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hit"),
        (F.col("l_suppkey") % CHROMS).cast("int").alias("chrom"),
        (_days("l_shipdate") * 100 + F.col("l_linenumber")).cast("int").alias("pos"),
        F.col("l_quantity").alias("weight"),
        (F.col("l_returnflag") == "N").alias("strand"),
        (10 + F.col("l_linenumber")).cast("int").alias("length"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    start = (_days("o_orderdate") * 100).cast("int")
    return t.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % CHROMS).cast("int").alias("chrom"),
        start.alias("start"),
        (start + 50 + F.col("o_orderkey") % 500).cast("int").alias("end"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("o_totalprice").alias("score"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    start = ((F.col("p_partkey") * 3571) % 250000).cast("int")
    return t.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % CHROMS).cast("int").alias("chrom"),
        start.alias("start"),
        (start + 200 + F.col("p_size") * 20).cast("int").alias("end"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, left and right anchors (chrom, pos): an order's first line with each other line."""
    t = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % CHROMS).cast("int").alias("c"), (_days("l_shipdate") * 100 + F.col("l_linenumber")).cast("int").alias("p")
    )
    first = t.where("l_linenumber = 1").select("l_orderkey", F.col("c").alias("lc"), F.col("p").alias("lp"))
    rest = t.where("l_linenumber > 1").select("l_orderkey", "l_linenumber", F.col("c").alias("rc"), F.col("p").alias("rp"))
    return first.join(rest, "l_orderkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair"), "lc", "lp", "rc", "rp")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq: a document's ASCII letters as bases."""
    t = table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("id"), F.regexp_replace(F.translate("text", LETTERS, BASES), "[^ACGT]", "").alias("seq"))


#: The same projections for DuckDB, as common table expressions.
HITS = f"""h AS (SELECT l_orderkey * 10 + l_linenumber AS hit, CAST(l_suppkey % {CHROMS} AS INT) AS chrom,
  CAST(date_diff('day', DATE '{ORIGIN}', CAST(l_shipdate AS DATE)) * 100 + l_linenumber AS INT) AS pos, l_quantity AS weight,
  l_returnflag = 'N' AS strand, CAST(10 + l_linenumber AS INT) AS length FROM lineitem)"""
REGIONS = f"""r AS (SELECT o_orderkey AS id, CAST(o_custkey % {CHROMS} AS INT) AS chrom,
  CAST(date_diff('day', DATE '{ORIGIN}', CAST(o_orderdate AS DATE)) * 100 AS INT) AS s,
  CAST(date_diff('day', DATE '{ORIGIN}', CAST(o_orderdate AS DATE)) * 100 + 50 + o_orderkey % 500 AS INT) AS e,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_totalprice AS score FROM orders)"""
GENES = f"""g AS (SELECT p_partkey AS id, CAST(p_partkey % {CHROMS} AS INT) AS chrom, CAST((p_partkey * 3571) % 250000 AS INT) AS s,
  CAST((p_partkey * 3571) % 250000 + 200 + p_size * 20 AS INT) AS e, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  p_name AS name, p_type AS type FROM part)"""
PAIRS = f"""t AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_suppkey % {CHROMS} AS INT) AS c,
  CAST(date_diff('day', DATE '{ORIGIN}', CAST(l_shipdate AS DATE)) * 100 + l_linenumber AS INT) AS p FROM lineitem),
  p AS (SELECT a.o * 10 + b.n AS pair, a.c AS lc, a.p AS lp, b.c AS rc, b.p AS rp FROM t a JOIN t b ON a.o = b.o AND a.n = 1 AND b.n > 1)"""
SEQUENCES = f"""q AS (SELECT doc_id AS id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents)"""
