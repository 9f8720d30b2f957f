"""Round trips through the text formats."""

from pyspark.sql import functions as F

from ..fixtures import GENES, SEQUENCES, genes, sequences, table
from ..sources import text
from ..tables import new_path
from .registry import query


@query(f"WITH {GENES} SELECT CAST(chrom AS VARCHAR) AS chrom, s AS \"start\", e AS \"end\", 'g' || id AS name, CAST(id AS DOUBLE) AS score, strand FROM g")
def source_bed(spark, d):
    path = new_path(spark, "text")
    g = genes(spark, d)
    text.write_bed(g.select("chrom", "start", "end", F.concat(F.lit("g"), F.col("id")).alias("name"), F.col("id").alias("score"), "strand"), path)
    return text.read_bed(spark, path)


@query(f"WITH {SEQUENCES} SELECT 's' || id AS name, seq FROM q WHERE seq <> ''")
def source_fasta(spark, d):
    path = new_path(spark, "text")
    text.write_fasta(sequences(spark, d).where("seq <> ''").select(F.concat(F.lit("s"), F.col("id")).alias("name"), "seq"), path)
    return text.read_fasta(spark, path)


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def source_frame(spark, d):
    path = new_path(spark, "text")
    text.write_frame(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal")), path)
    return text.read_frame(spark, path, "s_suppkey bigint,s_nationkey int,s_acctbal double")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_json_lines(spark, d):
    path = new_path(spark, "text")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").json(path)
