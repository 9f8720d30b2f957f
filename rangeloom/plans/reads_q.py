"""Round trips through the read formats, and the hit store."""

from pyspark.sql import functions as F

from ..fixtures import GENES, HITS, PAIRS, genes, hits, pairs
from ..operators.hitstore import HitStore
from ..sources import reads, text
from ..tables import new_path
from .registry import query

COLUMNS = """'r' || hit AS name, CAST(chrom AS VARCHAR) AS chrom, pos AS "start", pos + length - 1 AS "end", CASE WHEN strand THEN '+' ELSE '-' END AS strand, 1.0::DOUBLE / count(*) OVER (PARTITION BY hit) AS weight"""


def _strand(plus: str, minus: str):
    return F.when(F.col("strand"), plus).otherwise(minus)


def _lines(spark, d, *fields):
    """The hits as tab-separated lines in a new folder."""
    path = new_path(spark, "reads")
    rows = hits(spark, d).withColumns({"name": F.concat(F.lit("r"), F.col("hit")), "ref": F.concat(F.lit("chr"), F.col("chrom")), "seq": F.repeat(F.lit("A"), F.col("length"))})
    rows.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return path


@query(f"WITH {HITS} SELECT {COLUMNS} FROM h")
def source_bowtie(spark, d):
    return reads.read_reads(spark, _lines(spark, d, "name", _strand("+", "-"), "ref", F.col("pos") - 1, "seq", "seq", F.lit(0)), "bowtie")


@query(f"WITH {HITS} SELECT {COLUMNS} FROM h")
def source_eland(spark, d):
    zero = F.lit(0)
    return reads.read_reads(spark, _lines(spark, d, F.concat(F.lit(">"), F.col("name")), "seq", F.lit("U0"), F.lit(1), zero, zero, F.concat("ref", F.lit(".fa")), "pos", _strand("F", "R")), "eland")


@query(f"WITH {HITS} SELECT {COLUMNS} FROM h")
def source_novo(spark, d):
    ref = F.concat(F.lit(">"), F.col("ref"))
    return reads.read_reads(spark, _lines(spark, d, F.concat(F.lit("@"), F.col("name")), F.lit("S"), "seq", "seq", F.lit("U"), F.lit(9), F.lit(60), ref, "pos", _strand("F", "R")), "novo")


@query(f"WITH {HITS} SELECT {COLUMNS.replace('1.0::DOUBLE / count(*) OVER (PARTITION BY hit)', '0.5::DOUBLE').replace('pos + length - 1', 'pos + length + 1')} FROM h")
def source_sam(spark, d):
    flag = F.when(F.col("strand"), 0).otherwise(16)
    cigar = F.concat(F.lit("2S"), F.col("length") - 3, F.lit("M1I2D3M"))  # the reference span is two more than the length
    star, zero = F.lit("*"), F.lit(0)
    path = _lines(spark, d, "name", flag, "ref", "pos", F.lit(60), cigar, star, zero, zero, star, star, F.lit("NH:i:2"))
    return reads.read_reads(spark, path, "sam")


@query(f"WITH {PAIRS}, e AS (SELECT pair, lc, lp, rc, rp, CAST(lc AS VARCHAR) < CAST(rc AS VARCHAR) OR (lc = rc AND lp <= rp) AS ok FROM p) SELECT 'p' || pair AS name, CAST(CASE WHEN ok THEN lc ELSE rc END AS VARCHAR) AS chrom, CASE WHEN ok THEN lp ELSE rp END AS \"start\", CAST(CASE WHEN ok THEN rc ELSE lc END AS VARCHAR) AS r_chrom, CASE WHEN ok THEN rp ELSE lp END AS r_start FROM e")
def source_bedpe(spark, d):
    path = new_path(spark, "reads")
    end = lambda c, p: [F.concat(F.lit("chr"), F.col(c)), F.col(p), F.col(p) + 10]
    pairs(spark, d).select(F.concat_ws("\t", *end("lc", "lp"), *end("rc", "rp"), F.concat(F.lit("p"), F.col("pair")), F.lit(0), F.lit("+"), F.lit("+")).alias("value")).write.text(path)
    back = reads.read_reads(spark, path, "bedpe")
    return back.select("name", "left.chrom", "left.start", F.col("right.chrom").alias("r_chrom"), F.col("right.start").alias("r_start"))


def _gene_lines(spark, d, *fields):
    path = new_path(spark, "reads")
    rows = genes(spark, d).withColumns({"ref": F.concat(F.lit("chr"), F.col("chrom")), "tag": F.concat(F.lit("g"), F.col("id"))})
    rows.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return path


@query(f"""WITH {GENES} SELECT CAST(chrom AS VARCHAR) AS chrom, s AS "start", e AS "end", 'g' || id AS name, 2.5::DOUBLE AS signal, 3.0::DOUBLE AS p, 1.5::DOUBLE AS q, s + 7 AS summit FROM g""")
def source_narrow_peak(spark, d):
    return text.read_narrow_peak(spark, _gene_lines(spark, d, "ref", "start", F.col("end") + 1, "tag", F.lit(0), "strand", F.lit(2.5), F.lit(3.0), F.lit(1.5), F.lit(7)))


@query(f"""WITH {GENES} SELECT CAST(chrom AS VARCHAR) AS chrom, 'own' AS source, 'gene' AS type, s AS "start", e AS "end", strand, 'g' || id AS name FROM g""")
def source_gff(spark, d):
    dot = F.lit(".")
    got = text.read_gff(spark, _gene_lines(spark, d, "ref", F.lit("own"), F.lit("gene"), "start", "end", dot, "strand", dot, F.concat(F.lit("ID="), F.col("tag"), F.lit("; note=x"))))
    return got.select("chrom", "source", "type", "start", "end", "strand", F.col("attributes")["ID"].alias("name"))


@query(f"""WITH {GENES} SELECT 'g' || id AS query, 'chr' || chrom AS target, 98.5::DOUBLE AS identity, e - s + 1 AS length, s AS t_start, e AS t_end, 50.0::DOUBLE AS bits FROM g""")
def source_blast8(spark, d):
    one = F.lit(1)
    width = F.col("end") - F.col("start") + 1
    got = text.read_blast8(spark, _gene_lines(spark, d, "tag", "ref", F.lit(98.5), width, one, F.lit(0), one, width, "start", "end", F.lit(1e-9), F.lit(50.0)))
    return got.select("query", "target", "identity", "length", "t_start", "t_end", "bits")


@query(f"""WITH {GENES} SELECT 'bed' AS kind, count(*) AS n, CAST(sum(s) AS BIGINT) AS total FROM g UNION ALL SELECT 'frame', count(*), CAST(sum(s) AS BIGINT) FROM g""")
def multi_sink(spark, d):
    bed, frame = new_path(spark, "sink"), new_path(spark, "sink")
    g = genes(spark, d).select("chrom", "start", "end", F.concat(F.lit("g"), F.col("id")).alias("name"), F.col("id").alias("score"), "strand")
    reads.write_all(g, {bed: text.write_bed, frame: lambda df, p: text.write_frame(df.select("start"), p)})
    back = {"bed": text.read_bed(spark, bed), "frame": text.read_frame(spark, frame, "start int")}
    one, two = (x.agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("total")).select(F.lit(k).alias("kind"), "n", "total") for k, x in back.items())
    return one.unionByName(two)


SCHEMA = "hit long, chrom int, pos int, weight double, strand boolean, length int"


def _halves(spark, d):
    h = hits(spark, d)
    return HitStore(spark, new_path(spark, "hits"), SCHEMA), h.where("pos < 100000"), h.where("pos >= 100000")


@query(f"WITH {HITS} SELECT hit, chrom, pos, weight, strand, length FROM h")
def hitstore_append(spark, d):
    store, low, high = _halves(spark, d)
    store.store(low)
    store.append(high)  # behind what is there: new files
    return store.read().select("hit", "chrom", "pos", "weight", "strand", "length")


@query(f"WITH {HITS} SELECT chrom, count(*) AS n, min(pos) AS first, max(pos) AS last FROM h GROUP BY 1")
def hitstore_merge(spark, d):
    store, low, high = _halves(spark, d)
    store.append(high)
    store.append(low)  # before what is there: merged
    return store.read().groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query(f"WITH {HITS} SELECT chrom, count(*) AS n FROM h WHERE chrom NOT IN (1, 3) GROUP BY 1")
def hitstore_delete(spark, d):
    store, _, _ = _halves(spark, d)
    store.store(hits(spark, d))
    store.delete([1, 3])
    return store.read().groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HITS}, a AS (SELECT CAST(unnest(range(5, 12)) AS INT) AS chrom) SELECT chrom, chrom IN (SELECT chrom FROM h) AS found FROM a")
def hitstore_exists(spark, d):
    store, _, _ = _halves(spark, d)
    store.store(hits(spark, d))
    return store.exists(list(range(5, 12)))
