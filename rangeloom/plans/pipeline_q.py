"""Composite analyses: window peak calling, interaction clusters, modules, ranked comparison."""

from pyspark.sql import functions as F

from ..fixtures import GENES, HITS, PAIRS, REGIONS, genes, hits, pairs, regions
from ..functions import stats
from ..operators import intervals as iv
from .registry import query

WIN = f"""{HITS}, b AS (SELECT chrom, pos // 100 AS b, count(*) AS n FROM h GROUP BY 1, 2),
    w AS (SELECT chrom, b * 100 AS s, sum(n) OVER (PARTITION BY chrom ORDER BY b RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM b),
    m AS (SELECT count(*) * 500.0 / (8 * 251400) AS mean FROM h)"""


def windows(spark, d):
    """Sliding windows of five 100-wide bins from each occupied bin: hits, and the Poisson tail against the uniform rate.

    A window's bins are sent to the windows that hold them, so the sum is one partial aggregate without an ordered scan.
    """
    h = hits(spark, d)
    bins = h.groupBy("chrom", F.floor(F.col("pos") / 100).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sent = bins.select("chrom", F.explode(F.sequence(F.col("b") - 4, F.col("b"))).alias("b"), "n")
    sums = sent.groupBy("chrom", "b").agg(F.sum("n").alias("n")).join(bins.select("chrom", "b"), ["chrom", "b"], "left_semi")
    mean = h.agg((F.count(F.lit(1)) * 500.0 / (8 * 251400)).alias("mean"))
    return stats.poisson_tail(sums.join(F.broadcast(mean)), "n", "mean", "p").select("chrom", (F.col("b") * 100).alias("start"), "n", "mean", "p")


@query(f"""WITH {WIN}, x AS (SELECT chrom, s, n, mean, unnest(range(0, n::BIGINT)) AS j FROM w, m)
    SELECT chrom, s AS "start", CAST(n AS BIGINT) AS n, round(1 - sum(exp(j * ln(mean) - mean - lgamma(j + 1.0))), 6) AS p FROM x GROUP BY 1, 2, 3""")
def window_enrichment(spark, d):
    return windows(spark, d).select("chrom", "start", "n", F.round("p", 6).alias("p"))


@query(f"""WITH {WIN}, k AS (SELECT chrom, s, n FROM w, m WHERE n >= 1.6 * mean), o AS (SELECT *, CASE WHEN s - 499 <= lag(s) OVER (PARTITION BY chrom ORDER BY s) THEN 0 ELSE 1 END AS o FROM k),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM o)
    SELECT chrom, min(s) AS "start", max(s) + 499 AS "end", CAST(max(n) AS BIGINT) AS best FROM i GROUP BY chrom, g""")
def called_peaks(spark, d):
    """Enriched windows joined where they overlap, with the best count."""
    w = windows(spark, d).where(F.col("n") >= 1.6 * F.col("mean")).select("chrom", "start", (F.col("start") + 499).alias("end"), "n")
    return iv.islands(w).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("n").alias("best")).drop("island")


@query(f"""WITH {PAIRS}, a AS (SELECT pair, lc, least(lp, rp) AS lo, greatest(lp, rp) AS hi FROM p WHERE lc = rc AND abs(lp - rp) >= 500),
    b AS (SELECT *, CASE WHEN lo - lag(lo) OVER (PARTITION BY lc ORDER BY lo, pair) <= 300 THEN 0 ELSE 1 END AS o FROM a), c AS (SELECT *, sum(o) OVER (PARTITION BY lc ORDER BY lo, pair ROWS UNBOUNDED PRECEDING) AS g FROM b),
    e AS (SELECT *, CASE WHEN hi - lag(hi) OVER (PARTITION BY lc, g ORDER BY hi, pair) <= 2000 THEN 0 ELSE 1 END AS o2 FROM c), f AS (SELECT *, sum(o2) OVER (PARTITION BY lc, g ORDER BY hi, pair ROWS UNBOUNDED PRECEDING) AS g2 FROM e)
    SELECT lc AS chrom, min(lo) AS lo_start, max(lo) AS lo_end, min(hi) AS hi_start, max(hi) AS hi_end, count(*) AS n FROM f GROUP BY lc, g, g2 HAVING count(*) >= 3""")
def interaction_clusters(spark, d):
    """Intra-chromosomal pairs: gap clusters of their low ends, and within each, of their high ends."""
    p = pairs(spark, d).where("lc = rc AND abs(lp - rp) >= 500").select(F.col("pair").alias("id"), F.col("lc").alias("chrom"), F.least("lp", "rp").alias("lo"), F.greatest("lp", "rp").alias("hi"))
    one = iv.islands(p.withColumns({"start": F.col("lo"), "end": F.col("lo")}), 300).withColumnRenamed("island", "g")
    two = iv.islands(one.withColumns({"start": F.col("hi"), "end": F.col("hi")}), 2000, by=["chrom", "g"])
    out = two.groupBy("chrom", "g", "island").agg(F.min("lo").alias("lo_start"), F.max("lo").alias("lo_end"), F.min("hi").alias("hi_start"), F.max("hi").alias("hi_end"), F.count(F.lit(1)).alias("n"))
    return out.where("n >= 3").drop("g", "island")


@query(f"""WITH {REGIONS}, {GENES}, o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 0 ELSE 1 END AS o FROM r),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS k FROM o), m AS (SELECT chrom, k, min(s) AS s, max(e) AS e, count(*) AS n, count(*) FILTER (strand = '+') AS plus FROM i GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT m.chrom, m.s AS "start", m.e AS "end", n, plus, count(g.id) AS genes FROM m LEFT JOIN g ON g.chrom = m.chrom AND g.s <= m.e AND m.s <= g.e GROUP BY ALL""")
def site_modules(spark, d):
    """Clusters of sites up to 100 apart, with strand counts and the number of genes they touch."""
    m = iv.islands(regions(spark, d), 100).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("strand") == "+", 1)).alias("plus"))
    m = m.where("n >= 2").drop("island")
    hit = iv.interval_join(m, genes(spark, d)).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("genes"))
    return m.join(hit, ["chrom", "start", "end"], "left").withColumn("genes", F.coalesce("genes", F.lit(0)))


@query(f"""WITH {REGIONS}, {GENES}, m AS (SELECT r.id, r.score, EXISTS (SELECT 1 FROM g WHERE g.chrom = r.chrom AND g.s <= r.e AND r.s <= g.e) AS hit FROM r),
    k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS i, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS c FROM m)
    SELECT coalesce(min(i) FILTER (i >= 100 AND c * 1.0 / i <= 0.9) - 1, count(*)) AS prefix FROM k""")
def ranked_prefix(spark, d):
    """Length of the best-first prefix of which more than nine in ten match (at least the first hundred count)."""
    flags = iv.overlap_flags(regions(spark, d), genes(spark, d)).select("id", "score", F.col("overlaps").cast("int").alias("hit"), (-F.col("score")).alias("_o"))
    rows = stats.ranked(flags, ["_o", "id"], "i").withColumn("_part", F.floor(F.col("i") / 65536))
    rows = iv.carry(rows.withColumn("one", F.lit(1)), ["one"], "_part", ["i"], {"c": (F.sum, F.col("hit"), True)})
    first = F.min(F.when((F.col("i") >= 100) & (F.col("c") / F.col("i") <= 0.9), F.col("i")))
    return rows.agg(F.coalesce(first - 1, F.count(F.lit(1))).alias("prefix"))
