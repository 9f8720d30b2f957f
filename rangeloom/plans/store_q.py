"""Queries on the hit store."""

from pyspark.sql import functions as F

from ..fixtures import HITS, PAIRS, hits, pairs
from ..operators import store
from .registry import query

B = "CAST(1000 + ((pos - 1000) // 500) * 500 + 250 AS BIGINT)"
RANGE = "pos BETWEEN 1000 AND 200000"


@query(f"WITH {HITS} SELECT chrom, {B} AS centre, count(*) AS n FROM h WHERE {RANGE} GROUP BY 1, 2")
def store_histogram(spark, d):
    return store.histogram(hits(spark, d), 1000, 200000, 500)


@query(f"WITH {HITS} SELECT chrom, {B} AS centre, sum(weight) AS weight FROM h WHERE {RANGE} AND weight > 10 AND strand GROUP BY 1, 2")
def store_weight_histogram(spark, d):
    return store.histogram(hits(spark, d), 1000, 200000, 500, above=10, strand=True, weights=True)


@query(f"""WITH {HITS}, a AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY hit) AS rn FROM h WHERE {RANGE}),
    f AS (SELECT chrom, pos, min(rn) AS f FROM a WHERE weight > 10 GROUP BY 1, 2)
    SELECT chrom, {B} AS centre, count(*) AS n FROM a JOIN f USING (chrom, pos) WHERE weight > 10 AND rn - f < 1 GROUP BY 1, 2""")
def store_histogram_dedup(spark, d):
    return store.histogram(hits(spark, d), 1000, 200000, 500, above=10, dedup=1)


@query(f"""WITH {HITS}, a AS (SELECT chrom, (pos - 1000) // 5 AS b, length // 5 AS k, strand FROM h WHERE {RANGE}),
    x AS (SELECT chrom, unnest(CASE WHEN strand THEN range(b, least(b + k, 39800) + 1) ELSE range(greatest(b - k, least(b, 1)), b + 1) END) AS b FROM a)
    SELECT chrom, CAST(1000 + b * 5 + 2 AS BIGINT) AS centre, count(*) AS n FROM x GROUP BY 1, 2""")
def store_histogram_extended(spark, d):
    return store.histogram(hits(spark, d), 1000, 200000, 5, extend=True)


@query(f"WITH {HITS} SELECT chrom, count(*) AS n, sum(weight) AS weight FROM h WHERE {RANGE} AND weight >= 10 AND NOT strand GROUP BY chrom")
def store_count_weight(spark, d):
    return store.count(hits(spark, d), least=10, start=1000, stop=200000, strand=False)


@query(f"WITH {HITS} SELECT DISTINCT chrom FROM h")
def store_chroms(spark, d):
    return hits(spark, d).select("chrom").distinct()


@query(f"WITH {HITS} SELECT hit, pos, weight FROM h WHERE chrom = 3 AND {RANGE} AND strand")
def store_fetch(spark, d):
    return store.in_range(hits(spark, d), 3, 1000, 200000, True).select("hit", "pos", "weight")


@query(f"""WITH {HITS}, u AS (SELECT * FROM h UNION ALL SELECT event_id, CAST(user_id % 8 AS INT), CAST(floor(epoch(ts)) AS BIGINT) - 1704067200, value, true, 10 FROM events)
    SELECT chrom, CAST((pos // 1000) * 1000 + 500 AS BIGINT) AS centre, count(*) AS n FROM u WHERE pos BETWEEN 0 AND 3000000 GROUP BY 1, 2""")
def store_multi_histogram(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    more = e.select(F.col("event_id").alias("hit"), (F.col("user_id") % 8).cast("int").alias("chrom"), (F.unix_timestamp("ts") - 1704067200).alias("pos"), F.col("value").alias("weight"), F.lit(True).alias("strand"), F.lit(10).alias("length"))
    return store.histogram(hits(spark, d).unionByName(more), 0, 3000000, 1000)


@query(f"WITH {HITS} SELECT chrom, strand, pos, sum(weight) AS weight FROM h GROUP BY 1, 2, 3")
def store_bases(spark, d):
    return store.bases(hits(spark, d))


@query(f"""WITH {HITS}, a AS (SELECT chrom, strand, pos, sum(weight) AS w FROM h WHERE length < 13 GROUP BY ALL), b AS (SELECT chrom, strand, pos, sum(weight) AS w FROM h WHERE length >= 13 GROUP BY ALL)
    SELECT a.chrom, a.strand, a.pos, a.w - 0.5 * coalesce(b.w, 0) AS weight FROM a LEFT JOIN b USING (chrom, strand, pos) WHERE a.w - 0.5 * coalesce(b.w, 0) > 0""")
def store_control_subtracted(spark, d):
    h = hits(spark, d)
    return store.subtract_control(h.where("length < 13"), h.where("length >= 13"), 0.5)


@query(f"""WITH {HITS}, a AS (SELECT chrom, pos, sum(weight) AS w FROM h GROUP BY 1, 2)
    SELECT x.chrom, x.pos, round(sum(y.w * exp(0 - ((x.pos - y.pos) / 50.0) * ((x.pos - y.pos) / 50.0) / 2)), 6) AS density FROM a x JOIN a y ON x.chrom = y.chrom AND y.pos BETWEEN x.pos - 150 AND x.pos + 150 GROUP BY 1, 2""")
def store_density(spark, d):
    return store.density(hits(spark, d), 50).withColumn("density", F.round("density", 6))


@query(f"WITH {HITS} SELECT chrom, strand, pos, least(sum(weight), 40.0) AS weight FROM h GROUP BY 1, 2, 3")
def store_capped(spark, d):
    return store.cap(store.bases(hits(spark, d)), 40)


@query(f"WITH {HITS} SELECT chrom, count(*) AS n FROM (SELECT chrom, pos, lag(pos) OVER (PARTITION BY chrom ORDER BY hit, pos) AS b FROM h) WHERE pos < b GROUP BY 1")
def store_unsorted(spark, d):
    return store.unsorted(hits(spark, d))


@query(f"WITH {PAIRS} SELECT * FROM p WHERE (lc = 2 AND lp BETWEEN 50000 AND 90000 AND rc = 5 AND rp BETWEEN 40000 AND 99000) OR (rc = 2 AND rp BETWEEN 50000 AND 90000 AND lc = 5 AND lp BETWEEN 40000 AND 99000)")
def store_pair_range(spark, d):
    """Pairs with one end in an anchor and the other in a region, in either orientation."""
    ends = lambda a, b: (F.col(f"{a}c") == 2) & F.col(f"{a}p").between(50000, 90000) & (F.col(f"{b}c") == 5) & F.col(f"{b}p").between(40000, 99000)
    return pairs(spark, d).where(ends("l", "r") | ends("r", "l"))


@query(f"WITH {PAIRS} SELECT lc, rc, lp // 50000 AS lb, rp // 50000 AS rb, count(*) AS n FROM p GROUP BY 1, 2, 3, 4")
def store_contact_map(spark, d):
    b = lambda c: F.floor(F.col(c) / 50000)
    return pairs(spark, d).groupBy("lc", "rc", b("lp").alias("lb"), b("rp").alias("rb")).agg(F.count(F.lit(1)).alias("n"))
