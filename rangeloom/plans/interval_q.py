"""Queries on intervals."""

from pyspark.sql import functions as F

from ..fixtures import GENES, HITS, REGIONS, genes, hits, regions
from ..operators import intervals as iv
from .registry import query

OV = "r.chrom = g.chrom AND r.s <= g.e AND g.s <= r.e"


#: What joins need of both sides.
PLACE = ["id", "chrom", "start", "end"]


def points(spark, d):
    return hits(spark, d).select("hit", "chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), "pos", "weight")


@query(f"WITH {REGIONS}, {GENES} SELECT r.id, g.id AS r_id, least(r.e, g.e) - greatest(r.s, g.s) + 1 AS width FROM r JOIN g ON {OV}")
def interval_overlap_join(spark, d):
    return iv.interval_join(regions(spark, d).select(PLACE), genes(spark, d).select(PLACE)).select("id", "r_id", iv.overlap_width().alias("width"))


@query(f"WITH {REGIONS}, {HITS} SELECT r.id, count(*) AS n, sum(weight) AS weight FROM r JOIN h ON r.chrom = h.chrom AND h.pos BETWEEN r.s AND r.e GROUP BY r.id")
def interval_point_counts(spark, d):
    return iv.points_within(regions(spark, d), points(spark, d), "weight").where("n > 0").select("id", "n", "weight")


@query(f"WITH {REGIONS}, {GENES} SELECT id FROM r WHERE EXISTS (SELECT 1 FROM g WHERE {OV})")
def interval_semi(spark, d):
    return iv.overlapping(regions(spark, d), genes(spark, d)).select("id")


@query(f"WITH {REGIONS}, {GENES} SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE {OV})")
def interval_anti(spark, d):
    return iv.not_overlapping(regions(spark, d), genes(spark, d)).select("id")


@query(f"WITH {REGIONS}, {GENES} SELECT id, EXISTS (SELECT 1 FROM g WHERE {OV}) AS overlaps FROM r")
def interval_flags(spark, d):
    return iv.overlap_flags(regions(spark, d), genes(spark, d)).select("id", "overlaps")


@query(f"WITH {REGIONS}, {GENES} SELECT id FROM r WHERE EXISTS (SELECT 1 FROM g WHERE r.chrom = g.chrom AND g.s <= r.s AND r.e <= g.e)")
def interval_contained(spark, d):
    return iv.overlapping(regions(spark, d), genes(spark, d), how="within").select("id")


@query(f"WITH {REGIONS}, {GENES} SELECT r.id, sum(greatest(0, least(r.e, g.e) - greatest(r.s, g.s) + 1)) AS width FROM r JOIN g ON {OV} GROUP BY r.id")
def interval_overlap_length(spark, d):
    r = regions(spark, d)
    t = iv.overlap_totals(r, genes(spark, d)).where("n_all > 0")
    return r.join(t, ["chrom", "start", "end"]).groupBy("id").agg(F.sum("width_all").alias("width"))


@query(f"WITH {REGIONS}, {GENES} SELECT r.id, g.id AS r_id, greatest(0, g.s - r.e, r.s - g.e) AS distance FROM r JOIN g ON r.chrom = g.chrom AND r.s - 500 <= g.e AND g.s <= r.e + 500 WHERE greatest(0, g.s - r.e, r.s - g.e) < 500")
def interval_distance_join(spark, d):
    distance = F.greatest(F.lit(0), F.col("r_start") - F.col("end"), F.col("start") - F.col("r_end"))
    return iv.interval_join(regions(spark, d).select(PLACE), genes(spark, d).select(PLACE), gap=500).withColumn("distance", distance).where("distance < 500").select("id", "r_id", "distance")


@query(f"""WITH {REGIONS}, {GENES}, c AS (SELECT r.id, g.id AS r_id, greatest(0, g.s - r.e, r.s - g.e) AS distance, g.s > r.e AS behind, g.s AS gs, g.e AS ge FROM r JOIN g ON r.chrom = g.chrom)
    SELECT id, r_id, distance FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, behind, CASE WHEN behind THEN gs ELSE -ge END, CASE WHEN behind THEN ge ELSE gs END, r_id) = 1""")
def interval_nearest(spark, d):
    return iv.nearest(regions(spark, d), genes(spark, d)).select("id", "r_id", "distance")


@query(f"""WITH {REGIONS}, m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM r),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT chrom, min(s) AS "start", max(e) AS "end", count(*) AS n FROM i GROUP BY chrom, k""")
def interval_merge(spark, d):
    return iv.merge(regions(spark, d))


@query(f"""WITH {HITS}, m AS (SELECT chrom, pos, hit, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, hit) < 20 THEN 0 ELSE 1 END AS o FROM h),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY pos, hit ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT chrom, min(pos) AS "start", max(pos) AS "end", count(*) AS n FROM i GROUP BY chrom, k HAVING count(*) >= 3""")
def interval_gap_clusters(spark, d):
    return iv.clusters(hits(spark, d), 20, 3)


@query(f"""WITH {GENES}, v AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, s AS pos, 1 AS d FROM g UNION ALL SELECT chrom, e + 1, -1 FROM g) GROUP BY 1, 2)
    SELECT chrom, pos, CAST(sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM v""")
def interval_depth(spark, d):
    return iv.depth(genes(spark, d))


COVER = """{n} AS (WITH v AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, s AS pos, 1 AS d FROM {t} UNION ALL SELECT chrom, e + 1, -1 FROM {t}) GROUP BY 1, 2)
    SELECT chrom, pos, sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM v)"""


def runs(cond: str) -> str:
    return f"""w AS (SELECT chrom, pos, {cond} AS ok, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) - 1 AS e FROM z),
    x AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos) AS grp FROM w)
    SELECT chrom, min(pos) AS "start", max(e) AS "end" FROM x WHERE ok AND e IS NOT NULL GROUP BY chrom, grp"""


@query(f"WITH {GENES}, {COVER.format(n='z', t='g')}, {runs('k >= 2')}")
def interval_deep(spark, d):
    return iv.covered(genes(spark, d), 2)


BOTH = f"""{COVER.format(n='a', t='r')}, {COVER.format(n='b', t='g')},
    y AS (SELECT chrom, pos, max(ka) AS ka, max(kb) AS kb FROM (SELECT chrom, pos, k AS ka, NULL AS kb FROM a UNION ALL SELECT chrom, pos, NULL, k FROM b) GROUP BY 1, 2),
    z AS (SELECT chrom, pos, coalesce(last_value(ka IGNORE NULLS) OVER q, 0) AS ka, coalesce(last_value(kb IGNORE NULLS) OVER q, 0) AS kb FROM y WINDOW q AS (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {REGIONS}, {GENES}, {BOTH}, {runs('ka > 0 AND kb > 0')}")
def coverage_intersection(spark, d):
    return iv.algebra(regions(spark, d), genes(spark, d), F.col("in_a") & F.col("in_b"))


@query(f"WITH {REGIONS}, {GENES}, {BOTH}, {runs('ka > 0 OR kb > 0')}")
def coverage_union(spark, d):
    return iv.algebra(regions(spark, d), genes(spark, d), F.col("in_a") | F.col("in_b"))


@query(f"WITH {REGIONS}, {GENES}, {BOTH}, {runs('ka > 0 AND kb = 0')}")
def coverage_subtraction(spark, d):
    return iv.algebra(regions(spark, d), genes(spark, d), F.col("in_a") & ~F.col("in_b"))


@query(f"WITH {GENES}, {COVER.format(n='z', t='g')}, o AS ({'WITH ' + runs('k >= 1')}) SELECT chrom, CAST(sum(\"end\" - \"start\" + 1) AS BIGINT) AS bases FROM o GROUP BY 1")
def covered_bases(spark, d):
    return iv.covered(genes(spark, d)).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


@query(f"WITH {GENES}, w AS (SELECT id, e, unnest(range(s, e + 1, 300)) AS a FROM g) SELECT id, a AS w_start, least(a + 299, e) AS w_end FROM w")
def window_tumbling(spark, d):
    return iv.tumbling(genes(spark, d), 300).select("id", "w_start", "w_end")


@query(f"""WITH {GENES}, {HITS}, w AS (SELECT id, chrom, unnest(range(s, e + 1, 100)) AS a FROM g)
    SELECT w.id, w.a AS w_start, count(h.hit) AS n FROM w LEFT JOIN h ON w.chrom = h.chrom AND h.pos BETWEEN w.a AND w.a + 299 GROUP BY 1, 2""")
def window_sliding_counts(spark, d):
    w = iv.sliding(genes(spark, d), 300, 100).select("id", "chrom", F.col("w_start").alias("start"), F.col("w_end").alias("end"))
    return iv.points_within(w, points(spark, d)).select("id", F.col("start").alias("w_start"), "n")


@query(f"""WITH {REGIONS}, {GENES}, z AS (SELECT id, chrom, greatest(CASE WHEN strand = '+' THEN s - 8000 ELSE e - 2000 END, 0) AS s, CASE WHEN strand = '+' THEN s + 2000 ELSE e + 8000 END AS e FROM g)
    SELECT z.id, count(*) AS n FROM z JOIN r ON r.chrom = z.chrom AND r.s <= z.e AND z.s <= r.e GROUP BY z.id""")
def zone_assignment(spark, d):
    z = iv.zones(genes(spark, d), 8000, 2000)
    t = iv.overlap_totals(z, regions(spark, d)).where("n_all > 0")
    return z.join(t, ["chrom", "start", "end"]).groupBy("id").agg(F.sum("n_all").alias("n"))


@query(f"""WITH {REGIONS}, {GENES} SELECT r.id, CAST(count(*) FILTER (g.strand = '+') > 0 AS INT) || '' || CAST(count(*) FILTER (g.strand = '-') > 0 AS INT) AS bits
    FROM r LEFT JOIN g ON {OV} GROUP BY r.id""")
def annotation_bits(spark, d):
    r = regions(spark, d)
    t = iv.overlap_totals(r, genes(spark, d), {n: F.col("strand") == s for s, n in (("+", "p"), ("-", "m"))})
    bit = lambda n: F.max(F.coalesce((F.col(f"n_{n}") > 0).cast("int"), F.lit(0))).cast("string")
    return r.join(t, ["chrom", "start", "end"], "left").groupBy("id").agg(F.concat(bit("p"), bit("m")).alias("bits"))


@query(f"""WITH {REGIONS}, {GENES} SELECT r.id, g.type, sum(least(r.e, g.e) - greatest(r.s, g.s) + 1) / max(r.e - r.s + 1) AS share FROM r JOIN g ON {OV} GROUP BY 1, 2""")
def annotation_share(spark, d):
    r = regions(spark, d)
    g = genes(spark, d).withColumn("_type", F.coalesce(F.concat(F.lit("="), "type"), F.lit("")))  # a null is a type of its own
    types = g.select("chrom", "_type").distinct()
    t = iv.overlap_totals(r.select("chrom", "start", "end").distinct().join(types, "chrom"), g, by=["chrom", "_type"]).where("n_all > 0")
    type_ = F.when(F.col("_type") != "", F.expr("substr(_type, 2)")).alias("type")
    return r.join(t, ["chrom", "start", "end"]).groupBy("id", type_).agg((F.sum("width_all") / F.max(F.col("end") - F.col("start") + 1)).alias("share"))


@query(f"""WITH {REGIONS}, {GENES} SELECT g.id, arg_max(r.id, struct_pack(w := least(r.e, g.e) - greatest(r.s, g.s) + 1, i := -r.id)) AS region FROM g JOIN r ON {OV} GROUP BY g.id""")
def largest_overlap(spark, d):
    return iv.largest_overlap(genes(spark, d).select("id", "chrom", "start", "end"), regions(spark, d)).select("id", F.col("r_id").alias("region"))


@query(f"""WITH {REGIONS} SELECT a.id, b.id AS r_id, b.s - a.s AS gap FROM r a JOIN r b ON a.chrom = b.chrom AND a.id <> b.id AND b.s BETWEEN a.s AND a.s + 50""")
def windowed_pairs(spark, d):
    p = regions(spark, d).select(PLACE).withColumn("end", F.col("start"))
    j = iv.interval_join(p, p, gap=50).where("id <> r_id AND r_start >= start")
    return j.select("id", "r_id", (F.col("r_start") - F.col("start")).alias("gap"))


@query(f"""WITH {REGIONS}, {GENES} SELECT g.strand, CASE WHEN g.strand = '+' THEN r.s - g.s ELSE g.e - r.s END // 100 AS bin, count(*) AS n FROM g JOIN r ON r.chrom = g.chrom
    AND r.s BETWEEN (CASE WHEN g.strand = '+' THEN g.s ELSE g.e END) AND (CASE WHEN g.strand = '+' THEN g.s ELSE g.e END) + 1000 AND (g.strand = '+' OR r.s = g.e) GROUP BY 1, 2""")
def offset_profile(spark, d):
    """Offsets of region starts downstream of the plus strand's 5' ends (and at the minus strand's)."""
    five = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    anchors = genes(spark, d).groupBy("chrom", "strand", five.alias("five")).agg(F.count(F.lit(1)).alias("k"))
    last = F.when(F.col("strand") == "+", 10).otherwise(0)  # the last bin is one base wide
    w = anchors.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn("start", F.col("five") + F.col("bin") * 100)
    w = w.withColumn("end", F.when(F.col("bin") == last, F.col("start")).otherwise(F.col("start") + 99))
    n = iv.points_within(w, regions(spark, d).select("chrom", F.col("start").alias("pos"))).where("n > 0")
    return n.groupBy("strand", "bin").agg(F.sum(F.col("k") * F.col("n")).alias("n"))


@query(f"""WITH {REGIONS}, w AS (SELECT id, chrom, s, lag(s) OVER q AS a, lead(s) OVER q AS b, score FROM r WINDOW q AS (PARTITION BY chrom ORDER BY s, id))
    SELECT id, s - a AS before, b - s AS behind FROM w WHERE score >= 150000""")
def threshold_peaks(spark, d):
    r = iv.following(iv.preceding(regions(spark, d), ["chrom"], ["start", "id"], {"a": "start"}), ["chrom"], ["start", "id"], {"b": "start"})
    return r.where("score >= 150000").select("id", (F.col("start") - F.col("a")).alias("before"), (F.col("b") - F.col("start")).alias("behind"))


@query(f"""WITH {REGIONS} SELECT id, list(x ORDER BY o) AS ids FROM (SELECT a.id, unnest([1, 2, 3]) AS o, unnest([a.id, a.n1, a.n2]) AS x FROM
    (SELECT id, lead(id, 1) OVER w AS n1, lead(id, 2) OVER w AS n2 FROM r WINDOW w AS (PARTITION BY chrom ORDER BY s, e, id)) a WHERE n2 IS NOT NULL) GROUP BY id""")
def sliding_tuples(spark, d):
    return iv.tuples(regions(spark, d), ["start", "end", "id"], "id", 3)


@query()
def fuzzy_distinct(spark, d):
    return iv.fuzzy_distinct(regions(spark, d).select("id", "chrom", "start", "end"), 50)


@query(f"""WITH {REGIONS} SELECT a.id, b.id AS r_id, least(a.s, b.s) AS s1, greatest(a.s, b.s) - 1 AS e1, least(a.e, b.e) + 1 AS s2, greatest(a.e, b.e) AS e2
    FROM r a JOIN r b ON a.chrom = b.chrom AND a.id < b.id AND a.s <= b.e AND b.s <= a.e""")
def region_subtraction(spark, d):
    """The two outer fragments of overlapping pairs."""
    p = regions(spark, d).select(PLACE)
    j = iv.interval_join(p, p).where("id < r_id")
    return j.select("id", "r_id", F.least("start", "r_start").alias("s1"), (F.greatest("start", "r_start") - 1).alias("e1"), (F.least("end", "r_end") + 1).alias("s2"), F.greatest("end", "r_end").alias("e2"))


@query(f"""WITH {REGIONS}, m AS (SELECT r.*, EXISTS (SELECT 1 FROM r b WHERE b.chrom = r.chrom AND b.id <> r.id AND b.id % 2 = 1 AND b.s <= r.e + 100 AND r.s - 100 <= b.e) AS hit FROM r WHERE id % 2 = 0),
    k AS (SELECT count(*) FILTER (hit) AS matched, count(*) AS total FROM m) SELECT matched, total - matched AS missed, matched / total AS rate FROM k""")
def region_list_overlap(spark, d):
    r = regions(spark, d)
    one, two = r.where("id % 2 = 0"), r.where("id % 2 = 1")
    k = iv.with_flag(one, two, "m", gap=100).agg(F.count_if("m").alias("matched"), F.count(F.lit(1)).alias("total"))
    return k.select("matched", (F.col("total") - F.col("matched")).alias("missed"), F.try_divide("matched", "total").alias("rate"))


@query(f"""WITH {GENES} SELECT id, (s + e) // 2 AS midpoint, e - s + 1 AS width, greatest(s - 500, 0) AS x_start, least(e + 500, 249999) AS x_end,
    'chr' || chrom || ':' || s || '-' || e || ':' || strand AS location, 585 + s // 131072 AS first_bin FROM g""")
def coordinate_functions(spark, d):
    from ..functions import coords as c

    g = genes(spark, d)
    return g.select("id", c.midpoint().alias("midpoint"), c.width().alias("width"), *(x.alias(n) for x, n in zip(c.expand(500, 500, 249999), ("x_start", "x_end"))), c.location().alias("location"), c.first_bin(F.col("start")).alias("first_bin"))


@query(f"WITH {GENES} SELECT id, 'chr' || chrom AS chrom, s AS \"start\", e AS \"end\", strand FROM g")
def parse_locations(spark, d):
    from ..functions import coords as c

    return c.parse(genes(spark, d).select("id", c.location().alias("text")), "text").select("id", "chrom", "start", "end", "strand")
