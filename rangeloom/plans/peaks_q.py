"""Queries of peak statistics, sampling, masks and named functions."""

from pyspark.sql import functions as F

from ..fixtures import GENES, HITS, PAIRS, REGIONS, genes, hits, pairs, regions, table
from ..functions import named, stats
from ..operators import intervals as iv
from ..operators import peaks
from .registry import query

SIZES = "z AS (SELECT chrom, max(e) + 1 AS size FROM g GROUP BY 1)"


def points(spark, d):
    return hits(spark, d).select("hit", "chrom", "pos", "weight", "strand")


@query(f"WITH {GENES}, {SIZES} SELECT chrom, size FROM z")
def genome_sizes(spark, d):
    return peaks.genome_sizes(genes(spark, d))


@query(f"""WITH {GENES}, {SIZES}, w AS (SELECT chrom, size, unnest(range(0, size, 10000)) AS a FROM z) SELECT chrom, a AS "start", least(a + 10000, size) - 1 AS "end" FROM w""")
def genome_windows(spark, d):
    return peaks.over_genome(peaks.genome_sizes(genes(spark, d)), 10_000)


@query(f"""WITH {GENES}, {SIZES}, i AS (SELECT chrom, size, unnest(range(1, 501)) AS i FROM z) SELECT chrom, i, ((i * 48271 + chrom * 7919 + 11) % 2147483647 * 16807) % 2147483647 % size AS pos FROM i""")
def random_points(spark, d):
    return peaks.random_points(peaks.genome_sizes(genes(spark, d)), 500, 11)


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey * 7919 + 13) % 1000 < 100")
def random_sample(spark, d):
    """A tenth of the rows by a seeded congruence of the key."""
    return table(spark, d, "orders").where("(o_orderkey * 7919 + 13) % 1000 < 100").select("o_orderkey")


@query("SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 48271 + 5) % 2147483647, o_orderkey LIMIT 50)")
def random_limit(spark, d):
    """Fifty rows in a seeded order: a top-n, which Spark takes from each partition first."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.expr("(o_orderkey * 48271 + 5) % 2147483647"), "o_orderkey").limit(50)


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000) GROUP BY 1")
def row_limit(spark, d):
    """A limit before the grouping."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {REGIONS}, {HITS}, m AS (SELECT id, chrom, (s + e) // 2 AS m, e - s + 1 AS w FROM r), k AS (SELECT chrom, pos, count(*) AS c FROM h GROUP BY 1, 2)
    SELECT id, greatest(coalesce(sum(c) FILTER (pos BETWEEN m.m - 1000 AND m.m + 1000), 0) * any_value(w) / 2001.0, coalesce(sum(c), 0) * any_value(w) / 10001.0) AS expected
    FROM m LEFT JOIN k ON k.chrom = m.chrom AND k.pos BETWEEN m.m - 5000 AND m.m + 5000 GROUP BY id""")
def local_rate(spark, d):
    return peaks.local_rate(regions(spark, d), points(spark, d), [1000, 5000]).select("id", "expected")


@query(f"""WITH {REGIONS}, {HITS}, w AS (SELECT id, chrom, unnest(range(s, e + 1, 100)) AS a FROM r), k AS (SELECT chrom, pos, count(*) AS c FROM h GROUP BY 1, 2),
    n AS (SELECT id, a, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM w LEFT JOIN k ON k.chrom = w.chrom AND k.pos BETWEEN a AND a + 299 GROUP BY 1, 2), x AS (SELECT id, a, n, unnest(range(0, greatest(n, 1))) AS j FROM n),
    p AS (SELECT id, a, n, CASE WHEN n = 0 THEN 1 ELSE 1 - sum(exp(j * ln(9) - 9 - lgamma(j + 1.0))) END AS p FROM x GROUP BY 1, 2, 3) SELECT id, round(min(p), 6) AS p FROM p GROUP BY 1 HAVING min(p) <= 0.05""")
def enrichment_gate(spark, d):
    return peaks.gate(regions(spark, d), points(spark, d), 300, 100, 0.03, 0.05).select("id", F.round("p", 6).alias("p"))


@query(f"""WITH {HITS}, c AS (SELECT chrom, pos // 10000 AS b, count(*) FILTER (strand) AS x, count(*) FILTER (NOT strand) AS y FROM h GROUP BY 1, 2)
    SELECT CAST(sum(x * y) AS DOUBLE) / CAST(sum(x * x) AS DOUBLE) AS slope, count(*) AS bins FROM c WHERE x > 0 AND y > 0""")
def scaling_slope(spark, d):
    h = points(spark, d)
    return peaks.scaling_slope(h.where("strand"), h.where("NOT strand"), 10_000)


@query(f"""WITH {REGIONS}, {GENES}, a AS (SELECT id, chrom, s AS p FROM r), b AS (SELECT id, chrom, e AS p FROM g)
    SELECT 'left' AS side, id, EXISTS (SELECT 1 FROM b WHERE b.chrom = a.chrom AND abs(b.p - a.p) <= 150) AS near FROM a
    UNION ALL SELECT 'right', id, EXISTS (SELECT 1 FROM a WHERE b.chrom = a.chrom AND abs(b.p - a.p) <= 150) FROM b""")
def point_overlap(spark, d):
    a = regions(spark, d).select("id", "chrom", F.col("start").alias("pos"))
    return peaks.near_flags(a, genes(spark, d).select("id", "chrom", F.col("end").alias("pos")), 150)


@query(f"""WITH {REGIONS}, {GENES} SELECT r.id, g.id AS r_id, g.e - r.s AS gap FROM r JOIN g ON r.chrom = g.chrom AND g.e BETWEEN r.s - 150 AND r.s + 150""")
def point_pairs(spark, d):
    at = lambda df, c: df.select("id", "chrom", F.col(c).alias("start"), F.col(c).alias("end"))
    j = iv.interval_join(at(regions(spark, d), "start"), at(genes(spark, d), "end"), gap=150)
    return j.select("id", "r_id", (F.col("r_start") - F.col("start")).alias("gap"))


@query(f"""WITH {GENES}, {PAIRS} SELECT g.id, count(*) AS n FROM g JOIN p ON p.lc = g.chrom AND p.rc = g.chrom AND p.lp BETWEEN g.s - 4000 AND g.s + 4000 AND p.rp BETWEEN g.e - 4000 AND g.e + 4000 GROUP BY 1""")
def pair_proximity(spark, d):
    """Genes with pairs of which one end is near the gene's start and the other near its end."""
    p = pairs(spark, d).where("lc = rc").select(F.col("lc").alias("chrom"), F.col("lp").alias("x"), F.col("rp").alias("y"))
    g = genes(spark, d).select("id", "chrom", *((F.col(c) + k).alias(n) for c, k, n in (("start", -4000, "x0"), ("start", 4000, "x1"), ("end", -4000, "y0"), ("end", 4000, "y1"))))
    n = peaks.count_in_boxes(p.withColumn("n", F.lit(1).cast("long")), g, 8001).where("n > 0")
    return g.join(n, ["chrom", "x0", "x1", "y0", "y1"]).groupBy("id").agg(F.sum("n").alias("n"))


@query(f"""WITH {PAIRS} SELECT a.pair, b.pair AS r_pair, greatest(abs(a.lp - b.lp), abs(a.rp - b.rp)) AS distance FROM p a JOIN p b ON a.lc = b.lc AND a.rc = b.rc AND a.lc = a.rc AND a.pair <> b.pair
    AND b.lp BETWEEN a.lp - 400 AND a.lp + 400 AND b.rp BETWEEN a.rp - 400 AND a.rp + 400""")
def metric_range_search(spark, d):
    """All pairs of pairs within a Chebyshev radius."""
    p = pairs(spark, d).where("lc = rc").select("pair", F.col("lc").alias("chrom"), F.col("lp").alias("x"), F.col("rp").alias("y"))
    q = p.select(F.col("pair").alias("r_pair"), "chrom", (F.col("x") - 400).alias("x0"), (F.col("x") + 400).alias("x1"), (F.col("y") - 400).alias("y0"), (F.col("y") + 400).alias("y1"))
    j = peaks.in_boxes(p, q, 1024).where("pair <> r_pair")
    return j.select("pair", "r_pair", F.greatest(F.abs(F.col("x") - F.col("x0") - 400), F.abs(F.col("y") - F.col("y0") - 400)).alias("distance"))


@query(f"""WITH {HITS}, m AS (SELECT chrom, pos, hit, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, hit) <= 100 THEN 0 ELSE 1 END AS o FROM h), i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY pos, hit ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT chrom, min(pos) AS "start", max(pos) AS "end", count(*) AS n FROM i GROUP BY chrom, k HAVING count(*) >= 4 AND max(pos) - min(pos) > 200""")
def probe_tiles(spark, d):
    """Probes no further apart than a spacing, as tiles of a least count and length."""
    p = hits(spark, d).select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return iv.merge(p, 100).where((F.col("n") >= 4) & (F.col("end") - F.col("start") > 200))


@query(f"""WITH {GENES}, {HITS}, c AS (SELECT g.id, any_value(g.e - g.s + 1) AS w, count(h.hit) FILTER (h.strand) AS a, count(h.hit) FILTER (NOT h.strand) AS b FROM g LEFT JOIN h ON h.chrom = g.chrom AND h.pos BETWEEN g.s AND g.e GROUP BY 1)
    SELECT id, a, b, round(a * 1000.0 / w, 6) AS a_rate, round(b * 1000.0 / w, 6) AS b_rate, round(log2((a + 1.0) / (b + 1.0)), 6) AS change FROM c""")
def differential_counts(spark, d):
    """Counts of two samples a gene, their rates a kilobase, and the log ratio."""
    g, h = genes(spark, d).select("id", "chrom", "start", "end"), points(spark, d)
    a = iv.points_within(g, h.where("strand")).withColumnRenamed("n", "a")
    b = iv.points_within(g, h.where("NOT strand")).select("id", F.col("n").alias("b"))
    rate = lambda c: F.round(F.col(c) * 1000.0 / (F.col("end") - F.col("start") + 1), 6)
    return a.join(b, "id").select("id", "a", "b", rate("a").alias("a_rate"), rate("b").alias("b_rate"), F.round(F.log2((F.col("a") + 1.0) / (F.col("b") + 1.0)), 6).alias("change"))


@query(f"""WITH {GENES}, {HITS}, f AS (SELECT id, chrom, CASE WHEN strand = '+' THEN s ELSE e END AS f FROM g)
    SELECT CAST((h.pos - f.f + 500) // 50 AS BIGINT) AS bin, h.length, count(*) AS n FROM f JOIN h ON h.chrom = f.chrom AND h.pos BETWEEN f.f - 500 AND f.f + 499 GROUP BY 1, 2""")
def offset_by_length(spark, d):
    """Hits around 5' ends by offset and length."""
    five = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    f = genes(spark, d).select("chrom", five.alias("pos"))
    h = hits(spark, d).groupBy("chrom", "pos", "length").agg(F.count(F.lit(1)).alias("k")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    h = h.withColumn("end", F.col("pos") + 500 - 50 * F.col("bin")).withColumn("start", F.col("end") - 49)  # the 5' ends to which a hit is in that bin
    n = iv.points_within(h, f).where("n > 0")
    return n.groupBy("bin", "length").agg(F.sum(F.col("k") * F.col("n")).alias("n"))


@query("""WITH c AS (SELECT l_partkey, count(*) AS k, max(l_extendedprice) AS best FROM lineitem WHERE l_quantity >= 5 AND l_discount <= 0.08 GROUP BY 1 HAVING count(*) <= 40)
    SELECT l_orderkey, l_linenumber FROM lineitem JOIN c USING (l_partkey) WHERE l_quantity >= 5 AND l_discount <= 0.08 AND l_extendedprice = best""")
def alignment_filter(spark, d):
    """Order lines as alignments of their part: least length and identity, most hits a query, only the best."""
    t = table(spark, d, "lineitem")
    return peaks.filter_alignments(t, "l_partkey", "l_extendedprice", [], (F.col("l_quantity") >= 5) & (F.col("l_discount") <= 0.08), 40, True).select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, coalesce(value > 50, false) AS high, user_id < 50 AS early, event_type = 'click' AS click,
    CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN user_id < 50 THEN 2 ELSE 0 END + CASE WHEN event_type = 'click' THEN 4 ELSE 0 END AS mask FROM events""")
def bit_masks(spark, d):
    masks = peaks.mask({"high": F.col("value") > 50, "early": F.col("user_id") < 50, "click": F.col("event_type") == "click"})
    return table(spark, d, "events").select("event_id", *masks)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3")
def bounded_heap(spark, d):
    """The three least of each key; Spark cuts each partition's groups to three before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").withColumn("_rn", F.row_number().over(w)).where("_rn <= 3").select("o_custkey", "o_orderkey")


@query("SELECT user_id, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def first_element(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT c_custkey, n_name, c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL AND c_acctbal IS NOT NULL")
def pair_transforms(spark, d):
    """Pairs built, their right sides required, swapped, and projected."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    p = j.select(F.struct("c_custkey", "c_name", "c_acctbal").alias("a"), F.when(F.col("n_nationkey").isNotNull(), F.struct("n_name")).alias("b")).where("b IS NOT NULL AND a.c_acctbal IS NOT NULL")
    return p.select(F.struct(F.col("b").alias("first"), F.col("a").alias("second")).alias("p")).select("p.second.c_custkey", "p.first.n_name", "p.second.c_name")


@query("SELECT p_partkey, p_name AS name, p_size + 1 AS size FROM part")
def structure_edit(spark, d):
    """A record made, a field replaced, one added and one dropped."""
    r = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    r = r.withField("size", F.col("p_size") + 1).dropFields("type")
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.col("r").getField("name").alias("name"), "r.size")


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def edit_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("""SELECT event_id, (CAST(floor(value) AS BIGINT) * 97) // 3600 || ':' || lpad(CAST(((CAST(floor(value) AS BIGINT) * 97) % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((CAST(floor(value) AS BIGINT) * 97) % 60 AS VARCHAR), 2, '0') AS text FROM events WHERE value IS NOT NULL""")
def duration_text(spark, d):
    s = F.floor("value") * 97
    e = table(spark, d, "events").where("value IS NOT NULL")
    return e.select("event_id", F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60).alias("text"))


@query("""SELECT o_orderkey, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, epoch_ms(o_orderdate) AS millis, CAST(dayofyear(o_orderdate) AS INT) AS day FROM orders""")
def date_functions(spark, d):
    y = F.year("o_orderdate")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return table(spark, d, "orders").select("o_orderkey", leap.alias("leap"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("millis"), F.dayofyear("o_orderdate").alias("day"))


@query("""SELECT o_orderkey, 1.0::DOUBLE AS constant, o_totalprice AS price, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS status_o, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS status_p,
    CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS status_o_price FROM orders""")
def design_matrix(spark, d):
    """Constant, number, dummies of a factor without its base level, and an interaction."""
    is_ = lambda s: F.when(F.col("o_orderstatus") == s, 1).otherwise(0)
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.lit(1.0).alias("constant"), price.alias("price"), is_("O").alias("status_o"), is_("P").alias("status_p"), (is_("O") * price).alias("status_o_price"))


@query("""WITH c AS (SELECT p_type AS category, count(*) FILTER (p_size > 25) AS n, count(*) AS total FROM part GROUP BY 1), k AS (SELECT count(*) FILTER (p_size > 25) AS n, count(*) AS total FROM part)
    SELECT category, c.n, c.total, round((c.n * 1.0 / c.total) / (k.n * 1.0 / k.total), 9) AS fold FROM c, k WHERE c.n >= 3""")
def category_enrichment(spark, d):
    p = table(spark, d, "part")
    some = F.count_if(F.col("p_size") > 25)
    c = p.groupBy(F.col("p_type").alias("category")).agg(some.alias("n"), F.count(F.lit(1)).alias("total")).where("n >= 3")
    k = p.agg(some.alias("kn"), F.count(F.lit(1)).alias("kt"))
    return c.join(F.broadcast(k)).select("category", "n", "total", F.round((F.col("n") / F.col("total")) / (F.col("kn") / F.col("kt")), 9).alias("fold"))


@query("""WITH v AS (SELECT value, count(*) FILTER (event_type = 'click') AS p, count(*) FILTER (event_type <> 'click') AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
    c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v) SELECT CAST(sum(p * (b + n / 2.0)) AS DOUBLE) AS u, CAST(sum(p) AS BIGINT) AS n1, CAST(sum(n) AS BIGINT) AS n2 FROM c""")
def rank_sum(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL").select("value", (F.col("event_type") == "click").alias("one"))
    return stats.rank_sum(e, "value", "one")


@query("""WITH a AS (SELECT event_type AS k, count(*) FILTER (user_id < 50) AS x, count(*) FILTER (user_id >= 50) AS y FROM events GROUP BY 1), t AS (SELECT sum(x + 0.5) AS x, sum(y + 0.5) AS y FROM a)
    SELECT round(sum((a.x + 0.5) / t.x * ln(((a.x + 0.5) / t.x) / ((a.y + 0.5) / t.y))), 9) AS divergence FROM a, t""")
def relative_entropy(spark, d):
    a = table(spark, d, "events").groupBy("event_type").agg((F.count_if(F.col("user_id") < 50) + 0.5).alias("x"), (F.count_if(F.col("user_id") >= 50) + 0.5).alias("y"))
    t = a.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    p, q = F.col("x") / F.col("tx"), F.col("y") / F.col("ty")
    return a.join(F.broadcast(t)).agg(F.round(F.sum(p * F.log(p / q)), 9).alias("divergence"))


@query("""SELECT event_type, round(exp(avg(ln(value))), 6) AS mean FROM events WHERE value > 0 GROUP BY 1""")
def user_aggregate(spark, d):
    named.register(spark)
    table(spark, d, "events").where("value > 0").createOrReplaceTempView("rangeloom_events")
    return spark.sql("SELECT event_type, round(geometric_mean(value), 6) AS mean FROM rangeloom_events GROUP BY event_type")


@query(f"""WITH {GENES}, w AS (SELECT id, e, s, unnest(range(s, e + 1, 400)) AS a FROM g) SELECT id, CAST((a - s) // 400 AS INT) AS piece, a AS "start", least(a + 399, e) AS "end" FROM w""")
def table_function(spark, d):
    named.register(spark)
    genes(spark, d).select("id", F.col("start").alias("s"), F.col("end").alias("e")).createOrReplaceTempView("rangeloom_genes")
    return spark.sql("SELECT g.id, p.piece, p.start, p.end FROM rangeloom_genes g, LATERAL interval_pieces(g.s, g.e, 400) p")


@query(f"WITH {GENES}, w AS (SELECT id, e, unnest(range(s, e + 1, 250)) AS a FROM g) SELECT id, a AS w_start, least(a + 249, e) AS w_end FROM w")
def operator_by_name(spark, d):
    """An operator found by name, its parameter given as text."""
    return named.apply("tumbling", genes(spark, d), width="250").select("id", "w_start", "w_end")


@query("SELECT event_id, value * 2 + user_id AS a, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS b, coalesce(value, 0) BETWEEN 10 AND 20 AS c FROM events")
def expression_text(spark, d):
    """Columns from expressions given as text."""
    text = {"a": "value * 2 + user_id", "b": "CASE WHEN value > 50 THEN 'high' ELSE 'low' END", "c": "coalesce(value, 0) BETWEEN 10 AND 20"}
    return table(spark, d, "events").select("event_id", *(F.expr(e).alias(n) for n, e in text.items()))


@query("""SELECT p_partkey, round(cbrt(p_retailprice), 9) AS a, round(sinh(p_size / 50.0), 9) AS b, round(tanh(p_size / 50.0), 9) AS c, round(degrees(p_size / 50.0), 9) AS d, round(ln(1 + p_size), 9) AS e, round(exp(p_size / 50.0) - 1, 9) AS f,
    round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS g, CAST(sign(p_size - 25) AS INT) AS h, round(atan2(p_size, p_retailprice), 9) AS i, round(log10(p_retailprice), 9) AS j FROM part""")
def math_library(spark, d):
    s, r = F.col("p_size") / 50.0, F.col("p_retailprice")
    nine = lambda c, n: F.round(c, 9).alias(n)
    return table(spark, d, "part").select(
        "p_partkey", nine(F.cbrt(r), "a"), nine(F.sinh(s), "b"), nine(F.tanh(s), "c"), nine(F.degrees(s), "d"), nine(F.log1p("p_size"), "e"), nine(F.expm1(s), "f"),
        F.round(F.hypot("p_size", r), 6).alias("g"), F.signum(F.col("p_size") - 25).cast("int").alias("h"), nine(F.atan2("p_size", r), "i"), nine(F.log10(r), "j"),
    )
