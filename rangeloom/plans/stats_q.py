"""Queries of statistics and tests."""

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import stats
from .registry import query

COUNTS = """c AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'R') AS x, count(*) AS n FROM lineitem GROUP BY 1),
    t AS (SELECT sum(x) AS tx, sum(n) AS tn FROM c)"""
LF = "(lgamma(a + 1.0))"


def counts(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("x"), F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("x").alias("tx"), F.sum("n").alias("tn"))
    return c.join(F.broadcast(t))


@query(f"""WITH {COUNTS}, i AS (SELECT k, x, n, n * CAST(tx AS DOUBLE) / tn AS mean FROM c, t), s AS (SELECT k, x, mean, unnest(range(0, x)) AS j FROM i)
    SELECT i.k, round(1 - coalesce(sum(exp(j * ln(s.mean) - s.mean - lgamma(j + 1.0))), 0), 6) AS p FROM i LEFT JOIN s ON i.k = s.k GROUP BY i.k""")
def poisson_p(spark, d):
    rows = counts(spark, d).withColumn("mean", F.col("n") * F.col("tx").cast("double") / F.col("tn"))
    return stats.poisson_tail(rows, "x", "mean", "p").select("k", F.round("p", 6).alias("p"))


@query(f"""WITH {COUNTS}, s AS (SELECT k, x, n, CAST(tx AS DOUBLE) / tn AS q, unnest(range(0, x + 1)) AS j FROM c, t)
    SELECT k, round(least(1, sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(q) + (n - j) * ln(1 - q)))), 6) AS p FROM s GROUP BY k""")
def binomial_p(spark, d):
    rows = counts(spark, d).withColumn("q", F.col("tx").cast("double") / F.col("tn"))
    return stats.binomial_cdf(rows, "x", "n", "q", "p").select("k", F.round("p", 6).alias("p"))


@query(f"""WITH {COUNTS}, s AS (SELECT k, x, n, tx, tn, unnest(range(x, CAST(least(n, tx) AS BIGINT) + 1)) AS j FROM c, t)
    SELECT k, round(log10(sum(exp(lgamma(tx + 1.0) - lgamma(j + 1.0) - lgamma(tx - j + 1.0) + lgamma(tn - tx + 1.0) - lgamma(n - j + 1.0) - lgamma(tn - tx - n + j + 1.0) - lgamma(tn + 1.0) + lgamma(n + 1.0) + lgamma(tn - n + 1.0)))), 5) AS p
    FROM s GROUP BY k""")
def hypergeometric_p(spark, d):
    return stats.hypergeometric_tail(counts(spark, d), "x", "tn", "tx", "n", "p").select("k", F.round("p", 5).alias("p"))


P = "p AS (SELECT o_orderkey AS id, (o_orderkey * 7919 % 100003) / 100003.0 * (o_orderkey % 7 + 1) / 7.0 AS p FROM orders), a AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS n FROM p)"


def p_values(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), ((k * 7919 % 100003) / 100003.0 * (k % 7 + 1) / 7.0).alias("p"))


@query(f"WITH {P} SELECT id, rank, p * n / rank AS q FROM a")
def bh_raw(spark, d):
    return stats.bh(p_values(spark, d), "p", ["id"]).select("id", "rank", "q")


@query(f"WITH {P} SELECT id, least(p * n / rank, 1.0) AS q FROM a WHERE least(p * n / rank, 1.0) <= 0.9")
def bh_clipped(spark, d):
    return stats.bh(p_values(spark, d), "p", ["id"], clip=True).where("q <= 0.9").select("id", "q")


@query(f"WITH {P} SELECT id FROM a WHERE rank <= (SELECT max(rank) FROM a WHERE p * n / rank <= 0.7)")
def step_up_cutoff(spark, d):
    return stats.step_up(p_values(spark, d), "p", ["id"], 0.7).select("id")


ROC = "s AS (SELECT n_chars % 97 AS score, toxic AS label FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"


def scored(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("toxic IS NOT NULL")
    return j.select((F.col("n_chars") % 97).alias("score"), F.col("toxic").alias("label"))


@query(f"""WITH {ROC}, b AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1)
    SELECT score, sum(p) OVER (ORDER BY score DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY score DESC) / sum(n) OVER () AS fpr FROM b""")
def roc_curve(spark, d):
    return stats.roc(scored(spark, d), "score", "label")


@query(f"WITH {ROC} SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM s a JOIN s b ON a.label = 1 AND b.label = 0")
def roc_area(spark, d):
    return stats.auc(scored(spark, d), "score", "label")


@query("SELECT user_id, round(-sum(n / t * ln(n / t)), 9) AS entropy FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2) GROUP BY 1")
def entropy_by_user(spark, d):
    return stats.entropy(table(spark, d, "events"), ["user_id"], "event_type").withColumn("entropy", F.round("entropy", 9))


@query("""WITH xy AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT round(sum(n / t * ln(n * t / (nx * ny))), 9) AS information FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM xy)""")
def mutual_information(spark, d):
    return stats.mutual_information(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("information", 9).alias("information"))


@query(f"WITH {COUNTS} SELECT k, round((x / n - (tx - x) / (tn - n)) / sqrt((tx / tn) * (1 - tx / tn) * (1.0 / n + 1.0 / (tn - n))), 9) AS z FROM c, t")
def two_proportions(spark, d):
    rows = counts(spark, d)
    x, n, tx, tn = (F.col(c) for c in ("x", "n", "tx", "tn"))
    return rows.select("k", F.round(stats.z_two_proportions(x, n, tx - x, tn - n), 9).alias("z"))


@query("SELECT event_id, 1 - cos(value) AS versine, (1 - cos(value)) / 2 AS haversine, asinh(value) AS a, value * pi() / 180 AS radians, CASE WHEN value = 0 THEN 1 ELSE sin(value) / value END AS sinc FROM events WHERE value IS NOT NULL")
def math_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", (1 - F.cos(v)).alias("versine"), ((1 - F.cos(v)) / 2).alias("haversine"), F.asinh(v).alias("a"), F.radians(v).alias("radians"), F.when(v == 0, 1.0).otherwise(F.sin(v) / v).alias("sinc"))


@query("""SELECT vec_id, round(list_aggregate(embedding, 'max'), 5) AS top, round(list_aggregate(embedding, 'sum'), 4) AS total, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings""")
def array_functions(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(e), 5).alias("top"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"))
