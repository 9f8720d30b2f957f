"""Queries of the row-frame operators."""

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import frames as fr
from .registry import query


@query('SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey IS NOT DISTINCT FROM n_nationkey')
def frame_join(spark, d):
    j = fr.join(table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, d, "nation").withColumnRenamed("n_nationkey", "k"), "k")
    return j.select("left.c_custkey", "right.n_name")


@query('SELECT l_returnflag, avg(l_quantity) AS mean, var_pop(l_quantity) AS variance, avg((l_quantity - l_discount * 100) ** 2) AS squared_error, stddev_samp(l_quantity) AS sd, median(l_quantity) AS median FROM lineitem GROUP BY 1')
def frame_statistics(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.avg(q).alias("mean"), F.var_pop(q).alias("variance"), F.avg((q - F.col("l_discount") * 100) ** 2).alias("squared_error"), F.stddev_samp(q).alias("sd"), F.median(q).alias("median")
    )


@query('SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem GROUP BY 1')
def frame_correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(fr.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 9).alias("r"))


@query('SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)')
def frame_top(spark, d):
    return fr.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


@query('SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1')
def frame_arg_max(spark, d):
    return fr.arg_max(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query('SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1')
def frame_first_seen(spark, d):
    return fr.first_seen(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query('SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1')
def frame_occurrence(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT DISTINCT p_brand, p_type FROM part')
def frame_distinct(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("""WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey, s_name) AS position FROM supplier), b AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey, n_name) AS position FROM nation)
    SELECT position, s_suppkey, n_nationkey FROM a FULL JOIN b USING (position)""")
def frame_zip(spark, d):
    z = fr.zip_rows(table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "nation").select("n_nationkey", "n_name").withColumnRenamed("n_nationkey", "s_suppkey"), "s_suppkey")
    return z.select("position", F.col("left.s_suppkey").alias("s_suppkey"), F.col("right.s_suppkey").alias("n_nationkey"))


@query('SELECT least(greatest(CAST(floor((value - 10) / 5) AS BIGINT), 0), 19) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1')
def histogram_clamped(spark, d):
    return fr.histogram(table(spark, d, "events"), "value", 10, 5, 20)


@query('SELECT least(greatest(CAST(floor((value - 10) / 5) AS BIGINT), -1), 8) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1')
def histogram_overflow(spark, d):
    return fr.histogram(table(spark, d, "events"), "value", 10, 5, 8, clamp=False)


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag AS s, l_extendedprice AS v FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY v) AS rk FROM k), m AS (SELECT rk, avg(v) AS normalised FROM r GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(normalised, 2) AS normalised FROM r JOIN m USING (rk)""")
def quantile_normalisation(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("s"), F.col("l_extendedprice").alias("v"))
    return fr.quantile_normalise(rows, "s", "v").select("l_orderkey", "l_linenumber", (F.round(F.col("normalised") * 100) / 100).alias("normalised"))


@query("""SELECT o_orderstatus, coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent, coalesce(sum(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 0) AS low FROM orders GROUP BY 1""")
def frame_pivot(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.sum("o_totalprice"))
    return p.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0.0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0.0)).alias("low"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersection(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT event_type, value, event_id FROM events WHERE value > 50 AND NOT (event_type = 'click' OR user_id < 10)")
def predicate_filter(spark, d):
    return table(spark, d, "events").where((F.col("value") > 50) & ~((F.col("event_type") == "click") | (F.col("user_id") < 10))).select("event_type", "value", "event_id")


@query("SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS flag FROM events")
def predicate_indicator(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("flag"))


@query("SELECT coalesce(sum(l_discount) / nullif(sum(l_tax), 0), 0) AS fraction, l_shipmode FROM (SELECT l_discount, l_tax, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 2")
def count_fraction(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(F.coalesce(F.try_divide(F.sum("l_discount"), F.sum("l_tax")), F.lit(0.0)).alias("fraction"))


@query("""SELECT event_type, max(value) AS top, list_sort(list(event_id) FILTER (value = m)) AS ids FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1""")
def max_with_args(spark, d):
    e = table(spark, d, "events")
    top = e.groupBy("event_type").agg(F.max("value").alias("top"))
    return e.join(top, "event_type").where(F.col("value") == F.col("top")).groupBy("event_type", "top").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))


@query("SELECT o_orderpriority, o_orderstatus, grouping(o_orderstatus) AS g, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def grouping_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.grouping("o_orderstatus").cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT event_id, coalesce(props::JSON ->> '$.k', '') AS k, length(props) AS n FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.length("props").alias("n"))
