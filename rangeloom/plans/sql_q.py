"""Analytical patterns that are plain SQL, run by Spark SQL over temporary views and by DuckDB."""

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions.stats import median, ranked
from .registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> SQL that both engines run alike.
PATTERNS = {
    "sql_regression": """SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 9) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 9) AS intercept,
        round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 9) AS r2 FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY l_returnflag""",
    "sql_median_scaled": """WITH m AS (SELECT median(l_quantity) AS a, median(l_extendedprice) AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_quantity * (SELECT b FROM m) / (SELECT a FROM m) AS scaled FROM lineitem""",
    "sql_group_average": "SELECT l_partkey, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY l_partkey",
    "sql_clamped_mix": """SELECT l_orderkey, l_linenumber, greatest(l_extendedprice - 20 * l_quantity, 10) AS a, greatest(l_extendedprice * l_discount, 10) AS b,
        greatest(l_extendedprice - 20 * l_quantity, 10) / greatest(l_extendedprice * l_discount, 10) AS ratio FROM lineitem""",
    "sql_self_join": """SELECT a.l_partkey, count(*) AS n, sum(a.l_quantity * b.l_quantity) AS s FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = 1 AND b.l_suppkey = 2 GROUP BY a.l_partkey""",
    "sql_range_by_midpoint": """SELECT o_orderkey, row_number() OVER (ORDER BY (o_totalprice + c_acctbal) / 2, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 100000 AND 110000""",
    "sql_extrema": """SELECT (SELECT max(value) FROM events) AS top, (SELECT min(value) FROM events WHERE user_id BETWEEN 3 AND 90) AS low, (SELECT count(*) FROM events WHERE user_id < 50) AS n""",
    "sql_nested_semi": """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))""",
    "sql_or_subquery": """SELECT s_suppkey FROM supplier WHERE s_suppkey = 7 OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%')""",
    "sql_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sql_count_by_subquery": """SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_suppkey""",
    "sql_union_scans": """SELECT 'c' AS kind, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
        UNION ALL SELECT 's', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2""",
    "sql_like": "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '%E%'",
    "sql_half_open_sum": "SELECT user_id, sum(value) AS w FROM events WHERE value >= 10 AND value < 60 GROUP BY user_id",
    "sql_count_filtered": "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'",
    "sql_window_frames": """SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s,
        dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events""",
    "sql_set_overlap": """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey = 1), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey = 2)
        SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) x) AS both""",
    "sql_substring_scan": "SELECT doc_id, substring(text, 11, 20) AS piece FROM documents",
    "sql_metadata_match": """SELECT a.s_suppkey, min(b.s_suppkey) AS control FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey""",
}


def _by_midpoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice BETWEEN 100000 AND 110000")
    rows = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", ((F.col("o_totalprice") + F.col("c_acctbal")) / 2).alias("m"))
    return ranked(rows, ["m", "o_orderkey"], "place").select("o_orderkey", "place")


def _median_scaled(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    a, b = (F.broadcast(median(t, c).withColumnRenamed("median", n)) for c, n in (("l_quantity", "_a"), ("l_extendedprice", "_b")))
    return t.join(a).join(b).select("l_orderkey", "l_linenumber", F.try_divide(F.col("l_quantity") * F.col("_b"), "_a").alias("scaled"))


#: Where Spark's own plan for the SQL would be one task: the same rows from operators.
OWN = {"sql_median_scaled": _median_scaled, "sql_range_by_midpoint": _by_midpoint}


def _run(sql: str):
    def query(spark, sf_dir):
        for t in TABLES:
            if t in sql:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    return query


for _name, _sql in PATTERNS.items():
    QUERIES[_name] = OWN.get(_name) or _run(_sql)
    ORACLES[_name] = _sql
