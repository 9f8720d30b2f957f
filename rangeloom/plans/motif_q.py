"""Queries of motifs, hidden Markov models, graphs and read errors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import SEQUENCES, sequences, table
from ..functions import stats
from ..functions import strings as st
from ..operators import learn, peaks
from .registry import query
from .string_q import _BACK, _COL, MATRIX

WORDS = ["CACA", "GGATC", "TTTAAA", "ACGTACG"]
LONG = MATRIX + MATRIX[:2]
LONG_BACK = [{b: m["TGCA"["ACGT".index(b)]] for b in "ACGT"} for m in reversed(LONG)]
CUTOFFS = [2.0 + 0.5 * i for i in range(14)]


def _sum(matrix):
    return " + ".join(_COL(j, m) for j, m in enumerate(matrix))


PLACES = f"""{SEQUENCES}, w AS (SELECT unnest({WORDS}) AS word), z AS (SELECT id, word, seq, unnest(range(0, length(seq) - length(word) + 1)) AS "at" FROM q, w),
    h AS (SELECT id, word, "at" FROM z WHERE seq["at" + 1:"at" + length(word)] = word)"""


@query(f"""WITH {SEQUENCES}, w AS (SELECT id, seq, unnest(range(0, length(seq) - 3)) AS i FROM q),
    s AS MATERIALIZED (SELECT id, i, '+' AS strand, {_sum(MATRIX)} AS x FROM w UNION ALL SELECT id, i, '-', {_sum(_BACK)} FROM w)
    SELECT id, CAST(i AS INT) AS "at", strand, CAST(x AS DOUBLE) AS score FROM s WHERE x >= 5""")
def motif_hits(spark, d):
    return st.matrix_hits(sequences(spark, d), MATRIX, 5.0)


@query(f"""WITH {SEQUENCES}, w AS (SELECT id, seq, unnest(range(0, length(seq) - 5)) AS i FROM q),
    s AS (SELECT id, {_sum(LONG)} AS x FROM w UNION ALL SELECT id, {_sum(LONG_BACK)} FROM w), b AS (SELECT id, max(x) AS best FROM s GROUP BY 1),
    c AS (SELECT unnest({CUTOFFS}) AS cutoff), n AS (SELECT cutoff, count(*) FILTER (id % 2 = 0 AND best >= cutoff) AS fg, count(*) FILTER (id % 2 = 0) AS fg_all,
    count(*) FILTER (id % 2 = 1 AND best >= cutoff) AS bg, count(*) FILTER (id % 2 = 1) AS bg_all FROM b, c GROUP BY 1),
    r AS (SELECT *, greatest(bg, 1) / CAST(bg_all AS DOUBLE) AS p0 FROM n WHERE bg < bg_all AND fg > 0),
    t AS (SELECT cutoff, sum(exp(lgamma(fg_all + 1.0) - lgamma(j + 1.0) - lgamma(fg_all - j + 1.0) + j * ln(p0) + (fg_all - j) * ln(1 - p0))) AS p FROM (SELECT *, unnest(range(fg, fg_all + 1)) AS j FROM r) GROUP BY 1)
    SELECT cutoff, fg, bg, round(ln(fg / CAST(fg_all AS DOUBLE) / p0), 6) AS log_fold, round(least(p, 1), 6) AS p FROM r JOIN t USING (cutoff)""")
def motif_enrichment(spark, d):
    """For each score cutoff, the share of sequences of two sets that reach it, with the binomial upper tail (a background of
    no hits counts as one)."""
    best = st.scan_matrix(sequences(spark, d), LONG).withColumn("front", F.col("id") % 2 == 0)
    n = st.cutoff_counts(best, "best", "front", CUTOFFS).where("bg < bg_all AND fg > 0")
    n = n.withColumn("p0", F.greatest("bg", F.lit(1)) / F.col("bg_all")).withColumns({"misses": F.col("fg_all") - F.col("fg"), "q0": 1 - F.col("p0")})
    fold = F.log(F.col("fg") / F.col("fg_all") / F.col("p0"))
    return stats.binomial_cdf(n, "misses", "fg_all", "q0", "p").select("cutoff", "fg", "bg", F.round(fold, 6).alias("log_fold"), F.round("p", 6).alias("p"))


@query(f"""WITH {SEQUENCES}, k AS (SELECT id, seq[i:i + 7] AS site FROM (SELECT id, seq, unnest(range(1, length(seq) - 6)) AS i FROM q)), s AS (SELECT site, 1 + id % 3 AS w FROM k WHERE site LIKE 'ACG%'),
    c AS (SELECT i - 1 AS pos, site[i] AS base, w FROM (SELECT site, w, unnest(range(1, 9)) AS i FROM s)), m AS (SELECT avg(w) AS m FROM s),
    f AS (SELECT pos, l.base, (coalesce(sum(w) FILTER (c.base = l.base), 0) + 0.375 * any_value(m)) / (sum(w) + 1.5 * any_value(m)) AS f FROM c, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) l, m GROUP BY 1, 2)
    SELECT CAST(pos AS INT) AS pos, base, round(log2(f / 0.25), 6) AS score, round(sum(f * log2(f / 0.25)) OVER (PARTITION BY pos), 6) AS information FROM f""")
def position_matrix(spark, d):
    s = sequences(spark, d).select((1 + F.col("id") % 3).alias("weight"), F.explode(st.kmers(F.col("seq"), 8)).alias("site")).where("site LIKE 'ACG%'")
    return st.position_matrix(s).select("pos", "base", F.round("score", 6).alias("score"), F.round("information", 6).alias("information"))


@query(f"""WITH {PLACES} SELECT id, word, CAST("at" AS INT) AS "at" FROM h""")
def multi_pattern_places(spark, d):
    return st.many_occurrences(sequences(spark, d), WORDS)


@query(f"""WITH {PLACES}, s AS (SELECT DISTINCT id, word FROM h), n AS (SELECT id % 2 AS side, a.word, b.word AS other, count(*) AS n FROM s a JOIN s b USING (id) WHERE a.word < b.word GROUP BY 1, 2, 3)
    SELECT word, other, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS fg, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS bg FROM n GROUP BY 1, 2""")
def motif_pairs(spark, d):
    """Sequences of two sets that hold both of two words."""
    h = st.many_occurrences(sequences(spark, d), WORDS)
    fg, bg = (st.word_pairs(h.where(F.col("id") % 2 == side)).withColumnRenamed("n", n) for side, n in ((0, "fg"), (1, "bg")))
    return fg.join(bg, ["word", "other"], "full").select("word", "other", F.coalesce("fg", F.lit(0)).alias("fg"), F.coalesce("bg", F.lit(0)).alias("bg"))


@query(f"""WITH {PLACES} SELECT word, CAST("at" // 500 AS BIGINT) AS bin, count(*) AS hits, count(DISTINCT id) AS sequences FROM h GROUP BY 1, 2""")
def motif_density(spark, d):
    h = st.many_occurrences(sequences(spark, d), WORDS)
    per = h.groupBy("word", F.floor(F.col("at") / 500).alias("bin"), "id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word", "bin").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("sequences"))


@query(f"""WITH {PLACES}, n AS (SELECT id, word, count(*) AS n FROM h GROUP BY 1, 2) SELECT q.id, {', '.join(f"coalesce(max(n) FILTER (word = '{w}'), 0) AS n_{w.lower()}" for w in WORDS)} FROM q LEFT JOIN n USING (id) GROUP BY 1""")
def motif_features(spark, d):
    """Occurrences of each word in every sequence, one column a word."""
    s = sequences(spark, d)
    n = st.many_occurrences(s, WORDS).groupBy("id").pivot("word", WORDS).agg(F.count(F.lit(1)))
    return s.select("id").join(n, "id", "left").select("id", *(F.coalesce(w, F.lit(0)).alias(f"n_{w.lower()}") for w in WORDS))


@query("""WITH p AS (SELECT a.p_partkey, lpad(a.p_name, 30, ' ') AS a, lpad(b.p_name, 30, ' ') AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_partkey, CAST(30 - list_max(list_transform(range(-3, 4), lambda k: len(list_filter(range(1, 31), lambda i: i + k BETWEEN 1 AND 30 AND a[i] = b[i + k])))) AS INT) AS distance FROM p""")
def shift_distance(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lpad("p_name", 30, " ").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", st.shift_distance(F.col("a"), F.col("b"), 3).alias("distance"))


STEP, EMIT = [[0.9, 0.1], [0.2, 0.8]], [[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]


def user_symbols(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("value") > 60, 2).when(F.col("value") > 30, 1).otherwise(0).alias("symbol"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN value > 60 THEN 3 WHEN value > 30 THEN 2 ELSE 1 END AS s FROM events),
    f AS (SELECT user_id, i, CAST({EMIT[0]}[s] AS DOUBLE) AS b0, CAST({EMIT[1]}[s] AS DOUBLE) AS b1 FROM e),
    r AS (SELECT user_id, i, 0.5 * b0 / (0.5 * b0 + 0.5 * b1) AS a0, ln(0.5 * b0 + 0.5 * b1) AS ll FROM f WHERE i = 1
      UNION ALL SELECT user_id, i, x0 / (x0 + x1), ll + ln(x0 + x1) FROM (SELECT f.user_id, f.i, r.ll, (r.a0 * 0.9 + (1 - r.a0) * 0.2) * f.b0 AS x0, (r.a0 * 0.1 + (1 - r.a0) * 0.8) * f.b1 AS x1 FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1))
    SELECT user_id, max(i) AS n, round(arg_max(ll, i), 6) AS log_likelihood FROM r GROUP BY 1""")
def hmm_likelihood(spark, d):
    got = learn.sequence_likelihood(user_symbols(spark, d), "user_id", ["ts", "event_id"], "symbol", [0.5, 0.5], STEP, EMIT)
    return got.withColumn("log_likelihood", F.round("log_likelihood", 6))


@query()
def hmm_posteriors(spark, d):
    got = learn.state_posteriors(user_symbols(spark, d), "user_id", ["ts", "event_id"], "symbol", [0.5, 0.5], STEP, EMIT)
    return got.select("event_id", F.round(F.get("posterior", F.lit(0)), 9).alias("p0"))


@query()
def hmm_training(spark, d):
    """Log-likelihood of each of five rounds of expectation maximisation."""
    seen = learn.baum_welch(user_symbols(spark, d), "user_id", ["ts", "event_id"], "symbol", [0.5, 0.5], STEP, EMIT, rounds=5)[3]
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(seen)], "round int, log_likelihood double")


CHAINS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS t FROM orders),
    g AS (SELECT *, lag(k) OVER w AS before, coalesce(date_diff('day', lag(t) OVER w, t), 9999) AS gap FROM o WINDOW w AS (PARTITION BY c ORDER BY t, k)),
    i AS (SELECT *, sum(CASE WHEN gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t, k) AS island FROM g)"""


def order_chains(spark, d):
    """Links from an order to its customer's next one within 200 days."""
    w = Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"), "o_orderkey")
    o = table(spark, d, "orders").select(F.lag("o_orderkey").over(w).alias("a"), F.col("o_orderkey").alias("b"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap"))
    return o.where("gap <= 200").select("a", "b")


@query(f"WITH {CHAINS} SELECT k AS node, min(k) OVER (PARTITION BY c, island) AS component FROM i QUALIFY count(*) OVER (PARTITION BY c, island) > 1")
def graph_components(spark, d):
    return learn.connected(order_chains(spark, d))


@query(f"WITH {CHAINS} SELECT k AS node, CAST(row_number() OVER (PARTITION BY c, island ORDER BY t, k) - 1 AS INT) AS level FROM i QUALIFY count(*) OVER (PARTITION BY c, island) > 1")
def graph_levels(spark, d):
    return learn.topological_levels(order_chains(spark, d))


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS quantity, round(regr_r2(l_extendedprice, l_tax), 6) AS tax FROM lineitem")
def regression_r2(spark, d):
    t = table(spark, d, "lineitem")
    return spark.createDataFrame([tuple(round(learn.r_squared(t, "l_extendedprice", [x]), 6) for x in ("l_quantity", "l_tax"))], "quantity double, tax double")


@query("""WITH r AS (SELECT CAST(l_quantity AS BIGINT) AS q, l_linenumber AS x, l_suppkey % 3 + 1 AS i FROM lineitem), p AS (SELECT *, unnest(range(0, q + x + i + 8)) AS pos FROM r)
    SELECT pos, count(*) AS reads, count(*) FILTER (pos >= q AND pos < q + x) AS mismatches, count(*) FILTER (pos >= q + x AND pos < q + x + i) AS insertions,
    CAST(2 * count(*) FILTER (pos = q + x + i + 5) AS BIGINT) AS deletions FROM p GROUP BY 1""")
def read_error_rates(spark, d):
    """Mismatched, inserted and deleted bases at each position of the reads, from their CIGAR strings."""
    cigar = F.concat(F.col("l_quantity").cast("int"), F.lit("="), "l_linenumber", F.lit("X"), F.col("l_suppkey") % 3 + 1, F.lit("I5=2D3="))
    return peaks.position_errors(table(spark, d, "lineitem").select(cigar.alias("cigar")), "cigar")
