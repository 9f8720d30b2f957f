"""Queries on sequences and strings."""

from pyspark.sql import functions as F

from ..fixtures import SEQUENCES, sequences, table
from ..functions import strings as st
from .registry import query

MATRIX = [{"A": 1.0, "C": -1.0, "G": -0.5, "T": 0.25}, {"A": -1.0, "C": 2.0, "G": 0.5, "T": -0.75}, {"A": 0.5, "C": -2.0, "G": 1.5, "T": -1.0}, {"A": -0.25, "C": 0.75, "G": -1.5, "T": 1.25}]
K = "k AS (SELECT id, seq[i:i + 5] AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - 4)) AS i FROM q))"


@query(f"WITH {SEQUENCES} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, length(seq) - length(translate(seq, 'GC', '')) AS gc FROM q")
def sequence_strands(spark, d):
    return sequences(spark, d).select("id", st.reverse_complement(F.col("seq")).alias("rc"), st.gc(F.col("seq")).alias("gc"))


@query(f"WITH {SEQUENCES}, {K} SELECT kmer, count(DISTINCT id) AS n FROM k GROUP BY 1")
def kmer_counts(spark, d):
    return st.count_kmers(sequences(spark, d), 6)


@query(f"""WITH {SEQUENCES}, {K}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY 1), r AS (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM c), z AS (SELECT *, least(kmer, rc) AS key FROM r)
    SELECT arg_max(kmer, struct_pack(n := n, first := CASE WHEN kmer = key THEN 1 ELSE 0 END)) AS kmer, CAST(sum(n) AS BIGINT) AS n FROM z GROUP BY key""")
def kmer_strands_merged(spark, d):
    return st.merge_strands(st.count_kmers(sequences(spark, d), 6, per_sequence=False))


@query(f"""WITH {SEQUENCES}, {K}, a AS (SELECT kmer, count(DISTINCT id) AS pos FROM k WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT kmer, count(DISTINCT id) AS neg FROM k WHERE id % 2 = 1 GROUP BY 1)
    SELECT kmer, pos, coalesce(neg, 0) AS neg, round(pos / (coalesce(neg, 0) + 1.0), 9) AS fold FROM a LEFT JOIN b USING (kmer) WHERE pos > 1.2 * coalesce(neg, 0)""")
def kmer_enrichment(spark, d):
    s = sequences(spark, d)
    pos = st.count_kmers(s.where("id % 2 = 0"), 6).withColumnRenamed("n", "pos")
    neg = st.count_kmers(s.where("id % 2 = 1"), 6).withColumnRenamed("n", "neg")
    j = pos.join(neg, "kmer", "left").withColumn("neg", F.coalesce("neg", F.lit(0)))
    return j.where("pos > 1.2 * neg").withColumn("fold", F.round(F.col("pos") / (F.col("neg") + 1.0), 9))


_COL = lambda j, m: "CASE seq[i + {}] WHEN 'A' THEN {} WHEN 'C' THEN {} WHEN 'G' THEN {} ELSE {} END".format(j + 1, *(m["ACGT".index(b)] if isinstance(m, list) else m[b] for b in "ACGT"))
_BACK = [{b: m["TGCA"["ACGT".index(b)]] for b in "ACGT"} for m in reversed(MATRIX)]


@query(f"""WITH {SEQUENCES}, w AS (SELECT id, seq, unnest(range(0, length(seq) - 3)) AS i FROM q),
    s AS (SELECT id, i, '+' AS strand, {' + '.join(_COL(j, m) for j, m in enumerate(MATRIX))} AS x FROM w UNION ALL SELECT id, i, '-', {' + '.join(_COL(j, m) for j, m in enumerate(_BACK))} FROM w)
    SELECT id, CAST(x AS DOUBLE) AS best, strand, i AS "at" FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, strand, i) = 1""")
def matrix_scan(spark, d):
    return st.scan_matrix(sequences(spark, d), MATRIX)


@query(f"WITH {SEQUENCES} SELECT id, list_filter(range(0, greatest(length(seq) - 4, 1)), lambda x: seq[x + 1:x + 5] = 'ACGTA') AS places FROM q")
def word_places(spark, d):
    return sequences(spark, d).select("id", st.occurrences(F.col("seq"), "ACGTA").alias("places"))


@query("""SELECT a.p_partkey, hamming(lpad(a.p_name, 30, ' '), lpad(b.p_name, 30, ' ')) AS mismatches FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def hamming_neighbours(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lpad("p_name", 30, " ").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", st.hamming(F.col("a"), F.col("b")).alias("mismatches"))


@query(f"""WITH {SEQUENCES} SELECT id, list_sum(list_transform(range(0, 12), lambda i: (strpos('ACGT', seq[i + 1]) - 1) * CAST(pow(4, 11 - i) AS BIGINT)))::BIGINT AS packed FROM q WHERE length(seq) >= 12""")
def packed_prefix(spark, d):
    """The first twelve bases as a base-4 number."""
    return sequences(spark, d).where("length(seq) >= 12").select("id", st.pack(F.substring("seq", 1, 12)).alias("packed"))
