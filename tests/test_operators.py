import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import coords, stats, strings
from rangeloom.operators import frames, intervals, learn, store
from rangeloom.sources import text

HITS = [(i, 60, p, float(w), s == "+", n) for i, (p, w, s, n) in enumerate([(1, 10, "+", 10), (1, 10, "-", 10), (1, 10, "+", 10), (10, 10, "-", 10), (10, 20, "+", 20), (11, 20, "-", 20), (12, 20, "+", 20), (25, 20, "-", 20)])]
SCHEMA = "hit long, chrom int, pos int, weight double, strand boolean, length int"


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(HITS, SCHEMA)


def counts(df):
    return {r["centre"]: r["n"] for r in df.collect()}


def test_histogram_literals(hits):
    assert counts(store.histogram(hits, 0, 100, 10)) == {5: 3, 15: 4, 25: 1}
    assert counts(store.histogram(hits, 0, 100, 10, above=15)) == {15: 3, 25: 1}
    assert counts(store.histogram(hits, 0, 100, 10, strand=True)) == {5: 2, 15: 2}


def test_count_takes_the_limit_and_histogram_does_not(hits):
    assert store.count(hits, least=20).first()["n"] == 4
    assert counts(store.histogram(hits, 0, 100, 10, above=20)) == {}


def test_dedup_counts_from_the_first_that_passes(spark):
    random.seed(3)
    rows = [(i, 1, random.randrange(4), float(random.randrange(3)), True, 1) for i in range(60)]
    for d in (1, 2, 3):
        got = counts(store.histogram(spark.createDataFrame(rows, SCHEMA), 0, 9, 1, above=0, dedup=d))
        want: dict[int, int] = {}
        for p in range(4):
            seen = None
            for r in (r for r in rows if r[2] == p):
                if seen is not None:
                    seen += 1
                if r[3] > 0 and (seen is None or seen < d):
                    want[p] = want.get(p, 0) + 1
                    seen = 0 if seen is None else seen
        assert got == want


def test_interval_join_equals_nested_loop(spark):
    random.seed(1)
    make = lambda n: [(i, random.choice("ab"), s := random.randrange(300_000), s + random.choice([0, 10, 3000, 250_000])) for i in range(n)]
    a, b = make(120) + [(999, "a", 0, 900_000)], make(120)
    cols = "id long, chrom string, start int, end int"
    for how, ok in (("overlap", lambda x, y: x[2] <= y[3] and y[2] <= x[3]), ("within", lambda x, y: y[2] <= x[2] and x[3] <= y[3]), ("contains", lambda x, y: x[2] <= y[2] and y[3] <= x[3])):
        got = intervals.interval_join(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), how)
        want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and ok(x, y))
        assert sorted((r["id"], r["r_id"]) for r in got.collect()) == want


def test_merge_keeps_adjacent_apart_and_is_idempotent(spark):
    rows = [("a", 35, 45), ("a", 12, 20), ("a", 60, 80), ("a", 0, 10), ("a", 46, 50), ("a", 70, 200_000), ("a", 100_000, 100_001)]
    one = intervals.merge(spark.createDataFrame(rows, "chrom string, start int, end int"))
    got = sorted((r["start"], r["end"]) for r in one.collect())
    assert got == [(0, 10), (12, 20), (35, 45), (46, 50), (60, 200_000)]
    assert sorted((r["start"], r["end"]) for r in intervals.merge(one.drop("n")).collect()) == got


def test_fuzzy_distinct_equals_scan(spark):
    random.seed(5)
    rows = [(i, "a", s := random.randrange(400), s + random.randrange(80)) for i in range(150)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        if not any(abs(r[2] - k[2]) <= 5 and abs(r[3] - k[3]) <= 5 for k in kept):
            kept.append(r)
    got = intervals.fuzzy_distinct(spark.createDataFrame(rows, "id long, chrom string, start int, end int"), 5)
    assert sorted(r["id"] for r in got.collect()) == sorted(k[0] for k in kept)


def test_nearest_without_targets_is_null(spark):
    cols = "id long, chrom string, start int, end int"
    q = spark.createDataFrame([(1, "a", 5, 9), (2, "b", 5, 9)], cols)
    got = {r["id"]: (r["r_id"], r["distance"]) for r in intervals.nearest(q, spark.createDataFrame([(7, "a", 20, 30), (8, "a", 1, 2)], cols)).collect()}
    assert got == {1: (8, 3), 2: (None, None)}


def test_top_is_ascending_and_returns_all_of_a_short_input(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "v int")
    assert [r["v"] for r in frames.top(df, "v", 2).collect()] == [2, 3]
    assert [r["v"] for r in frames.top(df, "v", 9).collect()] == [1, 2, 3]


def test_join_matches_null_keys_and_correlation_of_a_constant_is_null(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, x int")
    assert frames.join(a, a, "k").count() == 2
    assert a.withColumn("c", F.lit(1.0)).agg(frames.pearson(F.col("x"), F.col("c")).alias("r")).first()["r"] is None


def test_tails_against_sums():
    assert math.isclose(stats.poisson_tail_value(3, 2.0), 1 - sum(math.exp(-2) * 2**j / math.factorial(j) for j in range(3)), rel_tol=1e-12)
    assert math.isclose(stats.binomial_cdf_value(2, 5, 0.3), sum(math.comb(5, j) * 0.3**j * 0.7 ** (5 - j) for j in range(3)), rel_tol=1e-12)
    assert math.isnan(stats.binomial_cdf_value(1, 0, 0.5))
    want = sum(math.comb(139, j) * math.comb(3596 - 139, 219 - j) for j in range(5, 140)) / math.comb(3596, 219)
    assert math.isclose(stats.hypergeometric_tail_value(5, 3596, 139, 219), math.log10(want), rel_tol=1e-9)


def test_strings(spark):
    df = spark.createDataFrame([(1, "ACGTN", "ACGTT")], "id long, seq string, other string")
    r = df.select(strings.reverse_complement(F.col("seq")).alias("rc"), strings.kmers(F.col("seq"), 3).alias("k"), strings.hamming(F.col("seq"), F.col("other")).alias("h"), strings.kmers(F.col("seq"), 9).alias("none")).first()
    assert (r["rc"], r["k"], r["h"], r["none"]) == ("NACGT", ["ACG", "CGT", "GTN"], 1, [])


def test_parse_location(spark):
    df = spark.createDataFrame([("1:1,000-2k:+",), ("x",), ("chrX:1.5m-2m",)], "t string")
    got = [tuple(r[1:]) for r in coords.parse(df, "t").collect()]
    assert got == [("1", 1000, 2000, "+"), (None, None, None, None), ("chrX", 1500000, 2000000, None)]


def test_viterbi_and_least_squares(spark):
    df = spark.createDataFrame([("u", i, s) for i, s in enumerate([0, 0, 0, 1, 1, 1])], "g string, t int, s int")
    got = learn.viterbi(df, "g", ["t"], "s", [0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [[0.9, 0.1], [0.1, 0.9]])
    assert [r["state"] for r in got.orderBy("t").collect()] == [0, 0, 0, 1, 1, 1]
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    assert [round(v, 6) for v in learn.least_squares(line, "y", ["x"])] == [1.0, 2.0]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#c\nchr1.x 10 20 n 5 +\nshort 1 2\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("1", 10, 19, "n", 5.0, "+")]
    (tmp_path / "a.sam").write_text("@HD\tx\nr1\t16\tchr2\t5\t60\t3M1D2M1I\t*\t0\t0\tACGTAC\tIIIIII\tNH:i:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert [tuple(r) for r in text.read_sam(spark, str(tmp_path / "a.sam")).collect()] == [("r1", "2", 5, 10, "-", 0.5)]
    (tmp_path / "a.bedpe").write_text("chr1 100 110 chr1 50 60 p 1 + -\n")
    r = text.read_bedpe(spark, str(tmp_path / "a.bedpe")).first()
    assert (r["left"]["start"], r["left"]["strand"], r["right"]["start"], r["right"]["strand"]) == (50, "-", 100, "+")
    (tmp_path / "f.txt").write_text("a b\nrow1 1 NA\nrow2 x 2.5\n")
    assert [tuple(r) for r in text.read_frame(spark, str(tmp_path / "f.txt"), "a int,b double").collect()] == [(1, None), (None, 2.5)]
    (tmp_path / "m.txt").write_text(">M1 x\nA [1 2]\nC [3 4]\nG [5 6]\nT [7 8]\n")
    assert {(r["letter"], r["pos"]): r["weight"] for r in text.read_matrices(spark, str(tmp_path / "m.txt")).collect()}[("G", 1)] == 6.0


def test_shortest_paths_go_to_the_end(spark):
    from rangeloom.operators import learn

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(55)], "a long, b long, w double").coalesce(1)
    got = {r["node"]: r["distance"] for r in learn.shortest_paths(edges, 0).collect()}
    assert got == {i: float(i) for i in range(56)}


def test_interval_join_meets_few_candidates(spark):
    """Short intervals meet in fine bins only: candidates stay within ten times of the pairs."""
    from pyspark.sql import functions as F

    from rangeloom.fixtures import hits, regions

    d = "/root/testdata/sf0.001"
    p = hits(spark, d).select("hit", "chrom", F.col("pos").alias("start"), F.col("pos").alias("end"))
    a = intervals._binned(p, 2, 1).select("chrom", "_class", "_bin")
    b = intervals._binned(regions(spark, d), 1, 2).select("chrom", "_class", "_bin")
    pairs = intervals.interval_join(p, regions(spark, d)).count()
    assert 0 < a.join(b, ["chrom", "_class", "_bin"]).count() <= 10 * pairs


def test_flags_equal_nested_loop(spark):
    import random

    r = random.Random(3)
    some = lambda n: [(i, i % 2, s := r.randrange(400_000), s + r.choice([0, 5, 300, 200_000])) for i in range(n)]
    a, b = some(60), some(25)
    cols = "id int, chrom int, start int, end int"
    for how, gap, test in (("overlap", 0, lambda x, y: y[2] <= x[3] and x[2] <= y[3]), ("overlap", 70, lambda x, y: y[2] <= x[3] + 70 and x[2] - 70 <= y[3]), ("within", 0, lambda x, y: y[2] <= x[2] and x[3] <= y[3]), ("contains", 0, lambda x, y: x[2] <= y[2] and y[3] <= x[3])):
        got = {(x["id"], x["f"]) for x in intervals.with_flag(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), "f", gap, how).collect()}
        assert got == {(x[0], any(x[1] == y[1] and test(x, y) for y in b)) for x in a}, how


def test_models_equal_plain_python(spark):
    import numpy as np

    from rangeloom.operators import learn

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (30, 3)), rng.normal(6, 1, (30, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got, centres = learn.kmeans(df, "v", [[0.0, 0, 0], [5.0, 5, 5]])
    want = np.array([[0.0, 0, 0], [5.0, 5, 5]])
    for _ in range(10):
        near = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
        want = np.stack([x[near == k].mean(0) for k in (0, 1)])
    assert np.allclose(centres, want) and {r["id"]: r["cluster"] for r in got.collect()} == dict(enumerate(near.tolist()))

    groups = learn.agglomerate(spark.createDataFrame([(1, 1, [0.0]), (1, 2, [1.0]), (1, 3, [9.0]), (2, 4, [0.5]), (1, 5, [9.5])], "g int, k int, v array<double>"), ["g"], "k", "v", 2.0)
    assert {r["k"]: r["cluster"] for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 5: 3, 4: 4}

    y = np.concatenate([rng.normal(0, 1, 400), rng.normal(10, 2, 600)])
    m = sorted(learn.mixture(spark.createDataFrame([(1, float(v)) for v in y], "g int, v double"), "g", "v").collect(), key=lambda r: r["mean"])
    assert np.allclose([r["weight"] for r in m], [0.4, 0.6], atol=0.03) and np.allclose([r["mean"] for r in m], [0, 10], atol=0.4) and np.allclose([r["sd"] for r in m], [1, 2], atol=0.3)


def test_affinity_equals_dense_messages(spark):
    import numpy as np

    from rangeloom.operators import learn

    at = np.array([0.0, 0.4, 0.9, 7.0, 7.3, 15.0])
    s = -np.abs(at[:, None] - at[None])
    n, preference, rounds, damping = len(at), -2.0, 15, 0.5
    rows = [(i, k, float(s[i, k])) for i in range(n) for k in range(n) if i != k]
    got = {r["node"]: r["exemplar"] for r in learn.affinity(spark.createDataFrame(rows, "i int, k int, s double"), preference, rounds, damping).collect()}
    np.fill_diagonal(s, preference)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        new = np.array([[s[i, k] - max(a[i, j] + s[i, j] for j in range(n) if j != k) for k in range(n)] for i in range(n)])
        r = damping * r + (1 - damping) * new
        new = np.array([[(sum(max(r[j, k], 0) for j in range(n) if j != k) if i == k else min(0, r[k, k] + sum(max(r[j, k], 0) for j in range(n) if j not in (i, k)))) for k in range(n)] for i in range(n)])
        a = damping * a + (1 - damping) * new
    assert got == {i: int((r + a)[i].argmax()) for i in range(n)}


def test_graph_queries_equal_breadth_first(spark):
    import heapq

    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    links = {}
    for a, b, w in duckdb.sql(f"select l_suppkey, -l_partkey, min(l_quantity) from '{d}/lineitem.parquet' group by 1, 2").fetchall():
        links.setdefault(a, []).append((b, w))
        links.setdefault(b, []).append((a, w))
    for name, weigh in (("shortest_path_lengths", lambda w: w), ("sql_reachability", lambda w: 1)):
        best, queue = {}, [(0, 1)]
        while queue:
            x, n = heapq.heappop(queue)
            if n not in best:
                best[n] = x
                for m, w in links.get(n, []):
                    heapq.heappush(queue, (x + weigh(w), m))
        assert {r[0]: r[1] for r in entry.queries()[name](spark, d).collect()} == best


def test_names_and_formats_are_checked(spark):
    import pytest

    from rangeloom.functions import named
    from rangeloom.sources import reads

    df = spark.createDataFrame([(1, 0, 9)], "chrom int, start int, end int")
    assert named.apply("tumbling", df, width="4").count() == 3
    for bad in (lambda: named.apply("nothing", df), lambda: named.apply("tumbling", df, breadth="4"), lambda: reads.read_reads(spark, "/x", "odd")):
        with pytest.raises(ValueError):
            bad()


def test_partial_auc(spark):
    from rangeloom.functions import stats

    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.6, False), (0.5, False)], "s double, l boolean")
    assert abs(stats.auc(df, "s", "l").first()[0] - 5 / 6) < 1e-12
    assert abs(stats.partial_auc(df, "s", "l", 1.0).first()[0] - 5 / 6) < 1e-12
    assert abs(stats.partial_auc(df, "s", "l", 1 / 3).first()[0] - 1 / 6) < 1e-12


def test_hidden_states_equal_all_paths(spark):
    import itertools

    import numpy as np

    from rangeloom.operators import learn

    start, step, emit = [0.3, 0.7], [[0.8, 0.2], [0.4, 0.6]], [[0.5, 0.4, 0.1], [0.1, 0.2, 0.7]]
    symbols = {1: [0, 2, 1, 1, 2], 2: [2], 3: [1, 0, 0]}
    rows = [(u, i, x) for u, xs in symbols.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "u int, i int, x int")
    seen = {(r["u"], r["i"]): r["posterior"] for r in learn.state_posteriors(df, "u", ["i"], "x", start, step, emit).collect()}
    total = {r["u"]: r["log_likelihood"] for r in learn.sequence_likelihood(df, "u", ["i"], "x", start, step, emit).collect()}
    for u, xs in symbols.items():
        mass, at = 0.0, np.zeros((len(xs), 2))
        for path in itertools.product((0, 1), repeat=len(xs)):
            p = start[path[0]] * emit[path[0]][xs[0]]
            for i in range(1, len(xs)):
                p *= step[path[i - 1]][path[i]] * emit[path[i]][xs[i]]
            mass += p
            at[range(len(xs)), path] += p
        assert abs(total[u] - np.log(mass)) < 1e-9
        assert all(np.allclose(seen[u, i], at[i] / mass) for i in range(len(xs)))
    s, a, e, likelihoods = learn.baum_welch(df, "u", ["i"], "x", start, step, emit, rounds=4)
    assert abs(likelihoods[0] - sum(total.values())) < 1e-9 and likelihoods == sorted(likelihoods)
    assert np.allclose(np.sum(a, 1), 1) and np.allclose(np.sum(e, 1), 1) and abs(sum(s) - 1) < 1e-12


def test_cycles_have_no_level(spark):
    from rangeloom.operators import learn

    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6), (2, 2 + 5)], "a long, b long")
    assert {r[0]: r[1] for r in learn.topological_levels(links).collect()} == {1: 0, 2: 1, 3: 2, 7: 2, 4: None, 5: None, 6: None}
    assert {r[0]: r[1] for r in learn.connected(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4, 6: 4}
    none = links.limit(0)
    assert not learn.topological_levels(none).count() and not learn.connected(none).count()


def test_linear_classifier_on_its_border(spark, tmp_path):
    """Values on the border, where the rounding of a tenth decides, against the SQL."""
    import duckdb

    import __spark_entry__ as entry

    duckdb.sql(f"COPY (SELECT u AS event_id, u AS user_id, (3 + u / 10) * 2 AS value FROM range(-500, 4000) t(u) UNION ALL SELECT -1000, NULL, 1.0) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = {tuple(r) for r in entry.queries()["linear_classifier"](spark, str(tmp_path)).select("event_id", "label").collect()}
    assert got == set(con.sql(entry.oracle_sql()["linear_classifier"]).fetchall())


def test_overlap_totals_and_largest_overlap_equal_nested_loop(spark):
    r = random.Random(8)
    some = lambda n, m: [(i, r.randrange(2), s := r.randrange(0, 9000, m), s + r.choice([0, 40, 300, 6000]), r.choice("+-")) for i in range(n)]
    a, b = some(150, 1), some(150, 100)
    cols = "id long, chrom int, start int, end int, strand string"
    left, right = spark.createDataFrame(a, cols), spark.createDataFrame(b, cols)
    width = lambda x, y: min(x[3], y[3]) - max(x[2], y[2]) + 1
    met = {x[0]: [(width(x, y), -y[0], y[4]) for y in b if x[1] == y[1] and width(x, y) > 0] for x in a}
    t = left.join(intervals.overlap_totals(left, right, {"all": F.lit(True), "plus": F.col("strand") == "+"}), ["chrom", "start", "end"])
    got = {x["id"]: (x["n_all"], x["width_all"], x["n_plus"], x["width_plus"]) for x in t.collect()}
    plus = {k: [m for m in v if m[2] == "+"] for k, v in met.items()}
    assert got == {k: (len(v), sum(m[0] for m in v), len(plus[k]), sum(m[0] for m in plus[k])) for k, v in met.items()}
    best = {x["id"]: x["r_id"] for x in intervals.largest_overlap(left, right).collect()}
    assert best == {k: -max(v)[1] for k, v in met.items() if v}


def test_interval_join_deals_few_bytes_to_all_partitions(spark, monkeypatch):
    """Small tables: no broadcast, no partition left out, and equal intervals meet once, in blocks of a bounded size."""
    monkeypatch.setattr(intervals, "BLOCK", 7)
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("chrom"), (F.col("id") % 10 * 5000).alias("start")).withColumn("end", F.col("start") + 100)
    j = intervals.interval_join(rows, rows)
    assert j.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    assert (j.count(), j.where("id % 30 <> r_id % 30").count(), j.distinct().count()) == (300_000, 0, 300_000)
    for how in ("within", "contains"):
        assert intervals.interval_join(rows.withColumn("w", F.lit(1)), rows.select("chrom", "start", "end"), how).count() == 300_000


def test_agglomeration_of_many_rows_keeps_no_matrix(spark):
    """Against the plain search of the closest pair, ties included; then a group whose distance matrix would be repeated 3,000 times."""
    import numpy as np

    v = np.round(np.random.default_rng(2).uniform(0, 6, (70, 2)))
    centre, members = [x for x in v], [[i] for i in range(len(v))]
    while len(centre) > 1:
        d = ((np.array(centre)[:, None] - np.array(centre)[None]) ** 2).sum(2)
        d[np.tril_indices(len(d))] = np.inf
        i, j = divmod(int(d.argmin()), len(d))
        if d[i, j] > 4:
            break
        a, b = len(members[i]), len(members[j])
        centre[i] = (centre[i] * a + centre[j] * b) / (a + b)
        members[i] += members[j]
        del centre[j], members[j]
    got = learn.agglomerate(spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "g int, k int, v array<double>"), ["g"], "k", "v", 2.0)
    assert {r["k"]: r["cluster"] for r in got.collect()} == {k: min(c) for c in members for k in c}
    many = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.array((F.col("id") % 1500 * 10).cast("double")).alias("v"))
    assert learn.agglomerate(many, ["g"], "k", "v", 2.0).where("cluster <> k % 1500").count() == 0


def test_affinity_on_line_equals_affinity_over_pairs(spark, monkeypatch):
    """Equal values, a lone row, a row without a value; and the same over the table of pairs, for groups beyond the bound."""
    r = random.Random(4)
    rows = [(i, g, v) for i, (g, v) in enumerate([(g, r.choice([0.0, 0.713, 1.137, 4.019, 4.533, 9.077, 13.211, 13.571])) for g in (1, 1, 2) for _ in range(12)] + [(3, 5.0), (1, None), (4, None), (4, 1.0), (4, 1.0)])]
    df = spark.createDataFrame(rows, "id long, g int, v double")
    pairs = [(a[0], b[0], None if a[2] is None or b[2] is None else -abs(a[2] - b[2]) / 2) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1]]
    at = {a[0]: a[2] for a in rows}
    places = lambda got: {x["node"]: (at[x["exemplar"]], x["exemplar"] == x["node"]) for x in got.collect()}  # noqa: E731 (rounding decides between equal rows)
    want = places(learn.affinity(spark.createDataFrame(pairs, "i long, k long, s double"), -1.3))
    assert places(learn.affinity_on_line(df, "g", "id", "v", 2, -1.3)) == want
    many = spark.range(20_000).select("id", F.lit(1).alias("g"), (F.col("id") % 2 * 50).cast("double").alias("v"))  # 4 * 10^8 pairs
    assert learn.affinity_on_line(many, "g", "id", "v", 1, -3.0).where("node % 2 <> exemplar % 2").count() == 0
    monkeypatch.setattr(learn, "MOST_PLACES", 3)
    assert places(learn.affinity_on_line(df, "g", "id", "v", 2, -1.3)) == want
