"""Queries on tables whose rows all lie at one place: ten thousand million pairs, which no answer here needs."""

import duckdb
import pytest

import __spark_entry__ as entry

N = 100_000
EXPECTED = {
    "annotation_bits": (N, {("10",)}),
    "zone_assignment": (N, {(N,)}),
    "largest_overlap": (N, {(0,)}),
    "offset_by_length": (1, {(10, 11, N * N)}),
    "annotation_share": (N, {("A", float(N))}),
    "interval_overlap_length": (N, {(51 * N,)}),
    "offset_profile": (1, {("+", 0, N * N)}),
}


@pytest.fixture(scope="module")
def stacked(tmp_path_factory):
    d = tmp_path_factory.mktemp("stacked")
    day = "TIMESTAMP '1995-01-01'"
    for name, sql in {
        "orders": f"SELECT i * 500 AS o_orderkey, i * 8 AS o_custkey, {day} AS o_orderdate, 1.0 AS o_totalprice",
        "part": "SELECT i * 250000 AS p_partkey, 'x' AS p_name, 'A' AS p_type, 1::INT AS p_size",
        "lineitem": f"SELECT i AS l_orderkey, 1::INT AS l_linenumber, i * 8 AS l_suppkey, i AS l_partkey, {day} AS l_shipdate, 1.0 AS l_quantity, 'N' AS l_returnflag",
    }.items():
        duckdb.sql(f"COPY ({sql} FROM range({N}) t(i)) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_no_pairs_are_made(spark, stacked, name):
    df = entry.queries()[name](spark, stacked)
    values = df.select(*(c for c in df.columns if c != "id"))
    assert (df.count(), {tuple(r) for r in values.distinct().collect()}) == EXPECTED[name]


def test_density_peaks_of_one_place_and_in_boxes(spark):
    from pyspark.sql import functions as F

    from rangeloom.operators import learn, peaks

    p = spark.range(50_000).select("id", F.lit(7).alias("x"), F.lit(9).alias("y"), F.lit(1).alias("weight"))
    got = learn.density_peaks(p, 5).groupBy("density", "delta").count().collect()
    assert {tuple(r) for r in got} == {(50_000, 0, 49_999), (50_000, 15, 1)}
    points = [(i, i * 7919 % 97, i * 104729 % 89, 1 + i % 3) for i in range(200)]
    d = lambda a, b: max(abs(a[1] - b[1]), abs(a[2] - b[2]))
    density = {a[0]: sum(b[3] for b in points if d(a, b) <= 5) for a in points}
    delta = {a[0]: min([15, *(d(a, b) for b in points if (density[b[0]], -b[0]) > (density[a[0]], -a[0]))]) for a in points}
    df = spark.createDataFrame(points, "id long, x int, y int, weight int")
    assert {r["id"]: (r["density"], r["delta"]) for r in learn.density_peaks(df, 5).collect()} == {k: (v, delta[k]) for k, v in density.items()}
    boxes = [(x, x + w, y, y + 11) for x, y, w in ((-3, 0, 20), (5, 40, 0), (17, 3, 44), (60, 60, 63), (95, 88, 9))]
    got = peaks.count_in_boxes(df.withColumn("n", F.lit(1)).withColumn("chrom", F.lit(1)), spark.createDataFrame([(1, *b) for b in boxes], "chrom int, x0 int, x1 int, y0 int, y1 int"), 64)
    inside = {b: sum(b[0] <= p[1] <= b[1] and b[2] <= p[2] <= b[3] for p in points) for b in boxes}
    assert {tuple(r)[1:5]: r["n"] for r in got.collect()} == inside


def test_graphs_hidden_models_medians_and_shifts_do_not_repeat_their_input(spark, monkeypatch):
    from pyspark.sql import functions as F

    from rangeloom.functions import stats, strings
    from rangeloom.operators import learn

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "a long, b long, w double").mapInArrow(count, "a long, b long, w double")
    for front in (0, 500_000):
        monkeypatch.setattr(learn, "FRONT", front)
        assert {r[0]: r[1] for r in learn.shortest_paths(edges, 0).collect()} == {i: float(i) for i in range(7)}
    assert seen.value == 12  # 6 links a call, not a round
    chain = spark.range(5000).select("id", (F.col("id") + 1).alias("b")).where("b % 500 <> 0").select(F.col("id").alias("a"), "b")
    assert learn._forest(chain.coalesce(1)).where("a = b OR b % 500 <> 0").count() == 0  # every link leads to the least node at once
    assert learn.connected(chain).where("component <> node - node % 500").count() == 0
    assert [stats.median(spark.createDataFrame([(v,) for v in vs], "v double"), "v").first()[0] for vs in ([3.0, 1.0, None, 2.0], [4.0, 1.0, 1.0, 2.0], [None])] == [2.0, 1.5, None]
    words = spark.createDataFrame([("abcd", "xabc"), ("abcd", "abcd"), ("aé", "éa"), (None, "a"), ("abcdefgh", "hgfedcba")], "a string, b string")
    assert [r[0] for r in words.select(strings.shift_distance(F.col("a"), F.col("b"), 3)).collect()] == [1, 0, 1, None, 7]
