"""Row-frame operators: joins, statistics, selection, set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import in_order
from .intervals import carry


def join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner equi-join in which null keys match null; both rows are nested."""
    a = left.select(F.struct(*left.columns).alias("left"))
    b = right.select(F.struct(*right.columns).alias("right"))
    return a.join(b, F.col(f"left.{key}").eqNullSafe(F.col(f"right.{key}")))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null where a column is constant or there is no pair."""
    ok = x.isNotNull() & y.isNotNull()
    s = lambda c: F.sum(F.when(ok, c))
    n = F.count(F.when(ok, F.lit(1)))
    top = n * s(x * y) - s(x) * s(y)
    bottom = F.sqrt(F.greatest(n * s(x * x) - s(x) * s(x), F.lit(0.0))) * F.sqrt(F.greatest(n * s(y * y) - s(y) * s(y), F.lit(0.0)))
    return F.try_divide(top, bottom)


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n largest, in ascending order (all rows if there are fewer)."""
    return df.orderBy(F.desc(by), *ties).limit(n).orderBy(by, *ties)


def arg_max(df: DataFrame, by: list[str], score: str, *ties: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_seen(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First row of each key, with a partial aggregate instead of a window's full shuffle."""
    rest = [c for c in df.columns if c not in by]
    got = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest))


def zip_rows(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Positional full outer zip of two ordered frames; positions come from a distributed count, not from one task."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn("_part", F.floor(F.col(order) / 4096))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        local = F.row_number().over(Window.partitionBy("_part").orderBy(order, *[c for c in df.columns if c != order]))
        return rows.withColumn("_rn", local).join(counts, "_part").select((F.col("_rn") + F.col("_before")).alias("position"), F.struct(*df.columns).alias(name))

    return numbered(left, "left").join(numbered(right, "right"), "position", "full")


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int, clamp: bool = True) -> DataFrame:
    """Counts by fixed-width bin. Outliers go to the end bins, or to bins -1 and ``bins``."""
    b = F.floor((F.col(value) - low) / width)
    edge = (0, bins - 1) if clamp else (-1, bins)
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.greatest(b, F.lit(edge[0])), F.lit(edge[1])).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_normalise(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Each value replaced by the mean, over samples, of the values of its rank (ties share a rank).

    Ranks come from the counts of distinct values, dealt out by ranges, so no sample is one task. A rank's values, at most one
    a sample, are added in ascending order, so the means don't depend on the partitioning.
    """
    counts = df.groupBy(sample, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = carry(in_order(counts, [sample, value]), [sample], "_part", [value], {"_rank": (F.sum, F.col("_n"), False)})
    total = F.aggregate(F.sort_array(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), "_n"))), F.lit(0.0), lambda t, x: t + x["v"] * x["_n"])
    means = ranks.groupBy("_rank").agg((total / F.sum("_n")).alias("normalised"))
    known = ranks.select(F.col(sample).alias("_s"), F.col(value).alias("_v"), "_rank").join(means, "_rank").drop("_rank")
    return df.join(known, F.col(sample).eqNullSafe(F.col("_s")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_s", "_v")
