"""Distribution functions and tests. Tails are Arrow-batched; distinct arguments are evaluated once and joined back."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import carry
from ..tables import materialize


def _log_choose(n: float, k: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return math.lgamma(n + 1) - lg(k + 1) - lg(n - k + 1)


def poisson_tail_value(k: float, mean: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    k = math.ceil(k)
    top = max(k, mean) + 40 * math.sqrt(max(k, mean)) + 60
    if k > mean:
        x = np.arange(k, top)
        logs = x * math.log(mean) - mean - np.vectorize(math.lgamma, otypes=[float])(x + 1)
        return float(np.exp(logs).sum())
    x = np.arange(0, k)
    return float(max(0.0, 1 - np.exp(x * math.log(mean) - mean - np.vectorize(math.lgamma, otypes=[float])(x + 1)).sum()))


def binomial_cdf_value(k: float, n: float, p: float) -> float:
    """P(X <= ceil(k)) of ceil(n) trials; NaN without trials."""
    if n == 0:
        return float("nan")
    k, n = math.ceil(k), math.ceil(n)
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    x = np.arange(0, k + 1)
    return float(min(1.0, np.exp(_log_choose(n, x) + x * math.log(p) + (n - x) * math.log1p(-p)).sum()))


def hypergeometric_tail_value(x: float, total: float, marked: float, drawn: float) -> float:
    """log10 P(at least x marked among the drawn)."""
    top = int(min(marked, drawn))
    k = np.arange(int(max(x, drawn + marked - total, 0)), top + 1)
    if not len(k):
        return float("-inf")
    logs = _log_choose(marked, k) + _log_choose(total - marked, drawn - k) - _log_choose(total, np.array(float(drawn)))
    m = logs.max()
    return float((m + math.log(np.exp(logs - m).sum())) / math.log(10))


def _over_distinct(df: DataFrame, args: list[str], out: str, f) -> DataFrame:
    """Evaluates f on the distinct argument rows only."""

    @F.pandas_udf("double")
    def tail(s: pd.DataFrame) -> pd.Series:
        return pd.Series([float(f(*map(float, r))) for r in s.itertuples(index=False)], dtype=float)

    some = df.select(*args).distinct().where(" AND ".join(f"`{a}` IS NOT NULL" for a in args)).withColumn(out, tail(F.struct(*args)))
    return df.join(some, args, "left")


def poisson_tail(df: DataFrame, k: str, mean: str, out: str) -> DataFrame:
    return _over_distinct(df, [k, mean], out, poisson_tail_value)


def binomial_cdf(df: DataFrame, k: str, n: str, p: str, out: str) -> DataFrame:
    return _over_distinct(df, [k, n, p], out, binomial_cdf_value)


def hypergeometric_tail(df: DataFrame, x: str, total: str, marked: str, drawn: str, out: str) -> DataFrame:
    return _over_distinct(df, [x, total, marked, drawn], out, hypergeometric_tail_value)


def z_two_proportions(a: Column, na: Column, b: Column, nb: Column) -> Column:
    p = (a + b) / (na + nb)
    return F.try_divide(a / na - b / nb, F.sqrt(p * (1 - p) * (1 / na + 1 / nb)))


def in_order(df: DataFrame, order: list) -> DataFrame:
    """The rows dealt out by ranges of the order, with the number of their range as ``_part`` (written once, so it is fixed)."""
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Position in a total order: within ranges, and carried over the ranges' counts."""
    return carry(in_order(df, order), [], "_part", order, {name: (F.sum, F.lit(1).cast("long"), True)}).drop("_part")


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, median: the middle value, or the mean of the middle two, from counts of distinct values in order."""
    by = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    by = carry(in_order(by, [value]), [], "_part", [value], {"_c": (F.sum, F.col("_n"), True)})
    n = by.agg(F.max("_c").alias("_all"))
    at = lambda rank: F.min(F.when(F.col("_c") >= rank, F.col(value)))
    two = by.join(F.broadcast(n)).agg(at(F.floor((F.col("_all") + 1) / 2)).alias("a"), at(F.floor(F.col("_all") / 2) + 1).alias("b"))
    return two.select((F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))


def bh(df: DataFrame, p: str, ties: list[str], clip: bool = False) -> DataFrame:
    """p * n / rank, without the monotone step; clipped at 1 if asked. Adds q and rank."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = ranked(df, [p, *ties]).join(F.broadcast(n))
    q = F.col(p) * F.col("_n") / F.col("rank")
    return out.withColumn("q", F.least(q, F.lit(1.0)) if clip else q).drop("_n")


def step_up(df: DataFrame, p: str, ties: list[str], rate: float) -> DataFrame:
    """Rows up to the last rank i with p(i) <= i * rate / n."""
    out = bh(df, p, ties)
    last = out.where(F.col("q") <= rate).agg(F.max("rank").alias("_last"))
    return out.join(F.broadcast(last)).where(F.col("rank") <= F.col("_last")).drop("_last", "q", "rank")


def _cumulated(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row a distinct score: rows of either label there (_p, _n), and at better or equal scores (_cp, _cn)."""
    one = F.col(label).cast("long")
    by = df.groupBy(score).agg(F.sum(one).alias("_p"), F.sum(1 - one).alias("_n"))
    return carry(in_order(by, [F.desc(score)]), [], "_part", [F.desc(score)], {"_cp": (F.sum, F.col("_p"), True), "_cn": (F.sum, F.col("_n"), True)}).drop("_part")


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row a distinct score, best first: score, tpr, fpr (cumulative, ties together)."""
    by = _cumulated(df, score, label)
    total = by.agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    return by.join(F.broadcast(total)).select(score, F.try_divide("_cp", "_tp").alias("tpr"), F.try_divide("_cn", "_tn").alias("fpr"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sums (ties count half)."""
    by = _cumulated(df, score, label)
    total = by.agg(F.sum("_n").alias("_tn"))
    worse = F.col("_tn") - F.col("_cn")
    return by.join(F.broadcast(total)).agg(F.try_divide(F.sum(F.col("_p") * (worse + F.col("_n") / 2)), F.sum("_p") * F.sum("_n")).alias("auc"))


def rank_sum(df: DataFrame, value: str, label: str) -> DataFrame:
    """The rank-sum statistic u of the rows with the label against the others (ties count half), and both numbers."""
    by = _cumulated(df, value, label)
    total = by.agg(F.sum("_n").alias("_tn"))
    u = F.sum(F.col("_p") * (F.col("_tn") - F.col("_cn") + F.col("_n") / 2))
    return by.join(F.broadcast(total)).agg(u.alias("u"), F.sum("_p").alias("n1"), F.sum("_n").alias("n2"))


def partial_auc(df: DataFrame, score: str, label: str, most: float) -> DataFrame:
    """Area under the curve up to a false positive rate of ``most``, by trapezoids, the last one cut at it."""
    by = roc(df, score, label)
    steps = carry(in_order(by, ["fpr", "tpr"]), [], "_part", ["fpr", "tpr"], {"_before": (F.max, F.struct("fpr", "tpr"), False)})
    x0, y0 = F.coalesce("_before.fpr", F.lit(0.0)), F.coalesce("_before.tpr", F.lit(0.0))
    x1 = F.least("fpr", F.lit(most))
    y1 = y0 + F.coalesce(F.try_divide((F.col("tpr") - y0) * (x1 - x0), F.col("fpr") - x0), F.col("tpr") - y0)
    return steps.where(x0 <= most).agg(F.sum((x1 - x0) * (y0 + y1) / 2).alias("auc"))


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Shannon entropy (natural logarithm) of a column's values in each group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    return counts.join(total, by).groupBy(*by).agg((-F.sum(p * F.log(p))).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    xy = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("_xy"))
    xs, ys = xy.groupBy(x).agg(F.sum("_xy").alias("_x")), xy.groupBy(y).agg(F.sum("_xy").alias("_y"))
    n = xy.agg(F.sum("_xy").alias("_n"))
    j = xy.join(xs, x).join(ys, y).join(F.broadcast(n))
    return j.agg(F.sum(F.col("_xy") / F.col("_n") * F.log(F.col("_xy") * F.col("_n") / (F.col("_x") * F.col("_y")))).alias("information"))
