"""User functions of the three kinds (scalar, aggregate, table) and the registry that finds operators by name.

Parameters given as text are converted by the operator's own signature, whose defaults fill in the others.
"""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv

OPERATORS: dict[str, Callable[..., DataFrame]] = {"tumbling": iv.tumbling, "sliding": iv.sliding, "merge": iv.merge, "covered": iv.covered, "zones": iv.zones, "depth": iv.depth}


def typed(f: Callable, given: dict[str, str]) -> dict:
    """Parameters from text by the types of the signature; an unknown name is an error."""
    kinds = typing.get_type_hints(f)
    known = inspect.signature(f).parameters
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown parameters {sorted(unknown)}; known: {list(known)}")
    convert = {bool: lambda s: s.lower() in ("1", "true", "yes"), int: int, float: float, str: str}
    return {n: convert.get(kinds.get(n), str)(v) for n, v in given.items()}


def apply(name: str, df: DataFrame, **given: str) -> DataFrame:
    """Runs an operator by name with parameters as text."""
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}; known: {sorted(OPERATORS)}")
    return OPERATORS[name](df, **typed(OPERATORS[name], given))


def geometric_mean(v: pd.Series) -> float:
    """An aggregate in Arrow batches: exp of the mean logarithm of the positive values."""
    v = v[v > 0]
    return float(np.exp(np.log(v).mean())) if len(v) else float("nan")


class Pieces:
    """A table function: a closed interval cut into pieces of at most a width."""

    def eval(self, start: int, end: int, width: int):
        for i, a in enumerate(range(start, end + 1, width)):
            yield i, a, min(a + width - 1, end)


def register(spark: SparkSession) -> None:
    """Makes the functions available to SQL by name."""
    spark.udf.register("geometric_mean", F.pandas_udf(geometric_mean, "double"))
    spark.udtf.register("interval_pieces", F.udtf(Pieces, returnType="piece int, start bigint, end bigint"))
