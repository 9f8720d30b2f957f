"""All registered queries of the core library, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    from . import frames_q, interval_q, learn_q, motif_q, peaks_q, pipeline_q, reads_q, source_q, sql_q, stats_q, store_q, stream_q, string_q  # noqa: F401


load()
