"""Operators that add helper columns see other names for the columns they do not know."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def shielded(df: DataFrame, needed: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` of ``df``, whose columns but ``needed`` have neutral names meanwhile; ``df``'s columns come back in place and name.

    ``step`` must keep the columns it is given. Names outside ``needed`` may
    repeat or equal any helper's.
    """
    twice = [c for c in needed if df.columns.count(c) != 1]
    if twice:
        raise ValueError(f"need exactly one column each of {twice}")
    inner = df.toDF(*[c if c in needed else f"_in{i}" for i, c in enumerate(df.columns)])
    return step(inner).select(*inner.columns).toDF(*df.columns)
