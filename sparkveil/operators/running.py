"""Running totals that survive a key, or one instant of a key, holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordered import running_sums


def running_totals(df: DataFrame, keys: list[str], ts: str, order: list[str], sums: dict) -> DataFrame:
    """Add running sums of ``sums`` (name to column) per key in (ts, order).

    Rows without a time come first; rows without a key are a key of their own.
    """
    return running_sums(df, list(keys), [ts, *order], sums)
