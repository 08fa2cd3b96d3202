"""Lookups of a set of keys in a stored table.

A few keys (up to ``PUSHED_KEYS``, counted first with one bounded read) become a literal
filter that reaches the Parquet scan: row groups whose value range or bloom filter holds none
of them are skipped (``snapshots.Layout``).  More keys are a semi join, for which Spark
builds its own runtime filter when that pays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUSHED_KEYS = 256


def with_keys(table: DataFrame, keys: DataFrame, column: str, pushed: int = PUSHED_KEYS) -> DataFrame:
    """Rows of ``table`` whose ``column`` is one of ``keys`` (a column of the same name)."""
    wanted = keys.select(column).where(F.col(column).isNotNull())
    few = wanted.limit(pushed + 1).collect()          # at most pushed + 1 values
    if len(few) > pushed:
        return table.join(wanted, column, "left_semi")
    values = sorted({r[0] for r in few})
    if not values:
        return table.where("false")
    # one equality each: Parquet tests every one against a row group's bloom filter
    return table.where(F.col(column).isin(values) if len(values) > 1 else F.col(column) == values[0])
