"""Join helpers shared by the operators.

``left_join_dim`` is the shop's "LEFT JOIN a dimension" with one change for
scale: rows whose join key is NULL (orders of deleted users, complaints of
deleted users, dangling lines) can never match, yet a sort-merge join hashes
all of them to the same reducer.  They get a second join key,
a hash of the row, that is 0 for all other rows and for the dimension, so a NULL
key holding a third of the rows is split over many tasks.  Hot non-NULL keys are left to AQE's skew-join
splitting (the big side is the streamed left side, which AQE may split).
When the planner's size check finds the dimension small enough it
broadcasts it and no shuffle happens at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_SALTS = 1024


def left_join_dim(left: DataFrame, dim: DataFrame, key: str, salts: int = NULL_SALTS) -> DataFrame:
    """``left LEFT JOIN dim USING (key)`` with NULL keys spread over ``salts`` values."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts))
    keyed = left.withColumn("_salt", F.when(F.col(key).isNull(), salt).otherwise(0).cast("int"))
    # 0 for every row, in a form that the optimizer keeps as a join key
    plain = dim.withColumn("_salt", F.pmod(F.col(key), F.lit(1)).cast("int"))
    return keyed.join(plain, [key, "_salt"], "left").select(*left.columns, *[c for c in dim.columns if c != key])


def left_anti_dim(left: DataFrame, keys: DataFrame, key: str, salts: int = NULL_SALTS) -> DataFrame:
    """Rows of ``left`` whose ``key`` is none of ``keys`` (distinct); NULL keys stay and are spread as above."""
    gone = keys.select(key).withColumn("_gone", F.lit(True))
    return left_join_dim(left, gone, key, salts).where(F.col("_gone").isNull()).drop("_gone")
