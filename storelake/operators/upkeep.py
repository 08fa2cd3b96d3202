"""Keeping order reports up to date from changes.

Order counts and sums are stored as partial sums: one row per day and one per user.  A
change of orders (old row, new row) takes the old row's share away and adds the new one's, so
a batch costs what it changes, not the orders there are.  The report itself is a plain
select over the stored sums.  Money is kept in whole cents, so no rounding error builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.functions.dates import period_label
from storelake.functions.money import cents_long, from_cents
from storelake.operators.reports import not_cancelled
from storelake.sources.model import Tables

DAILY_SCHEMA = T.StructType().add("day", T.DateType()).add("orders", T.LongType()).add("cents", T.LongType())
PER_USER_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("user_id", "orders", "processing", "cents")])
FACTS = ["order_id", "user_id", "order_date", "order_status", "totalPrice"]


def _shares(orders: DataFrame, sign: int) -> DataFrame:
    return orders.select(*FACTS).withColumn("sign", F.lit(sign))


def order_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows (FACTS, sign) that turn the old orders into the new ones.

    ``old`` and ``new`` may be whole tables or just the changed orders before and after; rows that are the same
    on both sides cancel out here, in an aggregate that needs no join.
    """
    both = _shares(old, -1).unionByName(_shares(new, 1))
    return both.groupBy(*FACTS).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def inserted(new_orders: DataFrame) -> DataFrame:
    """The changes of a batch that only inserts orders."""
    return _shares(new_orders, 1)


def _cents():
    live = F.when(not_cancelled(), cents_long(F.col("totalPrice")))
    return F.coalesce(F.sum(live * F.col("sign")), F.lit(0)).cast("bigint")


def daily_sums(changes: DataFrame) -> DataFrame:
    """(day, orders, cents) of live orders in signed rows."""
    return (changes.where(not_cancelled()).groupBy(F.to_date("order_date").alias("day"))
            .agg(F.sum("sign").cast("bigint").alias("orders"), _cents().alias("cents")))


def user_sums(changes: DataFrame) -> DataFrame:
    """(user_id, orders, processing, cents) in signed rows; orders of deleted users are left out."""
    processing = F.sum(F.when(F.col("order_status") == "Processing", F.col("sign")).otherwise(0))
    return (changes.where(F.col("user_id").isNotNull()).groupBy("user_id")
            .agg(F.sum("sign").cast("bigint").alias("orders"), processing.cast("bigint").alias("processing"), _cents().alias("cents")))


def merged(stored: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """The rows of ``stored`` sums that a change touches, after it: an upsert for the store."""
    names = [c for c in stored.columns if c != key]
    old = stored.join(change.select(key), key, "left_semi")       # a day or user is one row on either side
    return old.unionByName(change.select(*stored.columns)).groupBy(key).agg(*[F.sum(c).cast("bigint").alias(c) for c in names])


def revenue_report(daily: DataFrame, period: str = "daily", limit: int = 30) -> DataFrame:
    """A8-A10 from stored daily sums: the newest ``limit`` periods with orders."""
    label = period_label(F.col("day").cast("timestamp_ntz"), period)
    return (daily.where("orders > 0").groupBy(label.alias("period_label"))
            .agg(F.sum("orders").cast("bigint").alias("order_count"), from_cents(F.sum("cents")).alias("total_revenue"))
            .orderBy(F.desc("period_label")).limit(limit))


def user_report(t: Tables, per_user: DataFrame) -> DataFrame:
    """A12 from stored sums per user: every user, without orders 0 orders, NULL pending and 0 revenue."""
    sums = per_user.where("orders > 0")
    return (t.users.select("user_id").join(sums, "user_id", "left")
            .select("user_id", F.coalesce("orders", F.lit(0)).cast("bigint").alias("total_orders"),
                    F.col("processing").cast("bigint").alias("pending_orders"),
                    F.coalesce(from_cents(F.col("cents")), F.lit(0.0)).alias("total_revenue")))
