"""Order operators: listings, details, nesting, receipts (J2, J3, J6, P5, P6,
P9-P11, T3, R3).

Scale notes
-----------
* Customers are attached with ``left_join_dim``: orders of deleted users
  (NULL user_id) skip the shuffle instead of landing on one reducer.
* Order details join the variant and item dimensions to each other first
  (small), then the lines to that (one shuffle of the lines), then the
  orders to the lines on order_id.  In snapshots bucketed by order_id (``snapshots.Layout``) orders
  and lines meet first (``colocated``): that takes no shuffle there.
* Ordered listings are global sorts (range-partitioned, distributed);
  top-k lists are ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.operators.joins import left_join_dim
from storelake.sources.model import ORDER_MONTH, Tables

ORDER_COLS = ["order_id", "user_id", "order_date", "order_status", "totalPrice", "staff_id"]


def with_customer(t: Tables, orders: DataFrame) -> DataFrame:
    """Orders plus customer_name ('Deleted User' when unknown) and customer_email."""
    cust = t.users.select("user_id", F.col("name").alias("_n"), F.col("email").alias("_e"))
    return (left_join_dim(orders, cust, "user_id")
            .withColumn("customer_name", F.coalesce("_n", F.lit("Deleted User")))
            .withColumn("customer_email", F.coalesce("_e", F.lit("")))
            .drop("_n", "_e"))


def all_orders(t: Tables) -> DataFrame:
    """Every order with its customer, newest first (order_id breaks ties)."""
    return (with_customer(t, t.orders.select(*ORDER_COLS))
            .orderBy(F.desc("order_date"), F.desc("order_id")))


def orders_by_status(t: Tables, status: str) -> DataFrame:
    """P5: orders in one status with their customer, newest first."""
    return (with_customer(t, t.orders.where(F.col("order_status") == status).select(*ORDER_COLS))
            .orderBy(F.desc("order_date"), F.desc("order_id")))


def orders_by_date_range(t: Tables, start: str, end: str) -> DataFrame:
    """Orders whose calendar day is within [start, end] (inclusive)."""
    day = F.to_date("order_date")
    rng = t.orders.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if ORDER_MONTH in t.orders.columns:
        # snapshot partitioned by month: prune the folders outside the range
        rng = rng.where(F.col(ORDER_MONTH).between(start[:7], end[:7]))
    return (with_customer(t, rng.select(*ORDER_COLS))
            .orderBy(F.desc("order_date"), F.desc("order_id")))


def _line_dim(t: Tables) -> DataFrame:
    return (t.items_quant.select("itemQuant_id", F.col("itemQuant_id").alias("variant_id"),
                                 "item_id", "color", "stock",
                                 F.col("description").alias("item_description"))
            .join(t.items.select("item_id", "itemName", "basePrice"), "item_id", "left"))


def order_details(t: Tables, order_ids: DataFrame | None = None, colocated: bool = False) -> DataFrame:
    """One row per order line with order header, customer, variant and item.

    Orders without lines keep one row with NULL line columns; lines whose
    variant is unknown keep NULL variant/item columns.  ``order_ids``
    restricts the orders (all when None).  ``colocated``: orders and lines are bucketed by order_id.
    """
    orders = t.orders.select(*ORDER_COLS)
    lines = t.order_items.select("order_id", "orderItem_id", "quantity", "price", "itemQuant_id")
    if order_ids is not None:
        keys = order_ids.select("order_id")
        orders = orders.join(keys, "order_id", "left_semi")
        lines = lines.join(keys, "order_id", "left_semi")
    def with_variant(rows):
        return (left_join_dim(rows, _line_dim(t), "itemQuant_id")
                .drop("itemQuant_id").withColumnRenamed("variant_id", "itemQuant_id"))

    if colocated:
        joined = with_customer(t, with_variant(orders.join(lines, "order_id", "left")))
    else:
        joined = with_customer(t, orders).join(with_variant(lines), "order_id", "left")
    return (joined
            .select("order_id", "user_id", "order_date", "order_status", "totalPrice", "staff_id",
                    "customer_name", "customer_email", "orderItem_id", "quantity", "price",
                    "itemQuant_id", "color", "stock", "item_description", "item_id", "itemName",
                    "basePrice")
            .orderBy("order_id", "orderItem_id"))


def receipts(t: Tables, requests: DataFrame) -> DataFrame:
    """Order details only for (order_id, user_id) pairs where the
    requester owns the order (row-level security as a join)."""
    owned = (requests.select("order_id", F.col("user_id").alias("_req"))
             .join(t.orders.select("order_id", "user_id"), "order_id")
             .where(F.col("_req") == F.col("user_id"))
             .select("order_id"))
    return order_details(t, owned)


def user_order_history(t: Tables, user_ids: DataFrame) -> DataFrame:
    """Orders of the requested users, newest first per user (order_id
    breaks ties)."""
    keys = user_ids.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    hist = (t.orders.join(keys, "user_id", "left_semi")
            .select("user_id", "order_id", "order_date", "order_status", "totalPrice"))
    return hist.orderBy(F.asc("user_id"), F.desc("order_date"), F.desc("order_id"))


def orders_with_items(t: Tables, user_ids: DataFrame | None = None) -> DataFrame:
    """Orders with their lines nested as ARRAY<STRUCT>, empty when none.

    Lines are grouped per order_id *before* the join, so the array is built
    from the line table alone; its size is the order's line count.
    """
    orders = t.orders.select("order_id", "user_id", "order_date", "order_status", "totalPrice",
                             "staff_id")
    lines = t.order_items
    if user_ids is not None:
        orders = orders.join(user_ids.select("user_id"), "user_id", "left_semi")
        lines = lines.join(orders.select("order_id"), "order_id", "left_semi")
    nested = lines.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct(
        "orderItem_id", "itemQuant_id", "quantity", "price"))).alias("items"))
    empty = F.array().cast("array<struct<orderItem_id:bigint,itemQuant_id:bigint,"
                           "quantity:int,price:double>>")
    return (orders.join(nested, "order_id", "left")
            .withColumn("items", F.coalesce("items", empty))
            .orderBy(F.asc("user_id"), F.desc("order_date"), F.desc("order_id")))


def recent_orders(t: Tables, n: int = 5) -> DataFrame:
    """The ``n`` newest orders by id with customer name ('N/A' when unknown)."""
    top = t.orders.select("order_id", "user_id", "totalPrice", "order_status").orderBy(
        F.desc("order_id")).limit(n)
    cust = t.users.select("user_id", "name")
    return (top.join(cust, "user_id", "left")
            .select("order_id", F.coalesce("name", F.lit("N/A")).alias("customer_name"),
                    "totalPrice", "order_status")
            .orderBy(F.desc("order_id")))


def line_numbers(t: Tables) -> DataFrame:
    """Running line number per order as printed on the invoice.

    One window over the order, which is what a person ordered: one shuffle.
    """
    by_order = Window.partitionBy("order_id").orderBy("orderItem_id")
    return t.order_items.select("order_id", "orderItem_id", F.row_number().over(by_order).alias("line_no"))
