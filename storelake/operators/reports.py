"""Sales, revenue, inventory and dashboard reports.

Scale notes
-----------
* Order lines are the big table.  Every report that sums lines first keeps
  only live lines with a ``left_semi`` join on the orders (no order columns
  are carried), then **pre-aggregates per variant** before touching the
  catalog.  The map-side partial aggregate collapses a hot variant (even one
  holding a third of all lines) to one row per task, so the catalog joins
  see at most one row per variant instead of every line.
* Money is summed as exact cents (``decimal(18,2)``); the result does not
  depend on how rows are split across tasks.
* Top-k lists end with the primary key as last sort key, so ties are
  deterministic (``TakeOrderedAndProject``, no global sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.functions.dates import period_label
from storelake.functions.money import cents_long, from_cents, line_revenue_partial, money_sum
from storelake.sources.model import Tables



def not_cancelled() -> Column:
    """``order_status <> 'Cancelled'`` (NULL status is dropped, K5)."""
    return F.col("order_status") != "Cancelled"


def live_lines(t: Tables) -> DataFrame:
    """Order lines of orders whose status is known and not 'Cancelled'."""
    live = t.orders.where(not_cancelled()).select("order_id")
    return t.order_items.join(live, "order_id", "left_semi")


def sales_per_variant(t: Tables, price_is_line_total: bool = False) -> DataFrame:
    """(itemQuant_id, sold, revenue) over live lines, revenue kept as decimal.

    By default revenue is SUM(price * quantity) as the shop reports it (K1);
    ``price_is_line_total=True`` sums the stored line totals instead.
    """
    lines = live_lines(t)
    revenue = (F.sum(cents_long(F.col("price"))) if price_is_line_total
               else line_revenue_partial(F.col("price"), F.col("quantity")))
    return lines.groupBy("itemQuant_id").agg(F.sum("quantity").alias("sold"),
                                             revenue.alias("revenue"))


def sales_summary(t: Tables, limit: int = 10, price_is_line_total: bool = False) -> DataFrame:
    """Best sellers by units, with revenue; cancelled orders excluded."""
    per_variant = sales_per_variant(t, price_is_line_total)
    per_item = (per_variant
                .join(t.items_quant.select("itemQuant_id", "item_id"), "itemQuant_id")
                .join(t.items.select("item_id", "itemName"), "item_id")
                .groupBy("item_id", "itemName")
                .agg(F.sum("sold").cast("bigint").alias("total_sold"),
                     from_cents(F.sum("revenue")).alias("total_revenue")))
    return per_item.orderBy(F.desc("total_sold"), F.asc("item_id")).limit(limit)


def category_sales(t: Tables, price_is_line_total: bool = False) -> DataFrame:
    """Units and revenue per category.  An item in two categories counts
    in both (K2)."""
    # variant rows are already aggregated (one per variant), so they go
    # straight through the catalog joins without another per-item shuffle
    per_variant = (sales_per_variant(t, price_is_line_total)
                   .join(t.items_quant.select("itemQuant_id", "item_id"), "itemQuant_id")
                   .join(t.items.select("item_id"), "item_id", "left_semi"))
    per_cat = (per_variant
               .join(t.sub_category.select("item_id", "cat_id"), "item_id")
               .join(t.category, "cat_id")
               .groupBy("cat_id", "categoryName")
               .agg(F.sum("sold").cast("bigint").alias("total_sold"),
                    from_cents(F.sum("revenue")).alias("total_revenue")))
    return per_cat.orderBy(F.desc("total_revenue"), F.asc("cat_id")).select(
        "categoryName", "total_sold", "total_revenue")


def revenue_by_period(t: Tables, period: str = "daily", limit: int = 30) -> DataFrame:
    """Order count and revenue per day / Monday-week / month, newest
    ``limit`` non-empty periods (K3, K4)."""
    label = period_label(F.col("order_date"), period)
    agg = (t.orders.where(not_cancelled())
           .groupBy(label.alias("period_label"))
           .agg(F.count(F.lit(1)).alias("order_count"),
                F.coalesce(money_sum(F.col("totalPrice")), F.lit(0.0)).alias("total_revenue")))
    return agg.orderBy(F.desc("period_label")).limit(limit)


def variant_stock_per_item(t: Tables) -> DataFrame:
    """(item_id, stock_sum) pre-aggregated before any join to items."""
    return t.items_quant.groupBy("item_id").agg(F.sum("stock").alias("stock_sum"))


def item_stock_totals(t: Tables) -> DataFrame:
    """Every item with total stock over its variants, 0 without variants."""
    return (t.items.select("item_id", "itemName", "basePrice",
                           F.when(F.col("image").isNotNull(), 1).otherwise(0).alias("has_image"))
            .join(variant_stock_per_item(t), "item_id", "left")
            .withColumn("total_stock", F.coalesce(F.col("stock_sum"), F.lit(0)).cast("bigint"))
            .drop("stock_sum"))


def inventory_value(t: Tables) -> DataFrame:
    """A1: SUM(basePrice x stock) over all variants, 0 when there are none."""
    joined = t.items.select("item_id", "basePrice").join(
        t.items_quant.select("item_id", "stock"), "item_id")
    return joined.agg(F.coalesce(from_cents(F.sum(cents_long(F.col("basePrice")) * F.col("stock"))),
                                 F.lit(0.0)).alias("inventory_value"))


def pending_orders_count(t: Tables) -> DataFrame:
    """A2: orders with status 'Processing'."""
    return t.orders.where(F.col("order_status") == "Processing").agg(
        F.count(F.lit(1)).alias("pending_count"))


def low_stock_items(t: Tables, threshold: int = 10) -> DataFrame:
    """A4: items whose total stock is below ``threshold``, lowest first."""
    low = item_stock_totals(t).where(F.col("total_stock") < threshold)
    return low.select("item_id", "itemName", "basePrice", "total_stock", "has_image").orderBy(
        "total_stock", "item_id")


def low_stock_count(t: Tables, threshold: int = 10) -> DataFrame:
    """A3: number of items whose total stock is below ``threshold``."""
    totals = t.items.select("item_id").join(variant_stock_per_item(t), "item_id", "left")
    return totals.where(F.coalesce(F.col("stock_sum"), F.lit(0)) < threshold).agg(
        F.count(F.lit(1)).alias("low_stock_count"))


def latest_order_day(t: Tables) -> DataFrame:
    return t.orders.agg(F.max(F.to_date("order_date")).alias("d"))


def sales_on_day(t: Tables, as_of: str | Column | None = None) -> DataFrame:
    """A5: revenue of non-cancelled orders placed on day ``as_of``.

    ``as_of`` is a 'YYYY-MM-DD' string, a Column, or None for today (UTC, K21).
    """
    day = F.current_date() if as_of is None else (
        F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of)
    todays = t.orders.where((F.to_date("order_date") == day) & not_cancelled())
    return todays.agg(F.coalesce(money_sum(F.col("totalPrice")), F.lit(0.0)).alias("day_sales"))


def sales_on_latest_day(t: Tables) -> DataFrame:
    """A5 evaluated for the last day that has orders (a scalar subquery)."""
    return sales_on_day(t, latest_order_day(t).scalar())


def open_complaints_count(t: Tables, normalize_case: bool = False) -> DataFrame:
    """Complaints in status 'open' or 'pending' (K16: intake writes
    'Pending', which only matches with ``normalize_case``)."""
    status = F.lower(F.col("status")) if normalize_case else F.col("status")
    return t.complaint.where(status.isin("open", "pending")).agg(
        F.count(F.lit(1)).alias("open_complaints"))


def user_order_stats(t: Tables, user_ids: DataFrame | None = None) -> DataFrame:
    """Per user total orders, pending orders, non-cancelled revenue.

    Users without orders get 0 orders, NULL pending and 0 revenue (K6).
    Orders of deleted users (NULL user_id) are dropped before grouping, so
    that key never becomes a hot group.
    """
    per_user = (t.orders.where(F.col("user_id").isNotNull())
                .groupBy("user_id")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.when(F.col("order_status") == "Processing", 1).otherwise(0))
                      .alias("pending_orders"),
                     money_sum(F.when(not_cancelled(), F.col("totalPrice")).otherwise(F.lit(0.0)))
                      .alias("rev")))
    keys = (t.users.select("user_id") if user_ids is None
            else user_ids.select("user_id").distinct())
    return (keys.join(per_user, "user_id", "left")
            .select("user_id",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("total_orders"),
                    F.col("pending_orders").cast("bigint").alias("pending_orders"),
                    F.coalesce(F.col("rev"), F.lit(0.0)).alias("total_revenue")))


def dashboard_kpis(t: Tables, as_of: str | None = None, threshold: int = 10) -> DataFrame:
    """One row of dashboard counters, each a scalar subquery over its table.

    ``as_of`` is the day for the sales counter ('YYYY-MM-DD'); None takes the
    last day that has orders (use ``sales_on_day(t)`` for today's figure).
    """
    day_sales = sales_on_latest_day(t) if as_of is None else sales_on_day(t, as_of)
    base = pending_orders_count(t)
    return base.select(
        F.col("pending_count"),
        low_stock_count(t, threshold).scalar().alias("low_stock_count"),
        open_complaints_count(t).scalar().alias("open_complaints"),
        day_sales.scalar().alias("day_sales"),
        inventory_value(t).scalar().alias("inventory_value"),
    )


def dashboard(t: Tables, threshold: int = 10) -> dict[str, DataFrame]:
    """The back-office dashboard as DataFrames: the KPI row (A13) and the
    list sections it shows.  Each is an independent lazy plan; a caller
    rendering all of them in one session may ``persist()`` ``t.orders`` first,
    since four of them read the orders."""
    from storelake.operators.catalog import inventory_snapshot, list_categories, list_products
    from storelake.operators.customers import complaints, list_users
    from storelake.operators.orders import all_orders
    return {
        "kpis": dashboard_kpis(t, threshold=threshold),
        "sales_summary": sales_summary(t),
        "products": list_products(t),
        "orders": all_orders(t),
        "inventory": inventory_snapshot(t),
        "users": list_users(t),
        "categories": list_categories(t),
        "complaints": complaints(t),
    }
