"""Registered queries over stored tables: bucketed and sorted snapshots, lookups of few keys,
reports kept up to date from changes, the dashboard as one unit."""

from pyspark.sql import functions as F

from storelake.operators import changes as W
from storelake.operators import orders as O
from storelake.operators import reports as R
from storelake.operators import stock as S
from storelake.operators import upkeep as U
from storelake.operators.lookups import with_keys
from storelake.plans.change_plans import NOW
from storelake.plans.registry import REGISTRY, query
from storelake.session import materialize, scratch_dir
from storelake.sources import requests as RQ
from storelake.sources.model import Tables
from storelake.sources.snapshots import Layout, Store

BUCKETS = 16
BY_ORDER = {n: Layout(bucket="order_id", buckets=BUCKETS) for n in ("orders", "order_items")}
BY_KEY = {"users": Layout(sort="user_id", files=8, bloom=("email",)), "orders": Layout(sort="order_id", files=8, bloom=("user_id",))}


def _sql(name: str) -> str:
    """The oracle of the same query over the tables that aren't stored."""
    from storelake.plans import order_plans, report_plans  # noqa: F401 - fills REGISTRY
    return REGISTRY[name].body


def _stored(t, ctx, layouts) -> Tables:
    path = scratch_dir(ctx.spark, "stored")
    t.write_snapshot(path, layouts=layouts)
    return Tables.read_snapshot(ctx.spark, path)


@query("order_details_stored", _sql("order_details"))
def order_details_stored(t, ctx):
    """J3 over a snapshot bucketed by order: orders meet their lines without a shuffle."""
    return O.order_details(_stored(t, ctx, BY_ORDER), colocated=True)


@query("orders_with_items_stored", _sql("orders_with_items"))
def orders_with_items_stored(t, ctx):
    """J6 over the same buckets: lines are nested and joined where they lie."""
    return REGISTRY["orders_with_items"].fn(_stored(t, ctx, BY_ORDER), ctx)


@query("category_sales_stored", _sql("category_sales"))
def category_sales_stored(t, ctx):
    """A11 over the same buckets: live lines are picked without a shuffle."""
    return R.category_sales(_stored(t, ctx, BY_ORDER))


@query("recent_buyers_stored", """
    SELECT u.user_id, u.name, u.email, u.phone, u.role, u.notes, u.created_at, o.order_id, o.totalPrice
    FROM (SELECT order_id, user_id, totalPrice FROM orders_v ORDER BY order_id DESC LIMIT 5) o
    JOIN users u ON u.user_id = o.user_id""")
def recent_buyers_stored(t, ctx):
    """L2 for the buyers of T3's newest orders, in a snapshot sorted by key: few keys reach the scan."""
    stored = _stored(t, ctx, BY_KEY)
    newest = stored.orders.select("order_id", "user_id", "totalPrice").orderBy(F.desc("order_id")).limit(5)
    return with_keys(stored.users, newest, "user_id").join(newest, "user_id").select(
        *t.users.columns, "order_id", "totalPrice")


_NEWEST = "(SELECT user_id FROM (SELECT order_id, user_id FROM orders_v ORDER BY order_id DESC LIMIT 5) n)"


def _newest(stored):
    return stored.orders.select("order_id", "user_id").orderBy(F.desc("order_id")).limit(5)


@query("recent_histories_stored", f"""
    SELECT user_id, order_id, order_date, order_status, totalPrice FROM orders_v
    WHERE user_id IN {_NEWEST} ORDER BY user_id, order_date DESC, order_id DESC""")
def recent_histories_stored(t, ctx):
    """P9/P10 for the newest buyers: their ids reach the scan of the orders, whose row groups have a bloom
    filter on user_id."""
    stored = _stored(t, ctx, BY_KEY)
    found = with_keys(stored.orders, _newest(stored), "user_id")
    return found.select("user_id", "order_id", "order_date", "order_status", "totalPrice").orderBy(
        "user_id", F.desc("order_date"), F.desc("order_id"))


@query("recent_receipts_stored", """
    SELECT p.* FROM order_pages p JOIN (SELECT order_id FROM orders_v ORDER BY order_id DESC LIMIT 5) n USING (order_id)
    ORDER BY order_id, orderItem_id""")
def recent_receipts_stored(t, ctx):
    """P11 for the newest orders, over orders and lines sorted by order: only their row groups are read."""
    lines = Layout(sort="order_id", files=8)
    stored = _stored(t, ctx, BY_KEY | {"order_items": lines})
    ids = _newest(stored)
    few = stored.with_(orders=with_keys(stored.orders, ids, "order_id"), order_items=with_keys(stored.order_items, ids, "order_id"))
    return O.order_details(few)


@query("delete_products_null_keys", """
    SELECT * FROM (
      SELECT orderItem_id, order_id, CASE WHEN orderItem_id % 3 = 0 THEN NULL ELSE itemQuant_id END AS itemQuant_id, quantity, price
      FROM order_items) l
    WHERE itemQuant_id IS NULL OR itemQuant_id NOT IN (
      SELECT itemQuant_id FROM items_quant WHERE item_id IN (SELECT item_id FROM delete_items))""")
def delete_products_null_keys(t, ctx):
    """W4 where a third of the order lines has lost its variant: they stay, and don't meet in one task."""
    orphaned = t.order_items.withColumn("itemQuant_id", F.when(F.col("orderItem_id") % 3 != 0, F.col("itemQuant_id")))
    return W.delete_products(t.with_(order_items=orphaned), RQ.delete_items(ctx))["order_items"]


_CHANGED_ORDERS = """
    SELECT o.order_id, o.user_id, o.order_date, COALESCE(s.new_status, o.order_status) AS order_status, o.totalPrice
    FROM orders_v o LEFT JOIN (
      SELECT order_id, arg_max(new_status, seq) AS new_status FROM status_steps GROUP BY order_id) s USING (order_id)
    UNION ALL SELECT order_id, user_id, order_date, order_status, subtotal FROM new_orders_v"""


def _kept_up(t, ctx):
    """Stored sums of the orders, then a batch of status changes (W6) and one of checkouts."""
    store = Store(ctx.spark, scratch_dir(ctx.spark, "sums"), {"daily": U.DAILY_SCHEMA, "per_user": U.PER_USER_SCHEMA},
                  keys={"daily": ["day"], "per_user": ["user_id"]})
    first = U.inserted(t.orders)
    store.commit(replace={"daily": U.daily_sums(first), "per_user": U.user_sums(first)})
    changed = S.apply_order_status(t, RQ.status_changes(ctx))["orders"]
    placed = S.place_orders(t, RQ.order_requests(ctx), order_date=NOW)["new_orders"]
    # each change is summed twice, and each sum is read twice: write it once
    for change in (materialize(U.order_changes(t.orders, changed), "changes"), U.inserted(placed)):
        store.commit(upsert={"daily": U.merged(store.read("daily"), U.daily_sums(change), "day"),
                             "per_user": U.merged(store.read("per_user"), U.user_sums(change), "user_id")})
    return store


@query("revenue_weekly_kept_up", f"""
    SELECT strftime(order_date, '%Y-W%W') AS period_label, COUNT(*) AS order_count,
           CAST(SUM(CAST(totalPrice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM ({_CHANGED_ORDERS}) x WHERE order_status <> 'Cancelled'
    GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def revenue_weekly_kept_up(t, ctx):
    """A9 from daily sums that followed two batches of changes."""
    return U.revenue_report(_kept_up(t, ctx).read("daily"), "weekly")


@query("user_order_stats_kept_up", f"""
    SELECT u.user_id, COUNT(x.order_id) AS total_orders,
           CAST(SUM(CASE WHEN order_status = 'Processing' THEN 1 WHEN order_id IS NOT NULL THEN 0 END) AS BIGINT) AS pending_orders,
           COALESCE(CAST(SUM(CAST(totalPrice AS DECIMAL(18,2))) FILTER (WHERE order_status <> 'Cancelled') AS DOUBLE), 0) AS total_revenue
    FROM users u LEFT JOIN ({_CHANGED_ORDERS}) x ON x.user_id = u.user_id GROUP BY u.user_id""")
def user_order_stats_kept_up(t, ctx):
    """A12 from sums per user that followed two batches of changes."""
    return U.user_report(t, _kept_up(t, ctx).read("per_user"))


@query("dashboard_sections", """
    SELECT 'categories' AS section, COUNT(*) AS n_rows, CAST(SUM(cat_id) AS BIGINT) AS key_sum FROM category
    UNION ALL SELECT 'complaints', COUNT(*), CAST(SUM(complaint_id) AS BIGINT) FROM complaint
    UNION ALL SELECT 'inventory', COUNT(*), CAST(SUM(item_id) AS BIGINT) FROM items LEFT JOIN items_quant USING (item_id)
    UNION ALL SELECT 'kpis', 1, CAST(COUNT(*) AS BIGINT) FROM orders_v WHERE order_status = 'Processing'
    UNION ALL SELECT 'orders', COUNT(*), CAST(SUM(order_id) AS BIGINT) FROM orders_v
    UNION ALL SELECT 'products', COUNT(*), CAST(SUM(item_id) AS BIGINT) FROM items
    UNION ALL SELECT 'sales_summary', COUNT(*), CAST(SUM(item_id) AS BIGINT) FROM (
      SELECT item_id FROM item_sales ORDER BY total_sold DESC, item_id LIMIT 10) s
    UNION ALL SELECT 'users', COUNT(*), CAST(SUM(user_id) AS BIGINT) FROM users""")
def dashboard_sections(t, ctx):
    """The dashboard page: every section it shows, with its rows and the sum of their keys."""
    keys = {"categories": "cat_id", "complaints": "complaint_id", "inventory": "item_id", "kpis": "pending_count",
            "orders": "order_id", "products": "item_id", "sales_summary": "item_id", "users": "user_id"}
    found = R.dashboard(t)
    parts = [found[name].agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).cast("bigint").alias("key_sum"))
             .select(F.lit(name).alias("section"), "n_rows", "key_sum") for name, key in keys.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
