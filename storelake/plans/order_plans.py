"""Registered order queries."""

from pyspark.sql import functions as F

from storelake.operators import orders as O
from storelake.plans.model_sql import register
from storelake.plans.registry import query

# orders of known customers, and those of customers that are gone
register("customer_orders", """
    SELECT v.*, u.name AS customer_name, u.email AS customer_email FROM orders_v v JOIN users u USING (user_id)
    UNION ALL
    SELECT *, 'Deleted User', '' FROM orders_v
    WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM users)""")
_NEWEST = " ORDER BY order_date DESC, order_id DESC"


@query("all_orders", "SELECT * FROM customer_orders" + _NEWEST)
def all_orders(t, ctx):
    return O.all_orders(t)


@query("orders_by_status", "SELECT * FROM customer_orders WHERE order_status = 'Processing'" + _NEWEST)
def orders_by_status(t, ctx):
    return O.orders_by_status(t, "Processing")


@query("orders_by_date_range", """
    SELECT * FROM customer_orders
    WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '1996-04-01'""" + _NEWEST)
def orders_by_date_range(t, ctx):
    return O.orders_by_date_range(t, "1996-01-01", "1996-03-31")


# what each line sold; a line of an unknown variant keeps its own figures only
register("sold_goods", """
    SELECT l.order_id, l.orderItem_id, l.quantity, l.price, v.itemQuant_id, v.color, v.stock,
           v.description AS item_description, v.item_id, v.itemName, v.basePrice
    FROM order_items l LEFT JOIN (
      SELECT q.itemQuant_id, q.color, q.stock, q.description, q.item_id, i.itemName, i.basePrice
      FROM items_quant q LEFT JOIN items i USING (item_id)) v ON v.itemQuant_id = l.itemQuant_id""")
register("order_pages", """
    SELECT c.*, g.* EXCLUDE (order_id) FROM customer_orders c JOIN sold_goods g ON g.order_id = c.order_id
    UNION ALL
    SELECT c.*, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer_orders c
    WHERE c.order_id NOT IN (SELECT order_id FROM order_items)""")


@query("order_details", "SELECT * FROM order_pages ORDER BY order_id, orderItem_id")
def order_details(t, ctx):
    return O.order_details(t)


register("receipt_requests", """
    SELECT order_id, CASE WHEN order_id % 21 = 0 THEN user_id + 1 ELSE user_id END AS user_id
    FROM orders_v""")


def receipt_requests(t):
    return t.orders.select("order_id", F.when(F.col("order_id") % 21 == 0, F.col("user_id") + 1)
                    .otherwise(F.col("user_id")).alias("user_id"))


@query("receipts", """
    SELECT p.* FROM order_pages p JOIN receipt_requests r ON r.order_id = p.order_id AND r.user_id = p.user_id
    ORDER BY order_id, orderItem_id""")
def receipts(t, ctx):
    return O.receipts(t, receipt_requests(t))


_COMPLAINT_USERS = "(SELECT DISTINCT user_id FROM complaint WHERE user_id IS NOT NULL)"


@query("user_order_history", f"""
    SELECT user_id, order_id, order_date, order_status, totalPrice FROM orders_v
    WHERE user_id IN {_COMPLAINT_USERS} ORDER BY user_id, order_date DESC, order_id DESC""")
def user_order_history(t, ctx):
    return O.user_order_history(t, t.complaint.select("user_id"))


@query("user_orders", f"""
    SELECT user_id, order_id, order_date, order_status, totalPrice FROM orders_v
    WHERE user_id IN {_COMPLAINT_USERS} ORDER BY user_id, order_date DESC, order_id DESC""")
def user_orders(t, ctx):
    return O.user_order_history(t, t.complaint.select("user_id"))


@query("orders_with_items", """
    SELECT o.order_id, o.user_id, o.order_date, o.order_status, o.totalPrice, o.staff_id,
           oi.orderItem_id, oi.itemQuant_id, oi.quantity, oi.price
    FROM orders_v o LEFT JOIN order_items oi ON o.order_id = oi.order_id""")
def orders_with_items(t, ctx):
    """Nested per order, flattened back (explode_outer) for the comparison."""
    nested = O.orders_with_items(t)
    flat = nested.select("order_id", "user_id", "order_date", "order_status", "totalPrice",
                         "staff_id", F.explode_outer("items").alias("it"))
    return flat.select("order_id", "user_id", "order_date", "order_status", "totalPrice",
                       "staff_id", "it.orderItem_id", "it.itemQuant_id", "it.quantity", "it.price")


@query("orders_with_items_sizes", """
    SELECT o.order_id, CAST(count(oi.order_id) AS INTEGER) AS n_items
    FROM orders_v o LEFT JOIN order_items oi ON o.order_id = oi.order_id GROUP BY o.order_id""")
def orders_with_items_sizes(t, ctx):
    """Array sizes of the nested form: 0 for orders without lines."""
    return O.orders_with_items(t).select("order_id", F.size("items").alias("n_items"))


@query("recent_orders", """
    SELECT o.order_id, COALESCE(u.name, 'N/A') AS customer_name, o.totalPrice, o.order_status
    FROM (SELECT * FROM orders_v ORDER BY order_id DESC LIMIT 5) o
    LEFT JOIN users u ON o.user_id = u.user_id ORDER BY o.order_id DESC""")
def recent_orders(t, ctx):
    return O.recent_orders(t)


@query("line_numbers", """
    SELECT order_id, orderItem_id,
           CAST(row_number() OVER (PARTITION BY order_id ORDER BY orderItem_id) AS INTEGER) AS line_no
    FROM order_items""")
def line_numbers(t, ctx):
    return O.line_numbers(t)
