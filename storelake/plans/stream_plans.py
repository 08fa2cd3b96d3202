"""Registered streaming queries (X1-X3): each feeds rows derived from the
tables into a file source in several chunks, drains the stream with
``availableNow`` and returns the final state, which must equal the batch
operator on the same input."""


from storelake.plans.change_plans import NOW
from storelake.plans.registry import query
from storelake.session import scratch_dir
from storelake.sources import requests as RQ
from storelake.streaming import streams as X


def _dirs(spark, name):
    root = scratch_dir(spark, name)
    return f"{root}/source", f"{root}/state", f"{root}/checkpoint", f"{root}/out"


def _streamed(t, ctx, name):
    """The snapshot after streaming the checkout batch in 3 micro-batches."""
    src, state, ckpt, _ = _dirs(ctx.spark, name)
    after = []
    X.feed_in_chunks(RQ.order_requests(ctx).select(*X.REQUEST_SCHEMA.fieldNames()), src, "request_id", 3,
                     lambda: after.append(X.run_order_stream(ctx.spark, t, src, state, ckpt, order_date=NOW)))
    return after[-1] if after else t


@query("stream_orders", "SELECT * FROM stock_after_checkout")
def stream_orders(t, ctx):
    """Stock after the stream; checkouts that don't fit are refused as in the batch."""
    return _streamed(t, ctx, "stream-orders").items_quant


@query("stream_orders_new", """
    SELECT order_id, user_id, order_date, order_status, subtotal AS totalPrice, staff_id FROM new_orders_v""")
def stream_orders_new(t, ctx):
    """Orders the stream inserted (ids continue across micro-batches)."""
    final = _streamed(t, ctx, "stream-orders-new")
    return final.orders.join(t.orders.select("order_id"), "order_id", "left_anti")


@query("stream_cart", """
    SELECT user_id, item_id, CAST(sum(greatest(COALESCE(quantity, 1), 1)) AS BIGINT) AS added_quantity
    FROM cart_events WHERE item_id IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id, item_id""")
def stream_cart(t, ctx):
    """Running added quantity per (user, item) over the click stream."""
    src, _, ckpt, out = _dirs(ctx.spark, "stream-cart")
    ev = RQ.cart_events(ctx)
    X.feed_in_chunks(ev, src, "event_id", 3, lambda: X.cart_totals_stream(ctx.spark, src, ev.schema, out, ckpt))
    return X.read_cart_totals(ctx.spark, out)


@query("stream_revenue", """
    SELECT CAST(order_date AS DATE) AS day,
           CAST(sum(CASE WHEN order_status <> 'Cancelled' THEN 1 ELSE 0 END) AS BIGINT) AS order_count,
           COALESCE(CAST(sum(CASE WHEN order_status <> 'Cancelled'
                                  THEN CAST(totalPrice AS DECIMAL(18,2)) END) AS DOUBLE), 0)
             AS total_revenue,
           CAST(sum(CASE WHEN order_status = 'Processing' THEN 1 ELSE 0 END) AS BIGINT) AS open_orders
    FROM orders_v GROUP BY 1""")
def stream_revenue(t, ctx):
    """Running revenue / open orders per day over the order stream."""
    src, _, ckpt, out = _dirs(ctx.spark, "stream-revenue")
    X.feed_in_chunks(t.orders, src, "order_id", 3,
                     lambda: X.revenue_stream(ctx.spark, src, t.orders.schema, out, ckpt))
    return X.read_revenue(ctx.spark, out).select("day", "order_count", "total_revenue", "open_orders")
