"""Stock-moving jobs: order placement with admission, status changes.

Each job takes the current snapshot plus a DataFrame of requests and returns
a dict of new table DataFrames (and rejects).  Nothing is updated in place;
``Tables.write_snapshot`` writes the result as a new snapshot directory.

Admission (W8)
--------------
The shop checks each checkout against the item's current total stock and
then decrements it, one checkout after another.  A batch gives the same
result as that sequence, where rejecting an order leaves its stock for later
orders: see ``sequence.greedy_admission``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.functions.money import line_revenue_sum
from storelake.operators.catalog import first_variant
from storelake.operators.reports import variant_stock_per_item
from storelake.operators.sequence import greedy_admission, max_id, new_ids, new_ids_nested
from storelake.session import discard, materialize
from storelake.sources.model import Tables

DISCOUNT_CODE = "DISCOUNT10"
DISCOUNT_AMOUNT = 10.0


def priced_lines(t: Tables, requests: DataFrame) -> DataFrame:
    """Checkout lines of known items with unit price (NULL -> 0) and line total;
    lines of unknown items or with a quantity below 1 are dropped, as the cart
    page drops them."""
    items = t.items.select("item_id", F.coalesce("basePrice", F.lit(0.0)).alias("unit_price"))
    # a cart holds each item once: repeated (request, item) rows are one line
    carts = (requests.where(F.col("quantity") >= 1).groupBy("request_id", "user_id", "item_id")
             .agg(F.sum("quantity").cast("int").alias("quantity")))
    return (carts.join(items, "item_id")
            .withColumn("line_total", F.col("unit_price") * F.col("quantity")))


def _lines_with_stock(t: Tables, lines: DataFrame) -> DataFrame:
    stock = variant_stock_per_item(t)
    return (lines.select("request_id", "item_id", "quantity")
            .join(stock, "item_id", "left")
            .withColumn("avail", F.coalesce("stock_sum", F.lit(0)))
            .drop("stock_sum"))


def admit_orders(t: Tables, lines: DataFrame) -> DataFrame:
    """Request ids admitted under sequential checkout (see module doc)."""
    return greedy_admission(_lines_with_stock(t, lines), "request_id", ["item_id"], "quantity", "avail")


def check_stock(t: Tables, requests: DataFrame) -> DataFrame:
    """W8 report: every checkout request id with ``admitted`` true/false."""
    lines = priced_lines(t, requests)
    ok = admit_orders(t, lines).withColumn("admitted", F.lit(True))
    ids = requests.select("request_id").distinct()
    return (ids.join(ok, "request_id", "left")
            .select("request_id", F.coalesce("admitted", F.lit(False)).alias("admitted")))


def place_orders(t: Tables, requests: DataFrame, discounts: DataFrame | None = None,
                 order_date: str | None = None, order_id_base=None,
                 line_id_base=None) -> dict[str, DataFrame]:
    """Admit the checkout batch, then insert orders and lines and take the
    sold quantity off each item's first variant.

    ``requests``: (request_id, user_id, item_id, quantity), one cart per
    request_id.  ``discounts``: optional (request_id, coupon_code); a code
    equal to DISCOUNT10 after trim/upper takes 10 off the total (no floor),
    once however many coupon rows a request has.
    Returns new ``orders``, ``order_items``, ``items_quant`` and ``rejects``
    (plus ``new_orders`` / ``new_order_items``, the inserted rows alone, and ``changed_stock``,
    the variants whose stock moved).
    New ids continue after ``order_id_base`` / ``line_id_base`` when given
    (a stream carries them from batch to batch), else after the tables' max.
    """
    # the priced batch feeds admission, totals, lines and stock: write it
    # once to the shared checkpoint folder instead of re-deriving it per use
    lines = materialize(priced_lines(t, requests), "checkout-lines")
    admitted = admit_orders(t, lines)
    # few of the lines where stock is short, and every output is made from them
    ok_lines = materialize(lines.join(admitted, "request_id", "left_semi"), "admitted-lines")

    per_order = ok_lines.groupBy("request_id", "user_id").agg(
        line_revenue_sum(F.col("unit_price"), F.col("quantity")).alias("subtotal"))
    if discounts is not None:
        code = F.upper(F.trim("coupon_code"))
        amount = F.when(code == DISCOUNT_CODE, F.lit(DISCOUNT_AMOUNT)).otherwise(F.lit(0.0))
        disc = discounts.groupBy("request_id").agg(F.max(amount).alias("discount"))
        per_order = per_order.join(disc, "request_id", "left")
    else:
        per_order = per_order.withColumn("discount", F.lit(None).cast("double"))
    when = (F.current_timestamp().cast("timestamp_ntz") if order_date is None
            else F.lit(order_date).cast("timestamp_ntz"))
    if order_id_base is None:
        order_id_base = max_id(t.orders, "order_id")
    if line_id_base is None:
        line_id_base = max_id(t.order_items, "orderItem_id")
    # the numbered orders feed the order rows, the lines and the stock: write
    # them once (batch-sized) so the id ranking is not re-run per output
    per_order = materialize(per_order, "admitted-orders")
    new_orders = materialize(new_ids(per_order, "request_id", order_id_base, "order_id"),
                             "new-orders")
    discard(per_order)
    orders_out = new_orders.select(
        "order_id", "user_id", when.alias("order_date"), F.lit("Processing").alias("order_status"),
        (F.col("subtotal") - F.coalesce("discount", F.lit(0.0))).alias("totalPrice"),
        F.lit(0).cast("bigint").alias("staff_id"))

    variants = first_variant(t)
    new_lines = (ok_lines.join(new_orders.select("request_id", "order_id"), "request_id")
                 .join(variants, "item_id"))
    # line ids continue the table's sequence, in (order, item) order
    lines_out = new_ids_nested(new_lines, "order_id", "item_id", line_id_base, "orderItem_id")
    lines_out = lines_out.select("orderItem_id", "order_id", "itemQuant_id",
                                 F.col("quantity").cast("int").alias("quantity"),
                                 F.col("line_total").alias("price"))

    # what is sold needs no line ids: straight from the admitted lines
    sold = (ok_lines.groupBy("item_id").agg(F.sum("quantity").alias("_sold"))
            .join(variants, "item_id").select("itemQuant_id", "_sold"))
    stock_out = (t.items_quant.join(sold, "itemQuant_id", "left")
                 .withColumn("stock", (F.col("stock") - F.coalesce("_sold", F.lit(0))).cast("int"))
                 .withColumn("negative_stock", F.col("stock") < 0)
                 .select("itemQuant_id", "item_id", "color", "stock", "description",
                         "negative_stock"))
    changed = (t.items_quant.join(sold, "itemQuant_id")
               .withColumn("stock", (F.col("stock") - F.col("_sold")).cast("int")).select(*t.items_quant.columns))
    # one shuffle of the ids: a null id is neither admitted nor known
    seen = (requests.select("request_id", F.lit(False).alias("_known"), F.lit(False).alias("_in"))
            .unionByName(lines.select("request_id", F.col("request_id").isNotNull().alias("_known"), F.lit(False).alias("_in")))
            .unionByName(admitted.select("request_id", F.lit(True).alias("_known"), F.lit(True).alias("_in"))))
    rejects = (seen.groupBy("request_id").agg(F.max("_known").alias("_known"), F.max("_in").alias("_in")).where("NOT _in")
               .select("request_id", F.lit(None).cast("bigint").alias("item_id"),
                       F.when(F.col("_known"), "out_of_stock").otherwise("no_valid_line").alias("reason")))
    # An admitted line whose item has no variant cannot be stored
    no_variant = (ok_lines.join(variants, "item_id", "left_anti")
                  .select("request_id", "item_id", F.lit("no_variant").alias("reason")))
    rejects = rejects.unionByName(no_variant)
    return {
        "orders": t.orders.select(*orders_out.columns).unionByName(orders_out),
        "new_orders": orders_out,
        "order_items": t.order_items.unionByName(lines_out),
        "new_order_items": lines_out,
        "items_quant": stock_out,
        "changed_stock": changed,
        "rejects": rejects,
    }


def apply_order_status(t: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Set order statuses, one change after another by ``seq``.

    Every step of an order *into* 'Cancelled' gives its line quantities back to
    their variants (K12); the status before a step is the one of the order's
    previous change, for its first change the stored one.  The last change
    decides the status, the last named staff member the staff_id.  Unknown order ids
    and changes without a status change nothing.
    """
    known = t.orders.select("order_id", "order_status")
    steps = changes.where(F.col("new_status").isNotNull()).join(known, "order_id")
    by_order = Window.partitionBy("order_id").orderBy("seq")
    before = F.coalesce(F.lag("new_status").over(by_order), "order_status")
    steps = steps.withColumn("_into", (F.col("new_status") == "Cancelled") & ~before.eqNullSafe(F.lit("Cancelled")))
    named = F.when(F.col("staff_id").isNotNull(), F.col("seq"))
    folded = steps.groupBy("order_id").agg(
        F.max_by("new_status", "seq").alias("_status"), F.max_by("staff_id", named).alias("_staff"),
        F.sum(F.col("_into").cast("int")).alias("_times"))
    back = (t.order_items.join(folded.where("_times > 0").select("order_id", "_times"), "order_id")
            .groupBy("itemQuant_id").agg(F.sum(F.col("quantity") * F.col("_times")).alias("_back")))
    stock_out = (t.items_quant.join(back, "itemQuant_id", "left")
                 .withColumn("stock", (F.col("stock") + F.coalesce("_back", F.lit(0))).cast("int"))
                 .drop("_back"))
    orders_out = t.orders.join(folded, "order_id", "left").select(
        "order_id", "user_id", "order_date",
        F.coalesce("_status", "order_status").alias("order_status"), "totalPrice",
        F.coalesce("_staff", "staff_id").alias("staff_id"))
    return {"orders": orders_out, "items_quant": stock_out}
