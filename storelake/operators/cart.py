"""Cart jobs: fold cart events into carts, price carts.

Folding (W17)
-------------
Per (user, item) the cart quantity is a sequence of events:

* ``add q``: q is raised to 1; refused when cart + q exceeds the item's
  total stock, otherwise added;
* ``set q``: q is capped to the total stock; q <= 0 or no number removes the line;
* ``update``: the posted cart (one row per item, all with the event's id) replaces
  the user's whole cart: each row acts as ``set``, every other item of the
  user is removed;
* ``remove``: removes the line.

Only events after the last reset of the line matter, and that reset is a plain
aggregate: the last own set/update/remove, or the user's last update.  Each add
after it is accepted iff it fits in what earlier *accepted* adds left of
``stock - reset value``: ``fold.units_taken``, for pairs of any size (the adds of a bot
clicking millions of times are cut into blocks that many tasks summarise).

Events without a parsable item id are dropped, as the shop drops bad cart
keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.functions.money import cents_long, from_cents
from storelake.operators.fold import units_taken
from storelake.operators.reports import variant_stock_per_item
from storelake.operators.stock import DISCOUNT_AMOUNT, DISCOUNT_CODE
from storelake.session import materialize
from storelake.sources.model import Tables

KEY = ["user_id", "item_id"]


def fold_cart(t: Tables, ops: DataFrame) -> DataFrame:
    """(user_id, item_id, quantity) of every non-empty cart line."""
    stock = variant_stock_per_item(t).select("item_id", F.col("stock_sum").alias("_stock"))
    ev = materialize(ops.where(F.col("item_id").isNotNull() & F.col("user_id").isNotNull())
                     .join(stock, "item_id", "left")
                     .select("event_id", *KEY, "op", "quantity",
                             F.coalesce("_stock", F.lit(0)).cast("bigint").alias("stock")), "cart-events")

    # a missing quantity is no number: the entry is skipped and the line goes
    amount = F.coalesce(F.greatest(F.least(F.col("quantity").cast("bigint"), F.col("stock")), F.lit(0)), F.lit(0))
    value = F.when(F.col("quantity").isNull() | (F.col("op") == "remove"), F.lit(0)).otherwise(amount).cast("bigint")
    resets = (ev.where(F.col("op").isin("set", "update", "remove"))
              .groupBy(*KEY).agg(F.max("event_id").alias("own_id"),
                                 F.max_by(value, F.col("event_id")).alias("own_value")))
    updates = ev.where(F.col("op") == "update").groupBy("user_id").agg(F.max("event_id").alias("update_id"))
    pairs = ev.groupBy(*KEY).agg(F.first("stock").alias("stock")).join(resets, KEY, "left").join(updates, "user_id", "left")
    emptied = F.col("update_id") > F.coalesce("own_id", F.lit(-1))
    base = materialize(pairs.select(
        *KEY, "stock", F.greatest("own_id", "update_id").alias("reset_id"),
        F.when(emptied, F.lit(0)).otherwise(F.coalesce("own_value", F.lit(0))).cast("bigint").alias("base")), "cart-base")

    adds = (ev.where(F.col("op") == "add").drop("stock").join(base, KEY)
            .where(F.col("reset_id").isNull() | (F.col("event_id") > F.col("reset_id")))
            .select(*KEY, "event_id", (F.col("stock") - F.col("base")).alias("cap"),
                    F.greatest(F.coalesce(F.col("quantity"), F.lit(1)), F.lit(1)).cast("bigint").alias("q")))
    added = units_taken(adds, KEY, "event_id")
    state = (base.join(added, KEY, "left")
             .select(*KEY, (F.col("base") + F.coalesce("added", F.lit(0))).alias("quantity")))
    return state.where(F.col("quantity") > 0).select(
        *KEY, F.col("quantity").cast("int").alias("quantity"))


def price_cart(t: Tables, cart: DataFrame, coupons: DataFrame | None = None) -> DataFrame:
    """Per user the cart subtotal, coupon discount and totals.

    Unit price is basePrice (NULL -> 0); lines of unknown items are dropped.
    ``grand_total`` is the cart page figure (no discount), ``checkout_total``
    subtracts the coupon (DISCOUNT10 after trim/upper = 10, no floor at 0; once,
    however many coupon rows a user has).
    """
    priced = (cart.join(t.items.select("item_id", F.coalesce("basePrice", F.lit(0.0))
                                       .alias("unit_price")), "item_id")
              .withColumn("line_total", F.col("unit_price") * F.col("quantity")))
    per_user = priced.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("quantity").cast("bigint").alias("n_units"),
        from_cents(F.sum(cents_long(F.col("line_total")))).alias("subtotal"))
    if coupons is not None:
        code = F.upper(F.trim("coupon_code"))
        amount = F.when(code == DISCOUNT_CODE, F.lit(DISCOUNT_AMOUNT)).otherwise(F.lit(0.0))
        disc = coupons.groupBy("user_id").agg(F.max(amount).alias("discount"))
        per_user = per_user.join(disc, "user_id", "left")
    else:
        per_user = per_user.withColumn("discount", F.lit(None).cast("double"))
    return per_user.select(
        "user_id", "n_lines", "n_units", "subtotal",
        F.coalesce("discount", F.lit(0.0)).alias("discount"),
        F.col("subtotal").alias("grand_total"),
        (F.col("subtotal") - F.coalesce("discount", F.lit(0.0))).alias("checkout_total"))
