"""Request and change batches derived from the driver tables (FIXTURES.md §3).

The shop answers one web request at a time; here a *batch* of requests or
changes is a DataFrame derived by rule from the whole driver tables, so its
size grows with the data.  Each builder has a SQL twin registered with
``model_sql`` so the oracle reads exactly the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.plans.model_sql import register
from storelake.sources.model import cart_events_view, wishlist_events_view

# ------------------------------------------------------------------ key sets


def cart_events(ctx) -> DataFrame:
    return cart_events_view(ctx.raw["events"])


def wishlist_events(ctx) -> DataFrame:
    return wishlist_events_view(ctx.raw["events"])


def cart_item_ids(ctx) -> DataFrame:
    """Item ids users put in their carts (the cart page's lookups)."""
    return cart_events(ctx).select("item_id").distinct()


def wishlist_item_ids(ctx) -> DataFrame:
    return wishlist_events(ctx).select("item_id").distinct()


# ------------------------------------------------------------- user changes

def _email(name_col):
    return F.concat(F.lower(F.translate(name_col, "#", ".")), F.lit("@example.com"))


def new_users(ctx) -> DataFrame:
    """Registration batch, one form per customer: taken e-mails (plain and padded),
    e-mails shared inside the batch (plain and padded), malformed and new ones."""
    c = ctx.raw["customer"]
    k = F.col("c_custkey")
    text = k.cast("string")
    email = (F.when(k % 10 == 0, _email(F.col("c_name")))
              .when((k % 10 == 1) & (k % 40 == 21), F.concat(F.lit("new "), text, F.lit("@example")))
              .when(k % 10 == 1, F.concat(F.lit("new."), text, F.lit("@example.com")))
              .when(k % 10 == 2, F.concat(F.lit("dup."), (k % 7).cast("string"), F.lit("@example.org")))
              .when(k % 10 == 3, F.concat(F.lit("  new."), (k - 2).cast("string"), F.lit("@example.com ")))
              .when(k % 10 == 4, F.concat(F.lit(" "), _email(F.col("c_name")), F.lit(" ")))
              .otherwise(F.concat(F.lit("own."), text, F.lit("@example.net"))))
    phone = (F.when(k % 7 == 0, None)
              .when(k % 20 == 12, F.lit("12-34"))
              .otherwise(F.concat(F.lit("+92 (3"), F.lpad((k % 1000).cast("string"), 3, "0"),
                                  F.lit(") 555-1234"))))
    role = (F.when(k % 30 == 0, F.lit(" Staff ")).when(k % 30 == 10, F.lit("manager"))
             .otherwise(F.lit("customer")))
    return c.select(k.alias("request_id"),
                    F.when(k % 30 == 2, F.lit("")).otherwise(F.col("c_name")).alias("name"),
                    email.alias("email"), phone.alias("phone"), role.alias("role"))


register("new_users", """
    SELECT c_custkey AS request_id,
           CASE WHEN c_custkey % 30 = 2 THEN '' ELSE c_name END AS name,
           CASE WHEN c_custkey % 10 = 0 THEN concat(lower(replace(c_name, '#', '.')), '@example.com')
                WHEN c_custkey % 10 = 1 AND c_custkey % 40 = 21
                     THEN concat('new ', CAST(c_custkey AS VARCHAR), '@example')
                WHEN c_custkey % 10 = 1 THEN concat('new.', CAST(c_custkey AS VARCHAR), '@example.com')
                WHEN c_custkey % 10 = 2 THEN concat('dup.', CAST(c_custkey % 7 AS VARCHAR), '@example.org')
                WHEN c_custkey % 10 = 3 THEN concat('  new.', CAST(c_custkey - 2 AS VARCHAR), '@example.com ')
                WHEN c_custkey % 10 = 4 THEN concat(' ', lower(replace(c_name, '#', '.')), '@example.com ')
                ELSE concat('own.', CAST(c_custkey AS VARCHAR), '@example.net') END AS email,
           CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 20 = 12 THEN '12-34'
                ELSE concat('+92 (3', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), ') 555-1234')
           END AS phone,
           CASE WHEN c_custkey % 30 = 0 THEN ' Staff ' WHEN c_custkey % 30 = 10 THEN 'manager'
                ELSE 'customer' END AS role
    FROM customer""")


def user_patches(ctx) -> DataFrame:
    """Profile edits, three per customer in sequence ``seq``: NULL means 'leave as
    is'; caller role decides whether role/notes may change; some ask for an
    e-mail that is taken, that several users ask for, or that its holder has given up
    earlier (user 17n's after the move, and by that user 17n + 1's)."""
    k, j = F.col("c_custkey"), F.col("j")
    c = ctx.raw["customer"].withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    text = k.cast("string")

    def own(key):
        return F.concat(F.lit("customer."), F.lpad(key.cast("string"), 9, "0"), F.lit("@example.com"))

    return c.select(
        (k * 3 + j).alias("seq"), k.alias("user_id"),
        F.when((k + j) % 3 == 0, None).otherwise(F.concat(F.col("c_name"), F.lit(" Jr"), j.cast("string"))).alias("name"),
        F.when((j == 0) & (k % 11 == 0), own(k + 1))
         .when((j == 0) & (k > 2) & (k % 17).isin(1, 2), own(k - 1))
         .when((j == 1) & (k % 13 == 0), F.concat(F.lit("vip."), (k % 5).cast("string"), F.lit("@example.org")))
         .when((j == 1) & (k % 17 == 0), F.concat(F.lit(" moved."), text, F.lit("@example.org ")))
         .when((j == 2) & (k % 26 == 0), F.concat(F.lit("back."), text, F.lit("@example.org"))).alias("email"),
        F.when((k + j) % 4 == 0, None).otherwise(F.concat(F.lit("0300"), F.lpad((k + j).cast("string"), 7, "0"))).alias("phone"),
        F.when((k + j) % 6 == 0, None).otherwise(F.concat(F.lit("called back "), j.cast("string"))).alias("notes"),
        F.when(k % 25 == 0, F.lit("staff")).otherwise(F.lit(None).cast("string")).alias("role"),
        F.when((k + j) % 2 == 0, F.lit("admin")).otherwise(F.lit("staff")).alias("caller_role"))


register("user_patches", """
    SELECT c_custkey * 3 + j AS seq, c_custkey AS user_id,
           CASE WHEN (c_custkey + j) % 3 = 0 THEN NULL ELSE concat(c_name, ' Jr', CAST(j AS VARCHAR)) END AS name,
           CASE WHEN j = 0 AND c_custkey % 11 = 0
                     THEN concat('customer.', lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0'), '@example.com')
                WHEN j = 0 AND c_custkey > 2 AND c_custkey % 17 IN (1, 2)
                     THEN concat('customer.', lpad(CAST(c_custkey - 1 AS VARCHAR), 9, '0'), '@example.com')
                WHEN j = 1 AND c_custkey % 13 = 0 THEN concat('vip.', CAST(c_custkey % 5 AS VARCHAR), '@example.org')
                WHEN j = 1 AND c_custkey % 17 = 0 THEN concat(' moved.', CAST(c_custkey AS VARCHAR), '@example.org ')
                WHEN j = 2 AND c_custkey % 26 = 0 THEN concat('back.', CAST(c_custkey AS VARCHAR), '@example.org')
           END AS email,
           CASE WHEN (c_custkey + j) % 4 = 0 THEN NULL
                ELSE concat('0300', lpad(CAST(c_custkey + j AS VARCHAR), 7, '0')) END AS phone,
           CASE WHEN (c_custkey + j) % 6 = 0 THEN NULL ELSE concat('called back ', CAST(j AS VARCHAR)) END AS notes,
           CASE WHEN c_custkey % 25 = 0 THEN 'staff' ELSE NULL END AS role,
           CASE WHEN (c_custkey + j) % 2 = 0 THEN 'admin' ELSE 'staff' END AS caller_role
    FROM customer, (VALUES (0), (1), (2)) AS v(j)""")


def delete_users(ctx) -> DataFrame:
    return ctx.raw["customer"].where(F.col("c_custkey") % 50 == 1).select(
        F.col("c_custkey").alias("user_id"))


register("delete_users", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 50 = 1")


# ----------------------------------------------------------- catalog changes

def product_changes(ctx) -> DataFrame:
    """Product form posts: an update of every part (image kept / cleared /
    replaced by modulus), a second, conflicting one of some, and an insert
    (item_id NULL) for every part."""
    p = ctx.raw["part"]
    k = F.col("p_partkey")
    upd = p.select(
        k.alias("request_id"), k.alias("item_id"),
        F.concat(F.col("p_name"), F.lit(" v2")).alias("name"),
        F.when(k % 24 == 0, F.lit("abc"))
         .otherwise(F.format_string("%.2f", F.col("p_retailprice") + 1)).alias("price_text"),
        F.when(k % 16 == 0, F.lit("1.5")).otherwise((k % 9).cast("string")).alias("stock_text"),
        F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")).alias("short_desc"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("full_desc"),
        F.when(k % 5 == 0, F.lit(None).cast("binary"))
         .when(k % 5 == 1, F.lit(b"")).otherwise(F.concat(F.lit("img-"), F.col("p_name"))
                                                  .cast("binary")).alias("image"))
    again = p.where(k % 4 == 0).select(
        (k + F.lit(500_000_000)).alias("request_id"), k.alias("item_id"),
        F.concat(F.col("p_name"), F.lit(" v3")).alias("name"),
        F.format_string("%.2f", F.col("p_retailprice") + 2).alias("price_text"),
        (k % 5).cast("string").alias("stock_text"), F.lit("again").alias("short_desc"),
        F.lit(None).cast("string").alias("full_desc"), F.lit(None).cast("binary").alias("image"))
    ins = p.select(
        (k + F.lit(1_000_000_000)).alias("request_id"), F.lit(None).cast("bigint").alias("item_id"),
        F.concat(F.lit("new "), F.col("p_name")).alias("name"),
        F.concat(F.lit("Rs."), F.col("p_size").cast("string"), F.lit("/-")).alias("price_text"),
        (F.col("p_size") % 7).cast("string").alias("stock_text"),
        F.col("p_brand").alias("short_desc"), F.col("p_type").alias("full_desc"),
        F.lit(None).cast("binary").alias("image"))
    return upd.unionByName(again).unionByName(ins)


register("product_changes", """
    SELECT p_partkey AS request_id, p_partkey AS item_id, concat(p_name, ' v2') AS name,
           CASE WHEN p_partkey % 24 = 0 THEN 'abc' ELSE printf('%.2f', p_retailprice + 1) END AS price_text,
           CASE WHEN p_partkey % 16 = 0 THEN '1.5' ELSE CAST(p_partkey % 9 AS VARCHAR) END AS stock_text,
           concat('  ', p_brand, ' ') AS short_desc,
           CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS full_desc,
           CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN ''::BLOB
                ELSE CAST(concat('img-', p_name) AS BLOB) END AS image
    FROM part
    UNION ALL
    SELECT p_partkey + 500000000, p_partkey, concat(p_name, ' v3'), printf('%.2f', p_retailprice + 2),
           CAST(p_partkey % 5 AS VARCHAR), 'again', CAST(NULL AS VARCHAR), CAST(NULL AS BLOB)
    FROM part WHERE p_partkey % 4 = 0
    UNION ALL
    SELECT p_partkey + 1000000000, CAST(NULL AS BIGINT), concat('new ', p_name),
           concat('Rs.', CAST(p_size AS VARCHAR), '/-'), CAST(p_size % 7 AS VARCHAR),
           p_brand, p_type, CAST(NULL AS BLOB)
    FROM part""")


def delete_items(ctx) -> DataFrame:
    return ctx.raw["part"].where(F.col("p_partkey") % 50 == 1).select(
        F.col("p_partkey").alias("item_id"))


register("delete_items", "SELECT p_partkey AS item_id FROM part WHERE p_partkey % 50 = 1")


def category_assignments(ctx) -> DataFrame:
    """Every part assigned to an existing category (its type) or to a new one; the
    label defaults to the category name; every third part a second time with another label."""
    p = ctx.raw["part"]
    k = F.col("p_partkey")
    cat = (F.when(k % 2 == 0, F.col("p_type"))
            .otherwise(F.concat(F.lit("CUSTOM "), (k % 4).cast("string"))))
    label = F.when(k % 4 == 0, F.col("p_brand")).otherwise(F.lit(None).cast("string"))
    first = p.select(k.alias("request_id"), k.alias("item_id"), cat.alias("category_name"),
                     label.alias("subcategory_name"))
    second = p.where(k % 3 == 0).select(
        (k + F.lit(500_000_000)).alias("request_id"), k.alias("item_id"), cat.alias("category_name"),
        F.lit(" relabelled ").alias("subcategory_name"))
    return first.unionByName(second)


register("category_assignments", """
    SELECT p_partkey AS request_id, p_partkey AS item_id,
           CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE concat('CUSTOM ', CAST(p_partkey % 4 AS VARCHAR))
           END AS category_name,
           CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE NULL END AS subcategory_name
    FROM part
    UNION ALL
    SELECT p_partkey + 500000000, p_partkey,
           CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE concat('CUSTOM ', CAST(p_partkey % 4 AS VARCHAR)) END,
           ' relabelled '
    FROM part WHERE p_partkey % 3 = 0""")


# ------------------------------------------------------------ order changes

def status_changes(ctx) -> DataFrame:
    """Back-office status edits in sequence ``seq``: every order gets one, half a
    second (cancelled), some are reopened and cancelled again."""
    o, k, j = ctx.raw["orders"], F.col("o_orderkey"), F.col("j")
    steps = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)),
                     lambda x: (x == 0) | ((x == 1) & (k % 2 == 0)) | ((x == 2) & (k % 6 == 0)) | ((x == 3) & (k % 12 == 0)))
    status = (F.when((j == 1) | (j == 3) | (k % 5 == 0), "Cancelled").when(j == 2, "Processing")
               .when(k % 5 == 1, "Shipped").when(k % 5 == 2, "Delivered").when(k % 5 == 3, "Processing"))
    return o.withColumn("j", F.explode(steps)).select(
        (k * 4 + j).alias("seq"), k.alias("order_id"), status.alias("new_status"),
        F.when(k % 7 != 3, 7 + j).cast("bigint").alias("staff_id"))


register("status_changes", """
    SELECT o_orderkey * 4 + j AS seq, o_orderkey AS order_id,
           CASE WHEN j = 1 OR j = 3 OR o_orderkey % 5 = 0 THEN 'Cancelled' WHEN j = 2 THEN 'Processing'
                WHEN o_orderkey % 5 = 1 THEN 'Shipped' WHEN o_orderkey % 5 = 2 THEN 'Delivered'
                WHEN o_orderkey % 5 = 3 THEN 'Processing' END AS new_status,
           CASE WHEN o_orderkey % 7 <> 3 THEN CAST(7 + j AS BIGINT) END AS staff_id
    FROM orders, (VALUES (0), (1), (2), (3)) AS v(j)
    WHERE j = 0 OR (j = 1 AND o_orderkey % 2 = 0) OR (j = 2 AND o_orderkey % 6 = 0)
       OR (j = 3 AND o_orderkey % 12 = 0)""")


def order_requests(ctx) -> DataFrame:
    """Checkout batch (request_id, user_id, item_id, quantity): every order with the
    quantities of its lines; items run out of stock.  Some lines hold no or a negative
    quantity, and some items are unknown to the shop."""
    o, li = ctx.raw["orders"], ctx.raw["lineitem"]
    units = (F.col("l_quantity").cast("int") % 4) - F.when(F.col("l_suppkey") % 9 == 0, 2).otherwise(0)
    item = F.when(F.col("l_partkey") % 61 == 0, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return (o.join(li, o.o_orderkey == li.l_orderkey)
            .select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"),
                    item.alias("item_id"), units.cast("int").alias("quantity")))


register("order_requests", """
    SELECT o_orderkey AS request_id, o_custkey AS user_id,
           CASE WHEN l_partkey % 61 = 0 THEN -1 - l_partkey ELSE l_partkey END AS item_id,
           CAST(trunc(l_quantity) AS INTEGER) % 4 - CASE WHEN l_suppkey % 9 = 0 THEN 2 ELSE 0 END AS quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
# the cart page's reading: one line per item, quantities below 1 dropped
register("checkout_lines", """
    SELECT q.request_id, q.user_id, q.item_id, CAST(sum(q.quantity) AS INTEGER) AS quantity,
           any_value(COALESCE(i.basePrice, 0)) AS unit_price, any_value(COALESCE(s.total, 0)) AS avail
    FROM order_requests q JOIN items i ON q.item_id = i.item_id
    LEFT JOIN (SELECT item_id, sum(stock) AS total FROM items_quant GROUP BY item_id) s ON q.item_id = s.item_id
    WHERE q.quantity >= 1 GROUP BY q.request_id, q.user_id, q.item_id""")


def order_discounts(ctx) -> DataFrame:
    """Coupon rows per checkout: every 3rd request carries ' discount10 ', every 6th twice."""
    ids = ctx.raw["orders"].select(F.col("o_orderkey").alias("request_id"))
    code = F.when(F.col("request_id") % 3 == 0, F.lit(" discount10 ")).otherwise(F.lit(None).cast("string"))
    first = ids.select("request_id", code.alias("coupon_code"))
    return first.unionByName(first.where(F.col("request_id") % 6 == 0))


register("order_discounts", """
    SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN ' discount10 ' END AS coupon_code FROM orders
    UNION ALL SELECT o_orderkey, ' discount10 ' FROM orders WHERE o_orderkey % 6 = 0""")


# -------------------------------------------------------- complaints, addresses

def complaint_requests(ctx) -> DataFrame:
    """Feedback form posts: some blank, some without a rating."""
    e = ctx.raw["events"].where(F.col("event_type") == "signup")
    k = F.col("event_id")
    return e.select(k.alias("request_id"), F.col("user_id"), F.col("ts"),
                    F.when(k % 9 == 0, F.lit("   "))
                     .otherwise(F.concat(F.lit(" feedback "), F.col("props"))).alias("description"),
                    F.when(k % 4 == 0, F.lit(None).cast("string"))
                     .otherwise((1 + k % 5).cast("string")).alias("rating"))


register("complaint_requests", """
    SELECT event_id AS request_id, user_id, ts,
           CASE WHEN event_id % 9 = 0 THEN '   ' ELSE concat(' feedback ', props) END AS description,
           CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS VARCHAR) END AS rating
    FROM events WHERE event_type = 'signup'""")


def complaint_changes(ctx) -> DataFrame:
    """Status edits of all complaints in sequence ``seq``, every 4th twice."""
    e, k, j = ctx.raw["events"].where(F.col("event_type") == "error"), F.col("event_id"), F.col("j")
    twice = F.filter(F.array(F.lit(0), F.lit(1)), lambda x: (x == 0) | (k % 4 == 0))
    return e.withColumn("j", F.explode(twice)).select(
        (k * 2 + j).alias("seq"), k.alias("complaint_id"),
        F.when(j == 1, "in_progress").when(k % 6 != 1, "resolved").alias("new_status"))


register("complaint_changes", """
    SELECT event_id * 2 + j AS seq, event_id AS complaint_id,
           CASE WHEN j = 1 THEN 'in_progress' WHEN event_id % 6 <> 1 THEN 'resolved' END AS new_status
    FROM events, (VALUES (0), (1)) AS v(j)
    WHERE event_type = 'error' AND (j = 0 OR event_id % 4 = 0)""")


def address_requests(ctx) -> DataFrame:
    """A new address form from every customer; every 24th is incomplete."""
    c = ctx.raw["customer"]
    k = F.col("c_custkey")
    return c.select(k.alias("request_id"), k.alias("user_id"),
                    F.lit("Punjab").alias("province"),
                    F.concat(F.lit("City "), (k % 13).cast("string")).alias("city"),
                    F.when(k % 24 == 0, F.lit("")).otherwise(F.lit("Model Town")).alias("area"),
                    (k % 300).cast("string").alias("houseNumber"))


register("address_requests", """
    SELECT c_custkey AS request_id, c_custkey AS user_id, 'Punjab' AS province,
           concat('City ', CAST(c_custkey % 13 AS VARCHAR)) AS city,
           CASE WHEN c_custkey % 24 = 0 THEN '' ELSE 'Model Town' END AS area,
           CAST(c_custkey % 300 AS VARCHAR) AS houseNumber
    FROM customer""")


def address_drops(ctx) -> DataFrame:
    c = ctx.raw["customer"].where(F.col("c_custkey") % 45 == 0)
    return c.select(F.col("c_custkey").alias("user_id"),
                    F.col("c_nationkey").cast("bigint").alias("addr_id"))


register("address_drops", """
    SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS addr_id
    FROM customer WHERE c_custkey % 45 = 0""")


def wishlist_clears(ctx) -> DataFrame:
    return ctx.raw["customer"].where(F.col("c_custkey") % 10 == 3).select(
        F.col("c_custkey").alias("user_id"))


register("wishlist_clears", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 10 = 3")


# ---------------------------------------------------------------- cart ops

def cart_ops(ctx) -> DataFrame:
    """Cart page posts derived from the click events: mostly 'add' (quantity
    0-3, raised to 1), some 'set' (-1..3 or no number; <= 0 removes), some 'remove',
    some 'update' (the posted cart replaces the user's whole cart)."""
    e = cart_events(ctx)
    k = F.col("event_id")
    op = F.when(k % 40 == 17, "update").when(k % 10 < 7, "add").when(k % 10 < 9, "set").otherwise("remove")
    qty = (F.when(k % 10 < 7, k % 4).when((k % 10 < 9) & (k % 15 != 8), k % 5 - 1)
            .otherwise(F.lit(None))).cast("int")
    return e.select("event_id", "ts", "user_id", "item_id", op.alias("op"), qty.alias("quantity"))


register("cart_ops", """
    SELECT event_id, ts, user_id, item_id,
           CASE WHEN event_id % 40 = 17 THEN 'update' WHEN event_id % 10 < 7 THEN 'add'
                WHEN event_id % 10 < 9 THEN 'set' ELSE 'remove' END AS op,
           CAST(CASE WHEN event_id % 10 < 7 THEN event_id % 4
                     WHEN event_id % 10 < 9 AND event_id % 15 <> 8 THEN event_id % 5 - 1 END AS INTEGER) AS quantity
    FROM cart_events""")


def cart_coupons(ctx) -> DataFrame:
    """Coupon codes typed on the cart page (some invalid, some users twice)."""
    c = ctx.raw["customer"]
    k = F.col("c_custkey")
    code = F.when(k % 8 == 1, F.lit(" discount10")).otherwise(F.lit("SAVE5"))
    first = c.select(k.alias("user_id"), code.alias("coupon_code"))
    return first.unionByName(first.where(F.col("user_id") % 5 == 0)
                             .withColumn("coupon_code", F.lit("Discount10 ")))


register("cart_coupons", """
    SELECT c_custkey AS user_id, CASE WHEN c_custkey % 8 = 1 THEN ' discount10' ELSE 'SAVE5' END
           AS coupon_code
    FROM customer
    UNION ALL SELECT c_custkey, 'Discount10 ' FROM customer WHERE c_custkey % 5 = 0""")
