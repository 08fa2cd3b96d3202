"""Registered change jobs (W1-W18, L10, J7, J8): each returns the changed
table of the new snapshot; the oracle is one SELECT over the old tables and
the change batch."""

from pyspark.sql import functions as F

from storelake.operators import cart as K
from storelake.operators import changes as W
from storelake.operators import stock as S
from storelake.operators import wishlist as WL
from storelake.plans.model_sql import register
from storelake.plans.quality_plans import _AUDIT_SQL
from storelake.plans.registry import query
from storelake.sources import requests as RQ

NOW = "2024-02-01 12:00:00"

register("first_variant_v",
         "SELECT item_id, min(itemQuant_id) AS itemQuant_id FROM items_quant GROUP BY item_id")

# ------------------------------------------------------------------ W1, W2, W5

register("registrations", f"""
    SELECT n.request_id, n.name, trim(n.email) AS email, n.phone, n.role, a.errors, a.n_errors,
           trim(n.email) IN (SELECT trim(email) FROM users) AS taken
    FROM new_users n JOIN ({_AUDIT_SQL}) a ON n.request_id = a.request_id""")
register("accepted_users", """
    SELECT * FROM registrations r
    WHERE n_errors = 0 AND NOT taken AND request_id = (
      SELECT min(request_id) FROM registrations o WHERE o.email = r.email AND o.n_errors = 0)""")


@query("register_users", f"""
    SELECT user_id, name, email, phone, role, notes, created_at FROM users
    UNION ALL
    SELECT (SELECT COALESCE(max(user_id), 0) FROM users)
             + row_number() OVER (ORDER BY request_id) AS user_id,
           trim(name), email, NULLIF(trim(phone), ''),
           CASE WHEN lower(trim(role)) IN ('customer', 'staff', 'admin') THEN lower(trim(role))
                ELSE 'customer' END,
           CAST(NULL AS VARCHAR), TIMESTAMP '{NOW}'
    FROM accepted_users""")
def register_users(t, ctx):
    return W.register_users(t, RQ.new_users(ctx), created_at=NOW)["users"]


@query("register_users_rejects", """
    SELECT request_id, CASE WHEN n_errors > 0 THEN errors ELSE 'duplicate_email' END AS reason
    FROM registrations WHERE request_id NOT IN (SELECT request_id FROM accepted_users)""")
def register_users_rejects(t, ctx):
    return W.register_users(t, RQ.new_users(ctx), created_at=NOW)["rejects"]


register("refused_patches", """
    SELECT seq FROM (
      WITH RECURSIVE asks AS (
        SELECT seq, user_id, trim(email) AS email, row_number() OVER (ORDER BY seq) AS n FROM user_patches
        WHERE trim(email) <> ''),
      served AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, TRUE AS ok,
               (SELECT map(list(trim(email)), list(user_id)) FROM users) AS holder,
               (SELECT map(list(user_id), list(trim(email))) FROM users) AS holds
        UNION ALL
        SELECT n, seq, ok,
               CASE WHEN ok THEN map_concat(holder, CASE WHEN holds[user_id] <> email
                 THEN map([holds[user_id], email], [NULL, user_id]) ELSE map([email], [user_id]) END) ELSE holder END,
               CASE WHEN ok THEN map_concat(holds, map([user_id], [email])) ELSE holds END
        FROM (SELECT a.n, a.seq, a.user_id, a.email, s.holder, s.holds,
                     COALESCE(s.holder[a.email], a.user_id) = a.user_id AS ok
              FROM served s JOIN asks a ON a.n = s.n + 1) step)
      SELECT seq, ok FROM served) replayed WHERE NOT ok""")
register("patch_walk", """
    SELECT * FROM (
      WITH RECURSIVE edits AS (
        SELECT p.*, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM user_patches p
        WHERE seq NOT IN (SELECT seq FROM refused_patches)),
      walk AS (
        SELECT user_id, CAST(0 AS BIGINT) AS rn, name, email, phone, role, notes FROM users
        UNION ALL
        SELECT w.user_id, e.rn, COALESCE(e.name, w.name), COALESCE(NULLIF(trim(e.email), ''), w.email),
               COALESCE(e.phone, w.phone),
               CASE WHEN lower(e.caller_role) = 'admin' THEN COALESCE(e.role, w.role) ELSE w.role END,
               CASE WHEN lower(e.caller_role) = 'admin' THEN COALESCE(e.notes, w.notes) ELSE w.notes END
        FROM walk w JOIN edits e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS back FROM walk) x WHERE back = 1""")


@query("patch_users", """
    SELECT w.user_id, w.name, w.email, w.phone, w.role, w.notes, u.created_at
    FROM patch_walk w JOIN users u ON w.user_id = u.user_id""")
def patch_users(t, ctx):
    return W.patch_users(t, RQ.user_patches(ctx))["users"]


@query("patch_users_rejects", "SELECT seq, 'duplicate_email' AS reason FROM refused_patches")
def patch_users_rejects(t, ctx):
    return W.patch_users(t, RQ.user_patches(ctx))["rejects"]


@query("delete_users", """
    SELECT order_id,
           CASE WHEN user_id IN (SELECT user_id FROM delete_users) THEN NULL ELSE user_id END
             AS user_id,
           order_date, order_status, totalPrice, staff_id
    FROM orders_v""")
def delete_users(t, ctx):
    return W.delete_users(t, RQ.delete_users(ctx))["orders"]


def _kept(table: str, key: str, gone: str) -> str:
    return f"SELECT * FROM {table} WHERE {key} IS NULL OR {key} NOT IN (SELECT {key} FROM {gone})"


def _register_deletes(job, prefix, batch, tables):
    """One registered query per table that a delete job leaves behind."""
    for table, sql in tables.items():
        def build(t, ctx, table=table):
            return job(t, batch(ctx))[table]
        query(f"{prefix}_{table}", sql)(build)


_register_deletes(W.delete_users, "delete_users", RQ.delete_users,
                  {n: _kept(n, "user_id", "delete_users") for n in ("users", "cart", "wishlist", "user_address")})


@query("delete_users_complaints", """
    SELECT * FROM complaint
    WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM delete_users)""")
def delete_users_complaints(t, ctx):
    return W.delete_users(t, RQ.delete_users(ctx))["complaint"]


# ------------------------------------------------------------------ W3, W4, W11

register("parsed_products", r"""
    SELECT request_id, item_id, trim(name) AS itemName,
           COALESCE(TRY_CAST(trim(price_text) AS DOUBLE), 0) AS basePrice,
           CAST(COALESCE(CASE WHEN regexp_matches(trim(stock_text), '^[+-]?\d+$')
                              THEN TRY_CAST(trim(stock_text) AS INTEGER) ELSE 0 END, 0) AS INTEGER)
             AS stock,
           trim(COALESCE(short_desc, '')) AS short_desc, trim(COALESCE(full_desc, '')) AS full_desc,
           image
    FROM product_changes
    WHERE COALESCE(octet_length(image) <= 5242880, true)""")
register("product_updates", """
    SELECT item_id, min(request_id) AS request_id, arg_max(itemName, request_id) AS itemName,
           arg_max(basePrice, request_id) AS basePrice, arg_max(stock, request_id) AS stock,
           arg_max(short_desc, request_id) AS short_desc, arg_max(full_desc, request_id) AS full_desc,
           arg_max(image, request_id) FILTER (WHERE image IS NOT NULL) AS image
    FROM parsed_products WHERE item_id IN (SELECT item_id FROM items) GROUP BY item_id""")
register("product_inserts", """
    SELECT p.*, (SELECT COALESCE(max(item_id), 0) FROM items)
                  + row_number() OVER (ORDER BY request_id) AS new_item_id
    FROM parsed_products p WHERE item_id IS NULL""")


@query("upsert_products", """
    SELECT i.item_id,
           CASE WHEN u.item_id IS NOT NULL THEN u.itemName ELSE i.itemName END AS itemName,
           CASE WHEN u.item_id IS NOT NULL THEN u.basePrice ELSE i.basePrice END AS basePrice,
           CASE WHEN u.item_id IS NOT NULL THEN u.short_desc ELSE i.short_desc END AS short_desc,
           CASE WHEN u.item_id IS NOT NULL THEN u.full_desc ELSE i.full_desc END AS full_desc,
           CASE WHEN COALESCE(u.image, i.image) IS NOT NULL THEN 1 ELSE 0 END AS has_image,
           CAST(octet_length(COALESCE(u.image, i.image)) AS INTEGER) AS image_bytes
    FROM items i LEFT JOIN product_updates u ON i.item_id = u.item_id
    UNION ALL
    SELECT new_item_id, itemName, basePrice, short_desc, full_desc,
           CASE WHEN image IS NOT NULL THEN 1 ELSE 0 END, CAST(octet_length(image) AS INTEGER)
    FROM product_inserts""")
def upsert_products(t, ctx):
    items = W.upsert_products(t, RQ.product_changes(ctx))["items"]
    return items.select("item_id", "itemName", "basePrice", "short_desc", "full_desc",
                        F.when(F.col("image").isNotNull(), 1).otherwise(0).alias("has_image"),
                        F.length("image").alias("image_bytes"))


@query("upsert_products_variants", """
    SELECT q.itemQuant_id, q.item_id,
           CASE WHEN u.item_id IS NOT NULL THEN 'default' ELSE q.color END AS color,
           CASE WHEN u.item_id IS NOT NULL THEN u.stock ELSE q.stock END AS stock,
           CASE WHEN u.item_id IS NOT NULL
                THEN concat_ws(' - ', NULLIF(u.short_desc, ''), NULLIF(u.full_desc, ''))
                ELSE q.description END AS description
    FROM items_quant q
    LEFT JOIN first_variant_v f ON q.itemQuant_id = f.itemQuant_id
    LEFT JOIN product_updates u ON u.item_id = f.item_id
    UNION ALL
    SELECT (SELECT max(itemQuant_id) FROM items_quant) + row_number() OVER (ORDER BY request_id),
           item_id, 'default', stock,
           concat_ws(' - ', NULLIF(short_desc, ''), NULLIF(full_desc, ''))
    FROM (SELECT request_id, item_id, stock, short_desc, full_desc FROM product_updates
          WHERE item_id NOT IN (SELECT item_id FROM items_quant)
          UNION ALL
          SELECT request_id, new_item_id, stock, short_desc, full_desc FROM product_inserts) n""")
def upsert_products_variants(t, ctx):
    return W.upsert_products(t, RQ.product_changes(ctx))["items_quant"]


@query("delete_products", """
    SELECT * FROM order_items WHERE itemQuant_id NOT IN (
      SELECT itemQuant_id FROM items_quant WHERE item_id IN (SELECT item_id FROM delete_items))""")
def delete_products(t, ctx):
    return W.delete_products(t, RQ.delete_items(ctx))["order_items"]


_DELETED_VARIANTS = "(SELECT itemQuant_id FROM items_quant WHERE item_id IN (SELECT item_id FROM delete_items))"
_register_deletes(W.delete_products, "delete_products", RQ.delete_items, {
    "items_quant": _kept("items_quant", "item_id", "delete_items"),
    "cart": f"SELECT * FROM cart WHERE itemQuant_id IS NULL OR itemQuant_id NOT IN {_DELETED_VARIANTS}",
    "wishlist": f"SELECT * FROM wishlist WHERE itemQuant_id IS NULL OR itemQuant_id NOT IN {_DELETED_VARIANTS}"})


@query("delete_products_items", """
    SELECT item_id, itemName, basePrice FROM items WHERE item_id NOT IN (SELECT item_id FROM delete_items)""")
def delete_products_items(t, ctx):
    return W.delete_products(t, RQ.delete_items(ctx))["items"].select("item_id", "itemName", "basePrice")


@query("upsert_products_rejects", """
    SELECT request_id, 'image_too_large' AS reason FROM product_changes WHERE octet_length(image) > 5242880
    UNION ALL
    SELECT request_id, 'unknown_item' FROM parsed_products
    WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM items)""")
def upsert_products_rejects(t, ctx):
    return W.upsert_products(t, RQ.product_changes(ctx))["rejects"]


@query("delete_products_bridge", """
    SELECT * FROM sub_category WHERE item_id NOT IN (SELECT item_id FROM delete_items)""")
def delete_products_bridge(t, ctx):
    return W.delete_products(t, RQ.delete_items(ctx))["sub_category"]


register("category_next", """
    SELECT cat_id, categoryName FROM category
    UNION ALL
    SELECT (SELECT COALESCE(max(cat_id), 0) FROM category) + row_number() OVER (ORDER BY first_req),
           categoryName
    FROM (SELECT trim(category_name) AS categoryName, min(request_id) AS first_req
          FROM category_assignments
          WHERE trim(category_name) NOT IN (SELECT categoryName FROM category)
          GROUP BY 1) n""")
register("assign_resolved", """
    SELECT min(a.request_id) AS request_id, a.item_id, c.cat_id,
           arg_max(COALESCE(NULLIF(trim(a.subcategory_name), ''), trim(a.category_name)), a.request_id) AS label
    FROM category_assignments a JOIN category_next c ON trim(a.category_name) = c.categoryName
    GROUP BY a.item_id, c.cat_id""")


@query("assign_categories", "SELECT cat_id, categoryName FROM category_next")
def assign_categories(t, ctx):
    return W.assign_categories(t, RQ.category_assignments(ctx))["category"]


@query("assign_categories_bridge", """
    SELECT s.subcat_id, s.cat_id, s.item_id, COALESCE(a.label, s.subCatName) AS subCatName
    FROM sub_category s LEFT JOIN assign_resolved a ON s.cat_id = a.cat_id AND s.item_id = a.item_id
    UNION ALL
    SELECT (SELECT max(subcat_id) FROM sub_category) + row_number() OVER (ORDER BY a.request_id),
           a.cat_id, a.item_id, a.label
    FROM assign_resolved a
    WHERE NOT EXISTS (SELECT 1 FROM sub_category s WHERE s.cat_id = a.cat_id
                                                     AND s.item_id = a.item_id)""")
def assign_categories_bridge(t, ctx):
    return W.assign_categories(t, RQ.category_assignments(ctx))["sub_category"]


# ------------------------------------------------------------------ W6-W8

register("status_steps", """
    SELECT s.order_id, s.seq, s.new_status, s.staff_id,
           COALESCE(lag(s.new_status) OVER (PARTITION BY s.order_id ORDER BY s.seq), o.order_status) AS before
    FROM status_changes s JOIN orders_v o ON o.order_id = s.order_id WHERE s.new_status IS NOT NULL""")


@query("apply_order_status", """
    SELECT q.itemQuant_id, q.item_id, q.color, CAST(q.stock + COALESCE(r.back, 0) AS INTEGER) AS stock,
           q.description
    FROM items_quant q LEFT JOIN (
      SELECT oi.itemQuant_id, sum(oi.quantity) AS back
      FROM status_steps s JOIN order_items oi ON oi.order_id = s.order_id
      WHERE s.new_status = 'Cancelled' AND s.before IS DISTINCT FROM 'Cancelled' GROUP BY oi.itemQuant_id) r
    ON q.itemQuant_id = r.itemQuant_id""")
def apply_order_status(t, ctx):
    return S.apply_order_status(t, RQ.status_changes(ctx))["items_quant"]


@query("apply_order_status_orders", """
    SELECT o.order_id, o.user_id, o.order_date, COALESCE(s.new_status, o.order_status) AS order_status,
           o.totalPrice, COALESCE(s.staff_id, o.staff_id) AS staff_id
    FROM orders_v o LEFT JOIN (
      SELECT order_id, arg_max(new_status, seq) AS new_status,
             arg_max(staff_id, seq) FILTER (WHERE staff_id IS NOT NULL) AS staff_id
      FROM status_steps GROUP BY order_id) s ON o.order_id = s.order_id""")
def apply_order_status_orders(t, ctx):
    return S.apply_order_status(t, RQ.status_changes(ctx))["orders"]


# The oracle replays the checkouts one by one, i.e. the shop's own sequence: a keyed
# recursive CTE holds the room left of every item, at key -1 the number of the last checkout,
# and at keys below it the outcome of each.
register("numbered_checkouts", """
    SELECT dense_rank() OVER (ORDER BY request_id) AS rn, request_id, item_id,
           CAST(quantity AS BIGINT) AS q, CAST(avail AS BIGINT) AS avail FROM checkout_lines""")
register("replayed_checkouts", """
    SELECT r.request_id, w.v = 1 AS admitted FROM (
      WITH RECURSIVE todo AS MATERIALIZED (SELECT * FROM numbered_checkouts),
      walk(k, v) USING KEY (k) AS (
        (SELECT DISTINCT item_id, avail FROM todo UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT))
        UNION
        (WITH mine AS (
           SELECT l.rn, l.item_id, r.v - l.q AS room, min(r.v - l.q) OVER () AS least
           FROM todo l JOIN recurring.walk r ON r.k = l.item_id
           WHERE l.rn = (SELECT max(v) + 1 FROM walk WHERE k = -1))
         SELECT item_id, room FROM mine WHERE least >= 0
         UNION ALL SELECT DISTINCT CAST(-1 AS BIGINT), rn FROM mine
         UNION ALL SELECT DISTINCT -1 - rn, CAST(least >= 0 AS BIGINT) FROM mine))
      SELECT -1 - k AS rn, v FROM walk WHERE k < -1) w
    JOIN (SELECT DISTINCT rn, request_id FROM numbered_checkouts) r ON r.rn = w.rn""")
register("admitted_lines", """
    SELECT l.* FROM checkout_lines l JOIN replayed_checkouts a ON l.request_id = a.request_id WHERE a.admitted""")
register("new_orders_v", f"""
    SELECT r.request_id,
           (SELECT max(order_id) FROM orders_v) + row_number() OVER (ORDER BY r.request_id) AS order_id,
           r.user_id, TIMESTAMP '{NOW}' AS order_date, 'Processing' AS order_status,
           r.subtotal - COALESCE(d.discount, 0.0) AS totalPrice, r.subtotal, CAST(0 AS BIGINT) AS staff_id
    FROM (SELECT request_id, user_id,
                 CAST(sum(CAST(unit_price AS DECIMAL(18,2)) * quantity) AS DOUBLE) AS subtotal
          FROM admitted_lines GROUP BY request_id, user_id) r
    LEFT JOIN (SELECT request_id, max(CAST(CASE WHEN upper(trim(coupon_code)) = 'DISCOUNT10' THEN 10.0 ELSE 0.0 END AS DOUBLE))
                        AS discount FROM order_discounts GROUP BY request_id) d ON r.request_id = d.request_id""")
register("stock_after_checkout", """
    SELECT q.itemQuant_id, q.item_id, q.color, CAST(q.stock - COALESCE(s.sold, 0) AS INTEGER) AS stock, q.description
    FROM items_quant q LEFT JOIN (
      SELECT f.itemQuant_id, sum(r.quantity) AS sold
      FROM admitted_lines r JOIN first_variant_v f ON r.item_id = f.item_id GROUP BY f.itemQuant_id) s
    ON q.itemQuant_id = s.itemQuant_id""")


def _placed(t, ctx):
    return S.place_orders(t, RQ.order_requests(ctx), RQ.order_discounts(ctx), order_date=NOW)


@query("place_orders", """
    SELECT order_id, user_id, order_date, order_status, totalPrice, staff_id FROM new_orders_v""")
def place_orders(t, ctx):
    return _placed(t, ctx)["new_orders"]


@query("place_orders_lines", """
    SELECT (SELECT max(orderItem_id) FROM order_items)
             + row_number() OVER (ORDER BY o.order_id, q.item_id) AS orderItem_id,
           o.order_id, f.itemQuant_id, q.quantity, q.unit_price * q.quantity AS price
    FROM admitted_lines q JOIN new_orders_v o ON q.request_id = o.request_id
    JOIN first_variant_v f ON q.item_id = f.item_id""")
def place_orders_lines(t, ctx):
    return _placed(t, ctx)["new_order_items"]


@query("place_orders_stock", "SELECT *, stock < 0 AS negative_stock FROM stock_after_checkout")
def place_orders_stock(t, ctx):
    return _placed(t, ctx)["items_quant"]


@query("place_orders_rejects", """
    SELECT DISTINCT q.request_id, CAST(NULL AS BIGINT) AS item_id,
           CASE WHEN q.request_id IN (SELECT request_id FROM checkout_lines) THEN 'out_of_stock'
                ELSE 'no_valid_line' END AS reason
    FROM order_requests q WHERE q.request_id NOT IN (SELECT request_id FROM admitted_lines)
    UNION ALL
    SELECT request_id, item_id, 'no_variant' FROM admitted_lines
    WHERE item_id NOT IN (SELECT item_id FROM first_variant_v)""")
def place_orders_rejects(t, ctx):
    return _placed(t, ctx)["rejects"]


_CHECKED = """
    SELECT r.request_id, COALESCE(a.admitted, false) AS admitted
    FROM (SELECT DISTINCT request_id FROM order_requests) r
    LEFT JOIN replayed_checkouts a ON r.request_id = a.request_id"""


@query("check_stock", _CHECKED)
def check_stock(t, ctx):
    return S.check_stock(t, RQ.order_requests(ctx))


@query("place_orders_exact", _CHECKED)
def place_orders_exact(t, ctx):
    """The placed checkouts, seen from the batch: exact sequential admission."""
    rejects = _placed(t, ctx)["rejects"].where(F.col("item_id").isNull()).select("request_id", F.lit(False).alias("admitted"))
    return (RQ.order_requests(ctx).select("request_id").distinct().join(rejects, "request_id", "left")
            .select("request_id", F.coalesce("admitted", F.lit(True)).alias("admitted")))


# ------------------------------------------------------------------ W9, W10

@query("file_complaints", """
    SELECT * FROM complaint
    UNION ALL
    SELECT (SELECT max(complaint_id) FROM complaint) + row_number() OVER (ORDER BY request_id),
           user_id, concat('[Star Rating: ', COALESCE(rating, '5'), '/5] ', trim(description)),
           'Pending', ts
    FROM complaint_requests WHERE trim(description) <> ''""")
def file_complaints(t, ctx):
    return W.file_complaints(t, RQ.complaint_requests(ctx))["complaint"]


@query("set_complaint_status", """
    SELECT c.complaint_id, c.user_id, c.message, COALESCE(x.new_status, c.status) AS status,
           c.created_at
    FROM complaint c LEFT JOIN (
      SELECT complaint_id, arg_max(new_status, seq) AS new_status FROM complaint_changes
      WHERE new_status IS NOT NULL GROUP BY complaint_id) x ON c.complaint_id = x.complaint_id""")
def set_complaint_status(t, ctx):
    return W.set_complaint_status(t, RQ.complaint_changes(ctx))["complaint"]


# ------------------------------------------------------------------ W12, W13

register("address_ok", """
    SELECT *, (SELECT max(addr_id) FROM address) + row_number() OVER (ORDER BY request_id) AS addr_id,
           (SELECT max(id) FROM user_address) + row_number() OVER (ORDER BY request_id) AS link_id
    FROM address_requests
    WHERE trim(COALESCE(province, '')) <> '' AND trim(COALESCE(city, '')) <> ''
      AND trim(COALESCE(area, '')) <> '' AND trim(COALESCE(houseNumber, '')) <> ''""")


@query("add_addresses", """
    SELECT * FROM address
    UNION ALL
    SELECT addr_id, trim(province), trim(city), trim(area), trim(houseNumber) FROM address_ok""")
def add_addresses(t, ctx):
    return W.add_addresses(t, RQ.address_requests(ctx))["address"]


@query("add_addresses_links", """
    SELECT * FROM user_address UNION ALL SELECT link_id, user_id, addr_id FROM address_ok""")
def add_addresses_links(t, ctx):
    return W.add_addresses(t, RQ.address_requests(ctx))["user_address"]


@query("add_addresses_rejects", """
    SELECT request_id, 'incomplete' AS reason FROM address_requests
    WHERE request_id NOT IN (SELECT request_id FROM address_ok)""")
def add_addresses_rejects(t, ctx):
    return W.add_addresses(t, RQ.address_requests(ctx))["rejects"]


@query("drop_addresses_rows", "SELECT * FROM address WHERE addr_id NOT IN (SELECT addr_id FROM address_drops)")
def drop_addresses_rows(t, ctx):
    return W.drop_addresses(t, RQ.address_drops(ctx))["address"]


@query("drop_addresses", """
    SELECT * FROM user_address WHERE addr_id NOT IN (SELECT addr_id FROM address_drops)""")
def drop_addresses(t, ctx):
    return W.drop_addresses(t, RQ.address_drops(ctx))["user_address"]


# ------------------------------------------------------------------ wishlist

register("wish_pairs", """
    SELECT w.event_id, w.user_id, w.item_id, f.itemQuant_id
    FROM wishlist_events w JOIN first_variant_v f ON w.item_id = f.item_id""")


@query("in_wishlist", """
    SELECT p.user_id, p.itemQuant_id,
           EXISTS (SELECT 1 FROM wishlist w WHERE w.user_id = p.user_id
                                              AND w.itemQuant_id = p.itemQuant_id) AS in_wishlist
    FROM (SELECT user_id, item_id * 4 + event_id % 3 AS itemQuant_id FROM wishlist_events) p""")
def in_wishlist(t, ctx):
    pairs = RQ.wishlist_events(ctx).select(
        "user_id", (F.col("item_id") * 4 + F.col("event_id") % 3).alias("itemQuant_id"))
    return WL.in_wishlist(t, pairs)


@query("wishlist_items", """
    SELECT w.user_id, w.wishlist_id, w.itemQuant_id, i.item_id, i.itemName, i.basePrice
    FROM (SELECT user_id, itemQuant_id, max(wishlist_id) AS wishlist_id FROM wishlist
          GROUP BY user_id, itemQuant_id) w
    JOIN items_quant q ON w.itemQuant_id = q.itemQuant_id JOIN items i ON q.item_id = i.item_id
    ORDER BY w.user_id, w.wishlist_id DESC""")
def wishlist_items(t, ctx):
    return WL.wishlist_items(t)


@query("flag_wishlisted", """
    SELECT DISTINCT v.user_id, v.item_id,
           EXISTS (SELECT 1 FROM wishlist w JOIN items_quant q ON w.itemQuant_id = q.itemQuant_id
                   WHERE w.user_id = v.user_id AND q.item_id = v.item_id) AS in_wishlist
    FROM wishlist_events v""")
def flag_wishlisted(t, ctx):
    return WL.flag_wishlisted(t, RQ.wishlist_events(ctx))


@query("add_wishlist", """
    SELECT * FROM wishlist
    UNION ALL
    SELECT (SELECT max(wishlist_id) FROM wishlist) + row_number() OVER (ORDER BY event_id),
           user_id, itemQuant_id
    FROM (SELECT user_id, itemQuant_id, min(event_id) AS event_id FROM wish_pairs
          GROUP BY user_id, itemQuant_id) p
    WHERE NOT EXISTS (SELECT 1 FROM wishlist w WHERE w.user_id = p.user_id
                                               AND w.itemQuant_id = p.itemQuant_id)""")
def add_wishlist(t, ctx):
    return WL.add_wishlist(t, RQ.wishlist_events(ctx))["wishlist"]


@query("toggle_wishlist", """
    SELECT w.wishlist_id, w.user_id, w.itemQuant_id FROM wishlist w
    WHERE NOT EXISTS (SELECT 1 FROM wish_pairs p WHERE p.user_id = w.user_id
                        AND p.itemQuant_id = w.itemQuant_id
                      GROUP BY p.user_id, p.itemQuant_id HAVING count(*) % 2 = 1)
    UNION ALL
    SELECT (SELECT max(wishlist_id) FROM wishlist) + row_number() OVER (ORDER BY last_event),
           user_id, itemQuant_id
    FROM (SELECT user_id, itemQuant_id, max(event_id) AS last_event FROM wish_pairs
          GROUP BY user_id, itemQuant_id HAVING count(*) % 2 = 1) t
    WHERE NOT EXISTS (SELECT 1 FROM wishlist w WHERE w.user_id = t.user_id
                                               AND w.itemQuant_id = t.itemQuant_id)""")
def toggle_wishlist(t, ctx):
    return WL.toggle_wishlist(t, RQ.wishlist_events(ctx))["wishlist"]


@query("clear_wishlist", """
    SELECT c.user_id, CAST(count(w.wishlist_id) AS BIGINT) AS deleted_items
    FROM wishlist_clears c LEFT JOIN wishlist w ON c.user_id = w.user_id GROUP BY c.user_id""")
def clear_wishlist(t, ctx):
    return WL.clear_wishlist(t, RQ.wishlist_clears(ctx))["deleted"]


_register_deletes(WL.clear_wishlist, "clear_wishlist", RQ.wishlist_clears,
                  {"wishlist": _kept("wishlist", "user_id", "wishlist_clears")})


# ------------------------------------------------------------------ cart

# an update also removes every other item the user ever named
register("cart_steps", """
    SELECT event_id, user_id, item_id, op, quantity FROM cart_ops
    WHERE item_id IS NOT NULL AND user_id IS NOT NULL
    UNION ALL
    SELECT DISTINCT u.event_id, u.user_id, p.item_id, 'remove', CAST(NULL AS INTEGER)
    FROM cart_ops u JOIN (SELECT DISTINCT user_id, item_id FROM cart_ops WHERE item_id IS NOT NULL) p
      ON p.user_id = u.user_id
    WHERE u.op = 'update' AND u.item_id IS NOT NULL
      AND p.item_id NOT IN (SELECT q.item_id FROM cart_ops q WHERE q.event_id = u.event_id)""")
register("cart_state", """
    SELECT user_id, item_id, state AS quantity FROM (
      WITH RECURSIVE ev AS (
        SELECT o.user_id, o.item_id, o.op, o.quantity, COALESCE(s.total, 0) AS stock,
               row_number() OVER (PARTITION BY o.user_id, o.item_id ORDER BY o.event_id) AS rn
        FROM cart_steps o
        LEFT JOIN (SELECT item_id, sum(stock) AS total FROM items_quant GROUP BY item_id) s
          ON o.item_id = s.item_id),
      fold AS (
        SELECT user_id, item_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS state
        FROM ev GROUP BY user_id, item_id
        UNION ALL
        SELECT e.user_id, e.item_id, e.rn,
               CASE WHEN e.op = 'add' THEN
                      CASE WHEN f.state + greatest(COALESCE(e.quantity, 1), 1) > e.stock THEN f.state
                           ELSE f.state + greatest(COALESCE(e.quantity, 1), 1) END
                    WHEN e.op IN ('set', 'update') AND e.quantity IS NOT NULL THEN greatest(least(e.quantity, e.stock), 0)
                    ELSE 0 END
        FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.item_id = f.item_id AND e.rn = f.rn + 1)
      SELECT user_id, item_id, arg_max(state, rn) AS state FROM fold GROUP BY user_id, item_id
    ) x WHERE state > 0""")


@query("fold_cart", "SELECT user_id, item_id, CAST(quantity AS INTEGER) AS quantity FROM cart_state")
def fold_cart(t, ctx):
    return K.fold_cart(t, RQ.cart_ops(ctx))


@query("price_cart", """
    SELECT c.user_id, count(*) AS n_lines, CAST(sum(c.quantity) AS BIGINT) AS n_units,
           CAST(sum(CAST(COALESCE(i.basePrice, 0) * c.quantity AS DECIMAL(20,2))) AS DOUBLE) AS subtotal,
           COALESCE(max(d.discount), 0) AS discount,
           CAST(sum(CAST(COALESCE(i.basePrice, 0) * c.quantity AS DECIMAL(20,2))) AS DOUBLE) AS grand_total,
           CAST(sum(CAST(COALESCE(i.basePrice, 0) * c.quantity AS DECIMAL(20,2))) AS DOUBLE)
             - COALESCE(max(d.discount), 0) AS checkout_total
    FROM cart_state c JOIN items i ON c.item_id = i.item_id
    LEFT JOIN (SELECT user_id, max(CAST(CASE WHEN upper(trim(coupon_code)) = 'DISCOUNT10' THEN 10.0
                                        ELSE 0.0 END AS DOUBLE)) AS discount FROM cart_coupons GROUP BY user_id) d
      ON c.user_id = d.user_id
    GROUP BY c.user_id""")
def price_cart(t, ctx):
    return K.price_cart(t, K.fold_cart(t, RQ.cart_ops(ctx)), RQ.cart_coupons(ctx))
