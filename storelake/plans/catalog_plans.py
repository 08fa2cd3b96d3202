"""Registered catalog queries."""

from pyspark.sql import functions as F

from storelake.functions.text import sql_contains_term
from storelake.operators import catalog as C
from storelake.plans.model_sql import register
from storelake.plans.registry import query
from storelake.sources.requests import cart_item_ids, wishlist_item_ids, wishlist_events

_ITEM_COLS = ("i.item_id, i.itemName, i.basePrice, i.short_desc, i.full_desc, "
              "CASE WHEN i.image IS NOT NULL THEN 1 ELSE 0 END AS has_image")


# per item: units over all variants, and the name of the category with the lowest bridge id
register("units_in_stock", "SELECT item_id, sum(stock) AS units FROM items_quant GROUP BY item_id")
register("shown_category", """
    SELECT item_id, arg_min(categoryName, subcat_id) AS shown FROM sub_category JOIN category USING (cat_id) GROUP BY item_id""")
register("product_rows", """
    SELECT item_id, itemName, basePrice, COALESCE(short_desc, '') AS short_desc, COALESCE(full_desc, '') AS full_desc,
           CAST(COALESCE(units, 0) AS BIGINT) AS total_stock, CAST(image IS NOT NULL AS INTEGER) AS has_image,
           COALESCE(shown, '') AS category
    FROM items LEFT JOIN units_in_stock USING (item_id) LEFT JOIN shown_category USING (item_id)""")
_NEWEST_FIRST = " ORDER BY item_id DESC"


@query("list_products", "SELECT * FROM product_rows" + _NEWEST_FIRST)
def list_products(t, ctx):
    return C.list_products(t)


SEARCH_TERM = "Gear"


@query("search_products", f"SELECT * FROM product_rows WHERE {sql_contains_term('itemName', SEARCH_TERM)}" + _NEWEST_FIRST)
def search_products(t, ctx):
    return C.search_products(t, SEARCH_TERM)


@query("inventory_snapshot", """
    SELECT item_id, itemName, basePrice, itemQuant_id, color, stock, v.description, CAST(image IS NOT NULL AS INTEGER) AS has_image
    FROM items_quant v RIGHT JOIN items USING (item_id) ORDER BY item_id, itemQuant_id""")
def inventory_snapshot(t, ctx):
    return C.inventory_snapshot(t)


@query("list_categories", "SELECT cat_id, categoryName FROM category ORDER BY categoryName")
def list_categories(t, ctx):
    return C.list_categories(t)


FETCH_CATEGORY, FETCH_SEARCH = "PROMO", "ro"


register("category_members", "SELECT item_id, list(categoryName) AS names FROM sub_category JOIN category USING (cat_id) GROUP BY item_id")


@query("fetch_items", f"""
    SELECT item_id, itemName, basePrice, short_desc, full_desc, CAST(image IS NOT NULL AS INTEGER) AS has_image
    FROM items SEMI JOIN (SELECT item_id FROM category_members WHERE list_contains(names, '{FETCH_CATEGORY}')) m USING (item_id)
    WHERE {sql_contains_term('itemName', FETCH_SEARCH)}""")
def fetch_items(t, ctx):
    items = C.fetch_items(t, category=FETCH_CATEGORY, search=FETCH_SEARCH)
    return items.select("item_id", "itemName", "basePrice", "short_desc", "full_desc",
                        C.has_image().alias("has_image"))


def _shop_sql(page: int, where: str) -> str:
    return f"""
    SELECT f.item_id, f.itemName, f.basePrice, f.short_desc, f.full_desc, f.has_image,
           p.current_page, p.total_pages
    FROM (SELECT {_ITEM_COLS}, row_number() OVER (ORDER BY i.item_id) AS rn
          FROM items i {where}) f,
         (SELECT CAST(greatest(1, least({page}, n.total_pages)) AS BIGINT) AS current_page,
                 n.total_pages
          FROM (SELECT CAST(greatest(1, ceil(count(*) / 12.0)) AS BIGINT) AS total_pages
                FROM items i {where}) n) p
    WHERE f.rn > (p.current_page - 1) * 12 AND f.rn <= p.current_page * 12"""


@query("shop_page", _shop_sql(2, f"WHERE {sql_contains_term('i.itemName', 'gear')}"))
def shop_page(t, ctx):
    return C.shop_page(t, page=2, q="gear")


_LARGE = """WHERE i.item_id IN (SELECT s.item_id FROM sub_category s JOIN category c
                                 ON s.cat_id = c.cat_id WHERE c.categoryName = 'LARGE')"""


@query("shop_page_clamped", _shop_sql(9999, _LARGE))
def shop_page_clamped(t, ctx):
    return C.shop_page(t, page=9999, category="LARGE")


@query("featured_items", f"SELECT {_ITEM_COLS} FROM items i ORDER BY i.item_id LIMIT 6")
def featured_items(t, ctx):
    return C.featured_items(t)


@query("first_variant_rows", """
    SELECT itemQuant_id, item_id, color, stock, description FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY itemQuant_id) AS rn
      FROM items_quant) q WHERE rn = 1""")
def first_variant_rows(t, ctx):
    return C.first_variant_rows(t)


@query("first_category", "SELECT item_id, shown AS category FROM shown_category")
def first_category(t, ctx):
    return C.first_category(t)


_CART_IDS = "(SELECT DISTINCT item_id FROM cart_events)"
_WISH_IDS = "(SELECT DISTINCT item_id FROM wishlist_events)"


@query("items_by_ids", f"""
    SELECT {_ITEM_COLS} FROM items i WHERE i.item_id IN {_CART_IDS}""")
def items_by_ids(t, ctx):
    return C.items_by_ids(t, cart_item_ids(ctx)).select(
        "item_id", "itemName", "basePrice", "short_desc", "full_desc",
        C.has_image().alias("has_image"))


@query("item_by_id", """
    SELECT w.event_id, w.user_id, i.item_id, i.itemName, i.basePrice
    FROM wishlist_events w JOIN items i ON w.item_id = i.item_id""")
def item_by_id(t, ctx):
    req = wishlist_events(ctx).select("event_id", "user_id", "item_id")
    return C.item_by_request(t, req).select("event_id", "user_id", "item_id", "itemName",
                                            "basePrice")


@query("product_images", f"""
    SELECT item_id, hex(image) AS image_hex FROM items
    WHERE octet_length(image) > 0 AND item_id IN {_CART_IDS}""")
def product_images(t, ctx):
    imgs = C.product_images(t, cart_item_ids(ctx))
    return imgs.select("item_id", F.hex("image").alias("image_hex"))


@query("product_card", f"""
    SELECT p.* EXCLUDE (total_stock), v.itemQuant_id, v.color, v.stock, v.description
    FROM product_rows p LEFT JOIN (
      SELECT item_id, min(itemQuant_id) AS itemQuant_id, arg_min(color, itemQuant_id) AS color,
             arg_min(stock, itemQuant_id) AS stock, arg_min(description, itemQuant_id) AS description
      FROM items_quant GROUP BY item_id) v ON v.item_id = p.item_id
    WHERE p.item_id IN {_CART_IDS}""")
def product_card(t, ctx):
    return C.product_card(t, cart_item_ids(ctx))


@query("item_stock", f"""
    SELECT k.item_id, CAST(COALESCE((SELECT SUM(stock) FROM items_quant q
                                     WHERE q.item_id = k.item_id), 0) AS BIGINT) AS total_stock
    FROM {_CART_IDS} k""")
def item_stock(t, ctx):
    return C.item_stock(t, cart_item_ids(ctx))


@query("product_categories", f"""
    SELECT s.item_id, c.cat_id, c.categoryName, s.subcat_id, s.subCatName
    FROM sub_category s JOIN category c ON s.cat_id = c.cat_id
    WHERE s.item_id IN {_WISH_IDS}""")
def product_categories(t, ctx):
    return C.product_categories(t, wishlist_item_ids(ctx))


@query("first_variant", f"""
    SELECT item_id, min(itemQuant_id) AS itemQuant_id FROM items_quant
    WHERE item_id IN {_WISH_IDS} GROUP BY item_id""")
def first_variant(t, ctx):
    return C.first_variant(t, wishlist_item_ids(ctx))
