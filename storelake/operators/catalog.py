"""Catalog operators: listings, searches, product cards, paging, lookups.

Single-id fetches of the shop become key-set operators: they take a
DataFrame of ids and join it, so one job answers any number of requests.
Key sets are joined (``left_semi`` / inner), never turned into a giant
``isin`` literal on the driver.

Scale notes
-----------
* Stock is pre-aggregated per item from the variants *before* joining items.
* "First category" is ``min_by(categoryName, subcat_id)`` per item: a
  partial aggregate, no correlated subquery and no per-item sort.
* "First variant" is a ``row_number() = 1`` window, which Spark plans as a
  ``WindowGroupLimit`` so each task keeps one row per item before the shuffle.
* Item rows carry a BLOB; listings project ``has_image`` before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelake.functions.text import contains_term
from storelake.operators.reports import variant_stock_per_item
from storelake.sources.model import Tables

PAGE_SIZE = 12
PAGE_RANGE = 1 << 16       # items that are sorted for a page
FEATURED = 6


def has_image(image: Column | None = None) -> Column:
    image = F.col("image") if image is None else image
    return F.when(image.isNotNull(), 1).otherwise(0)


def first_category(t: Tables) -> DataFrame:
    """R2: (item_id, category) = category of the lowest subcat_id per item."""
    return (t.sub_category.join(t.category, "cat_id")
            .groupBy("item_id")
            .agg(F.min_by("categoryName", "subcat_id").alias("category")))


def first_variant_rows(t: Tables) -> DataFrame:
    """The full row of the lowest itemQuant_id of every item."""
    w = Window.partitionBy("item_id").orderBy("itemQuant_id")
    return (t.items_quant.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn"))


def first_variant(t: Tables, item_ids: DataFrame | None = None) -> DataFrame:
    """(item_id, itemQuant_id) of the lowest variant; items without one
    are absent."""
    firsts = t.items_quant.groupBy("item_id").agg(F.min("itemQuant_id").alias("itemQuant_id"))
    if item_ids is not None:
        firsts = firsts.join(item_ids.select("item_id"), "item_id", "left_semi")
    return firsts


def _product_rows(t: Tables, items: DataFrame) -> DataFrame:
    """Shape shared by list_products and search_products."""
    return (items.select("item_id", "itemName", "basePrice",
                         F.coalesce("short_desc", F.lit("")).alias("short_desc"),
                         F.coalesce("full_desc", F.lit("")).alias("full_desc"),
                         has_image().alias("has_image"))
            .join(variant_stock_per_item(t), "item_id", "left")
            .join(first_category(t), "item_id", "left")
            .select("item_id", "itemName", "basePrice", "short_desc", "full_desc",
                    F.coalesce("stock_sum", F.lit(0)).cast("bigint").alias("total_stock"),
                    "has_image",
                    F.coalesce("category", F.lit("")).alias("category")))


def list_products(t: Tables) -> DataFrame:
    """Every product with total stock, has_image and first category; newest id first."""
    return _product_rows(t, t.items).orderBy(F.desc("item_id"))


def _around(t: Tables, items: DataFrame) -> Tables:
    """The snapshot with variants and category rows of these items only, so
    that stock and labels are computed for them and not for the whole catalog."""
    ids = items.select("item_id")
    return t.with_(items_quant=t.items_quant.join(ids, "item_id", "left_semi"),
                   sub_category=t.sub_category.join(ids, "item_id", "left_semi"))


def search_products(t: Tables, q: str) -> DataFrame:
    """list_products restricted to names containing ``q`` (K7 search)."""
    items = t.items.where(contains_term("itemName", q))
    return _product_rows(_around(t, items), items).orderBy(F.desc("item_id"))


def inventory_snapshot(t: Tables) -> DataFrame:
    """Every item with each of its variants (items without variants kept)."""
    return (t.items.select("item_id", "itemName", "basePrice", has_image().alias("has_image"))
            .join(t.items_quant.select("item_id", "itemQuant_id", "color", "stock", "description"),
                  "item_id", "left")
            .select("item_id", "itemName", "basePrice", "itemQuant_id", "color", "stock",
                    "description", "has_image")
            .orderBy("item_id", "itemQuant_id"))


def list_categories(t: Tables) -> DataFrame:
    """Categories alphabetically (also the shop's fetch_categories)."""
    return t.category.select("cat_id", "categoryName").orderBy("categoryName", "cat_id")


def fetch_items(t: Tables, category: str | None = None, subcategory: str | None = None,
                search: str | None = None) -> DataFrame:
    """Items, optionally filtered by category name, sub-category label and a
    name search; one row per item.

    The category filters are an existence test on the bridge, so they are a
    ``left_semi`` join: an item in several matching categories still yields
    one row and no GROUP BY over item rows (which carry the image) is needed.
    """
    items = t.items
    if search:
        items = items.where(contains_term("itemName", search))
    if category or subcategory:
        bridge = t.sub_category
        if subcategory:
            bridge = bridge.where(F.col("subCatName") == subcategory)
        if category:
            cats = t.category.where(F.col("categoryName") == category).select("cat_id")
            bridge = bridge.join(cats, "cat_id", "left_semi")
        items = items.join(bridge.select("item_id"), "item_id", "left_semi")
    return items


def shop_page(t: Tables, page: int = 1, category: str | None = None,
              subcategory: str | None = None, q: str | None = None,
              page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of the shop listing, page clamped to [1, total_pages].

    Returns the page's items (without the image bytes) with ``current_page``
    and ``total_pages``.  Items are counted first; the ids around the page are estimated
    (approximate quantiles), the items below them are counted exactly, and only items between
    them are sorted: ``PAGE_RANGE`` or so, whatever the depth of the page.
    """
    items = fetch_items(t, category, subcategory, q).select(
        "item_id", "itemName", "basePrice", "short_desc", "full_desc",
        has_image().alias("has_image"))
    n = items.count()
    total_pages = max(1, -(-n // page_size))
    current = max(1, min(page, total_pages))
    first, near = (current - 1) * page_size, items
    if n > PAGE_RANGE:
        first, near = _page_range(items, first, page_size, n)
    return (near.orderBy("item_id").offset(first).limit(page_size)
            .select("*", F.lit(current).cast("bigint").alias("current_page"),
                    F.lit(total_pages).cast("bigint").alias("total_pages")).orderBy("item_id"))


def _page_range(items: DataFrame, first: int, size: int, n: int) -> tuple[int, DataFrame]:
    """Items of an id range that holds the places first..first + size - 1 of all ``n``, and how many
    of the range come before."""
    width = PAGE_RANGE / 2
    while True:
        ends = [max(0.0, (first - width) / n), min(1.0, (first + size + width) / n)]
        lo, hi = items.agg(F.percentile_approx("item_id", ends, int(min(1 << 30, max(10_000, 4 * n // PAGE_RANGE))))).first()[0]
        below, inside = items.agg(F.count(F.when(F.col("item_id") < lo, 1)),
                                  F.count(F.when(F.col("item_id").between(lo, hi), 1))).first()
        if below <= first and (first + size <= below + inside or below + inside == n):
            return first - below, items.where(F.col("item_id").between(lo, hi))
        width *= 2                  # the estimate was too narrow


def featured_items(t: Tables, n: int = FEATURED) -> DataFrame:
    """The first ``n`` items by id (home page)."""
    return (t.items.select("item_id", "itemName", "basePrice", "short_desc", "full_desc",
                           has_image().alias("has_image"))
            .orderBy("item_id").limit(n))


# ------------------------------------------------------------- key lookups

def items_by_ids(t: Tables, ids: DataFrame) -> DataFrame:
    """L3: item rows for a set of ids (empty set -> empty result)."""
    return t.items.join(ids.select("item_id"), "item_id", "left_semi")


def item_by_request(t: Tables, requests: DataFrame) -> DataFrame:
    """L4: one item row per request (request columns kept, unknown ids dropped)."""
    return requests.join(t.items, "item_id")


def product_images(t: Tables, ids: DataFrame) -> DataFrame:
    """(item_id, image) for requested items with a non-empty image."""
    return (t.items.select("item_id", "image")
            .where(F.length("image") > 0)
            .join(ids.select("item_id"), "item_id", "left_semi"))


def product_card(t: Tables, ids: DataFrame) -> DataFrame:
    """Item with its first variant (K10) and first category (K9), per id."""
    items = t.items.join(ids.select("item_id"), "item_id", "left_semi")
    t = _around(t, ids)
    return (items.select("item_id", "itemName", "basePrice",
                         F.coalesce("short_desc", F.lit("")).alias("short_desc"),
                         F.coalesce("full_desc", F.lit("")).alias("full_desc"),
                         has_image().alias("has_image"))
            .join(first_variant_rows(t), "item_id", "left")
            .join(first_category(t), "item_id", "left")
            .select("item_id", "itemName", "basePrice", "short_desc", "full_desc", "has_image",
                    "itemQuant_id", "color", "stock", "description",
                    F.coalesce("category", F.lit("")).alias("category")))


def item_stock(t: Tables, ids: DataFrame) -> DataFrame:
    """Total stock per requested item id, 0 when it has no variants."""
    keys = ids.select("item_id").distinct()
    return (keys.join(variant_stock_per_item(t), "item_id", "left")
            .select("item_id", F.coalesce("stock_sum", F.lit(0)).cast("bigint").alias("total_stock")))


def product_categories(t: Tables, ids: DataFrame) -> DataFrame:
    """Every (category, sub-category) association of the requested items."""
    return (t.sub_category.join(ids.select("item_id"), "item_id", "left_semi")
            .join(t.category, "cat_id")
            .select("item_id", "cat_id", "categoryName", "subcat_id", "subCatName"))
