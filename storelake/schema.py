"""Fixed schemas of the twelve shop tables and their declared relationships."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _D, _S, _B, _TS = (T.LongType(), T.IntegerType(), T.DoubleType(),
                           T.StringType(), T.BinaryType(), T.TimestampNTZType())


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(("user_id", _L, False), ("name", _S, False), ("email", _S, False),
                     ("phone", _S, True), ("role", _S, True), ("notes", _S, True),
                     ("created_at", _TS, True)),
    "category": _struct(("cat_id", _L, False), ("categoryName", _S, False)),
    "items": _struct(("item_id", _L, False), ("itemName", _S, False), ("basePrice", _D, False),
                     ("short_desc", _S, True), ("full_desc", _S, True), ("image", _B, True)),
    "sub_category": _struct(("subcat_id", _L, False), ("cat_id", _L, True), ("item_id", _L, True),
                            ("subCatName", _S, True)),
    "items_quant": _struct(("itemQuant_id", _L, False), ("item_id", _L, True), ("color", _S, True),
                           ("stock", _I, True), ("description", _S, True)),
    "orders": _struct(("order_id", _L, False), ("user_id", _L, True), ("order_date", _TS, True),
                      ("order_status", _S, True), ("totalPrice", _D, True), ("staff_id", _L, True)),
    "order_items": _struct(("orderItem_id", _L, False), ("order_id", _L, True),
                           ("itemQuant_id", _L, True), ("quantity", _I, True), ("price", _D, True)),
    "cart": _struct(("cart_id", _L, False), ("user_id", _L, True), ("itemQuant_id", _L, True),
                    ("quantity", _I, True)),
    "wishlist": _struct(("wishlist_id", _L, False), ("user_id", _L, True), ("itemQuant_id", _L, True)),
    "complaint": _struct(("complaint_id", _L, False), ("user_id", _L, True), ("message", _S, True),
                         ("status", _S, True), ("created_at", _TS, True)),
    "address": _struct(("addr_id", _L, False), ("province", _S, True), ("city", _S, True),
                       ("area", _S, True), ("houseNumber", _S, True)),
    "user_address": _struct(("id", _L, False), ("user_id", _L, True), ("addr_id", _L, True)),
}

TABLE_NAMES = tuple(SCHEMAS)

PRIMARY_KEYS = {
    "users": "user_id", "category": "cat_id", "items": "item_id", "sub_category": "subcat_id",
    "items_quant": "itemQuant_id", "orders": "order_id", "order_items": "orderItem_id",
    "cart": "cart_id", "wishlist": "wishlist_id", "complaint": "complaint_id",
    "address": "addr_id", "user_address": "id",
}

# The declared foreign keys of the shop schema, as
# (child table, child column, parent table, parent column).
FOREIGN_KEYS = (
    ("sub_category", "cat_id", "category", "cat_id"),
    ("sub_category", "item_id", "items", "item_id"),
    ("items_quant", "item_id", "items", "item_id"),
    ("orders", "user_id", "users", "user_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "itemQuant_id", "items_quant", "itemQuant_id"),
    ("cart", "user_id", "users", "user_id"),
    ("cart", "itemQuant_id", "items_quant", "itemQuant_id"),
    ("wishlist", "user_id", "users", "user_id"),
    ("wishlist", "itemQuant_id", "items_quant", "itemQuant_id"),
    ("complaint", "user_id", "users", "user_id"),
    ("user_address", "user_id", "users", "user_id"),
    ("user_address", "addr_id", "address", "addr_id"),
)

# NOT NULL columns of the shop schema (besides primary keys).
NOT_NULL = (
    ("users", "name"), ("users", "email"), ("category", "categoryName"),
    ("items", "itemName"), ("items", "basePrice"),
)

# Vocabularies used by the shop.
ORDER_STATUSES = ("Processing", "Shipped", "Delivered", "Cancelled")
ROLES = ("customer", "staff", "admin")
COMPLAINT_STATUSES = ("open", "in_progress", "resolved")
