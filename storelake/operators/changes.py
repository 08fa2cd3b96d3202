"""Table-to-table change jobs for users, catalog, complaints and addresses
(W1-W5, W9-W13).

Every job takes the current snapshot plus a change DataFrame and returns the
new table DataFrames (and rejects where rows can be refused).  Deletes are
``left_anti`` joins; patches are a left join plus ``coalesce``; inserts get
ids from ``sequence.new_ids`` (max id + rank in request order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.functions.parse import form_price, form_stock, image_within_limit
from storelake.functions.text import variant_description
from storelake.operators.catalog import first_variant
from storelake.operators.emails import refused_changes
from storelake.operators.joins import left_anti_dim, left_join_dim
from storelake.operators.quality import broken_rules, normalized_role
from storelake.operators.sequence import max_id, new_ids
from storelake.session import materialize
from storelake.sources.model import Tables, _conform

# ------------------------------------------------------------------- users


def register_users(t: Tables, batch: DataFrame, created_at: str | None = None
                   ) -> dict[str, DataFrame]:
    """Insert registrations that pass the form rules (Q1) and whose e-mail
    is new; inside the batch the first request for an e-mail wins.  Roles are
    normalised (Q5); the default is 'customer'."""
    broken = broken_rules()
    marked = batch.withColumns({"email": F.trim("email"), "_errors": F.array_join(broken, "; ")})
    taken = t.users.select(F.trim("email").alias("email"), F.lit(True).alias("_taken")).distinct()
    marked = marked.join(taken, "email", "left")
    usable = (F.col("_errors") == "") & F.col("_taken").isNull()
    firsts = marked.where(usable).groupBy("email").agg(F.min("request_id").alias("_first"))
    # both outputs read the annotated batch: write it once
    marked = materialize(marked.join(firsts, "email", "left").withColumn(
        "_in", F.coalesce(usable & (F.col("request_id") == F.col("_first")), F.lit(False))), "registrations")
    when = (F.current_timestamp().cast("timestamp_ntz") if created_at is None
            else F.lit(created_at).cast("timestamp_ntz"))
    rows = new_ids(marked.where("_in"), "request_id", max_id(t.users, "user_id"), "user_id")
    inserted = _conform(rows.select(
        "user_id", F.trim("name").alias("name"), "email",
        F.nullif(F.trim("phone"), F.lit("")).alias("phone"),
        normalized_role().alias("role"), F.lit(None).cast("string").alias("notes"),
        when.alias("created_at")), "users")
    rejects = marked.where("NOT _in").select(
        "request_id", F.when(F.col("_errors") != "", F.col("_errors")).otherwise("duplicate_email").alias("reason"))
    return {"users": t.users.unionByName(inserted), "new_users": inserted, "rejects": rejects}


def _last(column: str, when=None) -> "F.Column":
    """The last value of ``column`` by ``seq`` that is not NULL (and meets ``when``)."""
    counts = F.col(column).isNotNull() if when is None else F.col(column).isNotNull() & when
    return F.max_by(column, F.when(counts, F.col("seq")))


def patch_users(t: Tables, patches: DataFrame) -> dict[str, DataFrame]:
    """Profile edits, one after another by ``seq``.  NULL fields leave the
    value as it is; role and notes change only when the caller is an admin.

    An edit is refused whole when its (trimmed) e-mail belongs to another user at that moment: an
    e-mail that a user has given up earlier in the batch is free (``emails.refused_changes``).
    """
    p = materialize(patches.withColumn("email", F.nullif(F.trim("email"), F.lit(""))), "edits")
    owned = t.users.select("user_id", F.trim("email").alias("email"))
    refused = materialize(refused_changes(owned, p.where(F.col("email").isNotNull())), "refused-edits")
    admin = F.lower(F.col("caller_role")) == "admin"
    folded = p.join(refused, "seq", "left_anti").groupBy("user_id").agg(
        *[_last(c).alias(f"_{c}") for c in ("name", "email", "phone")],
        *[_last(c, admin).alias(f"_{c}") for c in ("role", "notes")])
    fields = ("name", "email", "phone", "role", "notes")
    out = t.users.join(folded, "user_id", "left").select(
        "user_id", *[F.coalesce(f"_{c}", c).alias(c) for c in fields], "created_at")
    return {"users": out, "rejects": refused.select("seq", F.lit("duplicate_email").alias("reason"))}


def delete_users(t: Tables, user_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove users with their carts, wishlists, complaints and address
    links; their orders stay with a NULL user (K19)."""
    ids = user_ids.select("user_id").distinct()
    gone = ids.withColumn("_gone", F.lit(True))
    orders = (left_join_dim(t.orders, gone, "user_id")
              .withColumn("user_id", F.when(F.col("_gone"), F.lit(None).cast("bigint"))
                          .otherwise(F.col("user_id")))
              .select(*t.orders.columns))

    def drop(df):
        return left_anti_dim(df, ids, "user_id")

    return {"users": drop(t.users), "cart": drop(t.cart), "wishlist": drop(t.wishlist),
            "complaint": drop(t.complaint), "user_address": drop(t.user_address),
            "orders": orders}


# ----------------------------------------------------------------- catalog

def upsert_products(t: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Product form posts, one after another by request_id.  Rows with an
    existing item_id update the item and its first variant (created when missing; the last
    post of an item counts, its image is the last one given); rows without item_id insert
    an item and one 'default' variant.  Image NULL keeps the stored one, empty
    bytes clear it; images over 5 MB are rejected.  Prices and stocks are
    parsed as the form does (F9); descriptions are trimmed and the variant
    description is F4 of the two."""
    parsed = changes.select(
        "request_id", "item_id", F.trim("name").alias("itemName"),
        form_price(F.col("price_text")).alias("basePrice"),
        F.coalesce(form_stock(F.col("stock_text")), F.lit(0)).alias("stock"),
        F.trim(F.coalesce("short_desc", F.lit(""))).alias("short_desc"),
        F.trim(F.coalesce("full_desc", F.lit(""))).alias("full_desc"),
        "image", image_within_limit(F.col("image")).alias("_ok"))
    rejects = parsed.where(~F.col("_ok")).select("request_id", F.lit("image_too_large").alias("reason"))
    ok = parsed.where(F.col("_ok")).drop("_ok")

    known = t.items.select("item_id")
    upd = (ok.where(F.col("item_id").isNotNull()).join(known, "item_id", "left_semi").groupBy("item_id")
           .agg(F.min("request_id").alias("request_id"),
                *[F.max_by(c, "request_id").alias(c) for c in ("itemName", "basePrice", "stock", "short_desc", "full_desc")],
                F.max_by("image", F.when(F.col("image").isNotNull(), F.col("request_id"))).alias("image")))
    unknown = (ok.where(F.col("item_id").isNotNull()).join(known, "item_id", "left_anti")
               .select("request_id", F.lit("unknown_item").alias("reason")))
    ins = new_ids(ok.where(F.col("item_id").isNull()).drop("item_id"), "request_id",
                  max_id(t.items, "item_id"), "item_id")

    u = upd.select("item_id", F.lit(True).alias("_hit"),
                   *[F.col(c).alias(f"_{c}") for c in
                     ("itemName", "basePrice", "short_desc", "full_desc", "image")])
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    items_upd = (t.items.join(u, "item_id", "left")
                 .select("item_id",
                         *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
                           for c in ("itemName", "basePrice", "short_desc", "full_desc")],
                         F.coalesce("_image", "image").alias("image")))
    items_out = items_upd.unionByName(
        ins.select("item_id", "itemName", "basePrice", "short_desc", "full_desc", "image"))

    # variants: updates hit the first variant; items without one (and new
    # items) get a new 'default' variant
    desc = variant_description(F.col("short_desc"), F.col("full_desc"))
    firsts = first_variant(t).select("item_id", F.col("itemQuant_id").alias("_first"))
    upd_v = (upd.select("request_id", "item_id", "stock", desc.alias("description"))
             .join(firsts, "item_id", "left"))
    v_patch = upd_v.where(F.col("_first").isNotNull()).select(
        F.col("_first").alias("itemQuant_id"), F.col("stock").alias("_stock"),
        F.col("description").alias("_desc"))
    iq = (t.items_quant.join(v_patch, "itemQuant_id", "left")
          .select("itemQuant_id", "item_id",
                  F.when(F.col("_stock").isNotNull(), F.lit("default")).otherwise(F.col("color"))
                   .alias("color"),
                  F.coalesce("_stock", "stock").alias("stock"),
                  F.coalesce("_desc", "description").alias("description")))
    needs = (upd_v.where(F.col("_first").isNull()).select("request_id", "item_id", "stock",
                                                         "description")
             .unionByName(ins.select("request_id", "item_id", "stock", desc.alias("description"))))
    new_v = new_ids(needs, "request_id", max_id(t.items_quant, "itemQuant_id"), "itemQuant_id")
    iq_out = iq.unionByName(new_v.select("itemQuant_id", "item_id", F.lit("default").alias("color"),
                                         F.col("stock").cast("int").alias("stock"), "description"))
    return {"items": _conform(items_out, "items"), "items_quant": _conform(iq_out, "items_quant"),
            "rejects": rejects.unionByName(unknown)}


def delete_products(t: Tables, item_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove items with their variants and every row pointing at those
    variants (order lines, carts, wishlists) or at the item (category bridge)."""
    ids = item_ids.select("item_id").distinct()
    variants = t.items_quant.join(ids, "item_id", "left_semi").select("itemQuant_id")
    # rows without a variant (or item) are kept, and spread: they would all meet in one reducer
    by_variant = lambda df: left_anti_dim(df, variants, "itemQuant_id")
    by_item = lambda df: left_anti_dim(df, ids, "item_id")
    return {"items": by_item(t.items), "items_quant": by_item(t.items_quant),
            "sub_category": by_item(t.sub_category), "order_items": by_variant(t.order_items),
            "cart": by_variant(t.cart), "wishlist": by_variant(t.wishlist)}


def assign_categories(t: Tables, assignments: DataFrame) -> dict[str, DataFrame]:
    """Put items into categories by name, creating missing categories
    (ids in order of first request).  An existing (category, item) row gets
    the new label; otherwise a bridge row is added.  Of several requests for
    one row the last gives the label, the first the place among new rows.  The label defaults to the
    category name."""
    a = assignments.select("request_id", "item_id", F.trim("category_name").alias("categoryName"),
                           F.coalesce(F.nullif(F.trim("subcategory_name"), F.lit("")),
                                      F.trim("category_name")).alias("label"))
    missing = (a.join(t.category.select("categoryName"), "categoryName", "left_anti")
               .groupBy("categoryName").agg(F.min("request_id").alias("_first")))
    new_cats = new_ids(missing, "_first", max_id(t.category, "cat_id"), "cat_id").select(
        "cat_id", "categoryName")
    # the new category table and the resolved batch are small and each is
    # read several times below: write them once to the shared checkpoint folder
    category_out = materialize(t.category.unionByName(new_cats), "categories")
    resolved = materialize(a.join(category_out, "categoryName").groupBy("cat_id", "item_id").agg(
        F.max_by("label", "request_id").alias("label"), F.min("request_id").alias("request_id")), "assignments")
    existing = resolved.join(t.sub_category.select("cat_id", "item_id"), ["cat_id", "item_id"],
                             "left_semi")
    relabel = existing.select("cat_id", "item_id", F.col("label").alias("_label"))
    bridge = (t.sub_category.join(relabel, ["cat_id", "item_id"], "left")
              .withColumn("subCatName", F.coalesce("_label", "subCatName")).drop("_label"))
    adds = resolved.join(t.sub_category.select("cat_id", "item_id"), ["cat_id", "item_id"],
                         "left_anti")
    adds = new_ids(adds, "request_id", max_id(t.sub_category, "subcat_id"), "subcat_id")
    bridge_out = bridge.unionByName(adds.select("subcat_id", "cat_id", "item_id",
                                                F.col("label").alias("subCatName")))
    return {"category": _conform(category_out, "category"),
            "sub_category": _conform(bridge_out, "sub_category")}


# -------------------------------------------------------- complaints, addresses

RATING_DEFAULT = "5"


def file_complaints(t: Tables, requests: DataFrame) -> dict[str, DataFrame]:
    """Feedback intake.  Blank texts are dropped; the rating defaults to 5;
    the stored message is '[Star Rating: r/5] text' with status 'Pending'."""
    text = F.trim("description")
    kept = requests.where(text != "")
    msg = F.concat(F.lit("[Star Rating: "), F.coalesce("rating", F.lit(RATING_DEFAULT)),
                   F.lit("/5] "), text)
    rows = new_ids(kept, "request_id", max_id(t.complaint, "complaint_id"), "complaint_id")
    inserted = _conform(rows.select("complaint_id", "user_id", msg.alias("message"),
                                    F.lit("Pending").alias("status"),
                                    F.col("ts").alias("created_at")), "complaint")
    return {"complaint": t.complaint.unionByName(inserted), "new_complaints": inserted}


def set_complaint_status(t: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """New status for the listed complaints; the last change by ``seq`` counts."""
    ch = (changes.where(F.col("new_status").isNotNull()).groupBy("complaint_id")
          .agg(F.max_by("new_status", "seq").alias("new_status")))
    out = (t.complaint.join(ch, "complaint_id", "left")
           .withColumn("status", F.coalesce("new_status", "status")).drop("new_status"))
    return {"complaint": out.select(*t.complaint.columns)}


ADDRESS_FIELDS = ("province", "city", "area", "houseNumber")


def add_addresses(t: Tables, requests: DataFrame) -> dict[str, DataFrame]:
    """Insert an address and link it to the user; all four fields are
    required (blank ones reject the form)."""
    complete = F.lit(True)
    for c in ADDRESS_FIELDS:
        complete = complete & (F.trim(F.coalesce(c, F.lit(""))) != "")
    ok = requests.where(complete)
    addr = new_ids(ok, "request_id", max_id(t.address, "addr_id"), "addr_id")
    addr_rows = addr.select("addr_id", *[F.trim(c).alias(c) for c in ADDRESS_FIELDS])
    links = new_ids(addr.select("request_id", "user_id", "addr_id"), "request_id",
                    max_id(t.user_address, "id"), "id")
    rejects = requests.where(~complete).select("request_id", F.lit("incomplete").alias("reason"))
    return {"address": t.address.unionByName(_conform(addr_rows, "address")),
            "user_address": t.user_address.unionByName(
                _conform(links.select("id", "user_id", "addr_id"), "user_address")),
            "rejects": rejects}


def drop_addresses(t: Tables, drops: DataFrame) -> dict[str, DataFrame]:
    """Remove the user's link and the address row itself; other users'
    links to that address go with it (K18, ON DELETE CASCADE)."""
    addr_ids = drops.select("addr_id").distinct()
    return {"address": t.address.join(addr_ids, "addr_id", "left_anti"),
            "user_address": t.user_address.join(addr_ids, "addr_id", "left_anti")}
