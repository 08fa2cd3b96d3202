"""Wishlist operators.

The shop stores variant ids in the wishlist and reads them back through the
variant table (K14: always joined through variants here).  Saving the
wishlist rewrites it, so only the resulting set of (user, variant) pairs
matters; jobs below compute that set with joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.operators.catalog import first_variant
from storelake.operators.sequence import max_id, new_ids
from storelake.session import materialize
from storelake.sources.model import Tables


def in_wishlist(t: Tables, pairs: DataFrame) -> DataFrame:
    """For each (user_id, itemQuant_id) pair whether it is in the wishlist."""
    present = t.wishlist.select("user_id", "itemQuant_id").distinct().withColumn("_p", F.lit(True))
    return (pairs.select("user_id", "itemQuant_id")
            .join(present, ["user_id", "itemQuant_id"], "left")
            .select("user_id", "itemQuant_id", F.coalesce("_p", F.lit(False)).alias("in_wishlist")))


def wishlist_items(t: Tables, user_ids: DataFrame | None = None) -> DataFrame:
    """The users' wishlist as item rows, newest entry first, each variant
    once (the first = newest entry wins, as the page de-duplicates)."""
    w = t.wishlist
    if user_ids is not None:
        w = w.join(user_ids.select("user_id"), "user_id", "left_semi")
    firsts = w.groupBy("user_id", "itemQuant_id").agg(F.max("wishlist_id").alias("wishlist_id"))
    return (firsts.join(t.items_quant.select("itemQuant_id", "item_id"), "itemQuant_id")
            .join(t.items.select("item_id", "itemName", "basePrice"), "item_id")
            .select("user_id", "wishlist_id", "itemQuant_id", "item_id", "itemName", "basePrice")
            .orderBy(F.asc("user_id"), F.desc("wishlist_id")))


def flag_wishlisted(t: Tables, shown: DataFrame) -> DataFrame:
    """Every (user_id, item_id) shown to a user on a catalog page (T1/T2),
    flagged when the user wishlisted the item."""
    liked = (t.wishlist.select("user_id", "itemQuant_id")
             .join(t.items_quant.select("itemQuant_id", "item_id"), "itemQuant_id")
             .select("user_id", "item_id").distinct().withColumn("_p", F.lit(True)))
    return (shown.select("user_id", "item_id").distinct().join(liked, ["user_id", "item_id"], "left")
            .select("user_id", "item_id", F.coalesce("_p", F.lit(False)).alias("in_wishlist")))


def wishlist_pairs(t: Tables, events: DataFrame) -> DataFrame:
    """Item-level wishlist requests mapped to the item's first variant; items
    without a variant are ignored (the shop redirects without saving)."""
    return (events.select("event_id", "user_id", "item_id")
            .join(first_variant(t), "item_id")
            .select("event_id", "user_id", "item_id", "itemQuant_id"))


def add_wishlist(t: Tables, events: DataFrame) -> dict[str, DataFrame]:
    """Insert (user, variant) pairs not yet present; within the batch the
    first request of a pair is inserted."""
    pairs = wishlist_pairs(t, events)
    firsts = pairs.groupBy("user_id", "itemQuant_id").agg(F.min("event_id").alias("event_id"))
    fresh = firsts.join(t.wishlist.select("user_id", "itemQuant_id"), ["user_id", "itemQuant_id"],
                        "left_anti")
    rows = new_ids(fresh, "event_id", max_id(t.wishlist, "wishlist_id"), "wishlist_id")
    inserted = rows.select("wishlist_id", "user_id", "itemQuant_id")
    return {"wishlist": t.wishlist.unionByName(inserted), "new_wishlist": inserted}


def toggle_wishlist(t: Tables, events: DataFrame) -> dict[str, DataFrame]:
    """Each event toggles (user, item's first variant); a pair is present
    at the end iff it was present XOR it was toggled an odd number of times.
    Surviving rows keep their id; new pairs get new ids in order of their
    last toggle."""
    pairs = wishlist_pairs(t, events)
    toggles = pairs.groupBy("user_id", "itemQuant_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    odd = toggles.where(F.col("n") % 2 == 1).select("user_id", "itemQuant_id", "last_event")
    # one join of the pair table, written once: rows that stay, and pairs that are new
    met = materialize(t.wishlist.select("wishlist_id", "user_id", "itemQuant_id")
                      .join(odd, ["user_id", "itemQuant_id"], "full_outer")
                      .where("wishlist_id IS NULL OR last_event IS NULL"), "toggled")
    added = new_ids(met.where("wishlist_id IS NULL").drop("wishlist_id"), "last_event",
                    max_id(t.wishlist, "wishlist_id"), "wishlist_id")
    keep = met.where("wishlist_id IS NOT NULL").select("wishlist_id", "user_id", "itemQuant_id")
    return {"wishlist": keep.unionByName(added.select("wishlist_id", "user_id", "itemQuant_id"))}


def clear_wishlist(t: Tables, user_ids: DataFrame) -> dict[str, DataFrame]:
    """Delete every wishlist row of the users; report rows deleted per user."""
    ids = user_ids.select("user_id").distinct()
    counts = (t.wishlist.join(ids, "user_id", "left_semi")
              .groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    report = (ids.join(counts, "user_id", "left")
              .select("user_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("deleted_items")))
    return {"wishlist": t.wishlist.join(ids, "user_id", "left_anti"), "deleted": report}

