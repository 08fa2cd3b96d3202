"""The twelve shop tables as DataFrames.

``load_model(spark, sf_dir)`` derives them from the driver's parquet tables
(rules in FIXTURES.md); ``Tables.read_snapshot`` reads a snapshot that one of
our change jobs wrote.  Everything stays lazy: building the model reads
nothing, and Catalyst prunes every column and window a query does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelake.schema import SCHEMAS, TABLE_NAMES
from storelake.sources.driver import read_driver
from storelake.sources.snapshots import ORDER_MONTH, Layout, Store  # noqa: F401


# SQL view names that differ from the model names.
SQL_VIEW_NAMES = {"orders": "orders_v"}
# The shop's own names of tables that differ from the model's.
SHOP_NAMES = {"orders": "Orders", "items_quant": "ItemsQuant", "order_items": "OrderItems",
              "sub_category": "SubCategory", "user_address": "UserAddress"}


class Tables:
    """The twelve shop tables.  Values may be DataFrames or zero-argument
    builders; a builder runs on first access, so a query only analyses the
    tables it touches."""

    def __init__(self, **tables):
        unknown = set(tables) - set(TABLE_NAMES)
        if unknown or len(tables) != len(TABLE_NAMES):
            raise ValueError(f"need exactly the tables {TABLE_NAMES}, got {sorted(tables)}")
        self._src = dict(tables)
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._src:
            raise AttributeError(name)
        if name not in self._cache:
            value = self._src[name]
            self._cache[name] = value if isinstance(value, DataFrame) else value()
        return self._cache[name]

    def with_(self, **changed) -> "Tables":
        """A new snapshot with some tables replaced."""
        merged = {n: (self._cache[n] if n in self._cache else self._src[n]) for n in TABLE_NAMES}
        merged.update(changed)
        return Tables(**merged)

    def apply(self, result: dict[str, DataFrame]) -> "Tables":
        """The snapshot after a change job: takes the job's table outputs
        (``orders``, ``items_quant``, ...) and ignores its reports
        (``rejects``, ``new_orders``, ...)."""
        return self.with_(**{k: v for k, v in result.items() if k in TABLE_NAMES})

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def register_views(self) -> None:
        """Expose every table to ``spark.sql`` under its SQL view name
        (``orders_v`` for the orders, the model name otherwise)."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(SQL_VIEW_NAMES.get(name, name))
            if name in SHOP_NAMES:
                df.createOrReplaceTempView(SHOP_NAMES[name])

    def write_snapshot(self, path: str, orders_by_month: bool = False,
                       layouts: dict[str, Layout] | None = None) -> None:
        """Commit all tables as the next version of the store at ``path`` (``snapshots.Store``).

        A job that dies on the way leaves the version before as it was.
        ``orders_by_month`` partitions the orders by ``order_month`` ('YYYY-MM'), so date-bounded
        reads prune whole folders.
        """
        layouts = dict(layouts or {})
        if orders_by_month:
            layouts["orders"] = Layout(month_of="order_date")
        tables = self.as_dict()
        Store(tables["orders"].sparkSession, path, SCHEMAS, layouts).commit(replace=tables)

    @staticmethod
    def read_snapshot(spark: SparkSession, path: str, orders_by_month: bool = False,
                      version: int | None = None) -> "Tables":
        """The last committed version (or ``version``) with the fixed schemas.  With ``orders_by_month``
        the orders keep their ``order_month`` partition column, which
        date-range operators use for partition pruning."""
        store = Store(spark, path, SCHEMAS)
        found = store.version(version)
        if found is None:
            raise FileNotFoundError(f"no snapshot is committed at {path}")
        return Tables(**{name: (lambda n=name: store.read(n, found.number, months=orders_by_month and n == "orders"))
                         for name in SCHEMAS})


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the fixed schema of table ``name`` (column order and types)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def json_key(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("bigint")


# ---------------------------------------------------------------- model views

def users_view(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return _conform(customer.select(
        k.alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.when(k % 7 == 0, None)
         .otherwise(F.concat(F.lit("03"), F.lpad(k.cast("string"), 9, "0"))).alias("phone"),
        F.when(k % 50 == 0, "admin").when(k % 10 == 0, "staff").otherwise("customer").alias("role"),
        F.when(k % 3 == 0, F.col("c_mktsegment")).alias("notes"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int"))
         .cast("timestamp_ntz").alias("created_at"),
    ), "users")


def orders_view(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "P", "Processing")
               .when(F.col("o_orderstatus") == "F", "Delivered")
               .when(F.col("o_orderpriority") == "1-URGENT", "Cancelled")
               .otherwise("Shipped"))
    return _conform(orders.select(
        k.alias("order_id"),
        F.when(F.col("o_custkey") % 97 == 5, None).otherwise(F.col("o_custkey")).alias("user_id"),
        F.col("o_orderdate").alias("order_date"),
        status.alias("order_status"),
        F.col("o_totalprice").alias("totalPrice"),
        ((k % 15) * 10).alias("staff_id"),
    ), "orders")


def items_view(part: DataFrame) -> DataFrame:
    return _conform(part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("itemName"),
        F.col("p_retailprice").alias("basePrice"),
        F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_brand")).alias("short_desc"),
        F.concat_ws(" ", "p_type", "p_name").alias("full_desc"),
        F.when(F.col("p_size") % 4 == 0, None).otherwise(F.col("p_name").cast("binary")).alias("image"),
    ), "items")


def items_quant_view(part: DataFrame) -> DataFrame:
    # Variant colours by variant number 0, 1, 2.
    colors = F.array(F.lit("default"), F.lit("black"), F.lit("white"))
    k = F.col("k")
    exploded = part.select(
        "p_partkey", "p_brand",
        F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)),
                           lambda v: v < F.col("p_size") % 4)).alias("k"))
    return _conform(exploded.select(
        (F.col("p_partkey") * 4 + k).alias("itemQuant_id"),
        F.col("p_partkey").alias("item_id"),
        F.element_at(colors, k + 1).alias("color"),
        ((F.col("p_partkey") * 7 + k * 5) % 13).cast("int").alias("stock"),
        F.col("p_brand").alias("description"),
    ), "items_quant")


def category_view(part: DataFrame) -> DataFrame:
    # distinct first: the window then sees one row per type (a vocabulary)
    types = part.select("p_type").distinct()
    return _conform(types.select(
        F.row_number().over(Window.orderBy("p_type")).alias("cat_id"),
        F.col("p_type").alias("categoryName"),
    ), "category")


def sub_category_view(part: DataFrame, category: DataFrame) -> DataFrame:
    bridged = (part.where(F.col("p_partkey") % 11 != 0)
               .select("p_partkey", "p_type", "p_brand",
                       F.explode(F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(0), F.lit(1)))
                                  .otherwise(F.array(F.lit(0)))).alias("j"))
               .join(category.withColumnRenamed("categoryName", "p_type"), "p_type"))
    return _conform(bridged.select(
        (F.col("p_partkey") * 2 + F.col("j")).alias("subcat_id"),
        F.when(F.col("j") == 0, F.col("cat_id")).otherwise(F.col("cat_id") % 6 + 1).alias("cat_id"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("subCatName"),
    ), "sub_category")


LINE_IDS = 100_000   # line ids set aside for each order, so ids are unique across the table


def order_items_view(lineitem: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return _conform(lineitem.select(
        (F.col("l_orderkey") * LINE_IDS + F.row_number().over(w)).alias("orderItem_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_partkey") * 4 + F.col("l_suppkey") % 3).alias("itemQuant_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    ), "order_items")


def address_view(nation: DataFrame, region: DataFrame) -> DataFrame:
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return _conform(joined.select(
        F.col("n_nationkey").alias("addr_id"),
        F.col("r_name").alias("province"),
        F.col("n_name").alias("city"),
        F.lit("Central").alias("area"),
        F.lit("1").alias("houseNumber"),
    ), "address")


def user_address_view(customer: DataFrame) -> DataFrame:
    return _conform(customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").alias("addr_id"),
    ), "user_address")


def complaint_view(events: DataFrame) -> DataFrame:
    e = events.where(F.col("event_type") == "error")
    eid = F.col("event_id")
    # Complaint status by event_id % 4.
    status = (F.when(eid % 4 == 0, "open").when(eid % 4 == 1, "Pending")
               .when(eid % 4 == 2, "in_progress").otherwise("resolved"))
    return _conform(e.select(
        eid.alias("complaint_id"),
        F.when(F.col("user_id") % 23 == 7, None).otherwise(F.col("user_id")).alias("user_id"),
        F.concat(F.lit("[Star Rating: "), (1 + eid % 5).cast("string"), F.lit("/5] "),
                 F.col("props")).alias("message"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
    ), "complaint")


def wishlist_view(events: DataFrame) -> DataFrame:
    e = events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id",
        (json_key(F.col("props")) * 4 + F.col("event_id") % 3).alias("itemQuant_id"))
    return _conform(e.groupBy("user_id", "itemQuant_id")
                     .agg(F.min("event_id").alias("wishlist_id")), "wishlist")


def cart_view(events: DataFrame) -> DataFrame:
    e = events.where(F.col("event_type") == "signup")
    return _conform(e.select(
        F.col("event_id").alias("cart_id"),
        F.col("user_id"),
        (json_key(F.col("props")) * 4).alias("itemQuant_id"),
        (1 + F.col("event_id") % 3).cast("int").alias("quantity"),
    ), "cart")


def cart_events_view(events: DataFrame) -> DataFrame:
    """One row per add-to-cart click: (event_id, ts, user_id, item_id, quantity)."""
    e = events.where(F.col("event_type") == "click")
    return e.select("event_id", "ts", "user_id",
                    json_key(F.col("props")).alias("item_id"),
                    (1 + F.col("event_id") % 3).cast("int").alias("quantity"))


def wishlist_events_view(events: DataFrame) -> DataFrame:
    """One row per wishlist toggle: (event_id, ts, user_id, item_id)."""
    e = events.where(F.col("event_type") == "view")
    return e.select("event_id", "ts", "user_id", json_key(F.col("props")).alias("item_id"))


def model_from_driver(t) -> Tables:
    """The shop model over the driver tables (``t`` maps driver table names to
    DataFrames, or is a lazy mapping); every view is built on first use."""
    category = lambda: category_view(t["part"])
    model: Tables | None = None

    def cat():
        return model.category

    model = Tables(
        users=lambda: users_view(t["customer"]),
        category=category,
        items=lambda: items_view(t["part"]),
        sub_category=lambda: sub_category_view(t["part"], cat()),
        items_quant=lambda: items_quant_view(t["part"]),
        orders=lambda: orders_view(t["orders"]),
        order_items=lambda: order_items_view(t["lineitem"]),
        cart=lambda: cart_view(t["events"]),
        wishlist=lambda: wishlist_view(t["events"]),
        complaint=lambda: complaint_view(t["events"]),
        address=lambda: address_view(t["nation"], t["region"]),
        user_address=lambda: user_address_view(t["customer"]),
    )
    return model


def load_model(spark: SparkSession, sf_dir: str) -> Tables:
    return model_from_driver(read_driver(spark, sf_dir))
