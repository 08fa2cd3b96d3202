"""Registered source/sink queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.plans.registry import query
from storelake.schema import PRIMARY_KEYS, SCHEMAS
from storelake.session import scratch_dir
from storelake.sources import sinks
from storelake.sources.model import Tables

_SQL_NAMES = {"orders": "orders_v"}


def _contents_sql(name: str) -> str:
    """Rows, values that are not NULL, summed keys and text length of one table."""
    cells = " + ".join(f"count({f.name})" for f in SCHEMAS[name])
    texts = [f"COALESCE(sum(length({f.name})), 0)" for f in SCHEMAS[name] if f.dataType == T.StringType()] or ["0"]
    return (f"SELECT '{name}' AS table_name, count(*) AS n_rows, {cells} AS n_values, "
            f"CAST(COALESCE(sum({PRIMARY_KEYS[name]}), 0) AS BIGINT) AS key_sum, "
            f"CAST({' + '.join(texts)} AS BIGINT) AS n_chars FROM {_SQL_NAMES.get(name, name)}")


def _long_sum(column: str):
    """SUM of a bigint column whose total may leave the bigint range: the exact total wraps around like
    64-bit addition, so within the range it is the plain sum and beyond it still a checksum."""
    half, whole = (F.lit(str(1 << bits)).cast("decimal(20,0)") for bits in (63, 64))
    total = F.coalesce(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(0))
    return (F.pmod(total + half, whole) - half).cast("bigint")


@query("scan_tables", " UNION ALL ".join(map(_contents_sql, SCHEMAS)))
def scan_tables(t, ctx):
    """Write the model as a snapshot, read every table back with its fixed
    schema and summarise what is there.  Line ids of large orders add up beyond a bigint (``_long_sum``)."""
    path = scratch_dir(ctx.spark, "snapshot")
    t.write_snapshot(path)
    parts = []
    for n, df in Tables.read_snapshot(ctx.spark, path).as_dict().items():
        cells = reduce(lambda a, b: a + b, [F.count(f.name) for f in SCHEMAS[n]])
        texts = [F.coalesce(F.sum(F.length(f.name)), F.lit(0)) for f in SCHEMAS[n] if f.dataType == T.StringType()]
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), cells.alias("n_values"),
                            _long_sum(PRIMARY_KEYS[n]).alias("key_sum"),
                            reduce(lambda a, b: a + b, texts, F.lit(0)).cast("bigint").alias("n_chars"))
                     .select(F.lit(n).alias("table_name"), "n_rows", "n_values", "key_sum", "n_chars"))
    return reduce(DataFrame.unionByName, parts)


PARAM_QUERY = ("SELECT complaint_id, user_id, status FROM complaint "
               "WHERE status = ? AND user_id IS NOT NULL AND complaint_id > ?")


@query("param_sql", """
    SELECT complaint_id, user_id, status FROM complaint
    WHERE status = 'Pending' AND user_id IS NOT NULL AND complaint_id > 100""")
def param_sql(t, ctx):
    return sinks.param_sql(ctx.spark, t, PARAM_QUERY, ["Pending", 100])


@query("param_sql_shop_names", """
    SELECT o.order_id, count(*) AS n_lines, sum(l.quantity) AS units
    FROM orders_v o JOIN order_items l ON l.order_id = o.order_id JOIN items_quant q ON q.itemQuant_id = l.itemQuant_id
    WHERE o.order_status = 'Shipped' GROUP BY o.order_id""")
def param_sql_shop_names(t, ctx):
    """S2 over the shop's own table names."""
    return sinks.param_sql(ctx.spark, t, """
        SELECT o.order_id, count(*) AS n_lines, sum(l.quantity) AS units
        FROM Orders o JOIN OrderItems l ON l.order_id = o.order_id JOIN ItemsQuant q ON q.itemQuant_id = l.itemQuant_id
        WHERE o.order_status = ? GROUP BY o.order_id""", ["Shipped"])


@query("export_sales_csv", """
    SELECT order_id AS "Order ID", strftime(order_date, '%Y-%m-%d %H:%M:%S') AS "Date",
           user_id AS "Customer ID", totalPrice AS "Total Price", order_status AS "Status",
           CAST(NULL AS VARCHAR) AS "Payment Method"
    FROM orders_v""")
def export_sales_csv(t, ctx):
    path = scratch_dir(ctx.spark, "sales-csv")
    sinks.export_sales_csv(t, path)
    return sinks.read_sales_csv(ctx.spark, path)


@query("load_images", """
    SELECT item_id, CAST(octet_length(image) AS INTEGER) AS image_bytes, hex(image) AS image_hex FROM (
      SELECT p_partkey AS item_id,
             CASE WHEN p_partkey % 3 = 0 THEN CAST(p_name AS BLOB)
                  WHEN p_partkey % 6 = 1 THEN CAST(concat(p_name, chr(10)) AS BLOB) END AS image
      FROM part) x""")
def load_images(t, ctx):
    """S4 over data: URIs, files below the scratch folder (a file holds its part's name and a line
    feed; half of the files are named by no row) and paths without a file."""
    p = ctx.raw["part"]
    k = F.col("p_partkey")
    root = scratch_dir(ctx.spark, "images")
    sinks.write_files(p.where(k % 3 == 1).select(F.col("p_name").alias("line"), k.alias("image_of")), root)
    listed = sinks.list_files(ctx.spark, root)
    files = listed.select(F.regexp_extract("path", "image_of=([0-9]+)[./]", 1).cast("bigint").alias("_k"), "path")
    url = (F.when(k % 3 == 0, F.concat(F.lit("data:image/png;base64,"),
                                       F.base64(F.col("p_name").cast("binary"))))
            .when(k % 6 == 1, F.col("path"))
            .when(k % 3 == 2, F.concat(F.lit("file:///nonexistent/"), k.cast("string"), F.lit(".png")))
            .otherwise(F.lit("")))
    refs = p.join(files, k == F.col("_k"), "left").select(k.alias("item_id"), url.alias("image_url"))
    imgs = sinks.load_images(ctx.spark, refs, root)
    return imgs.select("item_id", F.length("image").alias("image_bytes"),
                       F.hex("image").alias("image_hex"))


@query("user_profile_json", """
    SELECT u.user_id, u.name, u.email, u.phone, u.role, u.notes,
           strftime(u.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
           CAST(COALESCE(s.n, 0) AS BIGINT) AS total_orders,
           CAST(s.pending_orders AS BIGINT) AS pending_orders,
           COALESCE(s.rev, 0) AS total_revenue
    FROM users u LEFT JOIN (
        SELECT user_id, COUNT(*) AS n,
               SUM(CASE WHEN order_status = 'Processing' THEN 1 ELSE 0 END) AS pending_orders,
               CAST(SUM(CAST(CASE WHEN order_status <> 'Cancelled' THEN totalPrice ELSE 0 END
                             AS DECIMAL(18,2))) AS DOUBLE) AS rev
        FROM orders_v WHERE user_id IS NOT NULL GROUP BY user_id) s
      ON u.user_id = s.user_id""")
def user_profile_json(t, ctx):
    path = scratch_dir(ctx.spark, "profiles")
    sinks.write_user_profiles(t, path)
    back = sinks.read_user_profiles(ctx.spark, path)
    return back.select("user_id", "name", "email", "phone", "role", "notes", "created_at",
                       "order_stats.total_orders", "order_stats.pending_orders",
                       "order_stats.total_revenue")


@query("user_profile_orders", """
    SELECT user_id, order_id, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date, order_status, totalPrice
    FROM orders_v WHERE user_id IN (SELECT user_id FROM users)""")
def user_profile_orders(t, ctx):
    """The order history inside the user documents, one row per order."""
    path = scratch_dir(ctx.spark, "profiles")
    sinks.write_user_profiles(t, path)
    back = sinks.read_user_profiles(ctx.spark, path)
    return back.select("user_id", F.inline("orders"))
