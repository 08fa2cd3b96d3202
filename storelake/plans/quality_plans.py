"""Registered data-quality and scalar-function queries."""

from pyspark.sql import functions as F

from storelake.functions import money, parse, text
from storelake.operators import quality as Q
from storelake.plans.registry import query
from storelake.schema import FOREIGN_KEYS, NOT_NULL
from storelake.sources.requests import new_users, product_changes

_SQL_TABLE = {"orders": "orders_v"}

_EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
_CHECKS = [
    "CASE WHEN trim(COALESCE(name, '')) = '' THEN 'name_required' END",
    "CASE WHEN trim(COALESCE(email, '')) = '' THEN 'email_required' END",
    f"CASE WHEN trim(COALESCE(email, '')) <> '' AND NOT regexp_matches(trim(email), '{_EMAIL_RE}')"
    " THEN 'email_invalid' END",
    "CASE WHEN trim(COALESCE(phone, '')) = '' THEN 'phone_required' END",
    "CASE WHEN trim(COALESCE(phone, '')) <> '' AND NOT regexp_matches("
    r"regexp_replace(trim(phone), '[\s\-+()]', '', 'g'), '^\d{7,15}$') THEN 'phone_invalid' END",
]
_AUDIT_SQL = f"""
    SELECT request_id, concat_ws('; ', {', '.join(_CHECKS)}) AS errors,
           CAST({' + '.join(f'(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)' for c in _CHECKS)}
                AS INTEGER) AS n_errors
    FROM new_users"""


@query("registration_audit", _AUDIT_SQL)
def registration_audit(t, ctx):
    return Q.registration_audit(new_users(ctx))


@query("registration_audit_summary", f"""
    SELECT rule, count(*) AS n_rows FROM (
      SELECT unnest(string_split(errors, '; ')) AS rule FROM ({_AUDIT_SQL}) a) r
    WHERE rule <> '' GROUP BY rule""")
def registration_audit_summary(t, ctx):
    return Q.registration_audit_summary(new_users(ctx))


@query("duplicate_emails", """
    SELECT request_id, email, taken AS already_taken, batch_count, taken OR batch_count > 1 AS duplicate
    FROM (SELECT request_id, trim(email) AS email, count(*) OVER (PARTITION BY trim(email)) AS batch_count,
                 trim(email) IN (SELECT trim(email) FROM users) AS taken FROM new_users) b""")
def duplicate_emails(t, ctx):
    return Q.duplicate_emails(t, new_users(ctx))


@query("image_formats", """
    SELECT format, count(*) AS n_items, CAST(sum(n_bytes) AS BIGINT) AS total_bytes FROM (
      SELECT CASE WHEN image IS NULL OR octet_length(image) = 0 THEN 'none'
                  WHEN starts_with(hex(image), '89504E470D0A1A0A') THEN 'png'
                  WHEN starts_with(hex(image), 'FFD8FF') THEN 'jpeg'
                  WHEN starts_with(hex(image), '474946383761')
                       OR starts_with(hex(image), '474946383961') THEN 'gif'
                  WHEN starts_with(hex(image), '52494646')
                       AND substring(hex(image), 17, 8) = '57454250' THEN 'webp'
                  ELSE 'jpeg' END AS format,
             COALESCE(octet_length(image), 0) AS n_bytes
      FROM items) x GROUP BY format""")
def image_formats(t, ctx):
    return Q.image_formats(t)


def _fk_sql() -> str:
    parts = []
    for child, col, parent, pcol in FOREIGN_KEYS:
        c, p = _SQL_TABLE.get(child, child), _SQL_TABLE.get(parent, parent)
        parts.append(f"""
      SELECT 'foreign_key' AS "check", '{child}' AS table_name, '{col}' AS column_name,
             '{parent}.{pcol}' AS reference, count(*) AS violations
      FROM {c} x WHERE x.{col} IS NOT NULL AND x.{col} NOT IN (SELECT {pcol} FROM {p}
                                                            WHERE {pcol} IS NOT NULL)""")
    for table, col in NOT_NULL:
        parts.append(f"""
      SELECT 'not_null', '{table}', '{col}', '', count(*) FROM {_SQL_TABLE.get(table, table)}
      WHERE {col} IS NULL""")
    parts.append("""
      SELECT 'unique', 'users', 'email', '',
             CAST(COALESCE(sum(n - 1), 0) AS BIGINT)
      FROM (SELECT email, count(*) AS n FROM users GROUP BY email HAVING count(*) > 1) d""")
    return " UNION ALL ".join(parts)


@query("fk_audit", _fk_sql())
def fk_audit(t, ctx):
    return Q.fk_audit(t)


@query("normalize_roles", """
    SELECT request_id, role,
           CASE WHEN lower(trim(role)) IN ('customer', 'staff', 'admin') THEN lower(trim(role))
                ELSE 'customer' END AS normalized_role
    FROM new_users""")
def normalize_roles(t, ctx):
    return Q.normalize_roles(new_users(ctx))


_RATING_RE = r"^\[Star Rating: (\d+)/5\] ?"


@query("complaint_ratings", f"""
    SELECT status, rating, count(*) AS n_complaints, avg(text_len) AS avg_text_len FROM (
      SELECT status,
             TRY_CAST(NULLIF(regexp_extract(message, '{_RATING_RE}', 1), '') AS INTEGER) AS rating,
             length(regexp_replace(message, '{_RATING_RE}', '')) AS text_len
      FROM complaint) c GROUP BY status, rating""")
def complaint_ratings(t, ctx):
    return Q.complaint_ratings(t)


@query("variant_description", """
    SELECT item_id, concat_ws(' - ', NULLIF(trim(short_desc), ''), NULLIF(trim(full_desc), ''))
           AS description
    FROM items""")
def variant_description(t, ctx):
    return t.items.select("item_id", text.variant_description(F.col("short_desc"),
                                                              F.col("full_desc")).alias("description"))


@query("string_predicates", """
    SELECT item_id, starts_with(itemName, 'red') AS starts_with, suffix(itemName, 'rod') AS ends_with,
           contains(full_desc, itemName) AS "contains"
    FROM items""")
def string_predicates(t, ctx):
    preds = {"starts_with": F.col("itemName").startswith("red"),
             "ends_with": F.col("itemName").endswith("rod"),
             "contains": text.string_predicates(F.col("full_desc"), F.col("itemName"))["contains"]}
    return t.items.select("item_id", *[c.alias(n) for n, c in preds.items()])


@query("price_format", """
    SELECT item_id, basePrice,
           CASE WHEN basePrice = floor(basePrice)
                THEN concat('Rs.', CAST(CAST(basePrice AS BIGINT) AS VARCHAR), '/-')
                ELSE concat('Rs.', printf('%.2f', basePrice), '/-') END AS price_label
    FROM items""")
def price_format(t, ctx):
    return t.items.select("item_id", "basePrice",
                          money.format_price(F.col("basePrice")).alias("price_label"))


@query("price_parse", r"""
    SELECT request_id, price_text,
           COALESCE(TRY_CAST(NULLIF(regexp_extract(
               regexp_replace(regexp_replace(trim(price_text), '^(?i)rs\.', ''), '[^0-9.\-]', '', 'g'),
               '^(-?(\d+\.?\d*|\.\d+))', 1), '') AS DOUBLE), 0) AS price
    FROM product_changes""")
def price_parse(t, ctx):
    pc = product_changes(ctx)
    return pc.select("request_id", "price_text", money.parse_price(F.col("price_text")).alias("price"))


@query("parse_product_form", r"""
    SELECT request_id, item_id, trim(name) AS name,
           COALESCE(TRY_CAST(trim(price_text) AS DOUBLE), 0) AS price,
           CAST(COALESCE(CASE WHEN regexp_matches(trim(stock_text), '^[+-]?\d+$')
                              THEN TRY_CAST(trim(stock_text) AS INTEGER) ELSE 0 END, 0) AS INTEGER)
             AS stock,
           trim(short_desc) AS short_desc, trim(full_desc) AS full_desc,
           COALESCE(octet_length(image) <= 5242880, true) AS image_ok
    FROM product_changes""")
def parse_product_form(t, ctx):
    pc = product_changes(ctx)
    return pc.select("request_id", "item_id", F.trim("name").alias("name"),
                     parse.form_price(F.col("price_text")).alias("price"),
                     F.coalesce(parse.form_stock(F.col("stock_text")), F.lit(0)).alias("stock"),
                     F.trim("short_desc").alias("short_desc"), F.trim("full_desc").alias("full_desc"),
                     parse.image_within_limit(F.col("image")).alias("image_ok"))


@query("address_label", """
    SELECT addr_id, concat_ws(', ', houseNumber, area, city, province) AS label FROM address""")
def address_label(t, ctx):
    a = t.address
    return a.select("addr_id", text.address_label(F.col("houseNumber"), F.col("area"), F.col("city"),
                                                  F.col("province")).alias("label"))
