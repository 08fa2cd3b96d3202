"""The shop model as DuckDB SQL over the driver tables (the oracle side).

Each view mirrors the DataFrame of ``storelake.sources.model`` (rules in
FIXTURES.md).  ``with_model(sql)`` prefixes a query with exactly the views it
references (and their dependencies) as CTEs.
"""

from __future__ import annotations

import re

_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"

MODEL_SQL: dict[str, str] = {
    "users": """
        SELECT c_custkey AS user_id, c_name AS name,
               concat(lower(replace(c_name, '#', '.')), '@example.com') AS email,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    ELSE concat('03', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) END AS phone,
               CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 0 THEN 'staff'
                    ELSE 'customer' END AS role,
               CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS notes,
               CAST(DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM customer""",
    "orders_v": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_custkey % 97 = 5 THEN NULL ELSE o_custkey END AS user_id,
               o_orderdate AS order_date,
               CASE WHEN o_orderstatus = 'P' THEN 'Processing' WHEN o_orderstatus = 'F' THEN 'Delivered'
                    WHEN o_orderpriority = '1-URGENT' THEN 'Cancelled' ELSE 'Shipped' END AS order_status,
               o_totalprice AS totalPrice,
               CAST((o_orderkey % 15) * 10 AS BIGINT) AS staff_id
        FROM orders""",
    "items": """
        SELECT p_partkey AS item_id, p_name AS itemName, p_retailprice AS basePrice,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS short_desc,
               concat(p_type, ' ', p_name) AS full_desc,
               CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_name AS BLOB) END AS image
        FROM part""",
    "items_quant": """
        SELECT p_partkey * 4 + k AS itemQuant_id, p_partkey AS item_id,
               CASE k WHEN 0 THEN 'default' WHEN 1 THEN 'black' ELSE 'white' END AS color,
               CAST((p_partkey * 7 + k * 5) % 13 AS INTEGER) AS stock,
               p_brand AS description
        FROM part, (VALUES (0), (1), (2)) AS v(k)
        WHERE k < p_size % 4""",
    "category": """
        SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS cat_id, p_type AS categoryName
        FROM (SELECT DISTINCT p_type FROM part) t""",
    "sub_category": """
        SELECT p.p_partkey * 2 + j AS subcat_id,
               CASE WHEN j = 0 THEN c.cat_id ELSE c.cat_id % 6 + 1 END AS cat_id,
               p.p_partkey AS item_id, p.p_brand AS subCatName
        FROM part p JOIN category c ON c.categoryName = p.p_type, (VALUES (0), (1)) AS v(j)
        WHERE p.p_partkey % 11 <> 0 AND (j = 0 OR p.p_partkey % 5 = 0)""",
    "order_items": """
        SELECT l_orderkey * 100000
                 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                    l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS orderItem_id,
               l_orderkey AS order_id, l_partkey * 4 + l_suppkey % 3 AS itemQuant_id,
               CAST(trunc(l_quantity) AS INTEGER) AS quantity, l_extendedprice AS price
        FROM lineitem""",
    "address": """
        SELECT CAST(n_nationkey AS BIGINT) AS addr_id, r_name AS province, n_name AS city,
               'Central' AS area, '1' AS houseNumber
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "user_address": """
        SELECT c_custkey AS id, c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS addr_id
        FROM customer""",
    "complaint": """
        SELECT event_id AS complaint_id,
               CASE WHEN user_id % 23 = 7 THEN NULL ELSE user_id END AS user_id,
               concat('[Star Rating: ', CAST(1 + event_id % 5 AS VARCHAR), '/5] ', props) AS message,
               CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'Pending' WHEN 2 THEN 'in_progress'
                    ELSE 'resolved' END AS status,
               ts AS created_at
        FROM events WHERE event_type = 'error'""",
    "wishlist": f"""
        SELECT min(event_id) AS wishlist_id, user_id, itemQuant_id
        FROM (SELECT event_id, user_id, {_K} * 4 + event_id % 3 AS itemQuant_id
              FROM events WHERE event_type = 'purchase') t
        GROUP BY user_id, itemQuant_id""",
    "cart": f"""
        SELECT event_id AS cart_id, user_id, {_K} * 4 AS itemQuant_id,
               CAST(1 + event_id % 3 AS INTEGER) AS quantity
        FROM events WHERE event_type = 'signup'""",
    "cart_events": f"""
        SELECT event_id, ts, user_id, {_K} AS item_id, CAST(1 + event_id % 3 AS INTEGER) AS quantity
        FROM events WHERE event_type = 'click'""",
    "wishlist_events": f"""
        SELECT event_id, ts, user_id, {_K} AS item_id
        FROM events WHERE event_type = 'view'""",
}

_EXTRA: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    """Add a derived view (e.g. a change batch) usable by ``with_model``."""
    _EXTRA[name] = sql


def _all() -> dict[str, str]:
    return {**MODEL_SQL, **_EXTRA}


def _refs(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{re.escape(n)}\b", sql)]


def with_model(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every model view it (transitively) uses."""
    views = _all()
    order: list[str] = []

    def visit(name: str, stack: tuple = ()) -> None:
        if name in order or name in stack:
            return
        body = views[name]
        for dep in _refs(body, [v for v in views if v != name]):
            visit(dep, stack + (name,))
        order.append(name)

    for name in _refs(sql, views):
        visit(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in order)
    return f"WITH {ctes}\n{sql}"
