
import datetime as dt

from pyspark.sql import functions as F

from shop_helpers import make_tables

TS = dt.datetime(2024, 3, 4, 10, 0)


def _catalog(spark, **extra):
    rows = dict(
        users=[(1, "Ann", "ann@x.com", None, "customer", None, TS),
               (2, "Bob", "bob@x.com", "0300", "admin", "vip", TS)],
        items=[(10, "Red Rod", 5.0, "s", "f", bytearray(b"\x89PNG\r\n\x1a\n...")),
               (11, "blue %_\\ ring", 2.5, None, None, None),
               (12, "Écran", 7.0, None, None, None)],
        items_quant=[(40, 10, "default", 3, "d"), (41, 10, "black", 4, "d")],
        category=[(1, "LARGE"), (2, "SMALL")],
        sub_category=[(21, 2, 10, "b"), (20, 1, 10, "a"), (22, 1, 11, "a")],
    )
    rows.update(extra)
    return make_tables(spark, **rows)


def test_search_semantics(spark):
    from storelake.operators.catalog import search_products
    t = _catalog(spark)
    ids = lambda q: sorted(r.item_id for r in search_products(t, q).collect())
    assert ids("ROD") == [10]            # ASCII case folding
    assert ids("%") == [10, 11, 12]      # % is a wildcard
    assert ids("_") == [10, 11, 12]      # _ is a wildcard
    assert ids("\\") == [11]             # backslash is literal
    assert ids("é") == []                # only A-Z fold: 'É' does not match 'é'
    assert ids("É") == [12]


def test_first_category_and_stock(spark):
    from storelake.operators.catalog import list_products
    rows = {r.item_id: r for r in list_products(_catalog(spark)).collect()}
    assert rows[10].category == "LARGE"       # lowest subcat_id wins (K9)
    assert rows[10].total_stock == 7
    assert rows[11].total_stock == 0          # item without variant
    assert rows[12].category == ""
    assert rows[11].has_image == 0 and rows[10].has_image == 1


def test_week_labels(spark):
    from storelake.functions.dates import monday_week_label
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2024, 1, 1),),
                                (dt.date(2023, 1, 2),)], "d date")
    got = [r[0] for r in df.select(monday_week_label(F.col("d"))).collect()]
    assert got == ["2023-W00", "2024-W01", "2023-W01"]


def test_shop_page_clamps(spark):
    from storelake.operators.catalog import shop_page
    t = _catalog(spark)
    for page in (0, -3, 9999):
        rows = shop_page(t, page=page, page_size=2).collect()
        assert {r.current_page for r in rows} == {1 if page < 1 else 2}
        assert all(r.total_pages == 2 for r in rows)
    empty = shop_page(t, page=5, q="zzz")
    assert empty.count() == 0


def test_empty_id_set(spark):
    from storelake.operators.catalog import items_by_ids
    t = _catalog(spark)
    out = items_by_ids(t, spark.createDataFrame([], "item_id long"))
    assert out.count() == 0 and "itemName" in out.columns


def test_user_without_orders_and_null_status(spark):
    from storelake.operators.reports import revenue_by_period, user_order_stats
    t = _catalog(spark, orders=[(100, 2, TS, None, 50.0, 0), (101, 2, TS, "Processing", 20.0, 0)])
    stats = {r.user_id: r for r in user_order_stats(t).collect()}
    assert (stats[1].total_orders, stats[1].pending_orders, stats[1].total_revenue) == (0, None, 0.0)
    assert stats[2].total_orders == 2 and stats[2].pending_orders == 1
    assert stats[2].total_revenue == 20.0     # NULL status counts 0 revenue
    daily = revenue_by_period(t, "daily").collect()
    assert [(r.order_count, r.total_revenue) for r in daily] == [(1, 20.0)]  # NULL status dropped


def test_order_without_lines_nests_empty(spark):
    from storelake.operators.orders import order_details, orders_with_items
    t = _catalog(spark, orders=[(100, 1, TS, "Shipped", 5.0, 0), (101, 9, TS, "Shipped", 5.0, 0)],
                 order_items=[(1, 101, 40, 2, 10.0), (2, 101, 999, 1, 3.0)])
    nested = {r.order_id: r for r in orders_with_items(t).collect()}
    assert nested[100]["items"] == []
    assert len(nested[101]["items"]) == 2
    det = order_details(t).collect()
    assert len(det) == 3
    by_line = {r.orderItem_id: r for r in det}
    assert by_line[2].itemQuant_id is None and by_line[2].quantity == 1   # dangling variant kept
    assert {r.customer_name for r in det if r.order_id == 101} == {"Deleted User"}


def test_double_cancel_restocks_once(spark):
    from storelake.operators.stock import apply_order_status
    t = _catalog(spark, orders=[(100, 1, TS, "Shipped", 5.0, 0), (101, 1, TS, "Cancelled", 5.0, 0)],
                 order_items=[(1, 100, 40, 2, 10.0), (2, 101, 40, 5, 10.0)])
    changes = spark.createDataFrame([(1, 100, "Cancelled", 7), (2, 101, "Cancelled", 7)],
                                    "seq long, order_id long, new_status string, staff_id long")
    out = apply_order_status(t, changes)
    stock = {r.itemQuant_id: r.stock for r in out["items_quant"].collect()}
    assert stock[40] == 3 + 2                 # only the newly cancelled order gives stock back
    again = apply_order_status(t.with_(**out), changes)
    assert {r.itemQuant_id: r.stock for r in again["items_quant"].collect()}[40] == 5


def test_negative_stock_flag(spark):
    from storelake.operators.stock import place_orders
    t = _catalog(spark, orders=[(1, 1, TS, "Shipped", 1.0, 0)])
    req = spark.createDataFrame([(1, 1, 10, 7)], "request_id long, user_id long, item_id long, quantity int")
    out = place_orders(t, req, order_date="2024-01-01 00:00:00")
    rows = {r.itemQuant_id: r for r in out["items_quant"].collect()}
    # total stock 7 admits the order, the first variant (3) goes to -4
    assert rows[40].stock == -4 and rows[40].negative_stock
    assert out["new_orders"].collect()[0].totalPrice == 35.0


def test_cart_fold_edges(spark):
    from storelake.operators.cart import fold_cart, price_cart
    t = _catalog(spark)
    ops = spark.createDataFrame([
        (1, 1, 10, "add", 0), (2, 1, 10, "add", 5), (3, 1, 10, "add", 2),  # 1, 6 refused?, 3
        (4, 1, 11, "add", 1),              # no stock: refused
        (5, 1, None, "add", 1),            # bad key dropped
        (6, 2, 10, "add", 3), (7, 2, 10, "set", 99), (8, 2, 10, "add", 1),
        (9, 2, 12, "set", 0),
    ], "event_id long, user_id long, item_id long, op string, quantity int")
    got = {(r.user_id, r.item_id): r.quantity for r in fold_cart(t, ops).collect()}
    # user 1, item 10 (stock 7): 0->1 (min 1), +5 -> 6, +2 -> 8 > 7 refused
    assert got == {(1, 10): 6, (2, 10): 7}
    coupons = spark.createDataFrame([(1, " discount10 "), (2, "nope")], "user_id long, coupon_code string")
    priced = {r.user_id: r for r in price_cart(t, fold_cart(t, ops), coupons).collect()}
    assert priced[1].grand_total == 30.0 and priced[1].checkout_total == 20.0
    assert priced[2].discount == 0.0


def test_price_text_parsing(spark):
    from storelake.functions.money import format_price, parse_price
    df = spark.createDataFrame([("45",), ("45.50",), ("",), ("abc",), ("Rs.45/-",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_price(F.col("t"))).collect()] == [45.0, 45.5, 0.0, 0.0, 45.0, 0.0]
    nums = spark.createDataFrame([(45.0,), (45.5,), (0.125,)], "v double")
    assert [r[0] for r in nums.select(format_price(F.col("v"))).collect()] == [
        "Rs.45/-", "Rs.45.50/-", "Rs.0.13/-"]


def test_image_headers(spark):
    from storelake.operators.quality import image_format
    heads = [b"\x89PNG\r\n\x1a\nxxxx", b"\xff\xd8\xff\xe0", b"GIF87a..", b"GIF89a..",
             b"RIFF\x00\x00\x00\x00WEBPVP8", b"hello", None, b""]
    df = spark.createDataFrame([(bytearray(h) if h is not None else None,) for h in heads], "img binary")
    got = [r[0] for r in df.select(image_format(F.col("img"))).collect()]
    assert got == ["png", "jpeg", "gif", "gif", "webp", "jpeg", "none", "none"]


def test_registration_rules(spark):
    from storelake.operators.quality import registration_audit
    batch = spark.createDataFrame([
        (1, "A", "a@b.co", "0300 1234567"), (2, " ", "a@b", "12"), (3, "C", "", None),
    ], "request_id long, name string, email string, phone string")
    got = {r.request_id: r.errors for r in registration_audit(batch).collect()}
    assert got == {1: "", 2: "name_required; email_invalid; phone_invalid",
                   3: "email_required; phone_required"}


def test_ids_are_dense_across_blocks(spark):
    from storelake.operators.sequence import new_ids, running_sum
    df = spark.range(0, 1000).withColumn("g", F.col("id") % 3)
    ids = new_ids(df, "id", F.lit(100), "new_id", rows_per_block=7)
    assert sorted(r.new_id for r in ids.collect()) == list(range(101, 1101))
    rs = running_sum(df, ["g"], "id", F.col("id"), "cum", rows_per_block=5).where("g = 1 AND id = 10").first()
    assert rs.cum == 1 + 4 + 7 + 10


def test_load_images_from_files(spark, tmp_path):
    from storelake.sources.sinks import load_images
    (tmp_path / "a.png").write_bytes(b"\x89PNGdata")
    refs = spark.createDataFrame([
        (1, f"file://{tmp_path}/a.png"), (2, str(tmp_path / "a.png")), (3, "data:image/png;base64,aGk="),
        (4, "data:image/png;base64,***"), (5, "http://example.invalid/x.png"), (6, str(tmp_path / "b.png")),
    ], "item_id long, image_url string")
    got = {r.item_id: (bytes(r.image) if r.image is not None else None)
           for r in load_images(spark, refs, str(tmp_path)).collect()}
    assert got == {1: b"\x89PNGdata", 2: b"\x89PNGdata", 3: b"hi", 4: None, 5: None, 6: None}


def test_deleting_user_keeps_orders(spark):
    from storelake.operators.changes import delete_users
    t = _catalog(spark, orders=[(100, 1, TS, "Shipped", 5.0, 0)],
                 complaint=[(1, 1, "m", "open", TS)], wishlist=[(1, 1, 40)], user_address=[(1, 1, 3)])
    out = delete_users(t, spark.createDataFrame([(1,)], "user_id long"))
    assert out["orders"].collect()[0].user_id is None
    assert out["complaint"].count() == 0 and out["wishlist"].count() == 0
    assert out["users"].count() == 1


def test_null_keys_are_salted_not_dropped(spark):
    from storelake.operators.joins import left_join_dim
    left = spark.range(0, 3000).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id") % 7).alias("user_id"))
    dim = spark.range(0, 7).select(F.col("id").alias("user_id"), (F.col("id") * 10).alias("v"))
    out = left_join_dim(left, dim, "user_id")
    assert out.count() == 3000
    nulls = out.where(F.col("user_id").isNull())
    assert nulls.count() == 1000 and nulls.where(F.col("v").isNotNull()).count() == 0
    assert out.where("user_id = 3").select("v").distinct().collect()[0].v == 30


def test_hot_item_sales_summary(spark):
    """One variant holds a third of all lines; results stay exact."""
    from storelake.operators.reports import sales_summary
    lines = [(i, i, 40 if i % 3 == 0 else 41, 1, 2.5) for i in range(3000)]
    t = _catalog(spark, orders=[(i, 1, TS, "Shipped", 1.0, 0) for i in range(3000)], order_items=lines)
    rows = {r.item_id: r for r in sales_summary(t).collect()}
    assert rows[10].total_sold == 3000 and rows[10].total_revenue == 7500.0


def test_pages_of_any_depth(spark):
    import storelake.operators.catalog as C
    items = [(i, f"gear {i}", 1.0, None, None, None) for i in range(0, 200, 3)]
    t = make_tables(spark, items=items)
    for page in (1, 4, 14):
        rows = C.shop_page(t, page=page, page_size=5).collect()
        assert [r.item_id for r in rows] == list(range(0, 200, 3))[(page - 1) * 5:page * 5]


def test_numbering_of_sparse_and_huge_ids(spark):
    """Ids far apart, one outlier, ids near the top of the range, and a hot group: right sums, bounded blocks."""
    import random

    from storelake.operators.sequence import new_ids, running_sum, with_blocks
    rng = random.Random(1)
    ids = sorted(rng.sample(range(10 ** 6), 3000)) + [9 * 10 ** 18]
    rows = [(i, 0 if k % 3 else k) for k, i in enumerate(ids)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g long").repartition(3)
    got = {r.id: r.n for r in new_ids(df, "id", F.lit(5), "n", rows_per_block=50).collect()}
    assert [got[i] for i in ids] == list(range(6, 6 + len(ids)))
    cum = {r.id: r.cum for r in running_sum(df.where("g = 0"), ["g"], "id", F.lit(1), "cum", rows_per_block=50).collect()}
    assert [cum[i] for i in sorted(cum)] == list(range(1, len(cum) + 1))
    sizes = [r["count"] for r in with_blocks(df.where("g = 0"), ["g"], "id", 50).groupBy("_blk").count().collect()]
    assert len(sizes) > len(cum) / 100 and max(sizes) < 4 * 50


def test_changes_apply_in_sequence_and_keys_stay_unique(spark):
    """Several changes of one key in a batch: the snapshot keeps one row per key."""
    from storelake.operators import changes as W
    from storelake.operators.stock import apply_order_status, place_orders
    from storelake.schema import PRIMARY_KEYS
    t = _catalog(spark, orders=[(100, 1, TS, "Processing", 5.0, 3)], order_items=[(1, 100, 40, 2, 10.0)],
                 complaint=[(1, 1, "m", "open", TS)])

    def unique(out):
        for name, key in PRIMARY_KEYS.items():
            if name in out:
                assert out[name].groupBy(key).count().where("count > 1").count() == 0, name

    steps = [(1, 100, "Cancelled", None), (2, 100, "Shipped", 8), (3, 100, "Cancelled", None), (4, 100, "Cancelled", None)]
    out = apply_order_status(t, spark.createDataFrame(steps, "seq long, order_id long, new_status string, staff_id long"))
    unique(out)
    assert {r.itemQuant_id: r.stock for r in out["items_quant"].collect()}[40] == 3 + 2 + 2
    row = out["orders"].first()
    assert (row.order_status, row.staff_id) == ("Cancelled", 8)

    out = W.patch_users(t, spark.createDataFrame(
        [(1, 1, "A1", " bob@x.com ", None, "n1", "staff", "admin"), (2, 1, "A2", None, "1", None, None, "staff"),
         (3, 1, None, "new@x.com", "2", "n2", "admin", "staff"), (4, 2, "B1", "new@x.com", None, None, None, "admin"),
         (5, 2, "B2", " bob@x.com", None, "n3", None, "admin")],
        "seq long, user_id long, name string, email string, phone string, notes string, role string, caller_role string"))
    unique(out)
    rows = {r.user_id: r for r in out["users"].collect()}
    assert (rows[1].name, rows[1].email, rows[1].phone, rows[1].notes, rows[1].role) == ("A2", "new@x.com", "2", None, "customer")
    assert (rows[2].name, rows[2].email, rows[2].notes) == ("B2", "bob@x.com", "n3")
    assert sorted(r.seq for r in out["rejects"].collect()) == [1, 4]

    posts = [(5, 10, "first", "1", "1", "a", "b", bytearray(b"img")), (6, 10, "second", "2", "2", "c", "d", None)]
    out = W.upsert_products(t, spark.createDataFrame(posts, "request_id long, item_id long, name string, price_text string, "
                                                     "stock_text string, short_desc string, full_desc string, image binary"))
    unique(out)
    row = out["items"].where("item_id = 10").first()
    assert (row.itemName, row.basePrice, bytes(row.image)) == ("second", 2.0, b"img")

    out = W.set_complaint_status(t, spark.createDataFrame([(1, 1, "resolved"), (2, 1, "in_progress")], "seq long, complaint_id long, new_status string"))
    unique(out)
    assert out["complaint"].first().status == "in_progress"

    out = W.assign_categories(t, spark.createDataFrame(
        [(1, 12, "NEW", "x"), (2, 12, "NEW", "y"), (3, 10, "LARGE", "z1"), (4, 10, "LARGE", "z2")],
        "request_id long, item_id long, category_name string, subcategory_name string"))
    unique(out)
    assert sorted((r.item_id, r.subCatName) for r in out["sub_category"].collect()) == [(10, "b"), (10, "z2"), (11, "a"), (12, "y")]

    reg = W.register_users(t, spark.createDataFrame(
        [(1, "N", " new@x.com", "03001234567", "x"), (2, "N", "new@x.com ", "03001234567", "x"), (3, "N", " ann@x.com ", "03001234567", "x")],
        "request_id long, name string, email string, phone string, role string"), created_at="2024-01-01 00:00:00")
    unique(reg)
    assert [r.email for r in reg["new_users"].collect()] == ["new@x.com"]
    assert sorted(r.request_id for r in reg["rejects"].collect()) == [2, 3]

    req = spark.createDataFrame([(1, 1, 10, 1), (1, 1, 10, -4), (2, 1, 10, -4), (3, 1, 77, 1)], "request_id long, user_id long, item_id long, quantity int")
    twice = spark.createDataFrame([(1, "discount10"), (1, " DISCOUNT10 ")], "request_id long, coupon_code string")
    out = place_orders(t, req, twice, order_date="2024-01-01 00:00:00")
    unique(out)
    assert [r.totalPrice for r in out["new_orders"].collect()] == [-5.0]
    assert {r.request_id: r.reason for r in out["rejects"].collect()} == {2: "no_valid_line", 3: "no_valid_line"}


def test_money_beyond_ten_billion(spark):
    from storelake.operators.reports import revenue_by_period
    t = _catalog(spark, orders=[(1, 1, TS, "Shipped", 2e10, 0), (2, 1, TS, "Shipped", 0.25, 0)])
    assert revenue_by_period(t, "daily").first().total_revenue == 20000000000.25


def test_shared_folder_is_required_on_a_cluster(spark):
    import pytest
    from storelake.session import checkpoint_dir

    class Remote:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError):
        checkpoint_dir(Remote())


def test_month_partitioned_snapshot_prunes(spark, tmp_path):
    import io
    from contextlib import redirect_stdout

    from storelake.operators.orders import orders_by_date_range
    from storelake.plans.registry import context
    from storelake.sources.model import Tables
    from shop_helpers import SF_SMALL
    t = context(spark, SF_SMALL).t
    path = str(tmp_path / "snap")
    t.write_snapshot(path, orders_by_month=True)
    back = Tables.read_snapshot(spark, path, orders_by_month=True)
    got = orders_by_date_range(back, "1996-01-01", "1996-03-31")
    want = orders_by_date_range(t, "1996-01-01", "1996-03-31")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    buf = io.StringIO()
    with redirect_stdout(buf):
        got.explain("formatted")
    assert "PartitionFilters: [isnotnull(order_month" in buf.getvalue()


def test_deep_pages_sort_a_range_only(spark, monkeypatch):
    """Ids with gaps and clusters: every page of a listing that is longer than a range."""
    from storelake.operators import catalog as C
    monkeypatch.setattr(C, "PAGE_RANGE", 16)
    ids = sorted({k * k for k in range(120)} | set(range(5000, 5200)))
    t = make_tables(spark, items=[(i, f"n{i}", 1.0, None, None, None) for i in ids])
    for page in (1, 2, 9, 17, 40, 46, 99):
        rows = C.shop_page(t, page=page, page_size=7).collect()
        last = -(-len(ids) // 7)
        at = min(page, last)
        assert [r.item_id for r in rows] == ids[(at - 1) * 7:at * 7]
        assert {(r.current_page, r.total_pages) for r in rows} == {(at, last)}
