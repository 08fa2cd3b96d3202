"""A day in the shop as a chain of snapshot jobs, written and read back."""

from pyspark.sql import functions as F

from shop_helpers import SF_SMALL


def test_chain_of_change_jobs_round_trips(spark, tmp_path):
    from storelake.operators.changes import register_users
    from storelake.operators.reports import sales_summary, user_order_stats
    from storelake.operators.stock import apply_order_status, place_orders
    from storelake.plans.registry import context
    from storelake.sources.model import Tables
    from storelake.sources.requests import new_users, order_requests

    ctx = context(spark, SF_SMALL)
    t0 = ctx.t
    n_users = t0.users.count()

    reg = register_users(t0, new_users(ctx), created_at="2024-02-01 00:00:00")
    t1 = t0.apply(reg)
    added = reg["new_users"].count()
    assert t1.users.count() == n_users + added

    placed = place_orders(t1, order_requests(ctx), order_date="2024-02-02 00:00:00")
    t2 = t1.apply(placed)
    new_ids = [r.order_id for r in placed["new_orders"].collect()]
    assert new_ids and min(new_ids) > t1.orders.agg(F.max("order_id")).first()[0]

    path = str(tmp_path / "snap-2")
    t2.write_snapshot(path)
    t3 = Tables.read_snapshot(spark, path)
    assert t3.orders.count() == t2.orders.count()
    assert t3.order_items.count() == t2.order_items.count()

    cancel = spark.createDataFrame([(i, i, "Cancelled", 1) for i in new_ids],
                                   "seq long, order_id long, new_status string, staff_id long")
    t4 = t3.apply(apply_order_status(t3, cancel))
    # cancelling the new orders gives back exactly what placing them took
    stock0 = {r.itemQuant_id: r.stock for r in t1.items_quant.collect()}
    stock4 = {r.itemQuant_id: r.stock for r in t4.items_quant.collect()}
    assert stock0 == stock4
    # and the cancelled orders drop out of the sales report
    before = {r.item_id: r.total_sold for r in sales_summary(t1, limit=1000).collect()}
    after = {r.item_id: r.total_sold for r in sales_summary(t4, limit=1000).collect()}
    assert before == after
    stats = {r.user_id: r.total_orders for r in user_order_stats(t4).collect()}
    assert sum(stats.values()) == t4.orders.where(F.col("user_id").isNotNull()).join(
        t4.users.select("user_id"), "user_id", "left_semi").count()
