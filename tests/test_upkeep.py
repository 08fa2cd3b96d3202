"""Reports kept up to date equal the full queries after every batch; the dashboard shows the registered lists."""

import random

from shop_helpers import SF_SMALL, make_tables


def test_sums_follow_inserts_changes_and_deletes(spark, tmp_path):
    from storelake.operators import upkeep as U
    from storelake.operators.reports import revenue_by_period, user_order_stats
    from storelake.sources.snapshots import Store
    rng = random.Random(3)

    def order(i):
        day = f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d} 10:00:00"
        return [i, rng.choice([1, 2, 3, None]), day, rng.choice(["Processing", "Cancelled", "Shipped", None]),
                rng.choice([None, 0.1, 19.99, 250.0]), None]

    def table(rows):
        return spark.createDataFrame([tuple(r) for r in rows], "order_id long, user_id long, order_date string, order_status string, "
                                     "totalPrice double, staff_id long").selectExpr("order_id", "user_id", "CAST(order_date AS timestamp_ntz) AS order_date",
                                                                                    "order_status", "totalPrice", "staff_id")

    users = [(u, "n", f"{u}@e.org", None, "customer", None, None) for u in (1, 2, 3, 4)]
    rows = [order(i) for i in range(60)]
    store = Store(spark, str(tmp_path), {"daily": U.DAILY_SCHEMA, "per_user": U.PER_USER_SCHEMA},
                  keys={"daily": ["day"], "per_user": ["user_id"]})
    first = U.inserted(table(rows))
    store.commit(replace={"daily": U.daily_sums(first), "per_user": U.user_sums(first)})
    for step in range(3):
        old = [list(r) for r in rows]
        for r in rng.sample(rows, 12):
            r[3], r[1] = rng.choice(["Cancelled", "Delivered"]), rng.choice([r[1], 4])
        rows = [r for r in rows if rng.random() > 0.1] + [order(100 * (step + 1) + k) for k in range(8)]
        change = U.order_changes(table(old), table(rows))
        assert change.count() < len(rows)
        store.commit(upsert={"daily": U.merged(store.read("daily"), U.daily_sums(change), "day"),
                             "per_user": U.merged(store.read("per_user"), U.user_sums(change), "user_id")})
        t = make_tables(spark, users=users).with_(orders=table(rows))
        for period in ("daily", "weekly", "monthly"):
            got = U.revenue_report(store.read("daily"), period, 1000)
            assert got.collect() == revenue_by_period(t, period, 1000).select(*got.columns).collect()
        assert sorted(U.user_report(t, store.read("per_user")).collect()) == sorted(user_order_stats(t).collect())


def test_dashboard_shows_the_registered_lists(spark, registry):
    from storelake.operators.reports import dashboard
    from storelake.plans.registry import context
    sections = dashboard(context(spark, SF_SMALL).t)
    names = {"kpis": "dashboard_kpis", "orders": "all_orders", "users": "list_users", "products": "list_products",
             "inventory": "inventory_snapshot", "categories": "list_categories", "complaints": "complaints", "sales_summary": "sales_summary"}
    assert set(sections) == set(names)
    for section, name in names.items():
        want = registry[name].build(spark, SF_SMALL)
        shared = [c for c in want.columns if c in sections[section].columns]
        assert shared and sorted(map(str, sections[section].select(*shared).collect())) == sorted(map(str, want.select(*shared).collect())), section


def test_changes_are_written_once_for_all_sums(spark, monkeypatch):
    """The sums read the changed orders from a written table; the joins that find them run once."""
    from shop_helpers import SF_SMALL

    from storelake.plans import stored_plans
    from storelake.plans.registry import load_all
    seen, daily_sums = [], stored_plans.U.daily_sums
    monkeypatch.setattr(stored_plans.U, "daily_sums", lambda change: seen.append(change) or daily_sums(change))
    load_all()["revenue_weekly_kept_up"].build(spark, SF_SMALL)
    plans = [c._jdf.queryExecution().optimizedPlan().toString() for c in seen]
    assert len(plans) == 3 and not any("Join" in p or "Aggregate" in p for p in plans)
