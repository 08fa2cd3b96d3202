"""Stored snapshots: atomic commits, deltas, compaction, bucketed joins, skipped row groups."""

import pytest
from pyspark.sql import functions as F
from shop_helpers import SF_SMALL

from storelake.schema import SCHEMAS
from storelake.sources.model import Tables
from storelake.sources.snapshots import ConcurrentCommit, Layout, Store


def small_store(spark, path, **layouts):
    from pyspark.sql.types import StructType
    schemas = {"a": StructType.fromDDL("k long, v string"), "b": StructType.fromDDL("k long, n long")}
    return Store(spark, str(path), schemas, layouts, {"b": ["k"]})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_job_that_dies_between_two_tables_changes_nothing(spark, tmp_path):
    store = small_store(spark, tmp_path)
    assert store.version() is None and store.read("a").count() == 0
    a, b = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(1, 5)], "k long, n long")
    store.commit(replace={"a": a, "b": b}, note={"by": "first"})
    broken = b.withColumn("n", F.raise_error(F.lit("executor lost")).cast("long"))
    with pytest.raises(Exception, match="executor lost"):
        store.commit(replace={"a": a.withColumn("v", F.lit("new")), "b": broken})
    assert (tmp_path / "a").exists() and len(list((tmp_path / "a").iterdir())) == 2      # the dead job's folder is there
    assert store.versions() == [1] and store.version().note == {"by": "first"}
    assert rows(store.read("a")) == [(1, "x")] and rows(store.read("b")) == [(1, 5)]
    store.vacuum()
    assert len(list((tmp_path / "a").iterdir())) == 1 and rows(store.read("a")) == [(1, "x")]
    store.commit(replace={"a": a.withColumn("v", F.lit("new"))})
    assert rows(store.read("a")) == [(1, "new")] and rows(store.read("b")) == [(1, 5)]
    assert rows(store.read("a", 1)) == [(1, "x")]


def test_whole_shop_snapshot_survives_a_dead_writer(spark, tmp_path):
    from storelake.plans.registry import context
    t = context(spark, SF_SMALL).t
    path = str(tmp_path / "shop")
    t.write_snapshot(path)
    n = t.orders.count()
    bad = t.complaint.withColumn("status", F.raise_error(F.lit("gone")).cast("string"))
    with pytest.raises(Exception, match="gone"):
        t.with_(users=t.users.limit(0), orders=t.orders.limit(0), complaint=bad).write_snapshot(path)
    back = Tables.read_snapshot(spark, path)
    assert back.orders.count() == n and back.users.count() == t.users.count()
    with pytest.raises(FileNotFoundError):
        Tables.read_snapshot(spark, str(tmp_path / "none"))


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = small_store(spark, tmp_path), small_store(spark, tmp_path)
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    one.commit(replace={"a": a})
    late = two.version()
    one.commit(append={"a": a})
    late.number += 1
    with pytest.raises(ConcurrentCommit):
        two._publish(late)
    assert one.versions() == [1, 2] and one.read("a").count() == 2


def test_deltas_and_compaction(spark, tmp_path):
    store = small_store(spark, tmp_path)
    frame = lambda pairs: spark.createDataFrame(pairs, "k long, n long")
    store.commit(replace={"b": frame([(1, 1), (2, 2), (3, 3)])})
    store.commit(upsert={"b": frame([(2, 20), (4, 40)])})
    store.commit(upsert={"b": frame([(4, 41), (1, None)])})
    want = [(1, None), (2, 20), (3, 3), (4, 41)]
    key = lambda r: r[0]
    assert sorted(map(tuple, store.read("b").collect()), key=key) == want
    number = store.compact().number
    assert len(store.version().tables["b"]) == 1
    assert sorted(map(tuple, store.read("b").collect()), key=key) == want
    assert store.compact().number == number                     # nothing left to do
    store.vacuum()
    assert len(list((tmp_path / "b").iterdir())) == 1 and store.versions() == [number]


def test_a_hundred_commits_leave_few_folders(spark, tmp_path):
    store = small_store(spark, tmp_path)
    frame = lambda pairs: spark.createDataFrame(pairs, "k long, n long").coalesce(1)
    store.commit(replace={"b": frame([(-1, 0)])})
    want = {-1: 0}
    for k in range(100):
        store.commit(upsert={"b": frame([(k % 7, k), (k, -k)] if k % 7 != k else [(k, k)])})
        want |= {k % 7: k, k: -k} if k % 7 != k else {k: k}
        store.merge_deltas(4)
        store.vacuum()
    assert len(store.version().tables["b"]) <= 1 + 3 * 4 and len(store.versions()) == 1
    assert len(list((tmp_path / "b").iterdir())) == len(store.version().tables["b"])
    assert {r.k: r.n for r in store.read("b").collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_join_orders_and_lines_without_a_shuffle(spark, tmp_path):
    from storelake.operators.orders import order_details, orders_with_items
    from storelake.operators.reports import live_lines, sales_summary
    from storelake.plans.registry import context
    t = context(spark, SF_SMALL).t
    path = str(tmp_path / "shop")
    t.write_snapshot(path, layouts={n: Layout(bucket="order_id", buckets=4) for n in ("orders", "order_items")})
    back = Tables.read_snapshot(spark, path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" in _plan(live_lines(t)) and "Exchange" not in _plan(live_lines(back))
        lines = back.order_items.select("order_id", "orderItem_id")
        assert "Exchange" not in _plan(back.orders.join(lines, "order_id", "left"))
        assert "hashpartitioning(order_id" in _plan(order_details(t))
        assert "hashpartitioning(order_id" not in _plan(order_details(back, colocated=True))
        assert "hashpartitioning(order_id" not in _plan(orders_with_items(back))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows(sales_summary(back)) == rows(sales_summary(t))
    assert sorted(map(str, order_details(back, colocated=True).collect())) == sorted(map(str, order_details(t).collect()))
    # another session's catalog does not know the table: it is named again from the manifest
    for table in spark.catalog.listTables():
        if table.name.startswith("stored_"):
            spark.sql(f"DROP TABLE {table.name}")
    again = Tables.read_snapshot(spark, path)
    assert again.orders.count() == t.orders.count() and "hashpartitioning(order_id" not in _plan(order_details(again, colocated=True))


def test_lookups_of_few_keys_skip_row_groups(spark, tmp_path):
    from storelake.operators.lookups import with_keys
    n = 40_000
    users = spark.range(n).selectExpr(
        "id AS user_id", "concat('n', id) AS name", "concat(sha2(cast(id AS string), 256), '@example.com') AS email",
        "CAST(NULL AS string) AS phone", "'customer' AS role", "CAST(NULL AS string) AS notes",
        "CAST(NULL AS timestamp_ntz) AS created_at")
    store = Store(spark, str(tmp_path), {"users": SCHEMAS["users"]}, {"users": Layout(sort="user_id", files=8, bloom=("email",))})
    store.commit(replace={"users": users})

    def rows_scanned(df):
        got = df.collect()
        plan, total = [df._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                node = node.executedPlan()
            children = node.children()
            plan += [children.apply(i) for i in range(children.size())]
            if node.nodeName().startswith("Scan parquet"):
                total += node.metrics().get("numOutputRows").get().value()
        return len(got), total

    stored = store.read("users")
    keys = spark.createDataFrame([(7,), (39_000,), (None,)], "user_id long")
    found, scanned = rows_scanned(with_keys(stored, keys, "user_id"))
    assert found == 2 and scanned < 3 * n // 8
    mail = users.where("user_id IN (5, 12345)").select("email")
    found, scanned = rows_scanned(with_keys(stored, mail, "email"))
    assert found == 2 and scanned < n / 2
    many = spark.range(5000).selectExpr("id AS user_id")
    assert with_keys(stored, many, "user_id").count() == 5000
    assert with_keys(stored, many.limit(0), "user_id").count() == 0
