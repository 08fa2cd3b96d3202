"""Exact checkout admission (W8) against a sequential replay, and the order
stream (X1) against the batch job."""

import random

import pytest
from shop_helpers import SF_MID, SF_SMALL


def _replay(requests, stock):
    """The shop's behaviour: one checkout after another against total stock."""
    stock = dict(stock)
    by_req = {}
    for rid, item, qty in requests:
        by_req.setdefault(rid, []).append((item, qty))
    admitted = set()
    for rid in sorted(by_req):
        lines = by_req[rid]
        if all(qty <= stock.get(item, 0) for item, qty in lines):
            admitted.add(rid)
            for item, qty in lines:
                stock[item] = stock.get(item, 0) - qty
    return admitted


def _ctx(spark, sf_dir):
    from storelake.plans.registry import Ctx
    from storelake.sources.driver import read_driver
    from storelake.sources.model import model_from_driver
    raw = read_driver(spark, sf_dir)
    t = model_from_driver(raw)
    return Ctx(spark, sf_dir, raw, t)


def test_exact_admission_matches_replay_on_fixture(spark):
    from storelake.operators.reports import variant_stock_per_item
    from storelake.operators.stock import admit_orders, priced_lines
    from storelake.sources.requests import order_requests
    ctx = _ctx(spark, SF_MID)
    lines = priced_lines(ctx.t, order_requests(ctx))
    reqs = [(r.request_id, r.item_id, r.quantity) for r in lines.collect()]
    stock = {r.item_id: r.stock_sum for r in variant_stock_per_item(ctx.t).collect()}
    want = _replay(reqs, stock)
    exact = {r.request_id for r in admit_orders(ctx.t, lines).collect()}
    assert exact == want and 0 < len(want) < len({r[0] for r in reqs})


def _random_checkouts(seed, requests, items, caps, most=4):
    rng = random.Random(seed)
    rows = []
    for rid in range(requests):
        for it in rng.sample(range(items), rng.randint(1, min(most, items))):
            rows.append((rid, it, rng.randint(1, 4), caps(it)))
    return rows


LINES = "request_id long, item_id long, quantity long, cap long"


@pytest.mark.parametrize("items, replay_lines", [(6, 1 << 17), (6, 60), (150, 60), (150, 12)])
def test_replays_of_any_size_agree(spark, replay_lines, items):
    """Whole replay, components in shared tasks, and prefixes of components that are too large."""
    from storelake.operators.sequence import greedy_admission
    rows = _random_checkouts(items, 150, items, lambda i: 3 + i % 9 if items > 50 else 30 + i)
    rounds = []
    lines = spark.createDataFrame(rows, LINES)
    got = {r.request_id for r in greedy_admission(lines, "request_id", ["item_id"], "quantity", "cap", rows_per_block=16,
                                                  replay_lines=replay_lines, rounds=rounds).collect()}
    assert got == _replay([(r, i, q) for r, i, q, _ in rows], {i: c for _, i, _, c in rows})
    assert len(rounds) <= 1 + len(rows) // replay_lines


@pytest.mark.parametrize("replay_lines, most_rounds", [(1 << 17, 1), (8000, 3)])
def test_long_chain_takes_few_rounds(spark, replay_lines, most_rounds):
    """10,000 checkouts, each sharing an item with the next: every second one is refused."""
    from storelake.operators.sequence import greedy_admission
    n = 10_000
    lines = spark.range(n).selectExpr("id AS request_id", "explode(array(id, id + 1)) AS item_id", "1L AS quantity", "1L AS cap")
    rounds = []
    got = {r.request_id for r in greedy_admission(lines, "request_id", ["item_id"], "quantity", "cap",
                                                  replay_lines=replay_lines, rounds=rounds).collect()}
    assert got == set(range(0, n, 2))
    assert len(rounds) <= most_rounds


def test_block_numbers_rise_and_stay_even(spark):
    """Blocks follow the rows of the largest group, whatever the ids look like."""
    from pyspark.sql import functions as F

    from storelake.operators.sequence import with_blocks
    df = spark.range(20_000).selectExpr("id % 10 DIV 7 AS g", "id * id AS seq")
    blocks = with_blocks(df, ["g"], "seq", 50)
    per = blocks.groupBy("g", "_blk").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect()
    assert max(r.n for r in per) < 200 and len(per) > 300
    for g in (0, 1):
        own = sorted((r._blk, r.lo, r.hi) for r in per if r.g == g)
        assert all(a[2] < b[1] for a, b in zip(own, own[1:]))


def test_exact_admission_random_hot_item(spark):
    from storelake.operators.sequence import greedy_admission
    rng = random.Random(7)
    rows, caps = [], {1: 40, 2: 15, 3: 5}
    for rid in range(300):
        items = {1} if rng.random() < 0.6 else set(rng.sample([1, 2, 3], rng.randint(1, 3)))
        for it in items:
            rows.append((rid, it, rng.randint(1, 4), caps[it]))
    lines = spark.createDataFrame(rows, "request_id long, item_id long, quantity long, cap long")
    got = {r.request_id for r in greedy_admission(lines, "request_id", ["item_id"], "quantity", "cap",
                                                  rows_per_block=16).collect()}
    assert got == _replay([(r, i, q) for r, i, q, _ in rows], caps)


def test_order_stream_equals_batch_with_rejections(spark, tmp_path):
    from storelake.operators.stock import place_orders
    from storelake.sources.requests import order_requests
    from storelake.streaming.streams import REQUEST_SCHEMA, feed_in_chunks, run_order_stream
    ctx = _ctx(spark, SF_MID)
    req = order_requests(ctx).select(*REQUEST_SCHEMA.fieldNames())
    batch = place_orders(ctx.t, req, order_date="2024-02-01 00:00:00")
    after = []
    feed_in_chunks(req, str(tmp_path / "src"), "request_id", 3, lambda: after.append(run_order_stream(
        spark, ctx.t, str(tmp_path / "src"), str(tmp_path / "state"), str(tmp_path / "ckpt"),
        order_date="2024-02-01 00:00:00")))
    final = after[-1]
    assert len(after) == 3
    stock_b = {r.itemQuant_id: r.stock for r in batch["items_quant"].collect()}
    stock_s = {r.itemQuant_id: r.stock for r in final.items_quant.collect()}
    assert stock_b == stock_s
    new_b = sorted(tuple(r) for r in batch["new_orders"].collect())
    new_s = sorted(tuple(r) for r in final.orders.join(ctx.t.orders.select("order_id"), "order_id",
                                                       "left_anti").collect())
    assert new_b == new_s


def test_stream_replay_is_idempotent(spark, tmp_path):
    """Running the stream again over its checkpoint changes nothing, nor does a batch that Spark
    repeats because it died between the store's commit and its own."""
    from storelake.sources.requests import order_requests
    from storelake.streaming.streams import REQUEST_SCHEMA, feed_in_chunks, order_state, run_order_stream
    ctx = _ctx(spark, SF_SMALL)
    req = order_requests(ctx).select(*REQUEST_SCHEMA.fieldNames())
    args = (spark, ctx.t, str(tmp_path / "src"), str(tmp_path / "state"), str(tmp_path / "ckpt"))
    feed_in_chunks(req, str(tmp_path / "src"), "request_id", 5,
                   lambda: run_order_stream(*args, order_date="2024-02-01 00:00:00", fan=2))
    store = order_state(spark, str(tmp_path / "state"))
    # five batches of deltas were merged in twos: tiers 2 and 0
    assert [e["tier"] for e in store.version().tables["orders"]] == [2, 0]
    assert len(list((tmp_path / "state" / "orders").iterdir())) <= 6

    def everything():
        final = run_order_stream(*args, order_date="2024-02-01 00:00:00", fan=2)
        return (sorted(map(str, final.orders.collect())), sorted(map(str, final.items_quant.collect())),
                sorted(map(str, final.order_items.collect())), sorted(map(str, store.read("rejects").collect())))

    first = everything()
    assert len(first[0]) > ctx.t.orders.count()
    number = store.version().number
    newest = max((tmp_path / "ckpt" / "commits").iterdir(), key=lambda f: int(f.name) if f.name.isdigit() else -1)
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert everything() == first and store.version().number == number


def test_order_stream_equals_one_batch_after_many_merges(spark, tmp_path):
    from storelake.operators.stock import place_orders
    from storelake.sources.requests import order_requests
    from storelake.streaming.streams import REQUEST_SCHEMA, feed_in_chunks, run_order_stream
    ctx = _ctx(spark, SF_SMALL)
    req = order_requests(ctx).select(*REQUEST_SCHEMA.fieldNames())
    want = place_orders(ctx.t, req, order_date="2024-02-01 00:00:00")
    after = []
    feed_in_chunks(req, str(tmp_path / "src"), "request_id", 4, lambda: after.append(run_order_stream(
        spark, ctx.t, str(tmp_path / "src"), str(tmp_path / "state"), str(tmp_path / "ckpt"),
        order_date="2024-02-01 00:00:00", fan=2)))
    stock = lambda df: sorted((r.itemQuant_id, r.stock) for r in df.collect())
    assert stock(after[-1].items_quant) == stock(want["items_quant"])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(after[-1].order_items) == rows(want["order_items"])


def test_unreadable_manifest_is_not_taken_for_an_empty_state(spark, tmp_path):
    from storelake.streaming.streams import order_state
    store = order_state(spark, str(tmp_path / "state"))
    assert store.version() is None
    (tmp_path / "state" / "_manifest").mkdir(parents=True)
    (tmp_path / "state" / "_manifest" / "000000000001.json").write_bytes(b"no manifest at all")
    with pytest.raises(Exception):
        store.version()


def test_cart_totals_read_few_deltas(spark, tmp_path):
    """X2 after many micro-batches: a bounded number of folders, the totals of one plain aggregate."""
    from pyspark.sql import functions as F

    from storelake.streaming import streams as X
    schema = "event_id long, user_id long, item_id long, op string, quantity int"
    rng = random.Random(4)
    rows = [(e, rng.randrange(5), rng.choice([1, 2, 3, None]), "add", rng.choice([None, 0, 1, 4])) for e in range(300)]
    df = spark.createDataFrame(rows, schema)
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    X.feed_in_chunks(df, src, "event_id", 9, lambda: X.cart_totals_stream(spark, src, df.schema, out, ckpt, fan=3))
    assert len(X._totals(spark, out).version().tables["totals"]) == 1        # nine batches, merged in threes
    assert len(list((tmp_path / "out" / "totals").iterdir())) <= 8            # with those of the kept versions
    want = (df.where("item_id IS NOT NULL").groupBy("user_id", "item_id")
            .agg(F.sum(F.greatest(F.coalesce("quantity", F.lit(1)), F.lit(1)))))
    assert sorted(map(tuple, X.read_cart_totals(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_cart_fold_equals_sequential_replay(spark):
    """One path for pairs of any size: many adds on one pair, updates that replace the cart."""
    from storelake.operators.cart import fold_cart
    from storelake.operators.reports import variant_stock_per_item
    ctx = _ctx(spark, SF_SMALL)
    stock = {r.item_id: r.stock_sum for r in variant_stock_per_item(ctx.t).collect()}
    items = sorted(stock)[:6]
    rng = random.Random(5)
    ops, carts = [], {}
    for e in range(3000):
        user, item = rng.choice([1, 1, 2, 3]), rng.choice(items)
        op = rng.choices(["add", "set", "remove", "update"], [90, 4, 3, 1])[0]
        q = rng.choice([None, 0, 1, 2, 3])
        posted = [(item, q)] + ([(i, 1) for i in items if i != item][:1] if op == "update" else [])
        for i, n in posted:
            ops.append((e, user, i, op, n))
        cart = carts.setdefault(user, {})
        if op == "add":
            n = max(1 if q is None else q, 1)
            if cart.get(item, 0) + n <= stock[item]:
                cart[item] = cart.get(item, 0) + n
        elif op == "remove":
            cart.pop(item, None)
        else:
            if op == "update":
                cart.clear()
            for i, n in posted:
                cart[i] = max(0, min(n, stock[i])) if n is not None else 0
    df = spark.createDataFrame(ops, "event_id long, user_id long, item_id long, op string, quantity int")
    got = {(r.user_id, r.item_id): r.quantity for r in fold_cart(ctx.t, df).collect()}
    assert got == {(u, i): n for u, c in carts.items() for i, n in c.items() if n > 0}


def _plain_taken(adds, cap):
    left = cap
    for q in adds:
        left -= q if q <= left else 0
    return cap - left


def test_step_function_equals_replay():
    from storelake.operators.fold import step_function
    rng = random.Random(2)
    for _ in range(200):
        adds = [rng.randint(1, rng.choice([1, 3, 20])) for _ in range(rng.randint(0, 25))]
        lo = rng.randint(0, 10)
        hi = lo + rng.randint(0, 120)
        start, taken = step_function(adds, lo, hi)
        for r in range(lo, hi + 1):
            k = max(i for i, s in enumerate(start) if s <= r)
            assert taken[k] == _plain_taken(adds, r)
    assert step_function([5, 3, 9, 4, 2], 0, 100, pieces=3) is None


@pytest.mark.parametrize("pieces", [1 << 15, 4])
def test_large_counters_are_folded_in_blocks(spark, pieces):
    from storelake.operators.fold import units_taken
    rng = random.Random(pieces)
    rows = [(1, e, rng.randint(1, 9), 400) for e in range(0, 3000, 3)] + [(2, e, 1, 10**6) for e in range(500)]
    rows += [(3, e, rng.randint(1, 30), 20_000) for e in range(900)] + [(4, 1, 5, 3), (5, 1, 5, 5), (None, 7, 2, 9), (6, 1, 1, -4)]
    rows += [(7, e, 2, 0) for e in range(90)]
    df = spark.createDataFrame(rows, "k long, e long, q long, cap long").repartition(5)
    got = {r.k: r.added for r in units_taken(df, ["k"], "e", block_adds=40, pieces=pieces).collect()}
    want = {}
    for k, e, q, cap in rows:
        want.setdefault(k, (cap, []))[1].append((e, q))
    assert got == {k: _plain_taken([q for _, q in sorted(a)], cap) for k, (cap, a) in want.items() if k is not None} | {None: 2}


def test_a_million_adds_of_one_pair(spark):
    """Blocks of one hot counter are folded side by side; the last word has the limit."""
    from storelake.operators.fold import units_taken
    n = 1_000_000
    adds = spark.range(n).selectExpr("1L AS k", "id AS e", "1 + id % 3 AS q", "700000L AS cap")
    want = _plain_taken([1 + i % 3 for i in range(n)], 700_000)
    assert [(r.k, r.added) for r in units_taken(adds, ["k"], "e").collect()] == [(1, want)]


def test_shuffle_tasks_follow_the_rows_of_the_lines(spark, monkeypatch):
    """A task's share of a large checkout must not grow with the input; small folders keep the session's settings."""
    from storelake import session
    from storelake.plans.registry import load_all
    usual = {k: spark.conf.get(k) for k in (session.SHUFFLE_TASKS, session.ADVISORY_SIZE)}
    build = load_all()["check_stock"].build
    want = sorted(map(tuple, build(spark, SF_SMALL).collect()))
    assert {k: spark.conf.get(k) for k in usual} == usual
    try:
        monkeypatch.setattr(session, "ROWS_PER_TASK", 250)
        large = build(spark, SF_SMALL)
        lines = _ctx(spark, SF_SMALL).raw["lineitem"].count()
        assert int(spark.conf.get(session.SHUFFLE_TASKS)) == -(-lines // 250) > int(usual[session.SHUFFLE_TASKS])
        assert sorted(map(tuple, large.collect())) == want
    finally:
        monkeypatch.undo()
        build(spark, SF_SMALL)
    assert {k: spark.conf.get(k) for k in usual} == usual


def test_whole_groups_are_decided_like_cut_ones(spark):
    """Groups that fit one block are summed by a plain window, larger ones in blocks: the same requests."""
    from storelake.operators.sequence import greedy_admission
    rng = random.Random(11)
    rows = [(rid, it, rng.randint(1, 5), 30 + it) for rid in range(400) for it in rng.sample(range(12), 2)]
    lines = spark.createDataFrame(rows, "request_id long, item_id long, quantity long, cap long")
    got = [{r.request_id for r in greedy_admission(lines, "request_id", ["item_id"], "quantity", "cap", rows_per_block=n,
                                                   replay_lines=20).collect()} for n in (8, 1 << 16)]
    assert got[0] == got[1] == _replay([(r, i, q) for r, i, q, _ in rows], {i: 30 + i for i in range(12)})


def test_rounds_that_shrink_need_no_components(spark, monkeypatch):
    """Shops whose stock runs out: running sums alone decide until one task can replay the rest."""
    from storelake.operators import sequence
    monkeypatch.setattr(sequence, "_replay_components", lambda *a: pytest.fail("components were searched"))
    rng = random.Random(5)
    rows = [(rid, it, rng.randint(1, 3), it % 4 * 4) for rid in range(1200) for it in rng.sample(range(300), rng.randint(1, 4))]
    rounds = []
    got = {r.request_id for r in sequence.greedy_admission(spark.createDataFrame(rows, LINES), "request_id", ["item_id"], "quantity",
                                                           "cap", replay_lines=150, rounds=rounds).collect()}
    assert got == _replay([(r, i, q) for r, i, q, _ in rows], {i: c for _, i, _, c in rows})
    assert len(rounds) > 1 and all(2 * b <= a for a, b in zip(rounds, rounds[1:]))


def test_lines_without_request_or_item_take_nothing(spark):
    from storelake.operators.sequence import greedy_admission
    rows = [(None, 1, 2, 2), (1, 1, 2, 2), (2, 1, 1, 2), (3, None, 9, 0), (4, 2, 3, 2), (4, 3, 1, 5), (5, 3, 5, 5)]
    for replay_lines in (1, 1 << 17):
        got = greedy_admission(spark.createDataFrame(rows, LINES), "request_id", ["item_id"], "quantity", "cap",
                               replay_lines=replay_lines).collect()
        assert {r.request_id for r in got if r.request_id is not None} == {1, 3, 5}
