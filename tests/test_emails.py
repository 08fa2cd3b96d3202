"""E-mail changes (W2) against a sequential replay."""

import random

import pytest
from shop_helpers import make_tables


def replay(users, asks):
    holds, refused = dict(users), set()
    for seq, user, email in sorted(asks):
        if user not in holds:
            continue
        if any(e == email and u != user for u, e in holds.items()):
            refused.add(seq)
        else:
            holds[user] = email
    return refused


@pytest.mark.parametrize("users, emails, replay_rows", [(120, 90, 1 << 19), (120, 90, 30), (8, 6, 40)])
def test_changes_match_replay(spark, users, emails, replay_rows):
    from storelake.operators.emails import refused_changes
    rng = random.Random(users + emails + replay_rows)
    owned = [(u, f"e{u}" if rng.random() < 0.8 else f"e{rng.randrange(4)}") for u in range(users)] + [(users, None)]
    asks = [(s, rng.randrange(users + 2), f"e{rng.randrange(emails)}" if rng.random() < 0.9 else "hot")
            for s in range(0, 450, 3)]
    got = refused_changes(spark.createDataFrame(owned, "user_id long, email string"),
                          spark.createDataFrame(asks, "seq long, user_id long, email string").repartition(4), replay_rows)
    got = [r.seq for r in got.collect()]
    want = replay(owned, asks)
    assert sorted(got) == sorted(want) and want


def test_an_email_given_up_in_the_batch_is_free(spark):
    from storelake.operators import changes as W
    users = [(1, "A", "x@e.org", None, "customer", None, None), (2, "B", "b@e.org", None, "customer", None, None),
             (3, "C", "c@e.org", None, "customer", None, None)]
    t = make_tables(spark, users=users)
    edits = [(1, 2, "B1", " x@e.org"), (2, 1, "A1", "new@e.org"), (3, 2, "B2", "x@e.org "), (4, 1, "A2", "x@e.org"),
             (5, 3, "C1", "b@e.org"), (6, 3, None, " ")]
    batch = spark.createDataFrame([(s, u, n, e, None, None, None, "customer") for s, u, n, e in edits],
                                  "seq long, user_id long, name string, email string, phone string, notes string, role string, caller_role string")
    out = W.patch_users(t, batch)
    assert sorted(r.seq for r in out["rejects"].collect()) == [1, 4]
    assert sorted((r.user_id, r.name, r.email) for r in out["users"].collect()) == [
        (1, "A1", "new@e.org"), (2, "B2", "x@e.org"), (3, "C1", "b@e.org")]
