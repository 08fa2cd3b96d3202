"""Integer vectors: code compression (op13) and hard negatives (op12) against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelake.llm import codebooks, negatives
from storelake.llm.vectors import integer_vectors

VECTORS = "vec_id long, label int, embedding array<double>, code string, v int, anchor string"


def whole(rows):
    """(vec_id, label, integer vector) of rows that take part in the coding."""
    return [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def vector_rows(rng, n, dims=32, far=0.0):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, rng.choice([0, 1, 2, None]) if rng.random() < 0.1 else rng.randrange(4),
             [c + rng.gauss(0, 0.4) + far for c in rng.choice(centres)]) for i in range(n)]
    rows += [rows[5], rows[5], (rows[6][0], 3, rows[7][2]), (None, 1, rows[8][2]), (900, None, rows[9][2]),
             (901, 1, None), (902, 1, [float("nan")] * dims), (903, 2, [None] * dims), (904, 2, [float("inf")] * dims),
             (905, 2, [0.0] * dims), (906, 2, [1.0] * (dims - 3)), (907, 1, rows[10][2]), (-100, 1, rows[11][2])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)


def plain_codes(rows, parts, entries, rounds):
    kept = whole(rows)
    dims = -(-max((len(v) for _, _, v in kept), default=0) // parts) * parts
    w = dims // parts
    kept = [(i, l, v + [0] * (dims - len(v))) for i, l, v in kept]
    least = {}
    for i, _, v in kept:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    seeds = [least[i] for i in sorted(least)[:entries]] or [[0] * dims]
    books = [[s[p * w:(p + 1) * w] for s in seeds] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], e)) for e in books[p]]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        taken = [[[] for _ in b] for b in books]
        for _, _, v in kept:
            for p in range(parts):
                taken[p][nearest(v, p)[1]].append(v[p * w:(p + 1) * w])
        books = [[[sum(x) // len(t) for x in zip(*t)] if t else e for e, t in zip(b, tk)] for b, tk in zip(books, taken)]
    out = []
    for i, l, v in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, l, bytes(e for _, e in best), sum(d for d, _ in best)))
    return out, books


@pytest.mark.parametrize("dims, parts, entries", [(32, 16, 64), (30, 4, 8), (5, 16, 3)])
def test_codes_match_plain_version(spark, dims, parts, entries):
    rows = vector_rows(random.Random(dims), 120, dims)
    found = codebooks.compress(table(spark, rows), parts=parts, entries=entries)
    want, books = plain_codes(rows, parts, entries, codebooks.ROUNDS)
    got = [(r.vec_id, r.label, bytes(r.code), r.error) for r in found.rows.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    flat = [x for p in books for e in p for x in e]
    assert found.digest() == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    by_code = {(r[0], r[3]): r[2] for r in got}
    one = next(r for r in whole(rows) if r[0] == 3)
    code, error = next((c, e) for (i, e), c in by_code.items() if i == 3)
    back = codebooks.restored(code, found.codebooks)
    padded = np.zeros(len(back), np.int64)
    padded[:len(one[2])] = one[2]
    assert ((padded - back) ** 2).sum() == error


def test_small_blocks_give_the_same_codes(spark, monkeypatch):
    rows = vector_rows(random.Random(1), 150)
    want = sorted(map(str, codebooks.compress(table(spark, rows)).rows.collect()))
    monkeypatch.setattr(codebooks, "BLOCK", 7)      # closures carry the module's value of the driver
    found = codebooks.compress(table(spark, rows).coalesce(1))
    assert sorted(map(str, found.rows.collect())) == want


def test_codes_of_odd_tables(spark):
    empty = codebooks.compress(table(spark, [(1, 1, None)]).where("false"))
    assert empty.rows.count() == 0 and empty.digest() == hashlib.sha256(b"").hexdigest()
    bare = codebooks.compress(table(spark, [(1, 1, []), (2, None, [])]))
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in bare.rows.collect()) == [(1, bytes(16), 0), (2, bytes(16), 0)]
    nameless = codebooks.compress(table(spark, [(None, 1, [1.0] * 16)]))
    assert [(bytes(r.code), r.error) for r in nameless.rows.collect()] == [(bytes(16), 0)]
    huge = codebooks.compress(table(spark, [(1, 1, [1e300] * 16), (2, 1, [-1e300] * 16)]))
    assert [r.error for r in huge.rows.collect()] == [0, 0]


def plain_negatives(rows, every, positives=5, count=10, low=30, high=90):
    kept = sorted({(i, l, tuple(v)) for i, l, v in whole(rows) if i is not None and l is not None})
    out = []
    for a in kept:
        if a[0] % every:
            continue
        score = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in kept]
        own = sorted(x for x in score if x[2] == a[1] and x[1] != a[0])[:positives]
        for p, pid, _ in own:
            fit = sorted(x for x in score if x[2] != a[1] and low * -p <= 100 * -x[0] <= high * -p)[:count]
            out += [(a[0], pid, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("far, blocks", [(0.0, None), (0.6, None), (0.6, (5, 16)), (0.0, (3, 40))])
def test_negatives_match_plain_version(spark, far, blocks, monkeypatch):
    """``far``: all vectors share a direction, so bounds leave rows out; small blocks: many trees."""
    if blocks:
        monkeypatch.setattr(negatives, "ANCHORS", blocks[0])
        monkeypatch.setattr(negatives, "ROWS", blocks[1])
    rows = vector_rows(random.Random(int(far * 10)), 200, 8, far)
    usable = integer_vectors(table(spark, rows).drop("v")).select("vec_id", "label", "v")
    found = negatives.hard_negatives(usable, F.col("vec_id") % 4 == 0)
    want = plain_negatives(rows, 4)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


def test_negatives_of_odd_tables(spark):
    def run(rows):
        usable = integer_vectors(table(spark, rows).drop("v")).select("vec_id", "label", "v")
        return sorted(tuple(r) for r in negatives.hard_negatives(usable, F.col("vec_id") % 2 == 0).collect())

    assert run([(0, 1, None)]) == []
    assert run([(0, 1, [1.0]), (2, 2, [1.0])]) == []                     # no positives
    rows = [(k, k % 3, [1.0, 0.5]) for k in range(30)] + [(30, 0, []), (31, 1, [0.0, 0.0])]
    assert run(rows) == plain_negatives(rows, 2)
    rows = [(k, k % 2, [1e6 + k, 3e5]) for k in range(1, 9)]             # cut to the bound; beyond exact floats
    cut = [(i, l, [min(x, (1 << 26) / 256) for x in v]) for i, l, v in rows]
    assert run(rows) == plain_negatives(cut, 2)


def test_tree_and_bounds_leave_rows_out():
    """Scores along the tree are exact, and near anchors are spared most of the rows."""
    rng = np.random.default_rng(5)
    anchors = rng.integers(-200, 200, 16) + rng.integers(-3, 4, (40, 16))
    rows = rng.integers(-200, 200, (500, 16))
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(40)) and parent[0] == -1 and all(p < k for k, p in enumerate(parent))
    placed = anchors[order]
    asked = 0
    for k, need, score in negatives.walk(rows, placed, parent, edge, lambda k, lo, hi: np.flatnonzero(hi >= np.sort(lo)[-5])):
        exact = rows @ placed[k]
        assert (score == exact[need]).all() and set(np.argsort(-exact)[:5]) <= set(need.tolist())
        asked += len(need)
    assert asked < 40 * 500 / 4
