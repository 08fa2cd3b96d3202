"""Near-duplicate fingerprints (op11) against plain Python."""

import random

import numpy as np
import pytest
import xxhash
from corpus_rows import SCHEMA, edit, prose
from pyspark.sql import functions as F

import brute
from storelake.llm import simhash


def plain_fingerprint(text):
    w = brute.words(text)
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits):
    """Least index reachable from each index, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def expected(rows, bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = components(fps, bits)
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, f"{f:016x}", least.get(c, d)) for (d, _), f, c in zip(rows, fps, comp)), key=str)


def got(df):
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return sorted((tuple(r) for r in df.select("doc_id", digits, "component_id").collect()), key=str)


def test_texts_match_plain_version(docs, pairs):
    assert got(simhash.near_duplicates(docs)) == expected(pairs)


def test_near_copies_are_found(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        base = prose(rng, 400, 5000)
        rows += [base, edit(rng, base, 0.005), base + " end"]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert got(simhash.near_duplicates(df)) == want
    assert len({c for _, _, c in want}) < 80            # copies do link


def test_empty_and_clashing_columns(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    rows = [(1, "a b", "x", 5, 7, 2), (2, "a b", "y", 1, 1, 1), (3, None, None, 0, 0, 0), (4, " \n", None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, fp long, comp long, component_id long")
    assert got(simhash.near_duplicates(df)) == expected([(r[0], r[1]) for r in rows])


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = prose(random.Random(1), 900) + " \u0085 \x1f end"
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_fingerprint(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == whole


def scattered(rng, clusters, members, flips):
    out = set()
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(members):
            x = centre
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 2, 4, 5])
@pytest.mark.parametrize("bucket", [1 << 16, 8])
def test_links_of_fingerprints(spark, bits, bucket, monkeypatch):
    """Clusters around a centre, random ones and zeros; small buckets go through the large-bucket path."""
    rng = random.Random(bits)
    fps = scattered(rng, 4, 150, 8) + scattered(rng, 100, 1, 0) + [0, 1, 3, 31]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.comp for r in simhash.linked(nodes, bits, bucket).collect()}
    comp = components(fps, bits)
    groups = {}
    for x, c in zip(signed, comp):
        groups.setdefault(c, []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    assert {x: found.get(x, x) for x in signed} == want


def test_segments_keep_one_within_a_bit():
    for bits in range(1, 8):
        cut = simhash.segments(bits)
        assert sum(w for _, w in cut) == 64 and 2 * len(cut) > bits and 2 * (len(cut) - 1) <= bits
