"""Jaccard join, line dedup and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from corpus_rows import SCHEMA, edit, prose
from storelake.llm import decontaminate, jaccard, linededup
from storelake.operators.graph import components


def _key(row):
    return tuple((x is None, x) for x in row)


def test_jaccard_equals_brute_force(docs, pairs):
    got = [tuple(r) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got, key=_key) == sorted(brute.jaccard(pairs), key=_key)


def test_jaccard_finds_links_through_frequent_shingles(spark, monkeypatch):
    """Many near copies of one text, and a passage in most others: frequent classes, wide nodes, several rounds."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [edit(rng, base, 0.015) for _ in range(60)]
    texts += [passage + " " + prose(rng, n) for n in [5, 8, 10, 12, 14, 16, 18, 20] * 5]
    texts += [edit(rng, passage, 0.03) for _ in range(20)] + [" ".join(passage.split()[:k]) for k in range(3, 12)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "SEEN_OFTEN", (4, 20))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df).collect())
    assert got == sorted(brute.jaccard(rows))


def test_index_entries_meet(monkeypatch):
    """Any two sets that link share an entry that one of them may lead, whatever the classes."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 40))
        pool = np.arange(1, 3 * n + 3).astype(np.uint64)
        classes = rng.choice([1, 2, 3], len(pool), p=rng.dirichlet([2, 1, 1]))
        x = rng.choice(len(pool), n, replace=False)
        drop = int(rng.integers(0, n // 4 + 1))
        y = np.concatenate([x[drop:], rng.choice(np.setdiff1d(np.arange(len(pool)), x), int(rng.integers(0, n // 4 + 1)), replace=False)])
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        entries = []
        for s in (x, y):
            s = s[np.lexsort([pool[s], classes[s]])]
            keys, _, is_open, rest = jaccard.index_entries(pool[s], classes[s])
            entries.append({k: (o, r) for k, o, r in zip(keys, is_open, rest)})
        e, f = entries
        assert any(not (e[k][0] and f[k][0]) and 175 * min(e[k][1], f[k][1]) >= 75 * (len(x) + len(y)) for k in e.keys() & f.keys())


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")) \
        .unionByName(spark.range(3).select((F.col("id") + 1000).alias("a"), F.lit(999).alias("b")))
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in (999, 1000, 1001, 1002)} == {999}
    assert components(links.where("a < 0")).count() == 0


def test_jaccard_empty(no_docs):
    assert jaccard.jaccard_components(no_docs).collect() == []


def test_jaccard_stage_judges_rows_of_one_id_apart(spark):
    """Texts under one doc_id are kept or dropped by their own components, not by the id."""
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(3, a), (5, a + " more"), (5, b), (5, c), (5, c + " more"), (7, c), (9, d), (9, d), (9, ""), (9, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(parts)
        got = [(r["doc_id"], r["text"]) for r in jaccard.jaccard_stage(spark, df, "").collect()]
        assert len(got) == len(set(got)) == 5
        assert {(3, a), (5, b), (9, d)} <= set(got)
        assert len({(5, c), (5, c + " more")} & set(got)) == 1 and len({(9, ""), (9, None)} & set(got)) == 1


def test_jaccard_stage_keeps_one_of_each_group(spark, docs, pairs):
    got = jaccard.jaccard_stage(spark, docs, "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = Counter(r["doc_id"] for r in got.collect())
    want = {c for d, _, c in brute.jaccard(pairs) if d is not None and c == d}
    assert {k for k in kept if k is not None} == want
    assert all(n == 1 for k, n in kept.items() if k is not None) and kept[None] == 2


def _distinct(pairs):
    order = sorted(set(pairs), key=lambda r: (r[0] is None, r[0] or 0))
    return [r for r in order if not (r[0] is None)] + [r for r in order if r[0] is None]


@pytest.mark.parametrize("seed, bucket", [(1, 1 << 16), (2, 1 << 16), (2, 3)])
def test_line_dedup_equals_brute_force(spark, seed, bucket):
    """Runs of lines, passages in the middle of lines, and texts that repeat themselves; small buckets: windows as rows."""
    rng = random.Random(seed)
    lines = [prose(rng, rng.choice([1, 4, 9, 14, 30, 55, 70])).replace("\n", " ") for _ in range(40)]
    passages = [prose(rng, n) for n in (49, 50, 51, 64, 120)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(lines))
            parts += lines[k:k + rng.randrange(1, 8)] if rng.random() < 0.7 else [prose(rng, rng.randrange(1, 40)), ""]
        if rng.random() < 0.3:
            parts.append(f"  {prose(rng, 7)}\t{rng.choice(passages)}  {prose(rng, 9)} ")
        rows.append((i, "\n".join(parts)))
    rows += [(60, "\n".join(["a b c d e f g"] * 30)), (61, None), (62, ""), (63, rows[5][1]), (64, rows[6][1] + "\n\n"),
             (65, "same " * 200), (66, " ".join(["x y"] * 60) + " end"), (67, "same " * 70)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket=bucket).collect()}
    want = brute.line_dedup(rows)
    assert [got[i] for i, _ in rows] == want
    assert sum(a != b for a, (_, b) in zip(want, rows)) > 5


def test_line_dedup_cuts_passages_inside_lines(spark):
    rng = random.Random(9)
    passage = prose(rng, 60).replace("\n", " ")
    rows = [(k, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for k in range(5)] + [(9, prose(rng, 300))]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[9].text == rows[5][1]
    for k in range(1, 5):
        assert passage not in " ".join(got[k].text.split()) and got[k].words_removed >= 60
        assert len(got[k].text.split()) == 60 + 60 - got[k].words_removed


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = prose(random.Random(2), 120)
    names = ["doc_id", "text", "o", "_o", "t", "_t", "spans", "_spans", "gram", "lines_left"]
    df = spark.createDataFrame([(k, text, "a", "b", "c", "d", "e", "f", "g", 1) for k in (1, 2)], names)
    out = linededup.dedup_lines(df)
    assert out.columns == names[:-1] + ["lines_removed", "lines_left", "words_removed"]
    assert sorted((r.doc_id, r.o, r._o, r.t, r._t, r.spans, r._spans, r.words_removed) for r in out.collect()) == [
        (1, "a", "b", "c", "d", "e", "f", 0), (2, "a", "b", "c", "d", "e", "f", 120)]


def test_line_dedup_defined_cases(docs, no_docs, pairs):
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns + ["lines_removed", "lines_left", "words_removed"]
    rows = out.collect()
    assert len(rows) == len(pairs)
    want = dict(zip(_distinct(pairs), brute.line_dedup(_distinct(pairs))))
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert got == Counter((p[0], want[p]) for p in pairs)
    assert linededup.dedup_lines(no_docs).collect() == []


def test_decontamination_equals_brute_force(spark, docs, pairs):
    rng = random.Random(5)
    whole = pairs[15][1], pairs[18][1]
    items = [(1, whole[0]), (2, whole[1]), (2, whole[1]), (10, "One"), (None, "c d e"), (4, None), (5, "!!! ..."), (6, prose(rng, 30)),
             (7, " ".join(pairs[19][1].split()[5:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(pairs, items), key=_key)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    for block in (1 << 17, 20):          # one pass, and several passes over blocks of patterns
        got = decontaminate.find_contamination(docs, bench, pattern_block=block).select(*cols, (F.col("n_hit") > 0).alias("c")).collect()
        assert sorted([tuple(r) for r in got], key=_key) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_decontamination_empty(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(no_docs, none).collect() == []
    assert {r["n_hit"] for r in decontaminate.find_contamination(docs, none).collect()} == {0}


def test_sets_are_packed_and_unpacked():
    import numpy as np
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        tokens = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        assert (jaccard._unsix(jaccard._six(tokens)) == tokens >> np.uint64(14)).all()


def test_index_passes_find_the_same_entries(spark):
    """The rows indexed pass by pass are those of one pass, each pass with a share of them."""
    import numpy as np

    from storelake.llm import jaccard as J
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(40 + i % 5)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def found(passes):
        return [sorted(map(tuple, p.collect())) for p in J.written_entries(docs, *none, passes=passes)]

    whole, halves = found(1)[0], found(J.INDEX_PASSES)
    assert J.INDEX_PASSES > 1 and whole == sorted(sum(halves, [])) and all(0.3 < len(h) / len(whole) < 0.7 for h in halves)
