"""Sharding, packing, neighbour search and the pipeline."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from corpus_rows import SCHEMA, doc_rows
from storelake.llm import neighbours, packing, sharding
from storelake.llm.common import read_table

SF = "/root/testdata/sf0.01"


def test_shards_are_near_equal_and_whole(spark):
    # one source and one text hold a third of all rows
    df = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot " * 30)).otherwise(F.concat(F.lit("t"), F.repeat(F.lit("é"), (F.col("id") % 97).cast("int")))).alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source")) \
        .withColumn("doc_id", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id"))).drop("id")
    got = sharding.assign_shards(df).toPandas()
    src = df.toPandas()
    want = sorted((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in zip(src.doc_id, src.text))
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == want
    by = got.groupby("shard")["size"].sum()
    assert list(by.index) == list(range(40)) and by.max() < 1.05 * by.mean() and by.min() > 0.95 * by.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_slots_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 10)
    got = sharding.assign_shards(read_table(spark, SF, "documents"), 4).toPandas()
    assert len(got) == 1000
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_sharding_defined_cases(docs, no_docs):
    got = sharding.assign_shards(docs).toPandas()
    assert len(got) == docs.count() and got.shard.between(0, 39).all()
    assert (got[got["size"] == 16].text_crc32 == 0).all()
    assert sharding.assign_shards(no_docs).collect() == []


def _ids(text):
    from tokenizers import Tokenizer
    global _TOK
    if "_TOK" not in globals():
        _TOK = Tokenizer.from_file(packing.tokenizer_path())
    return np.array(_TOK.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def _check_packed(got, texts, limits=packing.Limits()):
    """``texts``: doc_id -> text, ids unique."""
    for d, own in got.groupby("doc_id"):
        own, ids = own.sort_values("start"), _ids(texts[d])
        assert (own.doc_tokens == len(ids)).all() and own.start.iloc[0] == 0
        assert (own.start + own.length).tolist() == own.start.tolist()[1:] + [len(ids)]
        for s, n, c in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(ids[s:s + n].tobytes()) == c
    assert set(got.doc_id) == set(texts)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset + own.length).tolist() == own.offset.tolist()[1:] + [own.length.sum()]
        prompt = np.clip(limits.prompt - own.start, 0, own.length)
        assert own.length.sum() <= limits.tokens and len(own) <= limits.segments and (own.length - prompt).sum() <= limits.loss


def test_packing_keeps_every_id_and_little_padding(spark):
    got = packing.packing_query(spark, SF).toPandas()
    texts = read_table(spark, SF, "documents").toPandas().set_index("doc_id").text.to_dict()
    _check_packed(got, texts)
    assert 1 - got.length.sum() / (4096 * got.sequence_id.nunique()) < 0.015
    # every limit closes sequences
    limits = packing.Limits()
    got["loss"] = got.length - np.clip(limits.prompt - got.start, 0, got.length)
    used = got.groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"), loss=("loss", "sum"))
    full = pd.DataFrame({"tokens": used.tokens == limits.tokens, "segments": used.segments == limits.segments, "loss": used.loss == limits.loss})
    for name in full:
        assert (full[name] & (full.sum(axis=1) == 1)).any(), name


def _plain_pack(demand, capacity):
    """The dot-product heuristic piece by piece: (bin, place) of each."""
    kinds = sorted({tuple(d) for d in demand})
    weight = [sum(k[j] / capacity[j] for k in kinds) / len(kinds) for j in range(3)]
    todo = {k: [i for i, d in enumerate(demand) if tuple(d) == k] for k in kinds}
    out, b = {}, 0
    while any(todo.values()):
        room, n = list(capacity), 0
        while True:
            fits = [k for k in kinds if todo[k] and all(x <= r for x, r in zip(k, room))]
            if not fits:
                break
            best = max(fits, key=lambda k: sum(k[j] / capacity[j] * weight[j] * room[j] / capacity[j] for j in range(3)))
            i = todo[best].pop(0)
            out[i] = (b, n)
            room, n = [r - x for r, x in zip(room, best)], n + 1
        b += 1
    return [out[i] for i in range(len(demand))]


def test_pack_vectors_equals_plain_heuristic():
    rng = np.random.default_rng(8)
    for _ in range(20):
        length = rng.integers(1, 4000, 60)
        demand = np.stack([length, np.ones(60, int), np.maximum(0, length - rng.integers(0, 64, 60))], axis=1)
        bins, place = packing.pack_vectors(demand, np.array([4096, 5, 4064]))
        assert list(zip(bins.tolist(), place.tolist())) == _plain_pack(demand.tolist(), (4096, 5, 4064))


def test_ids_of_odd_texts():
    odd = ["A0b 0 00 x<|endoftext|>y <|ENDOFTEXT|> z", "It's I'LL 3.14 naïve ΣΑΣ İstanbul ﬁ", "é a b c\u0085d ́x", "",
           "�​ 中文\U0001f600 0", "0", " 0 0 ", "x" * 3000, "\x00\x1c\x1d a\tb", None, "<|", "a0 b0 c0"]
    table = packing.WordIds(packing.tokenizer_path())
    for _ in range(2):                   # second time from the table
        ids, bounds = table.ids_of([None if t is None else t.encode() for t in odd], 2)
        for i, t in enumerate(odd):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == _ids(t).tolist(), t


def test_pack_vectors_respects_all_limits():
    rng = np.random.default_rng(3)
    demand = np.stack([rng.integers(1, 100, 500), np.ones(500, int), rng.integers(0, 50, 500)], axis=1)
    cap = np.array([100, 3, 60])
    bins, place = packing.pack_vectors(demand, cap)
    used = np.zeros((bins.max() + 1, 3), int)
    np.add.at(used, bins, demand)
    assert (used <= cap).all() and len(set(zip(bins, place))) == 500
    assert bins.max() + 1 <= 1.15 * max(np.ceil(demand.sum(axis=0) / cap))
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[101, 1, 0]]), cap)


def test_packing_defined_cases(spark, docs, no_docs):
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    small = packing.pack(packing.piece_rows(plain), group=16).toPandas()
    _check_packed(small, plain.toPandas().set_index("doc_id").text.to_dict())
    assert packing.pack(packing.piece_rows(docs)).groupBy().agg(F.sum("length")).first()[0] == \
        sum(len(_ids(r["text"])) for r in docs.collect())
    assert packing.pack(packing.piece_rows(no_docs)).collect() == []


def _exact(vectors, ids, q, own, k=5):
    score = (vectors * q).sum(axis=1) / (np.sqrt((vectors ** 2).sum(axis=1)) * np.sqrt((q * q).sum()))
    order = [i for i in np.lexsort([ids, -score]) if ids[i] != own][:k]
    return ids[order].tolist(), score[order]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_neighbours_recall(spark, sf):
    got = neighbours.neighbours_query(spark, sf).toPandas()
    table = read_table(spark, sf, "embeddings").toPandas()
    v, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        want, _ = _exact(v, ids, v[ids == q][0], q)
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        assert (np.diff(own.score) <= 0).all()
        hits += len(set(want) & set(own.vec_id))
        total += 5
    assert hits / total >= 0.95


def test_neighbours_defined_cases(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [0.0, 0.0]), (8, []), (9, [None, 1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (150, None)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, rank string")
    for block in (8192, 2):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = neighbours.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
        assert [(r[0], r[1], r[2], round(r[3], 9)) for r in got] == [
            (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 3, 0.0),
            (50, 1, 0, 1.0), (50, 2, 0, 1.0), (50, 3, 1, 1.0), (50, 4, 2, 1.0), (50, 5, 3, 0.0)]
    assert neighbours.nearest(df.where("vec_id > 200"), df.where("vec_id > 200")).collect() == []


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage after the classifier against plain Python, on what the classifier kept."""
    rows = [r for r in doc_rows(11) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    # alternating labels carry no information: the classifier keeps at least some documents
    spark.createDataFrame([(r[0], int(i % 9 != 0)) for i, r in enumerate(rows)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, rows[15][1]), (2, "a b c d e")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect()) if i else None
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/stage{i}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            got = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if i == 1:
            cut = brute.line_dedup(before)
            assert got == [(d, t) for (d, o), t in zip(before, cut) if t == o or brute.words(t)]
        elif i == 2:
            assert got == [b for b, (d, _, c) in zip(before, brute.jaccard(before)) if d == c]
        elif i == 3:
            assert got == [b for b, r in zip(before, brute.contamination(before, items)) if not r[5]]
        elif i == 4:
            _check_packed(docs.toPandas(), dict(before))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == docs.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_registers_the_operators():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def _plain_tree(rows, shards):
    """k-d tree over (size, keys) rows in plain Python: leaf of each row."""
    dims = len(rows[0][1])
    leaf = sum(s for s, _ in rows) / shards
    assert all(s > sharding.TOLERANCE * leaf for s, _ in rows)     # so that medians are exact
    out = [None] * len(rows)

    def split(members, first, leaves):
        if leaves == 1 or not members:
            for i in members:
                out[i] = first
            return
        spread = [(max(rows[i][1][d] for i in members) - min(rows[i][1][d] for i in members)) >> 31 for d in range(dims)]
        d = max(range(dims), key=lambda k: (spread[k], -k))
        order = sorted(members, key=lambda i: rows[i][1][d])
        target = sum(rows[i][0] for i in members) * (leaves // 2) / leaves
        below, n = 0, 0
        for i in order:
            if below + rows[i][0] >= target:
                n += target - below > below + rows[i][0] - target
                break
            below, n = below + rows[i][0], n + 1
        split(order[:n], first, leaves // 2)
        split(order[n:], first + leaves // 2, leaves - leaves // 2)

    split(list(range(len(rows))), 0, shards)
    return out


@pytest.mark.parametrize("shards", [3, 8])
def test_shards_equal_plain_tree(spark, monkeypatch, shards):
    """Texts of different sizes and sources, a third of them equal; the random bits are read from the written rows."""
    rng = np.random.default_rng(shards)
    rows = [(int(rng.integers(0, 10**6)), "x" * int(rng.integers(1, 400)) if i % 3 else "same text " * 12,
             str(rng.choice(["en", "de"])), str(rng.choice(["a", "b", "c"]))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    meta, kept = sharding.metadata(df).collect(), sharding.metadata(df)
    monkeypatch.setattr(sharding, "metadata", lambda docs: spark.createDataFrame(meta, kept.schema))
    keys = []
    for i in range(len(sharding.DIMENSIONS)):
        values = [r[f"_d{i}"] for r in meta]
        lo, span = min(values), max(1, max(values) - min(values))
        keys.append([int((float(v) - lo) / span * sharding._TOP) * (1 << 31) + r["_tie"] for v, r in zip(values, meta)])
    want = _plain_tree([(r["size"], [k[j] for k in keys]) for j, r in enumerate(meta)], shards)
    got = sharding.assign_shards(df, shards).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"]) for r in got) == sorted(
        (m["doc_id"], m["size"], s) for m, s in zip(meta, want))
    assert len(set(want)) == shards
