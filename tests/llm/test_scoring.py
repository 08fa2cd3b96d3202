"""Toxicity, quality, language model and secret scan: brute force and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from corpus_rows import SCHEMA, prose
from storelake.llm import lm, quality, secrets, toxicity
from storelake.llm.common import fold, read_table

SF = "/root/testdata/sf0.01"


def test_ftrl_learns_and_rejects_noise():
    rng = np.random.default_rng(0)
    rows, ys = [], []
    for _ in range(400):
        y = int(rng.random() < 0.5)
        idx = np.unique(np.concatenate([rng.integers(0, 200, 10), [200 + y], [1 << 10]]))
        rows.append((idx, np.ones(len(idx)) / 3))
        ys.append(y)
    w = quality.ftrl(rows, ys, 10)
    assert w[201] > 0 > w[200] and abs(w[201]) > np.abs(w[:200]).max()


def _labelled(spark, table, kind):
    labels = read_table(spark, SF, "labels")
    return table.join(labels, "doc_id").select("held_out", "score", "predicted", F.col(kind).alias("y")).toPandas()


def _auc(score, y):
    order = score.rank().to_numpy()
    n1 = int(y.sum())
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_quality_held_out(spark):
    got = quality.quality_query(spark, SF)
    rows = got.toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    held = _labelled(spark, got, "quality").query("held_out")
    assert _auc(held.score.reset_index(drop=True), held.y.to_numpy()) > 0.9
    assert held[held.y == 1].predicted.mean() > 0.97          # clean documents stay


def test_toxicity_held_out(spark):
    got = toxicity.toxicity_query(spark, SF)
    rows = got.toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    held = _labelled(spark, got, "toxic").query("held_out")
    assert held[held.y == 1].predicted.mean() >= 0.5 and held[held.y == 0].predicted.mean() < 0.05
    assert _auc(held.score.reset_index(drop=True), held.y.to_numpy()) > 0.8


def test_one_row_of_a_sampled_id_is_read(spark):
    from storelake.llm.common import label_sample, sampled_texts
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(50)] + [(2, None), (2, "two"), (3, None), (4, "four")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, toxic int")
    sample = label_sample(labels, "toxic", 100)
    rows = sampled_texts(docs, sample).collect()
    assert len(rows) == sample.count() and len({r.doc_id for r in rows}) == len(rows)
    assert {r.doc_id: r.text for r in rows}.get(2, "two") == "two"


@pytest.mark.parametrize("run", [
    lambda d, l: quality.score(d, quality.train(d, l)), lambda d, l: toxicity.score(d, toxicity.train(d, l))])
def test_classifiers_defined_cases(spark, docs, no_docs, run):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(40)] + [(3, 0, True), (None, 1, True), (5, None, None)],
                                "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    plain = docs
    for labels in (none, few, few.where("quality = 1").withColumn("toxic", F.lit(1))):
        rows = run(plain, labels).collect()
        assert len(rows) == plain.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert run(no_docs, few).collect() == []


def test_block_max_search_equals_brute_force():
    rng = np.random.default_rng(4)
    terms = np.arange(40, dtype=np.uint64)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)).round(1) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    vectors += vectors[:60]
    vectors.sort(key=lambda v: (v[0].tolist(), v[1].tolist()))
    index = toxicity.Index(terms, np.ones(40), rng.permutation(len(vectors)), rng.integers(0, 2, len(vectors)))
    index.fill(vectors)
    dense = np.zeros((len(vectors), 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, len(vectors), 7):
        t, w = vectors[i]
        cosine = np.round(dense[:, t] @ w, 12)
        order = [j for j in np.lexsort([index.ids, -cosine]) if cosine[j] > 0 and j != i][:toxicity.K]
        found, c = index.nearest(t, w, without=i)
        assert np.allclose(c, cosine[order]) and found.tolist() == order


# --- language model

def _texts(pairs):
    return [None if t is None else t.encode() for _, t in pairs]


def test_lm_base_scores_equal_brute_force(docs, pairs):
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    for head in (1 << 19, 20):           # all tokens shipped, and most looked up by a join
        model, unigrams = lm.train(docs.where(~held), head=head, lm_words=12, min_count=2)
        got = lm.score(docs, model, unigrams).withColumn("h", held).collect()
        flags = {r["doc_id"]: r["h"] for r in got}
        want = brute.base_scores(pairs, [flags[d] for d, _ in pairs])
        a = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
        b = sorted((d is None, d, n, k, round(s, 6)) for (d, _), (n, k, _, s) in zip(pairs, want))
        assert a == b and model.total == want[0][2]


def _reference_model(texts, words, min_count):
    """Backoff probabilities by the definition, from dictionaries."""
    sents = [brute.words(t) + [0] for t in texts]
    uni = Counter(w for s in sents for w in s)
    total, kinds = sum(uni.values()), len(uni)
    two = Counter((a, b) for s in sents for a, b in zip(s, s[1:]) if a in words and (b in words or b == 0))
    three = Counter(x for s in sents for x in zip(s, s[1:], s[2:]) if x[0] in words and x[1] in words and (x[2] in words or x[2] == 0))
    two = {k: n for k, n in two.items() if n >= min_count}
    three = {k: n for k, n in three.items() if n >= min_count}

    def p1(w):
        return (uni[w] + 1) / (total + kinds + 1)

    def back(seen, lower):
        return (1 - sum(seen.values())) / (1 - sum(lower(w) for w in seen)) if seen else 1.0

    def p2(a, w):
        seen = {k[1]: (n - lm.DISCOUNT) / uni[a] for k, n in two.items() if k[0] == a}
        return seen[w] if w in seen else back(seen, p1) * p1(w)

    def p3(a, b, w):
        seen = {k[2]: (n - lm.DISCOUNT) / two[(a, b)] for k, n in three.items() if k[:2] == (a, b)}
        return seen[w] if w in seen else back(seen, lambda x: p2(b, x)) * p2(b, w)

    def score(text):
        s, out = brute.words(text) + [0], 0.0
        for i, w in enumerate(s):
            if i > 1 and (s[i - 2], s[i - 1]) in two:
                out += math.log10(p3(s[i - 2], s[i - 1], w))
            elif i > 0:
                out += math.log10(p2(s[i - 1], w))
            else:
                out += math.log10(p1(w))
        return out

    known = list(uni)
    for a, b in list(two)[:10]:
        if b != 0:
            mass = sum(p3(a, b, w) for w in known) + back({}, p1) * 0
            unseen = p3(a, b, "never seen")
            assert abs(mass + unseen - 1) < 1e-6     # all tokens and one unknown
    return score


def test_automaton_equals_backoff_by_definition(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("the cat sat on a mat and The dog ran".split() + [f"z{rng.randrange(60)}"])
                         for _ in range(rng.choice([0, 1, 2, 3, 10, 64, 65, 66, 200])))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, unigrams = lm.train(df, lm_words=9, min_count=3)
    top = Counter(w for _, t in rows for w in brute.words(t))
    words = set(model.automaton.vocab.tolist())
    named = {w for w in top if int(lm.words_of([w.encode()]).hash[0]) in words}
    assert len(named) == 8
    want = _reference_model([t for _, t in rows], named, 3)
    extra = [(100, "the unseen cat unseen2 sat on"), (101, None), (102, "")]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows + extra, "doc_id long, text string"), model, unigrams).collect()}
    for i, t in rows + extra:
        assert abs(got[i] - want(t)) < 1e-6
    base = {r["doc_id"]: r["base_score"] for r in lm.score(df, model, unigrams).collect()}
    assert sum(got[i] for i, _ in rows) > sum(base.values())


def test_lm_ngrams_of_rare_words(spark):
    """N-grams count however many words are more frequent, and in however many blocks their weights are shipped."""
    rng = random.Random(3)
    filler = [f"f{i}" for i in range(2500)] * 6
    rng.shuffle(filler)
    rows = [(i, " ".join(filler[i::50])) for i in range(50)] + [(100 + i, f"rare words kept {i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, unigrams = lm.train(df)
    want = _reference_model([t for _, t in rows], {w for _, t in rows for w in brute.words(t)}, lm.MIN_COUNT)
    for block_rows in (lm.BLOCK, 2):
        got = {r["doc_id"]: r for r in lm.score(df, model, unigrams, block_rows=block_rows).collect()}
        assert len(got) == len(rows)
        for i, t in rows[::10] + rows[50:]:
            assert abs(got[i]["score"] - want(t)) < 1e-6
        assert all(got[100 + i]["score"] > got[100 + i]["base_score"] + 3 for i in range(4))


def test_lm_empty(spark, docs, no_docs):
    model, unigrams = lm.train(no_docs)
    rows = lm.score(docs, model, unigrams).collect()
    assert len(rows) == docs.count() and {r["base_score"] for r in rows} == {0.0} and {r["n_known"] for r in rows} == {0}
    assert lm.score(no_docs, model, unigrams).collect() == []


# --- secrets

def _secret_texts():
    rng = random.Random(9)
    key = lambda n, s="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(s) for _ in range(n))
    texts = ["secret:token:abcdefg", "token==abcdef", "PassWord = \"a/b+c.d=\" x", "api_key:'12345' apikey: 123456", "passwd :=secret",
             "AKIA" + key(15, "ABCDEF0123"), "AKIAAKIA" + key(16, "ABCDEF0123") + "z", "é中 token=éabcdef token=abcdef é AKIA" + key(16, "ABCD"),
             key(23, "abcdef01"), key(24, "abcdef01") + "g" + key(30, "abcdef01"), None, "", "secret", "password=short secret = " + key(30),
             "x" * 5000 + " token=" + key(40) + "\n" + "y" * 3000]
    plain = ("configuration directory compute_average internationalization_of_identifiers response_handler session "
             "maximum_number_of_connections translation operation authenticate_user_session window_aggregate_function "
             "documentation international_organization_names transaction_isolation_level_setting partition")
    texts += [f"{prose(rng, 20)} {plain} password={key(24)} {prose(rng, 5)} {key(32)} internationalization_of_identifiers {key(16, 'abcdef0123456789') * 2}"
              for _ in range(40)]
    return texts


def test_base_secrets_equal_brute_force(spark):
    texts = _secret_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = secrets.find_secrets(df)
    got = {r["doc_id"]: r for r in found.withColumn("base", secrets._listed("assign", "access", "hex"))
           .withColumn("all", secrets._listed(*secrets.KINDS)).collect()}
    for i, t in enumerate(texts):
        a, b, c, listed = brute.base_secrets(t)
        r = got[i]
        assert (len(r["assign"]), len(r["access"]), len(r["hex"])) == (a, b, c), (t, r)
        assert r["base"] == ",".join(listed)
        assert set(listed) <= set(r["all"].split(","))
        for x in r["markov"]:
            assert t[x["start"]:x["end"]] == x["value"]
    random_found = sum(len(got[i]["markov"]) for i in range(15, 55))
    assert random_found >= 36
    assert not any("internationalization" in x["value"] for r in got.values() for x in r["markov"])


def test_secret_beside_a_base_span(spark):
    """A random key joined to a base match is scored, and base matches themselves are not."""
    texts = _secret_texts()
    rng = random.Random(11)
    key = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    joined = [(key(28, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), sign) for sign in "/-=_"]
    first = len(texts)
    texts += [f"x {'0a1b2c3d' * 3}{sign}{k} y" for k, sign in joined]
    texts += [f"x {k}{sign}AKIA{key(16, 'ABCD0123')}{sign}{k} y" for k, sign in joined]
    got = {r["doc_id"]: r for r in secrets.find_secrets(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (k, _) in enumerate(joined * 2):
        r, text = got[first + i], texts[first + i]
        assert sum(k in x["value"] for x in r["markov"]) == text.count(k)
        for x in r["markov"]:
            assert text[x["start"]:x["end"]] == x["value"]
            assert not any(b["start"] < x["end"] and x["start"] < b["end"] for b in r["assign"] + r["access"] + r["hex"])


def test_identifiers_of_all_documents_count(spark):
    n = 4500
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("qwerty abc").alias("text")).unionByName(
        spark.createDataFrame([(n, "0a1b2c3d" * 3)], "doc_id long, text string"))
    ratio = secrets.train(df, secrets.scan(df))
    at = (ord("q") - 42) * 81 + ord("w") - 42          # unseen in the random string
    assert abs(ratio[at] - (math.log(0.5 / 40) - math.log((n + 0.5) / (n + 40)))) < 1e-9


def test_secrets_defined_cases(docs, no_docs):
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == docs.count()
    assert secrets.find_secrets(no_docs).collect() == []


def _plain_markov(texts):
    """Markov spans of each text by the module's rules, in plain Python."""
    import re
    base = [re.compile(p) for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX)]
    least = {0: secrets.ASSIGN_LEAST, 1: 0, 2: 0}
    spans, random, plain = [], Counter(), Counter()
    for text in texts:
        own = []
        for k, p in enumerate(base):
            for m in p.finditer(text):
                value = m[1] if k == 0 else m[0]
                if len(value) >= least[k]:
                    own.append((m.start(), m.end()))
                    random[value] += 1
        spans.append(sorted(own))
        for p in base:
            text = p.sub(" ", text)
        plain.update(re.findall(secrets.IDENTIFIER, text))

    def model(values):
        pair, total = Counter(), Counter()
        for v, n in values.items():
            for a, b in zip([None] + [ord(c) - secrets._FIRST for c in v], [ord(c) - secrets._FIRST for c in v]):
                a = 0 if a is None else a
                if 0 <= a < secrets._CODES and 1 <= b < secrets._CODES:
                    pair[a, b] += n
                    total[a] += n
        return lambda a, b: math.log((pair[a, b] + 0.5) / (total[a] + 0.5 * (secrets._CODES - 1)))

    one, two = model(random), model(plain)
    out = []
    for text, own in zip(texts, spans):
        found = []
        for m in re.finditer(secrets.LONG_RUN, text):
            at, parts = m.start(), []
            for a, b in own:
                if a < m.end() and b > m.start():
                    if a > at:
                        parts.append((at, a))
                    at = max(at, b)
            parts.append((at, m.end()))
            for a, b in parts:
                if b - a >= secrets.MARKOV_LENGTH:
                    codes = [ord(c) - secrets._FIRST for c in text[a:b]]
                    ratio = sum(one(p, c) - two(p, c) for p, c in zip([0] + codes, codes))
                    assert abs(ratio - secrets.MARKOV_LEAST) > 0.01           # far from the rounding of the shipped table
                    if ratio > secrets.MARKOV_LEAST:
                        found.append((a, b))
        out.append(found)
    return out


def test_markov_spans_equal_plain_version(spark):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for k in range(60):
        parts = [prose(rng, 12), f"password = '{key(rng.randrange(8, 30))}'", "some_long_identifier_name getInternalValueOf"]
        if k % 20 == 0:
            parts.append("0123456789abcdef" * 2)
        if k % 2:
            parts.append(key(rng.randrange(20, 60)))
        if k % 5 == 0:
            parts.append(f"{key(25)}/AKIA{'ABCDEFGH12345678'}-{key(30)}")
        if k % 7 == 0:
            parts.append("this_is_an_ordinary_identifier_with_many_words_in_it")
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(x.start, x.end) for x in r.markov] for r in secrets.find_secrets(df).collect()}
    want = _plain_markov(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 10 < sum(map(len, want)) and any(not w for w in want)
