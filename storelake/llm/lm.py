"""Language-model scores from a weighted backoff automaton.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z and one end
token a text.  Counts come from all training texts (id crc32 modulo 7 not 2).

* Unigrams: add-one probabilities over all counted tokens, (c + 1) / (N + V + 1).
* Bigrams and trigrams of all tokens, counted over all training texts, kept from
  ``MIN_COUNT`` on; absolute discounting.  What a context leaves over goes to its
  shorter context (backoff weights that make every state's probabilities sum to 1).

A kept n-gram is an arc; a context with arcs is a state; a failure arc leads to the
state of the next shorter context and carries the log of the backoff weight.  The
automaton is a table keyed by n-gram hash, built by joins.  Its weights are pushed: an arc
carries what it adds to the failure path that it saves, and a state its failure weight.
Both of a kept n-gram's shorter n-grams are kept, so a text's score is the sum of the weights
of its words, bigrams and trigrams, whichever order they are met in.

* Counts: tasks send sorted, packed key blocks by key range (a key once in ``FLUSH``
  tokens); a range holds about ``RANGE`` keys.
* A trigram of enough count holds two bigrams of enough count, so trigrams with another bigram
  are not sent.  The kept keys are tested in a bit table of at most 2^``SIEVE_BITS`` bits:
  a full one lets more through and never drops a kept n-gram.
* What is shipped to tasks is bounded: the counts of at most ``HEAD`` tokens and
  ``BLOCK`` weights a pass; more weights mean more passes over the texts.  Rarer tokens
  get their counts through a join with the full table.

Defined cases: null and empty texts are the end token alone; without training
texts every token has probability 1 / (0 + 0 + 1); repeated rows are scored
each; other columns are ignored; a null id belongs to the training side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import fold, read_table
from storelake.llm.words import shingle_hashes, signed, text_chunks, words_of
from storelake.session import materialize

HEAD = 1 << 19
MIN_COUNT = 4
DISCOUNT = 0.75
BLOCK = 1 << 22          # weights shipped for one pass over the texts
RANGE = 1 << 20          # n-grams that one task merges at a time
SIEVE_BITS = 28
FLUSH = 1 << 22          # tokens that a task gathers before it emits their counts
END = np.uint64(1)       # stands for the end token among word hashes


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by END, and where each text begins."""
    words = words_of(texts)
    return (np.insert(words.hash, words.bounds[1:], END),
            words.bounds + np.arange(len(words.bounds)))


def _counts(keys_of):
    """mapInArrow function that emits (key, n), pre-aggregated over FLUSH tokens."""

    def emit(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(key[k:k + (1 << 17)]), pa.array(n[k:k + (1 << 17)], pa.int64())],
                                             names=["key", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, texts in text_chunks(batch):
                keys = keys_of(*tokens_of(texts))
                held.append(keys)
                size += len(keys)
                if size >= FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


def count_keys(texts: DataFrame, keys_of) -> DataFrame:
    """(key, n) over all texts; the first aggregation happens inside each task."""
    return (texts.select("text").mapInArrow(_counts(keys_of), "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))


def most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts from the smallest count on (in steps of 1/8 power of two)
    that leaves at most ``limit`` rows."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["s"], r["rows"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("rows")).collect()),
                   reverse=True)
    total, least = 0, None
    for s, rows in sizes:
        total += rows
        if total > limit:
            break
        least = s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = counts.where(step >= least).select("key", "n").toArrow()
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


@dataclass
class Sieve:
    """Bit table of keys by their upper ``size`` bits."""
    size: int
    bits: np.ndarray

    @staticmethod
    def width(rows: int, most: int = SIEVE_BITS) -> int:
        return int(min(most, max(15, np.ceil(np.log2(16 * max(1, rows))))))

    @staticmethod
    def of_table(kept: DataFrame) -> "Sieve":
        size = Sieve.width(kept.count())
        slot = F.shiftrightunsigned("key", 64 - size)
        rows = (kept.groupBy(F.shiftright(slot, 15).alias("at"))
                .agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect())
        bits = np.zeros((1 << size) // 32768, "V4096")
        for r in rows:
            bits[r["at"]] = bytes(r["bits"])
        return Sieve(size, bits.view(np.uint8))

    @staticmethod
    def of_keys(keys: np.ndarray) -> "Sieve":
        size = Sieve.width(len(keys))
        flags = np.zeros(1 << size, bool)
        flags[keys >> np.uint64(64 - size)] = True
        return Sieve(size, np.packbits(flags, bitorder="little"))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.size)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def grams(hashes: np.ndarray, vocab: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the bigram and the trigram that begin at each token, and which of them count:
    the end token only ends an n-gram, and words are of the vocabulary (None: all)."""
    inner = hashes != END
    known = np.ones(len(hashes), bool) if vocab is None else np.isin(hashes, vocab) | ~inner
    two = inner[:-1] & known[:-1] & known[1:]
    return shingle_hashes(hashes, 2), two, shingle_hashes(hashes, 3), two[:-1] & two[1:]


def _planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes and so on: high bytes that are 0 compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _values(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


_PACKED = "part int, keys binary, n binary, shorter binary"


def _packed(keys_of, bits: int):
    """mapInArrow function: the keys of FLUSH tokens, each once, with their counts and shorter n-grams, by key range."""

    def emit(held):
        key, at, n = np.unique(np.concatenate([k for k, _ in held]), return_index=True, return_counts=True)
        shorter = np.concatenate([s for _, s in held])
        cut = np.searchsorted(key, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        for part, (a, b) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(key)])):
            if b > a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([_planes(np.diff(key[a:b], prepend=np.uint64(0)))], pa.binary()),
                     pa.array([_planes(n[a:b].astype(np.uint32))], pa.binary()),
                     pa.array([_planes(shorter[at[a:b]].ravel()) if len(shorter) else b""], pa.binary())],
                    names=["part", "keys", "n", "shorter"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, texts in text_chunks(batch):
                held.append(keys_of(tokens_of(texts)[0]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    return run


_NONE = np.zeros((0, 2), np.uint64)


def gather_grams(texts: DataFrame, keys_of, tokens: int, min_count: int = 1) -> DataFrame:
    """(key, n, left, right) of the n-grams that ``keys_of`` gives for a chunk's tokens as (keys,
    rows of their shorter n-grams or none); ``tokens``: how many there are about."""
    bits = int(min(14, max(5, np.ceil(np.log2(max(1, tokens / RANGE))))))

    def merge(table):
        key = np.concatenate([np.cumsum(_values(x.as_py(), np.uint64), dtype=np.uint64) for x in table["keys"]])
        n = np.concatenate([_values(x.as_py(), np.uint32) for x in table["n"]]).astype(np.int64)
        shorter = np.concatenate([_values(x.as_py(), np.uint64) for x in table["shorter"]]).reshape(-1, 2)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(n[order], first)
        keep = n >= min_count
        own = order[first[keep]]
        sides = [pa.array(signed(shorter[own, i])) if len(shorter) else pa.nulls(len(own), pa.int64()) for i in (0, 1)]
        return pa.table({"key": signed(key[first[keep]]), "n": n[keep], "left": sides[0], "right": sides[1]})

    return (texts.select("text").mapInArrow(_packed(keys_of, bits), _PACKED)
            .groupBy("part").applyInArrow(merge, "key long, n long, left long, right long"))


@dataclass
class Automaton:
    vocab: np.ndarray | None     # sorted hashes of the words that n-grams are made of (None: all)
    weights: DataFrame           # (key, w): pushed weights of states and arcs by n-gram hash
    size: int                    # rows of ``weights``


def build(texts: DataFrame, unigrams: DataFrame, total: int, types: int, vocab: np.ndarray | None,
          min_count: int) -> Automaton:
    sc = texts.sparkSession.sparkContext

    def bigrams(hashes):
        key, counts, _, _ = grams(hashes, vocab)
        return key[counts], _NONE

    kept2 = materialize(gather_grams(texts, bigrams, total, min_count).select("key", "n"), "bigrams")
    sieve2 = sc.broadcast(Sieve.of_table(kept2))

    def trigrams(hashes):
        two, _, key, counts = grams(hashes, vocab)
        may = sieve2.value.may_hold(two)
        return key[counts & may[:-1] & may[1:]], _NONE

    kept3 = materialize(gather_grams(texts, trigrams, total, min_count).select("key", "n"), "trigrams")
    sieve3 = sc.broadcast(Sieve.of_table(kept3))

    def shorter(hashes):                  # the shorter n-grams of what is kept, and of some that are not
        two, counts2, three, counts3 = grams(hashes, vocab)
        at2 = np.flatnonzero(counts2 & sieve2.value.may_hold(two))
        at3 = np.flatnonzero(counts3 & sieve3.value.may_hold(three))
        return (np.concatenate([two[at2], three[at3]]),
                np.concatenate([np.stack([hashes[at2], hashes[at2 + 1]], 1), np.stack([two[at3], two[at3 + 1]], 1)]))

    sides = materialize(gather_grams(texts, shorter, total).select("key", "left", "right"), "shorter")
    two, three = kept2.join(sides, "key"), kept3.join(sides, "key")

    gain = F.col("n") - F.lit(DISCOUNT)

    def failure(seen, below):
        least = F.lit(1e-9)
        return F.log10(F.greatest(1 - seen, least) / F.greatest(1 - below, least))

    def solve(arcs, contexts):
        """States (left, of, back) and arcs with them; ``arcs`` has p_below, ``contexts`` (left, of): their counts."""
        sums = materialize(arcs.groupBy("left").agg(F.sum(gain).alias("gain"), F.sum("p_below").alias("below")), "contexts")
        states = materialize(sums.join(contexts, "left")
                             .select("left", "of", failure(F.col("gain") / F.col("of"), F.col("below")).alias("back")), "states")
        p = gain / F.col("of")
        return states, materialize(arcs.join(states, "left").select(
            "key", "n", p.alias("p"), (F.log10(p) - F.col("back") - F.log10("p_below")).alias("w")), "arcs")

    p1 = (F.col("n") + 1) / F.lit(float(total + types + 1))
    states2, arcs2 = solve(materialize(two.join(unigrams.select(F.col("key").alias("right"), p1.alias("p_below")), "right"), "two"),
                           unigrams.select(F.col("key").alias("left"), F.col("n").alias("of")))
    states3, arcs3 = solve(materialize(three.join(arcs2.select(F.col("key").alias("right"), F.col("p").alias("p_below")), "right"), "three"),
                           arcs2.select(F.col("key").alias("left"), F.col("n").alias("of")))
    longer = states3.select(F.col("left").alias("key"), F.col("back"))
    weights = (states2.select(F.col("left").alias("key"), F.col("back").alias("w"))
               .unionByName(arcs2.join(longer, "key", "left").select("key", (F.col("w") + F.coalesce("back", F.lit(0.0))).alias("w")))
               .unionByName(arcs3.select("key", "w")))
    weights = materialize(weights, "weights")
    return Automaton(vocab, weights, weights.count())


@dataclass
class Weights:
    """One block of the automaton's weights."""
    vocab: np.ndarray | None
    key: np.ndarray          # sorted
    weight: np.ndarray
    sieve: Sieve

    @staticmethod
    def of(vocab: np.ndarray | None, rows: DataFrame) -> "Weights":
        table = rows.select("key", "w").toArrow()
        key = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        return Weights(vocab, key[order], table.column("w").to_numpy()[order], Sieve.of_keys(key))

    def read(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What this block adds to the score of each text: tokens ``bounds[i]:bounds[i + 1]``."""
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out = np.zeros(len(bounds) - 1)
        two, counts2, three, counts3 = grams(hashes, self.vocab)
        for key, counts in ((hashes, hashes != END), (two, counts2), (three, counts3)):
            at = np.flatnonzero(counts & self.sieve.may_hold(key))
            pos = np.minimum(np.searchsorted(self.key, key[at]), max(0, len(self.key) - 1))
            hit = self.key[pos] == key[at] if len(self.key) else np.zeros(0, bool)
            out += np.bincount(doc[at[hit]], self.weight[pos[hit]], len(out))
        return out


@dataclass
class Model:
    automaton: Automaton
    head: np.ndarray         # sorted token hashes with known counts, their counts
    count: np.ndarray
    total: int
    types: int


def train(texts: DataFrame, head: int = HEAD, lm_words: int | None = None,
          min_count: int = MIN_COUNT) -> tuple[Model, DataFrame]:
    """The model and the table of all token counts (key, n).  ``lm_words``: n-grams only of the end
    token and the ``lm_words`` - 1 most frequent words (None: of all tokens)."""
    unigrams = materialize(count_keys(texts, lambda hashes, _: signed(hashes)), "unigrams")
    sums = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    key, n = most_frequent(unigrams, head)
    hashes = key.view(np.uint64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    vocab = None
    if lm_words is not None:
        words = np.flatnonzero(hashes != END)
        vocab = np.sort(hashes[words[np.lexsort([hashes[words], -n[words]])][:lm_words - 1]])
    automaton = build(texts, unigrams, int(sums["n"]), int(sums["v"]), vocab, min_count)
    return Model(automaton, hashes, n, int(sums["n"]), int(sums["v"])), unigrams


def further_blocks(docs: DataFrame, automaton: Automaton, block: Column, blocks: int) -> DataFrame:
    """(_t, more): by text hash, what the weight blocks from the second on add to a text's score."""

    def adding(shipped):
        def run(batches):
            for batch in batches:
                for part, texts in text_chunks(batch):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shipped.value.read(*tokens_of(texts)))],
                                                     names=["_t", "w"])
        return run

    parts = []
    for i in range(1, blocks):
        shipped = docs.sparkSession.sparkContext.broadcast(Weights.of(automaton.vocab, automaton.weights.where(block == i)))
        parts.append(materialize(docs.select(F.xxhash64("text").alias("_t"), "text").mapInArrow(adding(shipped), "_t long, w double")
                                 .groupBy("_t").agg(F.max("w").alias("w")), "block"))
        shipped.unpersist()
    return reduce(DataFrame.unionByName, parts).groupBy("_t").agg(F.sum("w").alias("more"))


def score(docs: DataFrame, model: Model, unigrams: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    automaton = model.automaton
    blocks = max(1, -(-automaton.size // block_rows))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(replace(model, automaton=None))
    weights = sc.broadcast(Weights.of(automaton.vocab, automaton.weights.where(block == 0)))
    schema = docs.select("doc_id").schema.add("_t", "long").add("rid", "long").add("n_tokens", "long").add("n_head", "long") \
        .add("base_head", "double").add("score_head", "double").add("tail", T.ArrayType(T.StructType().add("key", "long").add("n", "long")))

    def run(batches):
        m, row = shipped.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in text_chunks(batch):
                hashes, bounds = tokens_of(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
                if len(m.head):
                    pos = np.minimum(np.searchsorted(m.head, hashes), len(m.head) - 1)
                    known = m.head[pos] == hashes
                else:
                    pos, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                unigram = np.zeros(len(hashes))
                unigram[known] = np.log10((m.count[pos[known]] + 1) / (m.total + (m.types + 1)))
                base = np.bincount(doc, unigram, len(texts))
                logp = base + weights.value.read(hashes, bounds)
                rare = np.flatnonzero(~known)
                rare = rare[np.lexsort([hashes[rare], doc[rare]])]
                h, d = hashes[rare], doc[rare]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(rare) else rare
                tail = pa.StructArray.from_arrays([pa.array(signed(h[new])), pa.array(np.diff(np.append(new, len(h))), pa.int64())],
                                                  names=["key", "n"])
                ends = np.searchsorted(d[new], np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("_t")), pa.array(row + np.arange(len(texts))),
                     pa.array(np.diff(bounds), pa.int64()), pa.array(np.bincount(doc, known, len(texts)).astype(np.int64)),
                     pa.array(base), pa.array(logp),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)], names=[f.name for f in schema])
                row += len(texts)

    read = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("_t")).mapInArrow(run, schema), "scores")
    weights.unpersist()
    count = F.coalesce("c", F.lit(0))
    tails = (read.select("rid", F.inline("tail")).join(unigrams.select("key", F.col("n").alias("c")), "key", "left")
             .groupBy("rid").agg(F.sum(F.col("n") * F.log10((count + 1) / F.lit(float(model.total + model.types + 1)))).alias("tail_score"),
                                 F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("tail_known")))
    rest = F.coalesce("tail_score", F.lit(0.0))
    if blocks > 1:
        further = materialize(further_blocks(docs, automaton, block, blocks), "further")
        read = read.join(further, "_t").withColumn("score_head", F.col("score_head") + F.col("more")).drop("more")
    return (read.drop("tail").join(tails, "rid", "left")
            .select("doc_id", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                    (F.col("base_head") + rest).alias("base_score"), (F.col("score_head") + rest).alias("score")))


def lm_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model, unigrams = train(docs.where(~held))
    return (score(docs, model, unigrams)
            .select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                    "base_score", "score"))
