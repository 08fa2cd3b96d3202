"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max
inverted indexes, distance-weighted votes, calibrated scores and evidence.

Training reads a bounded sample of labelled rows (``PER_CLASS`` ids a class and ``SAMPLE_BYTES`` of
their texts, not from the held-out fold).  Terms are words (digits, letters, all beyond ASCII;
A-Z lower-cased), and all terms of the examples are indexed.  A term weighs (1 + log of its count) times its IDF
times ``FLOOR`` + the square of its log-odds for label 1, where they are positive (shrunk by ``PRIOR``
examples): words that speak for label 1 decide who is near, and between texts that have none the
other words do.  Document frequencies behind the IDF are counted over all documents.

The index holds, for every term, the examples with it in blocks of ``BLOCK`` and the largest
weight of each block; alike examples share blocks.  A document's blocks are read by falling upper bound (the sum of
its weights times the blocks' maxima) until the k-th best cosine exceeds the next bound, so the ``K`` nearest
examples are exact; ties go to the smaller doc_id.  Neighbours vote with weight
1 / (1 - cosine + ``SOFT``); a logistic curve fitted on leave-one-out votes of the sample,
weighted to the class balance of all labels, turns votes into scores.  Documents without any term of an
example get the label share of the examples without any.

Defined cases: null and empty texts have no terms; with no label or one class only
the score is the (smoothed) share of label 1; repeated rows get a row each; of labelled rows that
share a doc_id one text is an example; extra columns are kept and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import fold, label_sample, labels_of, read_table, sampled_texts, with_fields
from storelake.llm.quality import logistic_fit
from storelake.llm.words import ALNUM, signed, text_chunks, words_of

PER_CLASS = 800
SAMPLE_BYTES = 32 << 20   # of a class's examples
FLOOR = 0.05
PRIOR = 5.0
BLOCK = 64
STEP = 16                 # blocks read at a time
PART = 4096               # terms whose document frequencies are added up together
K = 15
SOFT = 0.05
EVIDENCE = 3


def term_counts(texts: list[bytes | None], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, count), ordered by text and term; ``only``: sorted terms to keep."""
    words = words_of(texts, ALNUM)
    doc, term = words.doc(), words.hash
    if only is not None:
        if not len(only):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pos = np.minimum(np.searchsorted(only, term), len(only) - 1)
        keep = only[pos] == term
        doc, term = doc[keep], term[keep]
    order = np.lexsort([term, doc])
    doc, term = doc[order], term[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))) if len(doc) else doc
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0]..stop[0]-1, start[1]..stop[1]-1 and so on."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Index:
    """Block-max inverted index of the labelled examples, and the calibration."""
    terms: np.ndarray                    # sorted
    value: np.ndarray                    # weight of each term
    ids: np.ndarray                      # doc_id of each example
    label: np.ndarray
    # per term its blocks, from entry[t] to entry[t + 1]: number, largest weight, and where the block's postings begin
    entry: np.ndarray | None = None
    block: np.ndarray | None = None
    top: np.ndarray | None = None
    at: np.ndarray | None = None
    example: np.ndarray | None = None    # postings
    weight: np.ndarray | None = None
    blocks: int = 0
    slope: float = 0.0
    bias: float = 0.0
    bare: float = 0.5                    # score of a document without terms

    def unit(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and unit-length weights of ``count`` texts from (text, term, count) rows."""
        at = np.searchsorted(self.terms, term)
        weight = (1 + np.log(n)) * self.value[at]
        length = np.sqrt(np.bincount(doc, weight * weight, count))
        weight = weight / length[doc] if len(doc) else weight
        cuts = np.searchsorted(doc, np.arange(count + 1))
        return [(at[a:b], weight[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def vectors(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        return self.unit(*term_counts(texts, self.terms), len(texts))

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        size = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors])
        example = np.repeat(np.arange(len(vectors)), size)
        weight = np.concatenate([w for _, w in vectors])
        order = np.lexsort([example, term])
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        block = self.example // BLOCK
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        self.block, self.at = block[first], np.append(first, len(term))
        self.top = np.maximum.reduceat(self.weight, first)
        self.entry = np.searchsorted(term[first], np.arange(len(self.terms) + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, without: int | None = None
                ) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine above 0, and the cosines."""
        begin, end = self.entry[terms], self.entry[terms + 1]
        entry, w = _ranges(begin, end), np.repeat(weights, end - begin)
        block = self.block[entry]
        bound = np.bincount(block, self.top[entry] * w, self.blocks)
        order = np.argsort(-bound, kind="stable")
        found, cosine = np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, self.blocks, STEP):
            own = order[a:a + STEP]
            # rounding may put a bound just below the cosine it bounds
            if bound[own[0]] <= 0 or (len(found) == k and cosine[-1] > bound[own[0]] + 1e-9):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[own] = True
            hit = np.flatnonzero(chosen[block])
            lo, hi = self.at[entry[hit]], self.at[entry[hit] + 1]
            posting = _ranges(lo, hi)
            c = np.round(np.bincount(self.example[posting], self.weight[posting] * np.repeat(w[hit], hi - lo), len(self.ids)), 12)
            if without is not None:
                c[without] = 0
            i = np.flatnonzero(c > 0)
            if len(i) > 4 * k:           # only the best can stay
                i = i[c[i] >= np.partition(c[i], len(i) - k)[len(i) - k]]
            found, cosine = np.concatenate([found, i]), np.concatenate([cosine, c[i]])
            best = np.lexsort([self.ids[found], -cosine])[:k]
            found, cosine = found[best], cosine[best]
        return found, cosine

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = 1.0 / (1.0 - np.minimum(cosine, 1.0) + SOFT)
        return float((w * self.label[found]).sum() / w.sum())

    def score(self, vote: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * vote + self.bias, -500, 500))))


def term_values(term: np.ndarray, label: np.ndarray, kinds: int, ones: int, zeros: int) -> np.ndarray:
    """FLOOR + squared positive log-odds for label 1 of each of ``kinds`` terms; ``term`` and ``label``: one row per
    (example, term)."""
    in_one = np.bincount(term, label, kinds)
    in_zero = np.bincount(term, 1 - label, kinds)
    share = ones / (ones + zeros)
    odds = (np.log((in_one + PRIOR * share) / (ones + PRIOR))
            - np.log((in_zero + PRIOR * (1 - share)) / (zeros + PRIOR)))
    return FLOOR + np.maximum(odds, 0.0) ** 2


def document_frequency(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents with each term, over all documents, and the number of documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = shipped.value
        seen, rows = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            for part, texts in text_chunks(batch):
                _, term, _ = term_counts(texts, terms)
                seen[:-1] += np.bincount(np.searchsorted(terms, term), minlength=len(terms))
                rows += part.num_rows
        seen[-1] = rows
        cuts = range(0, len(seen), PART)
        yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int32()), pa.array([seen[k:k + PART].astype("<i8").tobytes() for k in cuts])],
                                         names=["part", "n"])

    def add(table):
        total = np.sum([np.frombuffer(x.as_py(), "<i8") for x in table["n"]], axis=0)
        return pa.table({"part": table["part"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect()
    out = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        out[r["part"]:r["part"] + PART] = np.frombuffer(r["n"], "<i8")
    return out[:-1], int(out[-1])


def _examples(docs: DataFrame, labels: DataFrame, kind: str, per_class: int, sample_bytes: int):
    """doc_id, label and (example, term, count) rows of the labelled sample, as arrays."""
    rows = sampled_texts(docs, label_sample(labels, kind, per_class)).withColumn("size", F.octet_length("text"))
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")       # at most per_class rows
    rows = rows.withColumn("so_far", F.sum(F.coalesce("size", F.lit(0))).over(so_far)).where(F.col("so_far") <= sample_bytes)

    def count(batches):
        for batch in batches:
            for part, texts in text_chunks(batch):
                doc, term, n = term_counts(texts)
                ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(signed(term))),
                     pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))], names=["doc_id", "label", "term", "n"])

    table = (rows.select("doc_id", "label", "text").mapInArrow(count, "doc_id long, label int, term array<long>, n array<int>")
             .toArrow().combine_chunks())
    ids, label = table["doc_id"].to_numpy(), table["label"].to_numpy().astype(np.int64)
    lists = [table[c].combine_chunks() for c in ("term", "n")]
    size = np.asarray(lists[0].value_lengths()) if len(ids) else np.zeros(0, np.int64)
    term, n = (x.flatten().to_numpy() if len(ids) else np.zeros(0, np.int64) for x in lists)
    return ids, label, np.repeat(np.arange(len(ids)), size), term.astype(np.int64).view(np.uint64), n


def train(docs: DataFrame, labels: DataFrame, kind: str = "toxic", per_class: int = PER_CLASS,
          sample_bytes: int = SAMPLE_BYTES) -> Index:
    none = np.zeros(0, np.uint64)
    prior = {r["label"]: r["n"] for r in labels_of(labels, kind).where(fold("doc_id", 5) != 0)
             .groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (prior.get(1, 0) + 1) / (sum(prior.values()) + 2)
    index = Index(none, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), bare=share)
    ids, label, example, term, n = _examples(docs, labels, kind, per_class, sample_bytes)
    ones, zeros = int(label.sum()), int(len(label) - label.sum())
    if not ones or not zeros:
        return index
    weight = {1: prior[1] / ones, 0: prior[0] / zeros}
    has = np.zeros(len(ids), bool)
    has[example] = True
    bare = [sum(weight[y] for y in label[~has].tolist() if y == k) for k in (0, 1)]
    index.bare = (bare[1] + share) / (sum(bare) + 1)
    if not len(term):
        return index
    index.terms, place = np.unique(term, return_inverse=True)
    seen, total = document_frequency(docs, index.terms)
    index.value = (np.log((total + 1) / (seen + 1)) + 1) * term_values(place, label[example], len(index.terms), ones, zeros)
    vectors = index.unit(example, term, n, len(ids))
    # alike examples share blocks: by their heaviest term, then the weight
    heaviest = [(int(t[np.argmax(w)]), -float(w.max())) if len(t) else (-1, 0.0) for t, w in vectors]
    order = sorted(np.flatnonzero(has).tolist(), key=lambda i: (*heaviest[i], ids[i]))
    index.ids, index.label = ids[order], label[order]
    vectors = [vectors[i] for i in order]
    index.fill(vectors)
    votes, ys = [], []
    for i, (t, w) in enumerate(vectors):
        found, cosine = index.nearest(t, w, without=i)
        if len(found):
            votes.append(index.vote(found, cosine))
            ys.append(index.label[i])
    ys_ = np.array(ys, float)
    index.slope, index.bias = logistic_fit(np.array(votes), ys_, np.where(ys_ == 1, weight[1], weight[0])) if votes else (0.0, 0.0)
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """All rows and columns of ``docs`` with score and evidence (nearest examples: id, label, cosine)."""
    docs = docs.drop("score", "evidence")
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()),
                                         T.StructField("cosine", T.DoubleType())]))
    schema = with_fields(docs, ("score", T.DoubleType()), ("evidence", evidence))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shipped.value
        for batch in batches:
            for part, texts in text_chunks(batch):
                scores, shown = [], []
                for t, w in ix.vectors(texts):
                    found, cosine = ix.nearest(t, w) if len(t) and ix.top is not None else (t[:0], w[:0])
                    scores.append(ix.score(ix.vote(found, cosine)) if len(found) and ix.top is not None else ix.bare)
                    shown.append([{"doc_id": int(ix.ids[i]), "label": int(ix.label[i]), "cosine": float(c)}
                                  for i, c in zip(found[:EVIDENCE], cosine[:EVIDENCE])] if ix.top is not None else [])
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(scores, pa.float64()), pa.array(shown, kind)],
                                                 names=part.schema.names + ["score", "evidence"])

    return docs.mapInArrow(run, schema)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (score(docs, train(docs, read_table(spark, sf_dir, "labels")))
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"))
