"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Features are the words and word pairs of a text (words: runs of letters and
digits, or of other visible characters; case kept), hashed to ``2**bits``
slots.  The value of a feature is its count divided by the square root of the
number of features, so a score is one sparse dot product and no text is cut.

Training reads a bounded sample of labelled rows (``per_class`` ids of each
class).  The sample is dealt by id hash into ``shards``; every shard runs FTRL
over its own rows in id order, in a Spark task, and the weights are averaged.
The model is at most ``2**bits`` weights, so it may be collected and shipped.
Slope and intercept of the final logistic are then fitted on the sample's
margins, weighted to the class balance of all labels.

Defined cases: null and empty texts score as the intercept; without any
label, or with labels of one class only, every score is the (smoothed) share of
label 1; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import DOC_COLUMNS, fold, label_sample, labels_of, read_table, sampled_texts, ship_package, with_fields
from storelake.llm.words import KINDS, shingle_hashes, text_chunks, words_of

BITS = 18
PER_CLASS = 6000      # bound of the training sample, for each class
SHARDS = 8
PASSES = 3
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray      # one float32 per hash slot
    bias: float
    slope: float = 1.0

    def margin(self, texts: list[bytes | None]) -> np.ndarray:
        slots, bounds = features(texts, int(math.log2(len(self.weights))))
        total = np.concatenate([[0.0], np.cumsum(self.weights[slots], dtype=np.float64)])
        n = np.diff(bounds)
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.maximum(n, 1))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.slope * self.margin(texts) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of the words and word pairs of each text, and where each text's slots begin."""
    words = words_of(texts, KINDS, lower=False)
    shift = np.uint64(64 - bits)
    n = np.diff(words.bounds)
    pairs = shingle_hashes(words.hash, 2)
    doc = words.doc()
    inside = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
    slots = np.concatenate([words.hash, pairs[inside]]) >> shift
    owner = np.concatenate([doc, doc[1:][inside]])
    order = np.argsort(owner, kind="stable")
    sizes = n + np.maximum(n - 1, 0)
    return slots[order].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int, passes: int = PASSES,
         alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal updates over the rows in order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(passes):
        for (idx, val), y in zip(rows, labels):
            w = weight(idx)
            p = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, float(w @ val)))))
            g = (p - y) * val
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    return weight(np.arange(size))


def logistic_fit(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted one-variable logistic regression (Newton's method)."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -500, 500)))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([np.sum(g * z) + 1e-3 * a, np.sum(g)])
        hess = np.array([[np.sum(h * z * z) + 1e-3, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-9]])
        step = np.linalg.solve(hess, grad)
        size = float(np.max(np.abs(step)))
        step = step / max(1.0, size)
        a, b = a - step[0], b - step[1]
        if size < 1e-8:
            break
    return a, b


def train(docs: DataFrame, labels: DataFrame, kind: str = "quality", bits: int = BITS,
          per_class: int = PER_CLASS, shards: int = SHARDS) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    size = (1 << bits) + 1
    prior = {r["label"]: r["n"] for r in
             labels_of(labels, kind).where(fold("doc_id", 5) != 0).groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = label_sample(labels, kind, per_class)
    rows = (sampled_texts(docs, sample)
            .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label"], kind="stable")
        data, ys = [], []
        for text, y in zip(pdf["text"], pdf["label"]):
            slots, _ = features([None if text is None else text.encode()], bits)
            idx, count = np.unique(slots, return_counts=True)
            data.append((np.append(idx, size - 1), np.append(count / math.sqrt(max(1, len(slots))), 1.0)))
            ys.append(int(y))
        w = ftrl(data, ys, bits)
        slot = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(slot, -1), "w": np.append(w[slot], float(len(ys))),
                             "ones": [0] * len(slot) + [int(sum(ys))]})

    fitted = (rows.groupBy("shard").applyInPandas(fit, "slot long, w double, ones long")
              .groupBy("slot").agg(F.sum("w").alias("w"), F.sum("ones").alias("ones"), F.count("*").alias("n"))
              .toPandas())
    total = fitted[fitted["slot"] == -1]
    ones_all, zeros_all = prior.get(1, 0), prior.get(0, 0)
    base = math.log((ones_all + 1) / (zeros_all + 1))
    if not len(total) or not 0 < total["ones"].iloc[0] < total["w"].iloc[0]:
        return Model(np.zeros(size - 1, np.float32), base)
    fitted_w = fitted[fitted["slot"] >= 0]
    w = np.zeros(size)
    w[fitted_w["slot"].to_numpy()] = fitted_w["w"].to_numpy() / int(total["n"].iloc[0])
    model = Model(w[:-1].astype(np.float32), 0.0)
    margins = score(rows.select("doc_id", "text", "label"), model, "p", raw=True).select("p", "label").toPandas()
    z, y = margins["p"].to_numpy(), margins["label"].to_numpy().astype(float)
    share = y.sum() / len(y)
    weight = np.where(y == 1, ones_all / share, zeros_all / (1 - share)) / (ones_all + zeros_all)
    model.slope, model.bias = logistic_fit(z, y, weight)
    return model


def score(docs: DataFrame, model: Model, out: str = "score", raw: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` and the score of the whole text (raw: the margin)."""
    docs = docs.drop(out)
    schema = with_fields(docs, (out, T.DoubleType()))
    of = model.margin if raw else model.score

    def run(batches):
        for batch in batches:
            for part, texts in text_chunks(batch):
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(of(texts), pa.float64())],
                                                 names=part.schema.names + [out])

    return docs.mapInArrow(run, schema)


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return (score(docs, model)
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learnt from the stage's own input."""
    ship_package(spark)
    docs = docs.select(*DOC_COLUMNS)
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, "quality_score").where(F.col("quality_score") >= THRESHOLD).drop("quality_score")
