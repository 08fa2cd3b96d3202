"""Hard-negative mining with bounds along a spanning tree of the anchors.

A score is the integer inner product of an anchor and a row (vectors as whole numbers,
``vectors.py``); higher scores come first, ties by vec_id.  An anchor's positives are its
best other rows of the same label; for each positive the best rows of other labels whose score
lies in a window below the positive's score are its hard negatives.

* Anchors are put in blocks of about ``ANCHORS``, ones whose components have the same signs side
  by side, and each block gets a minimum spanning tree of its vectors.
* The root scores every row of a row block.  A row c that scores within [lo, hi] at a parent
  anchor p scores within [lo - |a - p| |c|, hi + |a - p| |c|] at the child a (Cauchy-Schwarz).
  Only rows whose interval meets what the child still wants are scored again; all others hand
  their interval down.
* Positives: the fifth largest lower bound of the label's rows is a floor; rows whose interval lies
  below it are left.  Negatives: rows whose interval misses all windows of the anchor are left, and
  those below the tenth largest lower bound of rows that surely lie in a window.

Scores are exact whenever they are used; a bound only decides what need not be scored.
A task handles one block of anchors with one block of ``ROWS`` rows and returns the best few per
anchor; these are merged by a window whose input Spark cuts to the best few before the shuffle.
Rows are sent once per block of ANCHORS anchors, so a vector that crosses the network serves
ANCHORS scores.  In the tree's order a parent's intervals live only until its last child
(children with the largest subtree come last), so a task holds few of them.

Defined cases: rows with a null vec_id, a null label, a null vector, or null or non-finite
components take no part; a component that a shorter vector lacks counts as 0; rows equal in
vec_id, label and vector count once, other rows of one vec_id are rows of their own (a
positive never has its anchor's vec_id); an anchor without positives, or without rows in a
window, gives no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import read_table
from storelake.llm.vectors import integer_vectors
from storelake.session import materialize

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90        # window of a negative's score, in percent of the positive's
ANCHORS = 2048            # of a block
ROWS = 16384              # of a block
SIGNS = 16                # components whose signs order the anchors
TASKS = 20000             # most partitions of a grid; a partition may hold several blocks
EXACT = 1 << 53           # floats hold whole numbers up to this


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): vectors in an order where parents come first, each one's
    parent as a place in that order (-1: the root) and its distance to the parent."""
    n = len(vectors)
    v = vectors.astype(np.float64)
    square = (v * v).sum(axis=1)
    best = np.full(n, np.inf)
    link = np.full(n, -1)
    out = np.ones(n, bool)
    at, children = 0, [[] for _ in range(n)]
    added = []
    for _ in range(n):
        out[at] = False
        added.append(at)
        if link[at] >= 0:
            children[link[at]].append(at)
        gap = square + square[at] - 2 * (v @ v[at])
        nearer = out & (gap < best)
        best[nearer] = gap[nearer]
        link[nearer] = at
        if out.any():
            at = int(np.where(out, best, np.inf).argmin())
    size = np.ones(n, np.int64)
    for k in reversed(added):
        if link[k] >= 0:
            size[link[k]] += size[k]
    order, place, stack = [], np.full(n, -1), [0] if n else []
    while stack:
        k = stack.pop()
        place[k] = len(order)
        order.append(k)
        stack.extend(sorted(children[k], key=lambda c: -size[c]))   # the smallest subtree is popped first
    order = np.array(order, np.int64)
    parent = np.array([-1 if link[k] < 0 else place[link[k]] for k in order], np.int64)
    edge = np.array([0.0 if p < 0 else np.linalg.norm(v[k] - v[order[p]]) for k, p in zip(order, parent)])
    return order, parent, edge


def walk(rows: np.ndarray, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, wanted):
    """Yield (anchor's place, places of rows, their exact scores) along the tree.

    ``wanted(k, lo, hi)`` names the rows whose interval [lo, hi] makes anchor k want their score.
    """
    most = rows.shape[1] * int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0))
    if most >= EXACT:              # beyond exact floats: plain integer products, no bounds
        anything = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        for k in range(len(anchors)):
            need = wanted(k, *anything)
            yield k, need, rows[need] @ anchors[k]
        return
    v, a = rows.astype(np.float64), anchors.astype(np.float64)
    norm = np.linalg.norm(v, axis=1) * (1 + 1e-12)
    own = np.linalg.norm(a, axis=1) * (1 + 1e-12)
    last = {int(p): k for k, p in enumerate(parent)}
    live = {}
    for k in range(len(a)):
        p = int(parent[k])
        if p < 0:
            lo = hi = v @ a[k]
            need = wanted(k, lo, hi)
            score = lo[need]
        else:
            lo, hi = live[p]
            if last[p] == k:
                del live[p]
            reach, bound = edge[k] * (1 + 1e-9) * norm, own[k] * norm
            lo, hi = np.maximum(lo - reach, -bound), np.minimum(hi + reach, bound)
            need = wanted(k, lo, hi)
            if 2 * len(need) > len(v):
                lo = hi = v @ a[k]
                score = lo[need]
            else:
                score = v[need] @ a[k]
                lo[need] = hi[need] = score
        if k in last:
            live[k] = lo, hi
        yield k, need, score.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k])


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by falling score, then id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort([ids[keep], -scores[keep]])[:k]]


def _stack(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, x in enumerate(column):
        out[i, :len(x)] = x
    return out


def _blocks(anchors: pd.DataFrame, rows: pd.DataFrame):
    anchors = anchors.sort_values("place")
    width = max(anchors["v"].map(len).max(), rows["v"].map(len).max())
    return (anchors, _stack(anchors["v"], width), anchors["parent"].to_numpy(), anchors["edge"].to_numpy(),
            rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), _stack(rows["v"], width))


def _frame(parts: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame(p) for p in parts]) if parts else pd.DataFrame({c: [] for c in columns})


def _positives(count: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            anchors, a, parent, edge, ids, labels, v = _blocks(anchors, rows)
            key, a_id, a_label = (anchors[c].to_numpy(np.int64) for c in ("anchor", "vec_id", "label"))

            def wanted(k, lo, hi):
                own = np.flatnonzero((labels == a_label[k]) & (ids != a_id[k]))
                return own[hi[own] >= _kth(lo[own], count)] if len(own) > count else own

            for k, need, score in walk(v, a, parent, edge, wanted):
                best = _first(ids[need], score, count)
                if len(best):
                    found.append({"anchor": key[k], "positive_id": ids[need][best], "positive_score": score[best]})
        return _frame(found, ["anchor", "positive_id", "positive_score"])

    return run


def _negatives(count: int, low: int, high: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            anchors, a, parent, edge, ids, labels, v = _blocks(anchors, rows)
            key, a_label = (anchors[c].to_numpy(np.int64) for c in ("anchor", "label"))
            # low * p <= 100 * n <= high * p, as whole numbers
            windows = [[(-(-low * int(p) // 100), high * int(p) // 100) for p in x] for x in anchors["scores"]]

            def wanted(k, lo, hi):
                other = np.flatnonzero(labels != a_label[k])
                lo, hi = lo[other], hi[other]
                need = np.zeros(len(other), bool)
                for least, most in windows[k]:
                    inside = lo[(lo >= least) & (hi <= most)]
                    need |= (hi >= (_kth(inside, count) if len(inside) >= count else least)) & (lo <= most)
                return other[need]

            for k, need, score in walk(v, a, parent, edge, wanted):
                for slot, (least, most) in enumerate(windows[k]):
                    inside = np.flatnonzero((score >= least) & (score <= most))
                    best = inside[_first(ids[need][inside], score[inside], count)]
                    if len(best):
                        found.append({"anchor": key[k], "slot": slot, "negative_id": ids[need][best],
                                      "negative_score": score[best]})
        return _frame(found, ["anchor", "slot", "negative_id", "negative_score"])

    return run


def _tree(block: pd.DataFrame) -> pd.DataFrame:
    order, parent, edge = spanning_tree(_stack(block["v"], block["v"].map(len).max()))
    out = block.iloc[order].copy()
    return out.assign(place=np.arange(len(out)), parent=parent, edge=edge)


def _in_blocks(anchors: DataFrame) -> DataFrame:
    """Anchors with ``ab``, their block: of about ANCHORS rows, by the signs of some components.

    The rows of each sign pattern (at most 2**SIGNS) are counted, the patterns are laid end to end, and
    a row takes its pattern's stretch by a hash, so one frequent pattern spreads over many blocks.
    """
    sign = F.aggregate(F.sequence(F.lit(0), F.lit(SIGNS - 1)), F.lit(0),
                       lambda acc, k: acc * 2 + (F.coalesce(F.get("v", F.floor(k * F.size("v") / SIGNS).cast("int")),
                                                            F.lit(0)) >= 0).cast("int"))
    signed = anchors.withColumn("cell", sign)
    cells = (signed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("upto", F.sum("n").over(Window.orderBy("cell"))))
    share = F.pmod("anchor", F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = F.floor((F.col("upto") - F.col("n") + share * F.col("n")) / ANCHORS).cast("int")
    return signed.join(F.broadcast(cells), "cell").withColumn("ab", at).select("ab", "anchor", "vec_id", "label", "v")


def hard_negatives(table: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores for the anchors of ``table``.

    ``table``: vec_id, label and ``v`` (array<int>); ``is_anchor``: a condition on these.
    """
    label = F.col("label") if isinstance(table.schema["label"].dataType, (T.IntegralType, T.BooleanType)) else F.xxhash64("label")
    usable = table.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = materialize(usable.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
                       .select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), "v", "is_anchor")
                       .dropDuplicates().withColumn("anchor", F.xxhash64("vec_id", "label", "v")), "rows")
    tree = materialize(_in_blocks(rows.where("is_anchor"))
                       .groupBy("ab").applyInPandas(_tree, "ab int, anchor long, vec_id long, label long, v array<int>, "
                                                           "place int, parent int, edge double"), "anchor-trees")
    row_blocks = max(1, -(-rows.count() // ROWS))
    anchor_blocks = tree.agg(F.max("ab")).first()[0]
    anchor_blocks = 0 if anchor_blocks is None else anchor_blocks + 1

    def grid(anchors: DataFrame):
        """Each block of anchors with each block of rows."""
        def every(n):
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))

        tasks = max(1, min(TASKS, anchor_blocks * row_blocks))
        left = anchors.withColumn("rb", every(row_blocks)).repartition(tasks, "ab", "rb")
        right = (rows.select("vec_id", "label", "v", F.pmod("anchor", F.lit(row_blocks)).cast("int").alias("rb"))
                 .withColumn("ab", every(anchor_blocks)).repartition(tasks, "ab", "rb"))
        return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb"))

    near = grid(tree).applyInPandas(_positives(positives), "anchor long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = materialize(near.withColumn("slot", (F.row_number().over(best) - 1).cast("int"))
                       .where(F.col("slot") < positives), "positives")
    scores = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("s"))
    asked = tree.join(scores.select("anchor", F.col("s.positive_score").alias("scores")), "anchor", "left")
    # an anchor without positives stays in its tree: its children's bounds hang on it
    asked = asked.withColumn("scores", F.coalesce("scores", F.array().cast("array<bigint>")))
    found = grid(asked).applyInPandas(_negatives(negatives, low, high),
                                      "anchor long, slot int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= negatives)
    return (found.join(near, ["anchor", "slot"]).join(tree.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def negatives_query(spark, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = integer_vectors(table).select("vec_id", moved.alias("label"), "v")
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a, rows r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
fitting AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM fitting WHERE rank <= 10
"""
