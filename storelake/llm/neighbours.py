"""Approximate nearest neighbours by collision-counting hashing.

Every vector (scaled to length 1) is projected on ``PROJECTIONS`` random lines; each
line keeps a sorted array of the projections.  A query opens a window around
its own projection on every line and widens all windows step by step (virtual
rehashing: the arrays stay, only the windows grow by ``GROW``).  A vector that lies in
the windows of at least ``COLLISIONS`` of the lines is verified with its exact cosine.
The search ends when ``BETA`` of the block's vectors and k more are verified (or all are).

Vectors are dealt into blocks of about ``BLOCK`` rows and queries into blocks of ``QUERIES``; a
Spark task searches one block with one block of queries, so memory is bounded and work
spreads; then the best k of each query are taken over all blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; a query sees vectors of its own length only, and no row that
has its vec_id; equal rows are searched once as queries and found each as candidates;
rows without vec_id take no part; equal cosines are ranked by vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import read_table
from storelake.session import materialize

PROJECTIONS = 80
COLLISIONS = 0.6
GROW = 1.25
BETA = 0.18
FIRST_HALF = 0.4          # half width of the first windows, in projections of unit vectors
BLOCK = 8192
QUERIES = 1024
SEED = 20240


class Lines:
    """Sorted projection arrays of one block."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS) -> None:
        self.vectors = vectors
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.axes = np.random.default_rng(SEED + vectors.shape[1]).standard_normal((vectors.shape[1], projections))
        value = (vectors / self.norm[:, None]) @ self.axes
        self.order = np.argsort(value, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(value.T, self.order, axis=1)

    def candidates(self, query: np.ndarray, need: int, least: int) -> np.ndarray:
        """Rows in at least ``least`` windows, once there are ``need`` of them."""
        n = len(self.vectors)
        if n <= need:
            return np.arange(n)
        centre = (query / np.sqrt((query * query).sum())) @ self.axes
        lines = len(centre)
        lo = hi = np.array([np.searchsorted(self.value[j], centre[j]) for j in range(lines)])
        count = np.zeros(n, np.int32)
        half = FIRST_HALF
        while True:
            new_lo = np.array([np.searchsorted(self.value[j], centre[j] - half) for j in range(lines)])
            new_hi = np.array([np.searchsorted(self.value[j], centre[j] + half, "right") for j in range(lines)])
            parts = [self.order[j, new_lo[j]:lo[j]] for j in range(lines)]
            parts += [self.order[j, hi[j]:new_hi[j]] for j in range(lines)]
            count += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            lo, hi = new_lo, new_hi
            found = np.flatnonzero(count >= least)
            if len(found) >= need or (lo.max() == 0 and hi.min() == n):
                return found
            half *= GROW

    def cosine(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * query).sum(axis=1) / (self.norm[rows] * np.sqrt((query * query).sum()))


def _search(k: int):
    least = int(np.ceil(COLLISIONS * PROJECTIONS))

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            sizes = vectors["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                own = vectors[sizes == size]
                asked = queries[queries["v"].map(len) == size]
                if not len(asked):
                    continue
                ids = own["vec_id"].to_numpy()
                lines = Lines(np.stack(own["v"].to_numpy()).astype(np.float64))
                for query_id, v in zip(asked["vec_id"].tolist(), asked["v"]):
                    q = np.asarray(v, np.float64)
                    # one's own rows are set aside, so they never count as found
                    extra = int((ids == query_id).sum())
                    rows = lines.candidates(q, k + extra + int(BETA * len(ids)), least)
                    rows = rows[ids[rows] != query_id]
                    score = lines.cosine(rows, q)
                    best = np.lexsort([ids[rows], -score])[:k]
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def usable(table: DataFrame, column: str) -> DataFrame:
    """(vec_id, v): rows whose vector can take part, as doubles."""
    return (table.select("vec_id", F.col(column).cast("array<double>").alias("v"))
            .where(F.expr("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND "
                          "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
                          "AND exists(v, x -> x != 0)")))


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query."""
    vectors = materialize(usable(table, column).withColumn("lot", F.xxhash64("vec_id", F.monotonically_increasing_id())), "vectors")
    asked = materialize(usable(queries, column).dropDuplicates()
                        .withColumn("lot", F.xxhash64("vec_id")), "queries")
    blocks = max(1, -(-vectors.count() // BLOCK))
    parts = max(1, -(-asked.count() // QUERIES))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own = vectors.withColumn("vb", F.pmod("lot", F.lit(blocks)).cast("int")).withColumn("qb", every(parts))
    ask = asked.withColumn("qb", F.pmod("lot", F.lit(parts)).cast("int")).withColumn("vb", every(blocks))
    found = (own.groupBy("vb", "qb").cogroup(ask.groupBy("vb", "qb"))
             .applyInPandas(_search(k), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def neighbours_query(spark, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(table, table.where(F.col("vec_id") % 50 == 0))
