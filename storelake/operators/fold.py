"""Adds to counters with a limit, folded in sequence order.

Each counter has ``cap`` units; its adds come one after another, and one of q units is
taken iff q units are left.  What is taken in the end:

* Counters with up to ``BLOCK_ADDS`` adds are folded by one expression over their sorted
  adds (JVM side, a bounded list).
* The adds of a larger counter are cut into blocks, spread over tasks.  A block becomes a
  step function: for r units left at its start, the units it takes.  Only the r that can
  occur matter: at most cap, at least cap less all earlier adds.  The functions are then
  applied one after another, a binary search each, by a task that reads the counter's blocks in order
  and remembers one number.
* A block whose function would have more than ``PIECES`` steps is passed on as its adds instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.operators.sequence import with_blocks
from storelake.session import materialize

BLOCK_ADDS = 4096
PIECES = 1 << 15


def step_function(adds: list[int], lo: int, hi: int, pieces: int = PIECES):
    """(start, taken): with r units left, lo <= r <= hi, the adds take ``taken[k]`` units, where
    k is the last step with start[k] <= r.  None if there are more than ``pieces`` steps."""
    if sum(adds) <= lo:                     # all fit, whatever was taken before
        return np.array([lo], np.int64), np.array([sum(adds)], np.int64)
    start, taken = np.array([lo], np.int64), np.zeros(1, np.int64)
    for q in adds:
        fits = taken + q                    # the add is taken for r from here on
        end = np.append(start[1:], hi + 1)
        whole = fits <= start
        part = np.flatnonzero(~whole & (fits < end))
        taken = np.where(whole, fits, taken)
        if len(part):
            start = np.insert(start, part + 1, fits[part])
            taken = np.insert(taken, part + 1, fits[part])
        if len(start) > 1:
            new = np.concatenate([[True], taken[1:] != taken[:-1]])
            if not new.all():
                start, taken = start[new], taken[new]
            if len(start) > pieces:
                return None
    return start, taken


def _functions(pieces: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_seq")
        adds, cap, before = block["_q"].tolist(), int(block["_cap"].iloc[0]), int(block["_before"].iloc[0])
        found = step_function(adds, max(0, cap - before), max(0, cap), pieces)
        row = {"_key": block["_key"].iloc[0], "_blk": block["_blk"].iloc[0], "_cap": cap,
               "start": None if found is None else found[0].tolist(), "taken": None if found is None else found[1].tolist(),
               "adds": adds if found is None else None}
        return pd.DataFrame([row])

    return run


def _apply(batches):
    """Blocks sorted by (counter, block) to one row per counter: its key and the units taken."""
    key, cap, left = None, 0, 0
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["_key"] != key:
                if key is not None:
                    done.append((key, cap - left))
                key, cap = row["_key"], row["_cap"]
                left = cap
            if row["adds"] is not None:
                for q in row["adds"]:
                    left -= q if q <= left else 0
            elif left >= 0:
                left -= row["taken"][int(np.searchsorted(row["start"], left, "right")) - 1]
        yield _taken(done)
    if key is not None:
        yield _taken([(key, cap - left)])


def _taken(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
                                      names=["_key", "added"])


def units_taken(adds: DataFrame, key: list[str], seq: str, block_adds: int = BLOCK_ADDS, pieces: int = PIECES) -> DataFrame:
    """(*key, added): the units that each counter's adds take, in ``seq`` order.

    ``adds``: one row per add with the key columns, ``seq`` (unique in a counter), q (1 or more) and
    cap, the counter's units at the start.
    """
    adds = materialize(adds.select(*key, F.col(seq).cast("bigint").alias("_seq"), F.col("q").cast("bigint").alias("_q"),
                                   F.col("cap").cast("bigint").alias("_cap")), "adds")
    large = materialize(adds.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_adds).select(*key), "large")
    small = (adds.join(large, key, "left_anti").groupBy(*key)
             .agg(F.array_sort(F.collect_list(F.struct("_seq", "_q"))).alias("_adds"), F.first("_cap").alias("_cap")))
    taken = F.aggregate("_adds", F.lit(0).cast("bigint"),
                        lambda n, x: n + F.when(n + x["_q"] <= F.col("_cap"), x["_q"]).otherwise(F.lit(0).cast("bigint")))
    small = small.select(*key, taken.alias("added"))
    if large.isEmpty():
        return small
    # one text for all key columns: blocks are grouped and sorted by it
    rows = with_blocks(adds.join(large, key, "left_semi").withColumn("_key", F.to_json(F.struct(*key))), ["_key"], "_seq", block_adds)
    rows = materialize(rows, "large-adds")
    before = Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = (rows.groupBy("_key", "_blk").agg(F.sum("_q").alias("_sum"))
            .select("_key", "_blk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    functions = (rows.select("_key", "_blk", "_seq", "_q", "_cap").join(sums, ["_key", "_blk"]).groupBy("_key", "_blk")
                 .applyInPandas(_functions(pieces), "_key string, _blk int, _cap long, start array<long>, taken array<long>, adds array<long>"))
    applied = (materialize(functions, "step-functions").repartition("_key").sortWithinPartitions("_key", "_blk")
               .mapInArrow(_apply, "_key string, added long"))
    names = rows.groupBy("_key").agg(*[F.first(c).alias(c) for c in key])
    return small.unionByName(applied.join(names, "_key").select(*key, "added"))
