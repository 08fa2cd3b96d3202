"""Sharding by a k-d tree over document metadata, in DataFrame expressions only.

The tree starts with all documents and ``shards`` leaves to make.  A node for k leaves is
split along its widest dimension -- the one whose range of values is the largest part of
the whole table's range -- at the weighted median: the key below which k // 2 of k parts of the
bytes lie.  Law: ``bytes`` (sizes of shards near equal).

A key is the dimension's value, scaled to 32 bits, before 31 random bits of the
row, so a value that a third of all rows share can be split too.  Medians of all nodes of a level are
found together: each pass sums the bytes of ``BINS`` equal steps of every node's key
interval (a map-side combined aggregation) and keeps the step with the target, until that step holds
less than ``TOLERANCE`` of a leaf.  Only the steps of at most ``shards`` nodes reach the driver.

Slots number the rows of a shard from 0.  A shard is numbered in parts of some ``PART`` rows (by the
random bits) after the parts before it, so no task needs a whole shard.

Defined cases: a null text has no bytes; null metadata is the least value; equal rows are
rows each; with fewer rows than shards some shards are empty; an empty table gives no rows;
a document larger than a shard's share fills its shard alone as far as it can.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import read_table
from storelake.session import materialize

SHARDS = 40
OVERHEAD = 16
BINS = 1024
TOLERANCE = 0.001
PART = 50_000
DIMENSIONS = ("size", "doc_id", "lang", "source")
_TOP = (1 << 32) - 1


@dataclass
class Node:
    name: int
    first: int           # leaves first .. first + leaves - 1
    leaves: int


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, size, crc and the dimensions as longs."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.coalesce(F.crc32(F.col(c).cast("binary")), F.lit(0)).cast("long").alias(f"_d{i}") if c in ("lang", "source")
          else F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"_d{i}")
          for i, c in enumerate(DIMENSIONS) if c != "size"],
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)).alias("_tie")
    ).withColumn("_d0", F.col("size"))


def _case(values: dict[int, object], on: str = "_node", kind: str = "long") -> str:
    body = " ".join(f"WHEN {k} THEN cast({v} AS {kind})" for k, v in values.items())
    return f"CASE {on} {body} END" if values else f"cast(NULL AS {kind})"


def _medians(rows: DataFrame, nodes: list[Node], weight: dict[int, int], leaf: float) -> dict[int, int]:
    """For every node the key at which its lower part ends (column _key of ``rows``)."""
    low = {n.name: 0 for n in nodes}
    high = {n.name: 1 << 63 for n in nodes}
    below = {n.name: 0 for n in nodes}
    cut: dict[int, int] = {}
    while len(cut) < len(nodes):
        open_nodes = [n for n in nodes if n.name not in cut]
        step = {n.name: max(1, -(-(high[n.name] - low[n.name]) // BINS)) for n in open_nodes}
        sums = (rows.where(F.col("_node").isin([n.name for n in open_nodes]))
                .select("_node", "size", "_key", F.expr(_case({k: low[k] for k in step})).alias("_lo"),
                        F.expr(_case({k: high[k] - 1 for k in step})).alias("_hi"), F.expr(_case(step)).alias("_step"))
                .where("_key >= _lo AND _key <= _hi")
                .withColumn("_bin", F.expr("(_key - _lo) div _step"))
                .groupBy("_node", "_bin").agg(F.sum("size").alias("w")).collect())
        by_node: dict[int, list[tuple[int, int]]] = {n.name: [] for n in open_nodes}
        for r in sums:
            by_node[r["_node"]].append((r["_bin"], r["w"]))
        for n in open_nodes:
            k, target = n.name, weight[n.name] * (n.leaves // 2) / n.leaves
            total = below[k]
            for b, w in sorted(by_node[k]):
                if total + w >= target:
                    start, end = low[k] + b * step[k], min(high[k], low[k] + (b + 1) * step[k])
                    if w <= TOLERANCE * leaf or step[k] == 1:
                        cut[k] = start if target - total <= total + w - target else end
                    low[k], high[k], below[k] = start, end, total
                    break
                total += w
            else:
                cut[k] = high[k]
    return cut


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    meta = materialize(metadata(docs), "metadata")
    dims = range(len(DIMENSIONS))
    whole = meta.agg(F.sum("size").alias("w"), F.count("*").alias("n"),
                     *[f(f"_d{i}").alias(f"{a}{i}") for i in dims for f, a in ((F.min, "lo"), (F.max, "hi"))]).first()
    keys = []
    for i in dims:
        lo, span = whole[f"lo{i}"] or 0, max(1, (whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0))
        keys.append(F.expr(f"cast((cast(_d{i} AS double) - ({lo}D)) / {span}D * {_TOP}D AS long) * {1 << 31}L + _tie").alias(f"_k{i}"))
    total = whole["w"] or 0
    rows = meta.select("doc_id", "size", "text_crc32", "_tie", *keys, F.lit(1).cast("long").alias("_node"))
    nodes, done = [Node(1, 0, shards)], {}
    while nodes:
        done |= {n.name: n.first for n in nodes if n.leaves == 1}
        nodes = [n for n in nodes if n.leaves > 1]
        if not nodes or not total:
            break
        spans = rows.where(F.col("_node").isin([n.name for n in nodes])).groupBy("_node").agg(
            F.sum("size").alias("w"), *[(F.max(f"_k{i}") - F.min(f"_k{i}")).alias(f"s{i}") for i in dims])
        found = {r["_node"]: r for r in spans.collect()}
        nodes = [n for n in nodes if n.name in found]
        widest = {n.name: max(dims, key=lambda i: (found[n.name][f"s{i}"] >> 31, -i)) for n in nodes}
        key = f"element_at(array({', '.join(f'_k{i}' for i in dims)}), {_case({k: d + 1 for k, d in widest.items()}, kind='int')})"
        keyed = rows.withColumn("_key", F.expr(key))
        cuts = _medians(keyed, nodes, {k: r["w"] for k, r in found.items()}, total / shards)
        rows = materialize(keyed.withColumn("_node", F.expr(
            f"CASE WHEN _node IN ({', '.join(str(n.name) for n in nodes) or '-1'}) THEN "
            f"_node * 2 + if(_key >= {_case(cuts)}, 1, 0) ELSE _node END")).drop("_key"), "tree")
        nodes = [m for n in nodes for m in (Node(2 * n.name, n.first, n.leaves // 2),
                                            Node(2 * n.name + 1, n.first + n.leaves // 2, n.leaves - n.leaves // 2))]
    placed = materialize(rows.select("doc_id", "size", "text_crc32", "_tie",
                                     F.expr(_case(done, kind="int") if total else "cast(NULL AS int)").alias("shard")), "placed")
    parts = max(1, -(-whole["n"] // (shards * PART)))
    placed = placed.withColumn("_part", F.pmod("_tie", F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
              .select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("shard", "_part").orderBy("_tie", "doc_id", "text_crc32")
    return (placed.withColumn("_row", F.row_number().over(inside)).join(starts, ["shard", "_part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot")))


def sharding_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return (assign_shards(docs)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
