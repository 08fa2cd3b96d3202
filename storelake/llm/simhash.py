"""SimHash near-duplicates by deletion-variant signatures.

A text's 64-bit fingerprint: the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) give 4-word shingles,
repeats included, joined by one space (fewer words: the whole sequence); h is a
shingle's XXH64 with seed 42; a bit is 1 if it is set in more than half of the h.
Fingerprints that differ in at most ``BITS`` = 4 bits link.

* Equal fingerprints are one node, so copies of a text cost nothing further.
* The 64 bits are cut into 4 // 2 + 1 = 3 segments.  Four differing bits can't put two into each of three
  segments, so in one of them two linked fingerprints differ by at most one bit.
* Every segment is indexed once for each of its bits, with that bit wiped out (its deletion variants,
  64 in all).  Two fingerprints that differ by at most one bit in a segment have a variant in common:
  equality finds them.
* Rows are dealt and sorted by variant; a task reads one bucket of equal variants after the other
  and verifies whole fingerprints.  Buckets of up to ``SMALL`` rows are compared position against position.
  Larger ones are searched outwards: a fingerprint is compared with those not reached yet only, so a
  bucket of m near copies costs some m comparisons and gives m - 1 links.
* A bucket beyond ``BUCKET`` rows leaves the task as rows.  Its members are first compared with ``LEADERS``
  members chosen by a hash, a few times; links found join their components.  What is left
  to compare are fingerprints of different components: the bucket is cut into chunks, the
  largest component's chunks against all others and these among themselves, and every pair of chunks is a
  bucket of at most BUCKET rows for the same search.  No link between different components is lost.

The index has 64 rows of 16 bytes for each distinct fingerprint and is shuffled once, never written.

Defined cases: a null text, an empty one and one without words have fingerprint zero, which links
like any other; null doc_ids are never a component's id unless it has no other; rows of one doc_id are
separate; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import read_table, ship_package
from storelake.operators.graph import components
from storelake.session import materialize

SHINGLE = 4
SEED = 42
BITS = 4
SMALL = 48                # largest bucket compared position against position
BUCKET = 1 << 16          # largest bucket searched by one task
LEADERS, LEADER_ROUNDS = 8, 3
PIECE = 1 << 20           # bytes of text at a time
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEPARATORS = b" \t\n\x0b\x0c\r"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about PIECE bytes; no word is cut."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and text[stop] not in _SEPARATORS:
            stop += 1
        yield text[at:stop].translate(_LOWER).split()       # bytes.split() splits at exactly these six
        at = stop


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text."""
    ones, count, carried = np.zeros(64, np.int64), 0, []
    for piece in _words(text or b""):
        words = carried + piece
        if len(words) >= SHINGLE:
            h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(SHINGLE)))),
                            np.uint64, len(words) - SHINGLE + 1)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
            count += len(h)
            words = words[len(words) - SHINGLE + 1:]
        carried = words
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, f"doc_id {id_type}, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = bits // 2 + 1
    ends = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """key, fp: each fingerprint (column fp) once for each of its bits, which is wiped out of its segment."""
    rows = [F.struct(F.lit(a + k).cast("long").alias("bit"), F.lit(a).alias("first"),
                     F.lit(_signed((1 << w) - 1 - (1 << k))).cast("long").alias("mask")) for a, w in segments(bits) for k in range(w)]
    one = nodes.select("fp", F.explode(F.array(*rows)).alias("x"))
    rest = F.expr("shiftrightunsigned(fp, x.first)").bitwiseAND(F.col("x.mask"))
    # beyond 2 segments a segment has 32 bits at most: the wiped bit's number fits above it
    key = F.shiftleft(F.col("x.bit"), 48).bitwiseOR(rest) if bits >= 2 else F.xxhash64("x.bit", rest)
    return one.select(key.alias("key"), "fp")


def _differ(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _search(fps: np.ndarray, group: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Links that join all members of a bucket that reach each other by links.

    ``group``: members of one group are joined already.
    """
    left = np.arange(len(fps))
    found, queue = [], []
    while len(left) or queue:
        if queue:
            at = queue.pop()
        else:
            at, left = int(left[0]), left[1:]
            if group is not None:
                same = group[left] == group[at]
                queue.extend(left[same].tolist())
                left = left[~same]
        near = _differ(fps[left], fps[at]) <= bits
        if near.any():
            new = left[near]
            left = left[~near]
            found.extend((at, int(x)) for x in new)
            queue.extend(new.tolist())
            if group is not None and len(left):
                same = np.isin(group[left], group[new])
                queue.extend(left[same].tolist())
                left = left[~same]
    return found


def _links(bits: int, bucket: int, grouped: bool):
    """Sorted (key, fp[, comp]) rows to links (a, b), and rows of buckets that are too large (key, fp)."""
    def table(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

    def large(fps, key):
        return table(fps.view(np.int64), [None] * len(fps), np.full(len(fps), key, np.int64))

    def compare(key, fp, group):
        """All whole buckets of some sorted rows."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        a, b = [], []
        rows = np.flatnonzero((size > 1) & (size <= SMALL))
        step = 1
        while len(rows):
            rows = rows[rows + step < len(key)]
            rows = rows[key[rows] == key[rows + step]]
            near = _differ(fp[rows], fp[rows + step]) <= bits
            if group is not None:
                near &= group[rows] != group[rows + step]
            a.append(fp[rows[near]])
            b.append(fp[rows[near] + step])
            step += 1
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            pairs = np.array(_search(fp[s:s + n], None if group is None else group[s:s + n], bits), np.int64).reshape(-1, 2) + s
            a.append(fp[pairs[:, 0]])
            b.append(fp[pairs[:, 1]])
        if a:
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            if len(pair):
                yield table(pair[:, 0], pair[:, 1], [None] * len(pair))

    def run(batches):
        key, fp, group = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        flowing = None                # the key of a bucket that is being passed on
        for batch in batches:
            new = batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key, fp = np.concatenate([key, new[0]]), np.concatenate([fp, new[1]])
            if grouped:
                group = np.concatenate([group, batch.column("comp").to_numpy(zero_copy_only=False)])
            if flowing is not None:
                n = int(np.searchsorted(key, flowing, "right"))
                yield large(fp[:n], flowing)
                key, fp, group = key[n:], fp[n:], group[n:]
                if len(key):
                    flowing = None
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))        # the last bucket may go on
            if last:
                yield from compare(key[:last], fp[:last], group[:last] if grouped else None)
                key, fp, group = key[last:], fp[last:], group[last:]
            if len(key) > bucket:
                flowing = int(key[0])
                yield large(fp, flowing)
                key, fp, group = key[:0], fp[:0], group[:0]
        if len(key):
            yield from compare(key, fp, group if grouped else None)

    return run


def _bucket_links(rows: DataFrame, bits: int, bucket: int) -> DataFrame:
    """Links (a, b) found in buckets of equal key, and rows (a, null, key) of buckets that are too large."""
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(bits, bucket, "comp" in rows.columns), "a long, b long, key long")


def _close(a: str, b: str, bits: int):
    return (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits)


def _with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (key, fp) with comp, the component of fp by the links so far."""
    comps = components(links).select(F.col("node").alias("fp"), "comp")
    return rows.join(comps, "fp", "left").select("key", "fp", F.coalesce("comp", "fp").alias("comp"))


def _large_buckets(rows: DataFrame, links: DataFrame, bits: int, bucket: int) -> DataFrame:
    """All links needed once the rows (key, fp) of large buckets are compared, too."""
    for turn in range(LEADER_ROUNDS):
        by_hash = [F.min_by("fp", F.xxhash64("fp", F.lit(turn * LEADERS + k))) for k in range(LEADERS)]
        leaders = rows.groupBy("key").agg(F.array_distinct(F.array(*by_hash)).alias("lead"))
        met = rows.join(leaders, "key").select("fp", F.explode("lead").alias("lead")).where(_close("fp", "lead", bits))
        links = materialize(links.unionByName(met.select(F.col("fp").alias("a"), F.col("lead").alias("b"))).distinct(), "links")
    rows = materialize(_with_component(rows, links), "large")
    # the largest component of a bucket is compared with the others only
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n"),
                                    (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    half = max(1, bucket // 2)
    chunks = main.select("key", "main", F.ceil(F.col("n") / half).cast("int").alias("of_main"),
                         F.ceil(F.col("others") / half).cast("int").alias("of_others"))
    cut = rows.join(chunks, "key")
    is_main = F.col("comp") == F.col("main")
    mine = F.pmod(F.xxhash64("fp"), F.when(is_main, F.col("of_main")).otherwise(F.col("of_others"))).cast("int")
    cut = cut.withColumn("mine", mine).withColumn("is_main", is_main)
    # pairs of chunks: (main m, other o), and (other o, other p) with o <= p
    with_main = F.transform(F.sequence(F.lit(0), F.col("of_main") - 1), lambda m: F.struct(m.alias("x"), F.col("mine").alias("y"), F.lit(True).alias("z")))
    among = F.transform(F.sequence(F.lit(0), F.col("of_others") - 1), lambda o: F.struct(
        F.least(o, F.col("mine")).alias("x"), F.greatest(o, F.col("mine")).alias("y"), F.lit(False).alias("z")))
    pairs = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("of_others") - 1),
                                                 lambda o: F.struct(F.col("mine").alias("x"), o.alias("y"), F.lit(True).alias("z")))
                   ).otherwise(F.concat(with_main, among))
    parts = (cut.select("key", "fp", "comp", F.explode(pairs).alias("p"))
             .select(F.xxhash64("key", "p.x", "p.y", "p.z").alias("key"), "fp", "comp"))
    # chunks are dealt evenly by a hash of distinct values: no bucket is passed on again
    found = materialize(_bucket_links(parts, bits, 1 << 62), "links")
    return links.unionByName(found.select("a", "b"))


def linked(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(node, comp): fingerprints (column fp, distinct) that link with another, with the least one reachable."""
    met = materialize(_bucket_links(variants(nodes, bits), bits, bucket), "links")
    links = met.where("b IS NOT NULL").select("a", "b")
    large = met.where("b IS NULL").select("key", F.col("a").alias("fp"))
    if not large.isEmpty():
        links = _large_buckets(large, links, bits, bucket)
    return components(links)


def near_duplicates(docs: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable by links) of every row."""
    ship_package(docs.sparkSession)
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comps = linked(nodes.select("fp"), bits, bucket).select(F.col("node").alias("fp"), "comp")
    joined = nodes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = joined.join(least, "comp").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def simhash_query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
