"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct 5-word shingles (fewer words: the whole
sequence as one), each known by 62 bits of its hash.  Equal sets are one node.
Two nodes link when 100 * intersection >= 75 * union.

* Order: shingles are ordered by class, then hash.  Class 1 are the rare ones;
  classes 2 and 3 hold shingles seen often (tasks read all documents and count what they meet more than
  once; at most ``FREQUENT`` shingles are listed, so the list may be shipped).  Classes only
  decide where a link is found, never whether it is.
* A node of n shingles can miss at most n // 4 of them in a linked node, so both
  share a shingle among the first n // 4 + 1 of either: the plain prefix.
* Prefixes are extended until, whichever n // 4 are missing, some class k keeps
  k shingles: sum of max(0, n_k - k + 1) > n // 4.  Rare shingles are indexed by
  themselves, frequent ones by their k-combinations.
* A node with more than ``WIDE`` frequent shingles in its prefix (or too few
  shingles to extend) would give too many combinations: it is indexed by the single
  shingles of its plain prefix.  All others add their plain prefix's frequent
  shingles too, but only to be met by such nodes ("open" rows).

Two nodes are compared if at an entry that they share what follows is enough for a
link (at the first shingle they share it is, if they link).  Entries met by no other node are dropped.  Instead of all pairs of an entry, every
member is first compared with a few leaders (the node whose prefix others share
most, and some chosen by a hash of the node, the same ones in all entries they share);
members found linked are one component and are not compared again.
Entries that still hold several components get ever more leaders
(``MORE_LEADERS`` times as many each round) until all remaining pairs are compared, so no
link between different texts is missed and a group of m copies costs m comparisons.
Pairs are compared by an exact upper bound from 256 bucket counts first, then on whole sets.

The work between texts and links is on (key, node) rows; rows of frequent entries are
salted, and the rest are grouped by a key that few nodes share.

Defined cases: texts without words have an empty set and link with nothing; null
doc_ids are never a component's id unless it has no other; rows of one doc_id are
separate; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import DOC_COLUMNS, read_table, ship_package
from storelake.llm.lm import most_frequent
from storelake.llm.words import mix64, shingle_hashes, signed, text_chunks, words_of
from storelake.operators.graph import components
from storelake.session import discard, free_shuffles, materialize

SHINGLE = 5
FREQUENT = 1 << 19        # bound of the list of frequent shingles
SEEN_OFTEN = (32, 1024)   # counts from which a shingle is of class 2, 3
WIDE = 8
FLUSH = 1 << 22           # shingles between two rounds of counting in a task
BINS = 256
FILTER_BITS = 23          # bits of the bitmap that says whose sets are wanted
SALTS = 64
INDEX_PASSES = 2          # passes over the texts that index a share of the keys each: the index rows are the largest shuffle
LEADERS = 4               # leaders of an entry in the first round, besides the best one
MORE_LEADERS = 8          # times as many in the next


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingles (62-bit) of each text."""
    words = words_of(texts)
    rolled = shingle_hashes(words.hash, shingle) >> np.uint64(2)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(rolled[a:b - shingle + 1]))
        elif b > a:
            out.append(shingle_hashes(words.hash[a:b], b - a) >> np.uint64(2))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """64-bit name of a set (signed)."""
    with np.errstate(over="ignore"):
        total = np.sum(mix64(tokens + np.uint64(1)), dtype=np.uint64) + np.uint64(len(tokens))
    return int(signed(mix64(np.array([total], np.uint64)))[0])


def _emit(**columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()],
                                      names=list(columns))


def profiles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document (doc_id, node, n, bins, text_hash), and behind them (key, seen) rows:
    shingles that a task met more than once, with their count."""
    schema = docs.select("doc_id").schema.add("node", "long").add("n", "long").add("bins", "binary") \
        .add("key", "long").add("seen", "long").add("text_hash", "long")

    def often(held):
        key = np.concatenate(held)
        held.clear()
        key.sort()                                   # in place: the largest arrays of a task
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key)))
        key, n = key[first[n > 1]], n[n > 1]
        for k in range(0, len(key), 1 << 16):
            m = len(key[k:k + (1 << 16)])
            yield m, signed(key[k:k + (1 << 16)]), n[k:k + (1 << 16)]

    def run(batches):
        held, size, met = [], 0, set()
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for part, texts in text_chunks(batch):
                nodes, ns, bins = [], [], []
                for tokens in shingle_sets(texts, shingle):
                    node = node_of(tokens) if len(tokens) else None
                    nodes.append(node)
                    ns.append(len(tokens))
                    bins.append(np.minimum(np.bincount((tokens % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255)
                                .astype(np.uint8).tobytes())
                    if node not in met and len(tokens):
                        met.add(node)
                        held.append(tokens)
                        size += len(tokens)
                n = part.num_rows
                yield _emit(doc_id=part.column(0), node=pa.array(nodes, pa.int64()), n=pa.array(ns, pa.int64()),
                            bins=pa.array(bins, pa.binary()), key=pa.nulls(n, pa.int64()), seen=pa.nulls(n, pa.int64()),
                            text_hash=part.column(2))
            if size >= FLUSH:
                for m, key, seen in often(held):
                    yield _emit(doc_id=pa.nulls(m, kind), node=pa.nulls(m, pa.int64()), n=pa.nulls(m, pa.int64()),
                                bins=pa.nulls(m, pa.binary()), key=key, seen=pa.array(seen, pa.int64()),
                                text_hash=pa.nulls(m, pa.int64()))
                held, size, met = [], 0, set()
        if held:
            for m, key, seen in often(held):
                yield _emit(doc_id=pa.nulls(m, kind), node=pa.nulls(m, pa.int64()), n=pa.nulls(m, pa.int64()),
                            bins=pa.nulls(m, pa.binary()), key=key, seen=pa.array(seen, pa.int64()),
                            text_hash=pa.nulls(m, pa.int64()))

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, schema)


def index_entries(tokens: np.ndarray, classes: np.ndarray) -> tuple[list, list, list, list]:
    """Keys of one node's prefix, whether each is frequent, whether it is open (to be
    met by wide nodes only), and how many shingles two nodes can share at most that
    first meet there.  ``tokens`` are in order (class, hash)."""
    misses = len(tokens) // 4
    plain = misses + 1
    sizes = [int((classes == k).sum()) for k in (1, 2, 3)]
    need, taken, at = plain, [], 0
    for k, c in zip((1, 2, 3), sizes):
        take = min(c, need + k - 1) if need > 0 else 0
        if take < k:
            take = 0
        taken.append((k, at, take))
        need -= max(0, take - k + 1)
        at += c
    wide = need > 0 or taken[1][2] + taken[2][2] > WIDE
    head = tokens[:plain]
    keys, frequent, is_open = head.tolist(), (classes[:plain] > 1).tolist(), (classes[:plain] > 1).tolist()
    rest = list(range(len(tokens), len(tokens) - plain, -1))
    if wide:
        return keys, frequent, [False] * plain, rest
    for k, start, take in taken[1:]:
        for combo in combinations(range(start, start + take), k):
            h = np.zeros(1, np.uint64)
            for i in combo:
                h = mix64(h + tokens[i:i + 1])
            # class 3 begins after at most one shared shingle of class 2
            rest.append(len(tokens) - combo[0] + (k - 2))
            keys.append(int(h[0]) | (1 << 63))
            frequent.append(True)
            is_open.append(False)
    return keys, frequent, is_open, rest


def index_rows(docs: DataFrame, shipped, at: int = 0, passes: int = 1, shingle: int = SHINGLE) -> DataFrame:
    """(place, node, info) of every document's prefix, for the keys of pass ``at`` of ``passes``; ``shipped`` is a broadcast
    of the frequent shingles, sorted, and their classes; place is 128 times the key (48 bits of a shingle's hash; those of
    combinations lie above) plus a salt: 0 for rare shingles, else one of SALTS numbers by node; info is 2 * n, plus 1 for
    open rows, plus 2**32 times the most that can be shared from there on."""
    def run(batches):
        listed, its_class = shipped.value
        for batch in batches:
            for part, texts in text_chunks(batch):
                keys, nodes, info, salts, met = [], [], [], [], set()
                sets = shingle_sets(texts, shingle)
                if len(listed):
                    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    pos = np.minimum(np.searchsorted(listed, flat), len(listed) - 1)
                    flat_class = np.where(listed[pos] == flat, its_class[pos], 1)
                    cuts = np.cumsum([len(s) for s in sets])[:-1]
                    classes_of = np.split(flat_class, cuts)
                for i, tokens in enumerate(sets):
                    if not len(tokens) or (node := node_of(tokens)) in met:
                        continue
                    met.add(node)
                    classes = classes_of[i] if len(listed) else None
                    if classes is None or not (classes > 1).any():
                        own = tokens[:len(tokens) // 4 + 1]
                        f = o = np.zeros(len(own), np.int64)
                        left = np.arange(len(tokens), len(tokens) - len(own), -1)
                    else:
                        order = np.argsort(classes, kind="stable")
                        own, f, o, left = index_entries(tokens[order], classes[order])
                        own = np.array(own, np.uint64)
                    keys.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
                    info.append((np.asarray(left, np.int64) << 32) + 2 * len(tokens) + np.asarray(o, np.int64))
                    salts.append(np.asarray(f, np.int64) * (1 + node % SALTS))
                if keys:
                    key = np.concatenate(keys) >> np.uint64(14)
                    own = np.flatnonzero(key % np.uint64(passes) == np.uint64(at))
                    place = (key << np.uint64(7)) + np.concatenate(salts).astype(np.uint64)
                    yield _emit(place=signed(place[own]), node=np.concatenate(nodes)[own], info=np.concatenate(info)[own])

    return docs.select("text").mapInArrow(run, "place long, node long, info long")


def shared_entries(index: DataFrame, partitions: int) -> DataFrame:
    """Index rows whose key more than one node has (frequent keys are kept as they are)."""
    own = Window.partitionBy("place")
    kept = (index.repartition(partitions, "place")
            .withColumns({"lo": F.min("node").over(own), "hi": F.max("node").over(own)})
            .where("place % 128 > 0 OR lo != hi"))
    # a node has one salt, so repeated rows lie in one partition already
    return kept.dropDuplicates(["place", "node"]).select(
        F.shiftright("place", 7).alias("key"), "node", F.expr("info % 4294967296 div 2").cast("int").alias("n"),
        F.expr("info div 4294967296").cast("int").alias("rest"), (F.col("info") % 2 == 1).alias("open"))


def wanted_bitmap(ids: DataFrame) -> np.ndarray:
    """Bitmap of 2**FILTER_BITS bits with the hash of each id set (1 MB)."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    rows = (ids.select(slot.alias("s")).groupBy(F.expr("s div 32").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, tokens): the shingles (48 bits each, ``_six``) of the wanted documents (doc_id, node)."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(wanted_bitmap(wanted))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("int").alias("slot")

    def run(batches):
        bitmap = shipped.value
        for batch in batches:
            s = batch.column(1).to_numpy()
            hit = (bitmap[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1)
            chosen = batch.take(pa.array(np.flatnonzero(hit)))
            if not chosen.num_rows:
                continue
            for part, texts in text_chunks(chosen):
                sets = shingle_sets(texts, shingle)
                yield _emit(doc_id=part.column(0),
                            node=pa.array([node_of(x) if len(x) else None for x in sets], pa.int64()),
                            tokens=pa.array([_six(x) for x in sets], pa.binary()))

    schema = docs.select("doc_id").schema.add("node", "long").add("tokens", "binary")
    found = docs.select("doc_id", slot, "text").mapInArrow(run, schema)
    return found.join(wanted.withColumnRenamed("doc_id", "_id").select("_id", F.col("node").alias("_node")),
                      F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node"))).select("node", "tokens")


def _six(tokens: np.ndarray) -> bytes:
    """The upper 48 of the 62 bits, sorted: the steps between them, first all lowest bytes, then all second ones and
    so on (steps are small, so their highest bytes are zeros that compress away)."""
    upper = (tokens >> np.uint64(14)).astype("<u8")
    return np.diff(upper, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    steps = np.zeros((len(raw) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _bound_filter(percent: int):
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BINS)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
            full = ((x == 255) | (y == 255)).any(axis=1)
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            keep = full | (100 * most >= percent * (n - most))
            yield batch.select([0, 1]).filter(pa.array(keep))
    return run


def _compare(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = _unsix(x), _unsix(y)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def written_entries(docs: DataFrame, frequent: np.ndarray, seen: np.ndarray, shingle: int = SHINGLE,
                    passes: int = INDEX_PASSES) -> list[DataFrame]:
    """``shared_entries`` of all index rows, written pass by pass: the index rows of one are gone before the next."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shipped = spark.sparkContext.broadcast((frequent, np.where(seen >= SEEN_OFTEN[1], 3, 2)))
    parts = []
    for at in range(passes):
        parts.append(materialize(shared_entries(index_rows(docs, shipped, at, passes, shingle), partitions), "shared"))
        free_shuffles(spark)
    return parts


def link_nodes(docs: DataFrame, nodes: DataFrame, parts: list[DataFrame], percent: int = 75,
               shingle: int = SHINGLE) -> DataFrame:
    """(node, comp) for all nodes with links; ``nodes``: (node, doc_id, n, bins); ``parts``: the written entries."""
    spark = docs.sparkSession
    shared = reduce(DataFrame.unionByName, parts)
    reach = shared.groupBy("node").agg((F.count("*") / F.first("n")).alias("reach"))
    entry = written = materialize(shared.join(reach, "node"), "entries")
    discard(*parts)
    free_shuffles(spark)
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30)      # the same nodes lead everywhere
    tested = links = label = None
    leaders = LEADERS
    while True:
        comp = F.col("node").alias("comp") if label is None else F.coalesce("comp", "node").alias("comp")
        now = (entry if label is None else entry.join(label, "node", "left")).select(*entry.columns, comp)
        group = now.groupBy("key").agg(
            F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
            F.max(F.when(~F.col("open"), F.struct("reach", "node"))).alias("best"))
        group = group.where("c0 != c1 AND best IS NOT NULL")
        if tested is not None:               # in smaller entries every pair has been compared
            group = group.where(F.col("size") > leaders // MORE_LEADERS)
        now = materialize(now.join(group.select("key", "size", F.col("best.node").alias("best")), "key"), "rounds")
        discard(written)                     # each table goes once its successor is written
        written = now
        largest = now.agg(F.max("size")).first()[0]
        if largest is None:
            break
        chosen = (F.col("node") == F.col("best")) | (chance * F.col("size") < leaders)
        lead = now.where(chosen & ~F.col("open")).select("key", F.col("node").alias("l"), F.col("n").alias("ln"),
                                                         F.col("rest").alias("lr"), F.col("comp").alias("lc"))
        # what both can still share is enough: (100 + p) * shared >= p * (n + ln)
        met = (now.join(lead, "key").where((F.col("comp") != F.col("lc"))
                                           & (100 * F.least("n", "ln") >= percent * F.greatest("n", "ln"))
                                           & ((100 + percent) * F.least("rest", "lr") >= percent * (F.col("n") + F.col("ln"))))
               .select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct())
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        met = materialize(met, "candidates")
        tested = met if tested is None else tested.unionByName(met)
        # only the nodes met in this round take their bucket counts through the joins
        side = materialize(nodes.select("node", "n", "bins").join(
            met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "sides")
        rough = (met.join(side.toDF("a", "na", "xa"), "a").join(side.toDF("b", "nb", "xb"), "b")
                 .select("a", "b", "xa", "xb", "na", "nb").mapInArrow(_bound_filter(percent), "a long, b long"))
        rough = materialize(rough, "rough")
        discard(side)
        free_shuffles(spark)
        if not rough.isEmpty():
            wanted = rough.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
            wanted = materialize(wanted.select("doc_id", "node"), "wanted")
            sets = materialize(whole_sets(docs, wanted, shingle), "sets")
            sure = (rough.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
                    .select("a", "b", "ta", "tb").mapInArrow(_compare(percent), "a long, b long"))
            sure = materialize(sure, "links")
            discard(wanted, sets)
            free_shuffles(spark)
            links = sure if links is None else links.unionByName(sure)
            if label is not None:
                discard(label)
            label = components(links)
        discard(rough)
        entry = now.select(*entry.columns)
        if leaders >= largest:
            break
        leaders *= MORE_LEADERS
    if label is None:
        return spark.createDataFrame([], "node long, comp long")
    return label


def labelled_rows(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, comp (least node reachable by links) and component_id
    (least doc_id) of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = materialize(profiles(docs, shingle), "profiles")
    counted = table.where("key IS NOT NULL").groupBy("key").agg(F.sum("seen").alias("n")).where(f"n >= {SEEN_OFTEN[0]}")
    key, seen = most_frequent(materialize(counted, "frequent"), FREQUENT)
    own = table.where("key IS NULL")
    nodes = materialize(own.where("node IS NOT NULL").groupBy("node")
                        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bins").alias("bins")), "nodes")
    free_shuffles(spark)
    parts = written_entries(docs, key.view(np.uint64), seen, shingle)
    label = link_nodes(docs, nodes, parts, percent, shingle)
    named = nodes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "comp").select("node", "comp", "component_id")
    return (own.select("doc_id", "text_hash", "node", "n").join(of_node, "node", "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", "comp",
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row."""
    return labelled_rows(docs, percent, shingle).select("doc_id", "n_shingles", "component_id")


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the least doc_id.

    Rows without doc_id stay; of a component's rows that share the least doc_id one stays, by
    the least node and text hash.  Rows of one doc_id in several components are each judged in their own.
    """
    ship_package(spark)
    docs = docs.select(*DOC_COLUMNS)
    found = (labelled_rows(docs).where("doc_id = component_id").groupBy("doc_id", "comp")
             .agg(F.min(F.struct("node", "text_hash")).alias("first")).select("doc_id", F.col("first.text_hash").alias("_t")))
    kept = (docs.withColumn("_t", F.xxhash64("text")).join(found, ["doc_id", "_t"], "left_semi")
            .dropDuplicates(["doc_id", "_t"]).select(*DOC_COLUMNS))
    return kept.unionByName(docs.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT DISTINCT rid, doc_id, hash(s) AS s FROM (
    SELECT rid, doc_id, list_slice(w, k, k + 4) AS s
    FROM (SELECT rid, doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM words WHERE len(w) > 0))),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
pairs AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS both FROM sets a JOIN sets b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (
  SELECT p.x, p.y FROM pairs p JOIN sizes a ON a.rid = p.x JOIN sizes b ON b.rid = p.y
  WHERE 100 * p.both >= 75 * (a.n + b.n - p.both)),
reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       coalesce(least(w.doc_id, min(o.doc_id)), w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (rid) LEFT JOIN reach r ON r.x = w.rid LEFT JOIN words o ON o.rid = r.y
GROUP BY w.rid, w.doc_id, s.n
"""
