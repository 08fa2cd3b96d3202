"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
The patterns are the windows of ``window`` consecutive words of each benchmark
item; an item of fewer words (but not none) is one pattern.  Patterns of one
length m form one search: a block is two words (one, if m is 1); the shift
table gives for a hashed block how far the end of the window may move on; where
the shift is 0, the block's suffix-hash bucket holds the patterns that end so, of
which the one with the window's hash is compared word by word.

Patterns are handled in blocks of ``PATTERN_BLOCK`` (about 12 MB of text), so
what is shipped to the tasks is bounded however large the benchmark is; more
blocks mean more passes over the documents, and hits of all blocks are united.

Defined cases: null texts have no words; repeated benchmark rows count once;
an item without id counts as the item named ``null``; repeated documents get a row
each; an empty benchmark hits nothing; extra columns are kept (but for those
named like the added ones).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import DOC_COLUMNS, read_table, ship_package
from storelake.llm.words import ALNUM, Words, mix64, shingle_hashes, text_chunks, words_of
from storelake.session import materialize

WINDOW = 10
PATTERN_BLOCK = 1 << 17
SEGMENT = 256            # words that one pointer scans; pointers of a batch move together

_FOUND = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()),
          ("items_sha256", T.StringType()), ("items", T.ArrayType(T.StringType()))]
_STATE = [("_hit_at", T.ArrayType(T.IntegerType())), ("_hit_len", T.ArrayType(T.IntegerType())),
          ("_hit_items", T.ArrayType(T.StringType()))]


def pattern_rows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct pattern: its words (joined by a space) and the ids of its items."""

    def cut(batches):
        for batch in batches:
            for part, texts in text_chunks(batch):
                words = words_of(texts, ALNUM)
                names, patterns = [], []
                ids = part.column(part.schema.get_field_index("item")).to_pylist()
                for i, item in enumerate(ids):
                    own = words.text(words.bounds[i], words.bounds[i + 1])
                    for k in range(max(1, len(own) - window + 1) if own else 0):
                        names.append(item)
                        patterns.append(b" ".join(own[k:k + window]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(patterns, pa.string())],
                                                 names=["item", "pattern"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return (rows.mapInArrow(cut, "item string, pattern string").distinct()
            .groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")))


@dataclass
class Search:
    """Shift table and suffix buckets of the patterns of one length."""
    m: int
    shift: np.ndarray
    suffix: np.ndarray       # sorted suffix-block hashes
    window: np.ndarray       # sorted window hashes
    row: np.ndarray          # pattern number by position in ``window``

    @staticmethod
    def build(m: int, hashes: np.ndarray, rows: np.ndarray) -> "Search":
        """``hashes``: a row of m word hashes per pattern."""
        block = min(2, m)
        bits = max(12, min(22, int(np.ceil(np.log2(max(2, 16 * hashes.size))))))
        shift = np.full(1 << bits, m - block + 1, np.int64)
        for end in range(block - 1, m):      # ends move right, so smaller shifts come last
            shift[_slot(_block(hashes, end, block), bits)] = m - 1 - end
        whole = _window(hashes.T)
        order = np.argsort(whole)
        return Search(m, shift, np.unique(_block(hashes, m - 1, block)), whole[order], rows[order])

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(start word, pattern number) of the windows whose hash is a pattern's."""
        m, bits = self.m, int(np.log2(len(self.shift)))
        block = min(2, m)
        blocks = shingle_hashes(words.hash, block) if block == 2 else mix64(words.hash)
        first, last = words.bounds[:-1] + m - 1, words.bounds[1:]
        n = np.maximum(0, -((first - last) // SEGMENT))
        owner = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = first[owner] + k * SEGMENT
        stop = np.minimum(at + SEGMENT, last[owner])
        ends = []
        while len(at):
            step = self.shift[_slot(blocks[at - block + 1], bits)]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        end = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
        end = end[_member(self.suffix, blocks[end - block + 1])]
        whole = _window([words.hash[end - m + 1 + k] for k in range(m)])
        pos = np.minimum(np.searchsorted(self.window, whole), len(self.window) - 1)
        same = self.window[pos] == whole
        return (end - m + 1)[same], self.row[pos[same]]


def _block(hashes: np.ndarray, end: int, block: int) -> np.ndarray:
    return shingle_hashes(np.ascontiguousarray(hashes[:, end - 1:end + 1]).ravel(), 2)[::2] if block == 2 \
        else mix64(hashes[:, end])


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _window(columns) -> np.ndarray:
    out = None
    for c in columns:
        out = mix64(c) if out is None else mix64(out + c)
    return out


def _member(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    pos = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[pos] == x


@dataclass
class Patterns:
    """The searches of one block of patterns."""
    text: list[bytes]
    items: list[list[str]]
    searches: list[Search]

    @staticmethod
    def build(rows) -> "Patterns":
        text = [r["pattern"].encode() for r in rows]
        words = words_of(text, ALNUM)
        sizes = np.diff(words.bounds)
        searches = []
        for m in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == m)
            at = words.bounds[:-1][own][:, None] + np.arange(m)
            searches.append(Search.build(m, words.hash[at], own))
        return Patterns(text, [list(r["items"]) for r in rows], searches)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start word, length, pattern number), each confirmed by comparing the words."""
        out = []
        for s in self.searches:
            start, row = s.find(words)
            sure = [i for i, (a, r) in enumerate(zip(start.tolist(), row.tolist()))
                    if b" ".join(words.text(a, a + s.m)) == self.text[r]]
            out.append((start[sure], np.full(len(sure), s.m), row[sure]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def _scan(patterns_b, last: bool):
    def run(batches):
        patterns = patterns_b.value
        for batch in batches:
            for part, texts in text_chunks(batch):
                yield _scan_part(part, words_of(texts, ALNUM), patterns, last)
    return run


def _scan_part(part: pa.RecordBatch, words: Words, patterns: Patterns, last: bool) -> pa.RecordBatch:
    n = part.num_rows
    old = [part.column(part.schema.get_field_index(c)).to_pylist() for c, _ in _STATE]
    at, length, items = ([list(x or []) for x in col] for col in old)
    start, size, row = patterns.occurrences(words)
    doc = np.searchsorted(words.bounds, start, "right") - 1
    for d, s, m, r in zip(doc.tolist(), (start - words.bounds[doc]).tolist(), size.tolist(), row.tolist()):
        at[d].append(s)
        length[d].append(m)
        items[d].extend(patterns.items[r])
    items = [sorted(set(x)) for x in items]
    rest = [(name, col) for name, col in zip(part.schema.names, part.columns) if name not in dict(_STATE)]
    if not last:
        new = [pa.array(at, pa.list_(pa.int32())), pa.array(length, pa.list_(pa.int32())),
               pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([c for _, c in rest] + new, names=[k for k, _ in rest] + [k for k, _ in _STATE])
    n_hit = []
    for a, m in zip(at, length):
        end = total = 0
        for s, e in sorted((s, s + k) for s, k in zip(a, m)):
            total += max(0, e - max(s, end))
            end = max(end, e)
        n_hit.append(total)
    cols = [pa.array(np.diff(words.bounds), pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            pa.array(items, pa.list_(pa.string()))]
    assert len(n_hit) == n
    return pa.RecordBatch.from_arrays([c for _, c in rest] + cols, names=[k for k, _ in rest] + [k for k, _ in _FOUND])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       pattern_block: int = PATTERN_BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_hit, n_items,
    items_sha256 and items (the matched item ids, sorted as strings)."""
    spark = docs.sparkSession
    docs = docs.drop(*[k for k, _ in _FOUND + _STATE])
    patterns = materialize(pattern_rows(benchmark, window), "patterns")
    blocks = max(1, -(-patterns.count() // pattern_block))
    patterns = patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    base = list(docs.schema.fields)
    state = docs.select("*", *[F.lit(None).cast(t).alias(k) for k, t in _STATE])
    for i in range(blocks):
        last = i == blocks - 1
        rows = patterns.where(F.col("block") == i).select("pattern", "items").collect()
        shipped = spark.sparkContext.broadcast(Patterns.build(rows))
        fields = [T.StructField(k, t) for k, t in (_FOUND if last else _STATE)]
        state = state.mapInArrow(_scan(shipped, last), T.StructType(base + fields))
        if not last:
            state = materialize(state, "scanned")
    return state


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                    (F.col("n_hit") > 0).alias("contaminated")))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word inside a benchmark window."""
    ship_package(spark)
    found = find_contamination(docs.select(*DOC_COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return found.where(F.col("n_hit") == 0).select(*DOC_COLUMNS)


SQL = r"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, list_slice(w, k, k + least(10, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS m FROM windows),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
doc_windows AS (
  SELECT rid, k, m, list_slice(w, k, k + m - 1) AS win
  FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM docs, sizes WHERE len(w) >= m)),
found AS (SELECT d.rid, d.k, d.m, x.item FROM doc_windows d JOIN windows x ON d.win = x.win),
hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(generate_series(k, k + m - 1)) AS p FROM (SELECT DISTINCT rid, k, m FROM found)) GROUP BY rid),
names AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (rid) LEFT JOIN names n USING (rid)
"""
