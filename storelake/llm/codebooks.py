"""Vector code compression with per-dimension value dictionaries.

Components become whole numbers (``vectors.py``) and every vector is cut into
``PARTS`` equal parts.  A part is stored as the index of the nearest of ``ENTRIES`` codebook entries.

* The table is turned once into blocks of at most ``BLOCK`` rows.  A block holds for
  each dimension the sorted distinct values found there (its dictionary) and for each
  row the place of its value (its dictionary code).  Blocks are written to the shared
  folder; all rounds work on them.
* For each dimension of a block the squared differences of every dictionary value to
  all entries are tabulated once.  The distances of a part are then gathers from these tables
  by dictionary code, added up over the part's dimensions: no multiplication per row.
* A round assigns every part (ties go to the lower index) and replaces each entry by the
  floor of its parts' mean; entries without parts stay.  Tasks add up their
  own parts, so one row per entry, dimension and task is shuffled, whatever the rows.

Only the codebooks (PARTS * ENTRIES entries, a size that does not follow the rows) pass
the driver.  Every row is read where it lies: no shuffle of rows, no hot key.

Defined cases: rows with a null vector, or with null or non-finite components, are
dropped; shorter vectors count as filled up with zeros, up to the longest one's length and
to a multiple of ``PARTS``; the first entries are those of the smallest vec_ids that are not
null (of repeated vec_ids the least vector), fewer if there are fewer; rows without
vec_id are coded like all others (without any vec_id, one entry of zeros begins); repeated rows
are coded and counted each; a null label is a label of its own; an empty table gives
no rows; of other columns only the label is read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import read_table
from storelake.llm.vectors import integer_vectors, matrix
from storelake.session import materialize

PARTS = 16
ENTRIES = 64              # at most 256: two hex digits a part
ROUNDS = 2
BLOCK = 4096


@dataclass
class Compressed:
    """``rows``: vec_id, label, code (bytes, one a part), error.  ``codebooks``: part, entry, position."""
    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components, in order, as decimal integers."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def _to_blocks(width: int, schema: pa.Schema):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                values = matrix(batch.column("v"), width)
                words, codes = [], []
                for d in range(width):
                    distinct, place = np.unique(values[:, d], return_inverse=True)
                    words.append(distinct.tolist())
                    codes.append(place.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("vec_id").to_pylist()], schema.field("vec_id").type),
                     pa.array([batch.column("label").to_pylist()], schema.field("label").type),
                     pa.array([words], schema.field("dictionary").type),
                     pa.array([codes], schema.field("codes").type)], schema=schema)

    return run


def nearest_entries(dictionary: list, codes: list, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's parts, as arrays rows x parts."""
    parts, entries, width = books.shape
    rows = len(codes[0]) // 2 if codes else 0
    best = np.zeros((rows, parts), np.int64)
    least = np.zeros((rows, parts), np.int64)
    for p in range(parts):
        total = np.zeros((rows, entries), np.int64)
        for j in range(width):
            d = p * width + j
            gap = np.asarray(dictionary[d], np.int64)[:, None] - books[p, :, j][None, :]
            total += (gap * gap)[np.frombuffer(codes[d], "<u2")]
        best[:, p] = total.argmin(axis=1)
        least[:, p] = np.take_along_axis(total, best[:, p:p + 1], axis=1)[:, 0]
    return best, least


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for dictionary, codes in zip(batch.column("dictionary").to_pylist(), batch.column("codes").to_pylist()):
                best, _ = nearest_entries(dictionary, codes, books)
                for p in range(parts):
                    count[p] += np.bincount(best[:, p], minlength=entries)
                    for j in range(width):
                        d = p * width + j
                        value = np.asarray(dictionary[d], np.int64)[np.frombuffer(codes[d], "<u2")]
                        np.add.at(total[p, :, j], best[:, p], value)
        p, e = np.nonzero(count)
        k = len(p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()),
             pa.array(np.tile(np.arange(width), k), pa.int32()), pa.array(np.repeat(count[p, e], width), pa.int64()),
             pa.array(total[p, e].ravel(), pa.int64())], names=["part", "entry", "pos", "n", "total"])

    return run


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    sums = (blocks.select("dictionary", "codes")
            .mapInArrow(_sums(books), "part int, entry int, pos int, n long, total long")
            .groupBy("part", "entry", "pos")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    out = books.copy()
    for r in sums.collect():          # one row per component of the codebooks at most
        out[r.part, r.entry, r.pos] = int(r.total) // r.n
    return out


def _code(books: np.ndarray, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("vec_id", "label", "dictionary", "codes")]
            for ids, labels, dictionary, codes in zip(*columns):
                if not codes:         # all vectors are empty
                    best = least = np.zeros((len(ids), len(books)), np.int64)
                else:
                    best, least = nearest_entries(dictionary, codes, books)
                lines = [row.tobytes() for row in best.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, schema.field("vec_id").type), pa.array(labels, schema.field("label").type),
                     pa.array(lines, pa.binary()), pa.array(least.sum(axis=1), pa.int64())], schema=schema)

    return run


def compress(table: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> Compressed:
    """Code every usable row of ``table`` (vec_id, label and the vector column)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte: 1 to 256 entries")
    kept = integer_vectors(table.select("vec_id", "label", column), column).select("vec_id", "label", "v")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)      # of a part
    id_type, label_type = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    block_type = T.StructType([
        T.StructField("vec_id", T.ArrayType(id_type)), T.StructField("label", T.ArrayType(label_type)),
        T.StructField("dictionary", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("codes", T.ArrayType(T.BinaryType()))])
    blocks = materialize(kept.mapInArrow(_to_blocks(parts * width, to_arrow_schema(block_type)), block_type), "blocks")

    first = kept.select("vec_id").where("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries)
    seeds = sorted((r.vec_id, list(r.v)) for r in
                   kept.join(F.broadcast(first), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).collect())
    start = np.zeros((max(1, len(seeds)), parts * width), np.int64)
    for i, (_, v) in enumerate(seeds):
        start[i, :len(v)] = v
    books = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        books = improved(blocks, books)

    row_type = T.StructType([T.StructField("vec_id", id_type), T.StructField("label", label_type),
                             T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    rows = blocks.mapInArrow(_code(books, to_arrow_schema(row_type)), row_type)
    return Compressed(rows, books)


def restored(code: bytes, codebooks: np.ndarray) -> np.ndarray:
    """The (whole-number) vector that a code stands for."""
    return np.concatenate([codebooks[p, e] for p, e in enumerate(code)])


def codebooks_query(spark, sf_dir: str) -> DataFrame:
    found = compress(read_table(spark, sf_dir, "embeddings"))
    rows = materialize(found.rows, "codes")      # read twice below
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return (rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                    F.lit(found.digest()).alias("codebooks_sha256")))


def _assign_sql(name: str, books: str) -> str:
    """Nearest entry and distance of each part: the least of distance * 64 + entry."""
    return f"""
{name} AS (
  SELECT rid, part, best % 64 AS entry, best // 64 AS dist FROM (
    SELECT rid, part, min(d * 64 + entry) AS best FROM (
      SELECT v.rid, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d
      FROM vals v JOIN {books} b ON b.part = v.part AND b.pos = v.pos GROUP BY v.rid, v.part, b.entry)
    GROUP BY rid, part))"""


def _update_sql(name: str, assigned: str, books: str) -> str:
    return f"""
{name} AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN u.n IS NULL THEN b.x ELSE (u.s - ((u.s % u.n) + u.n) % u.n) // u.n END AS x
  FROM {books} b LEFT JOIN (
    SELECT a.part, a.entry, v.pos, count(*)::HUGEINT AS n, sum(v.x) AS s
    FROM {assigned} a JOIN vals v ON v.rid = a.rid AND v.part = a.part GROUP BY a.part, a.entry, v.pos) u
  ON u.part = b.part AND u.entry = b.entry AND u.pos = b.pos)"""


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT max(len(v)) // 16 AS w FROM kept),
vals AS (
  SELECT rid, (i - 1) // w AS part, (i - 1) % w AS pos, v[i]::HUGEINT AS x
  FROM (SELECT rid, v, unnest(generate_series(1, len(v))) AS i FROM kept), cut),
seeds AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept WHERE vec_id IS NOT NULL
          QUALIFY row_number() OVER (ORDER BY vec_id) <= 64),
b0 AS (SELECT part, entry, pos, x FROM seeds JOIN vals USING (rid)),
{_assign_sql('a0', 'b0')},{_update_sql('b1', 'a0', 'b0')},{_assign_sql('a1', 'b1')},{_update_sql('b2', 'a1', 'b1')},{_assign_sql('a2', 'b2')},
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2),
coded AS (
  SELECT rid, string_agg(lpad(lower(printf('%x', entry::BIGINT)), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
  FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""
