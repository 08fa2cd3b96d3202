"""Line dedup by winnowing.

A passage of ``RUN_WORDS`` words or more (white space ignored, case kept) that occurred before --
in a document with a smaller doc_id, or further up in the same one -- is a repeat, and its words
go: whole lines, and parts of lines where a passage begins or ends inside one.  Lines as
units alone cannot do that (a passage inside longer lines has no line in common), so the hashes
are of runs of words and cross line breaks.

1. Winnowing: of the grams of ``GRAM_WORDS`` words inside every window of ``RUN_WORDS`` words, the
   one with the least hash is a fingerprint (ties: each of them).  Which one depends on the window's
   words alone, so two copies of a passage share a fingerprint at the same place.
2. Fingerprints that occur more than once (a bit table of them is shipped; a full one lets more
   through and never drops one) come again with their position and ``RUN_WORDS`` -
   ``GRAM_WORDS`` words on either side, known by 24 bits each.
3. Positions of equal fingerprints meet, in document order, and are extended both ways: s
   words back and the rest forward make up a window, for every s.  A window that an earlier position also has is a
   repeat, and its words go.  A repeated window is found at each of its fingerprints.
4. Repeated windows overlap into the longest repeated runs.

Positions are compared with what came before by hash, never pair by pair.  A fingerprint with more
than ``BUCKET`` positions is not gathered in one task: its windows become rows, whose first
occurrence is an aggregate.  Texts are read three times (hash, extend, cut).

Defined cases: null and empty texts stay as they are; rows equal in doc_id and
text are one document and get one result; rows without doc_id come last in order;
texts of one doc_id are ordered by their hash; a line that loses all its words goes with its
line break, of one that loses some the others stay as they are (white space behind
a lost word goes with it); an empty table gives no rows; extra columns are kept
(but for those named like the added ones).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelake.llm.common import DOC_COLUMNS, read_table, ship_package, with_fields
from storelake.llm.lm import Sieve
from storelake.llm.words import _BASE, _POWERS, SPACED, Words, mix64, signed, text_chunks, words_of
from storelake.session import discard, materialize

RUN_WORDS = 50
GRAM_WORDS = 26           # over half, so that neighbouring fingerprints of a run touch
BUCKET = 1 << 16          # most positions of a fingerprint that one task compares
FLUSH = 1 << 20           # fingerprints between two rounds of counting in a task
BLANK = bytes([32, 9, 10, 11, 12, 13])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _order():
    """Place of a document: its id; without one it comes last."""
    return F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = best(values[:len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return best(values[:len(values) - rest], values[rest:]) if rest else values


def fingerprints(words: Words, run: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (word numbers) and hashes of the grams that winnowing selects in some texts."""
    n = len(words.hash)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * up[:n], out=total[1:])
    value = mix64((total[gram:] - total[:n + 1 - gram]) * down[:n + 1 - gram]) | np.uint64(1)
    spread = run - gram + 1
    least = _sliding(value, spread, np.minimum)          # of each window
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    least[np.arange(len(least)) + run > ends[:len(least)]] = 0      # no window crosses texts
    around = np.zeros(len(least) + 2 * (spread - 1), np.uint64)
    around[spread - 1:spread - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(around, spread, np.maximum) == value)
    return at, value[at]


def _rows(names, columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _count(run_words: int, gram_words: int):
    def emit(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(key), 1 << 16):
            yield _rows(["gram", "n"], [signed(key[k:k + (1 << 16)]), n[k:k + (1 << 16)].astype(np.int64)])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, texts in text_chunks(batch):
                held.append(fingerprints(words_of(texts, SPACED, lower=False), run_words, gram_words)[1])
                size += len(held[-1])
                if size >= FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    return run


_PLACE = "gram long, o long, t long, at int, before int, behind int, context binary"


def _places(shipped, run_words: int, gram_words: int):
    """Fingerprints that may occur more than once, with the words around them: before (the nearest
    first), then behind."""
    reach = run_words - gram_words

    def run(batches):
        for batch in batches:
            for part, texts in text_chunks(batch):
                words = words_of(texts, SPACED, lower=False)
                at, value = fingerprints(words, run_words, gram_words)
                keep = shipped.value.may_hold(value)
                at, value = at[keep], value[keep]
                doc = np.searchsorted(words.bounds, at, "right") - 1
                begin, end = words.bounds[doc], words.bounds[doc + 1]
                short = (words.hash >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                for k in range(0, len(at), 1 << 13):
                    own = slice(k, k + (1 << 13))
                    steps = np.arange(reach)
                    near = np.concatenate([at[own, None] - 1 - steps, at[own, None] + gram_words + steps], axis=1)
                    around = short[np.clip(near, 0, len(short) - 1)]
                    row = pa.array(doc[own])
                    yield _rows(["gram", "o", "t", "at", "before", "behind", "context"],
                                [signed(value[own]), part.column(0).take(row), part.column(1).take(row),
                                 (at[own] - begin[own]).astype(np.int32), np.minimum(reach, at[own] - begin[own]).astype(np.int32),
                                 np.minimum(reach, end[own] - at[own] - gram_words).astype(np.int32),
                                 pa.FixedSizeBinaryArray.from_buffers(pa.binary(6 * reach), len(around), [None, pa.py_buffer(around.tobytes())])
                                 .cast(pa.binary())])

    return run


def _context(batch, reach: int) -> np.ndarray:
    """The words around every position, as numbers: positions x (before, then behind)."""
    raw = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("context")).to_pylist()), np.uint8)
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = raw.reshape(-1, 3)
    return wide.view("<u4").reshape(-1, 2 * reach)


def _window_keys(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """For every position and every s: the hash of the window that begins s words before the fingerprint."""
    reach = context.shape[1] // 2
    context = context.astype(np.uint64)
    one, two = np.zeros((len(gram), reach + 1), np.uint64), np.zeros((len(gram), reach + 1), np.uint64)
    one[:, 0], two[:, 0] = gram, gram + np.uint64(1)
    for s in range(reach):
        one[:, s + 1] = mix64(one[:, s] * _BASE + context[:, s])
        two[:, s + 1] = mix64(two[:, s] * _BASE + context[:, reach + s])
    return mix64(one + mix64(two[:, ::-1]))


def _shared(equal: np.ndarray) -> np.ndarray:
    """How many of the first columns are true, by row."""
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))


def _columns(batch, *names):
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def _repeats(run_words: int, gram_words: int):
    """Positions sorted by (gram, o, t, at) to (o, t, first, last): the words of repeated windows.

    A position is compared with its gram's first one.  Where all its windows are there, too, or no
    other position came between, that tells all; only what is left of grams with
    three positions or more is looked up by the hashes of all windows.
    """
    reach = run_words - gram_words

    def compare(batch):
        gram, o, t, at = _columns(batch, "gram", "o", "t", "at")
        same = (gram[1:] == gram[:-1]) & (o[1:] == o[:-1]) & (t[1:] == t[:-1]) & (at[1:] == at[:-1])
        batch = batch.filter(pa.array(np.append(True, ~same)))         # rows equal in doc_id and text are one document
        gram, o, t, at, before, behind = _columns(batch, "gram", "o", "t", "at", "before", "behind")
        context = _context(batch, reach)
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        sizes = np.diff(np.append(starts, len(gram)))
        run, head = np.repeat(np.arange(len(starts)), sizes), np.repeat(starts, sizes)
        equal = context == context[head]
        back = np.minimum(_shared(equal[:, :reach]), np.minimum(before, before[head]))
        on = np.minimum(_shared(equal[:, reach:]), np.minimum(behind, behind[head]))
        # windows that begin s words before the fingerprint are repeated for least <= s <= most
        least, most = reach - on, back.astype(np.int64)
        least[starts], most[starts] = run_words, -1
        open_ = (sizes[run] > 2) & ((back < before) | (on < behind))
        open_[starts] = False
        rest = np.flatnonzero(np.bincount(run[open_], minlength=len(starts))[run] > 0)
        if len(rest):
            key = _window_keys(gram[rest].view(np.uint64), context[rest])
            low, high = np.full(len(rest), run_words, np.int64), np.full(len(rest), -1, np.int64)
            for s in range(reach + 1):
                rows = np.flatnonzero((before[rest] >= s) & (behind[rest] >= reach - s))
                _, new = np.unique(key[rows, s], return_index=True)
                again = np.ones(len(rows), bool)
                again[new] = False
                rows = rows[again]
                low[rows] = np.minimum(low[rows], s)
                high[rows] = s
            least[rest], most[rest] = low, high
        hit = np.flatnonzero(least <= most)
        if len(hit):
            yield _rows(["o", "t", "first", "last"], [o[hit], t[hit], (at[hit] - most[hit]).astype(np.int32),
                                                      (at[hit] - least[hit] + run_words).astype(np.int32)])

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            gram = held.column(0).to_numpy(zero_copy_only=False)
            whole = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0     # the last one may go on
            if whole:
                yield from compare(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from compare(held)

    return run


def _windows(run_words: int, gram_words: int):
    reach = run_words - gram_words

    def run(batches):
        for batch in batches:
            gram, at, before, behind = _columns(batch, "gram", "at", "before", "behind")
            key, s = _window_keys(gram.view(np.uint64), _context(batch, reach)), np.arange(reach + 1)
            row, s = np.nonzero((before[:, None] >= s) & (behind[:, None] >= reach - s))
            take = pa.array(row)
            yield _rows(["window", "o", "t", "first"], [signed(key[row, s]), batch.column(1).take(take), batch.column(2).take(take),
                                                        (at[row] - s).astype(np.int32)])

    return run


def repeated_spans(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS,
                   bucket: int = BUCKET) -> DataFrame:
    """(o, t, spans): for documents with repeats, the spans of words [first, last) that occurred earlier."""
    if not run_words // 2 < gram_words <= run_words:
        raise ValueError("a gram has more than half of a run's words")
    texts = docs.select(_order().alias("o"), F.xxhash64("text").alias("t"), "text")
    counts = (texts.select("text").mapInArrow(_count(run_words, gram_words), "gram long, n long")
              .groupBy("gram").agg(F.sum("n").alias("n")))
    twice = materialize(counts.where("n > 1"), "repeated-grams")
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of_table(twice.select(F.col("gram").alias("key"))))
    places = texts.mapInArrow(_places(sieve, run_words, gram_words), _PLACE)
    large = materialize(twice.where(F.col("n") > bucket).select("gram"), "large-grams")
    spans, written = [], []
    if not large.isEmpty():
        places = materialize(places, "places")
        written.append(places)
        rows = (places.join(large, "gram", "left_semi").select("gram", "o", "t", "at", "before", "behind", "context")
                .mapInArrow(_windows(run_words, gram_words), "window long, o long, t long, first int"))
        rows = materialize(rows, "windows")
        place = F.struct("o", "t", "first")
        origin = (rows.groupBy("window").agg(F.min(place).alias("origin"), F.max(place).alias("final"))
                  .where("origin != final").select("window", "origin"))
        origin = materialize(origin, "origins")          # apart from the join, which Spark can then split
        written += [rows, origin]
        spans.append(rows.join(origin, "window").where(place != F.col("origin"))
                     .select("o", "t", "first", (F.col("first") + run_words).alias("last")))
        places = places.join(large, "gram", "left_anti").select(*places.columns)
    spans.append(places.repartition("gram").sortWithinPartitions("gram", "o", "t", "at")
                 .mapInArrow(_repeats(run_words, gram_words), "o long, t long, first int, last int"))
    every = spans[0] if len(spans) == 1 else spans[0].unionByName(spans[1])
    out = materialize(every.groupBy("o", "t").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    discard(twice, large, *written)
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the words of the spans, how many lines went whole and how many words went."""
    edge = np.zeros(max(b for _, b in spans) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    gone = np.cumsum(edge) > 0
    lost_upto = np.concatenate([[0], np.cumsum(gone)])
    every = text.split(b"\n")
    edges = np.concatenate([[0], np.cumsum([len(x.split()) for x in every])])      # bytes.split() splits at the same bytes
    lost = np.diff(lost_upto[np.minimum(edges, len(gone))])
    kept, lines = [], 0
    for line, at, n, x in zip(every, edges[:-1].tolist(), np.diff(edges).tolist(), lost.tolist()):
        if not x:
            kept.append(line)
        elif x == n:
            lines += 1
        else:
            pieces = _WORD.findall(line)
            out = gone[at:at + n].tolist() + [False] * max(0, at + n - len(gone))
            lead = b"" if out[0] else line[:len(line) - sum(map(len, pieces))]
            rest = lead + b"".join(p for p, y in zip(pieces, out) if not y)
            kept.append(rest.rstrip(BLANK) if out[-1] else rest)
    return b"\n".join(kept), lines, int(lost_upto[-1])


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS,
                bucket: int = BUCKET) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without repeated runs, and ``lines_removed`` (lines
    that went whole), ``lines_left`` (lines with words) and ``words_removed``."""
    docs = docs.drop("lines_removed", "lines_left", "words_removed")
    o, t, found = _free(docs, "o"), _free(docs, "t"), _free(docs, "spans")
    spans = repeated_spans(docs.select("doc_id", "text"), run_words, gram_words, bucket).toDF(o, t, found)
    joined = docs.withColumns({o: _order(), t: F.xxhash64("text")}).join(spans, [o, t], "left").select(*docs.columns, found)
    text_at, spans_at = docs.columns.index("text"), len(docs.columns)
    schema = with_fields(docs, ("lines_removed", T.LongType()), ("lines_left", T.LongType()), ("words_removed", T.LongType()))

    def run(batches):
        for batch in batches:
            for part, texts in text_chunks(batch):
                out, gone, left, lost = [], [], [], []
                for text, s in zip(texts, part.column(spans_at).to_pylist()):
                    lines = words = 0
                    if text is not None and s:
                        text, lines, words = cut_words(text, [(x["first"], x["last"]) for x in s])
                    out.append(None if text is None else text.decode("utf-8", "replace"))
                    gone.append(lines)
                    lost.append(words)
                    left.append(sum(bool(x.strip(BLANK)) for x in (text or b"").split(b"\n")))
                cols = [pa.array(out, pa.string()) if k == text_at else part.column(k) for k in range(spans_at)]
                yield _rows([f.name for f in schema], cols + [pa.array(x, pa.int64()) for x in (gone, left, lost)])

    return joined.mapInArrow(run, schema)


def linededup_query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def linededup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs; a document of which nothing is left goes."""
    ship_package(spark)
    cut = F.col("words_removed") > 0
    out = dedup_lines(docs.select(*DOC_COLUMNS)).where(~cut | (F.col("lines_left") > 0))
    return out.select("doc_id", "text", "lang", "source",
                      F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))
