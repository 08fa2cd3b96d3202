"""Packing documents into training sequences: vector bin packing with the
dot-product heuristic under simultaneous limits on tokens, segments and
loss-bearing tokens.

Token ids come from a public tokenizer file (lower-cased word BPE) and an end
id.  Words between white space are tokenised once per worker and looked up by
hash afterwards: the tokenizer never joins characters across white space, so
this gives the ids of the whole text.

The first ``Limits.prompt`` ids of a document stand for its instruction: they bear no loss, all
others do.  A document is cut into pieces that keep the limits by themselves: the first has
up to ``prompt`` + ``loss`` ids (or ``tokens``), the others up to ``loss``.  All three limits bind:
short documents fill a sequence's segments first, later pieces of long ones its loss-bearing
tokens, mixtures its tokens.

Pieces are dealt at random (by a hash of the row) into groups of about
``GROUP`` pieces, so a group has a bounded size whatever the data look like, and a Spark
task packs each group: an empty sequence is opened and takes, again and
again, the piece that fits and has the largest dot product of its demand
with what is left of the three limits; when nothing fits, the next one is opened.
Only the last sequences of a group can be badly filled.

Defined cases: null and empty texts have the end id only; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.common import read_table, ship_package
from storelake.llm.words import mix64, text_chunks, words_of
from storelake.session import materialize

END_ID = 2
GROUP = 1 << 15
CACHE_WORDS = 1_500_000   # words whose ids a worker keeps


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 16        # attention masks and positions of instruction data are kept per segment
    loss: int = 4064
    prompt: int = 32          # ids at a document's start that bear no loss


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words by word hash; new words are tokenised in long joined texts."""

    _kept: dict[str, "WordIds"] = {}

    def __init__(self, path: str) -> None:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.gap = self.tok.encode("0", add_special_tokens=False).ids[0]
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "WordIds":
        """The worker's own table (kept between tasks)."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; plain words are joined with the digit 0, whose id then divides them."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if "0" not in t and "<|" not in t]
        out: list[np.ndarray | None] = [None] * len(words)
        for k in range(0, len(plain), 500):
            own = plain[k:k + 500]
            ids = np.array(self.tok.encode_batch_fast([" 0 ".join(texts[i] for i in own)],
                                                      add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.gap)
            assert len(cut) == len(own) - 1
            for i, part in zip(own, np.split(ids, cut)):
                out[i] = part[1:] if len(part) and part[0] == self.gap else part
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def ids_of(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end_id``, and where each text's ids begin."""
        words = words_of(texts, lower=not any(t and b"<|" in t for t in texts))
        key, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        pos = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = self.key[pos] == key if len(self.key) else np.zeros(len(key), bool)
        new = np.flatnonzero(~known)
        got = self._encode([words.buffer[words.start[i]:words.end[i]].tobytes() for i in first[new]])
        n = np.zeros(len(key) + 1, np.int64)
        at = np.zeros(len(key) + 1, np.int64)
        if known.any():
            n[:-1][known], at[:-1][known] = self.n[pos[known]], self.at[pos[known]]
        sizes = np.array([len(x) for x in got], np.int64)
        fresh = np.concatenate(got) if got else np.zeros(0, np.uint32)
        n[new], at[new] = sizes, len(self.ids) + np.cumsum(sizes) - sizes
        pool = np.concatenate([self.ids, fresh])
        if len(self.key) + len(new) <= CACHE_WORDS:
            where = np.searchsorted(self.key, key[new])
            self.key = np.insert(self.key, where, key[new])
            self.n, self.at = np.insert(self.n, where, n[new]), np.insert(self.at, where, at[new])
            self.ids = pool
        pool = np.append(pool, np.uint32(end_id))
        n[-1], at[-1] = 1, len(pool) - 1
        which = np.insert(back, words.bounds[1:], len(key))
        size = n[which]
        ends = np.cumsum(size)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - (ends - size), size)]
        text_ends = ends[words.bounds[1:] + np.arange(len(texts))]
        return ids, np.concatenate([[0], text_ends])


def piece_rows(docs: DataFrame, path: str | None = None, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens and lot (a random number)."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType
    schema = docs.select("doc_id").schema.add("start", "long").add("length", "long").add("ids_crc32", "long") \
        .add("doc_tokens", "long").add("loss_tokens", "long").add("lot", "long")
    assert kind is not None
    head, later = min(limits.tokens, limits.loss + limits.prompt), min(limits.tokens, limits.loss)

    def run(batches):
        table, task, seen = WordIds.of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, texts in text_chunks(batch):
                ids, bounds = table.ids_of(texts, end_id)
                raw = ids.astype("<u4")
                total = np.diff(bounds)
                pieces = 1 + np.maximum(0, -(-(total - head) // later))
                row = np.repeat(np.arange(len(texts)), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(k > 0, head + (k - 1) * later, 0)
                length = np.minimum(total[row] - start, np.where(k > 0, later, head))
                loss = length - np.clip(limits.prompt - start, 0, length)
                at = bounds[row] + start
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                lot = mix64(np.arange(seen, seen + len(row)).astype(np.uint64) + np.uint64(task << 40))
                seen += len(row)
                ids_of_rows = part.column(part.schema.get_field_index("doc_id")).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids_of_rows, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(total[row], pa.int64()), pa.array(loss, pa.int64()),
                     pa.array((lot >> np.uint64(1)).view(np.int64))], names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_vectors(demand: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of every row of ``demand`` (rows that alone exceed the capacity are refused)."""
    if len(demand) and (demand > capacity).any():
        raise ValueError("an example exceeds the limits by itself")
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    kind = kind.ravel()
    left = np.bincount(kind, minlength=len(kinds))
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(left)[:-1]) if len(kinds) else []
    taken = [0] * len(kinds)
    scaled = kinds / capacity
    weight = scaled.mean(axis=0) if len(kinds) else scaled
    bins, place = np.zeros(len(demand), np.int64), np.zeros(len(demand), np.int64)
    live = np.arange(len(kinds))
    current = 0
    while len(live):
        room, k = capacity.astype(np.int64).copy(), 0
        while True:
            fits = live[(kinds[live] <= room).all(axis=1)]
            if not len(fits):
                break
            best = int(fits[np.argmax(scaled[fits] @ (weight * room / capacity))])
            i = members[best][taken[best]]
            taken[best] += 1
            left[best] -= 1
            bins[i], place[i] = current, k
            room, k = room - kinds[best], k + 1
            if not left[best]:
                live = live[live != best]
        current += 1
    return bins, place


def pack(pieces: DataFrame, limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset."""
    pieces = materialize(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("lot_group", F.pmod("lot", F.lit(groups)))
    schema = dealt.drop("lot", "loss_tokens", "lot_group").schema.add("sequence_id", "long").add("offset", "long")
    capacity = np.array([limits.tokens, limits.segments, limits.loss])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lot", kind="stable").reset_index(drop=True)
        demand = np.stack([pdf["length"], np.ones(len(pdf), np.int64), pdf["loss_tokens"]], axis=1)
        bins, place = pack_vectors(demand, capacity)
        order = np.lexsort([place, bins])
        out = pdf.iloc[order].copy()
        length, b = out["length"].to_numpy(), bins[order]
        before = np.cumsum(length) - length
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        out["offset"] = before - np.repeat(before[first], np.diff(np.append(first, len(b))))
        out["sequence_id"] = out["lot_group"].to_numpy() * (4 * group) + b
        return out[[f.name for f in schema]]

    return dealt.groupBy("lot_group").applyInPandas(run, schema)


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack(piece_rows(read_table(spark, sf_dir, "documents")))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    ship_package(spark)
    return pack(piece_rows(docs))
