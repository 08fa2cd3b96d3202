"""Words of many texts at once, as numpy arrays.

Texts are handled as UTF-8 bytes with A-Z lower-cased.  A word is a maximal
run of bytes outside a separator set; both separator sets used here are ASCII,
so a byte-wise split equals the code-point-wise one.  Every word gets a 64-bit
polynomial hash over a fixed random byte table, mixed at the end; two different
words collide with a chance of about 2**-61.

Work is done in pieces of about ``PIECE`` bytes cut between words, so memory
does not follow the length of a text or of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20          # bytes per numpy pass
_BASE = np.uint64(0x9E3779B97F4A7C15)   # odd, so invertible modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer on unsigned 64-bit integers (two multiply-xorshift steps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_ALL = np.arange(256, dtype=np.uint64)
_BYTE_VALUE = mix64((_ALL + np.uint64(1)) * _BASE)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + np.uint64(32), _ALL).astype(np.uint8)
#: True for bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: True for bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, all beyond ASCII).
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
#: 1 for letters, digits and all beyond ASCII, 2 for other visible characters.
KINDS = np.where(ALNUM | ((_ALL >= 65) & (_ALL <= 90)), 1, np.where(SPACED, 2, 0)).astype(np.uint8)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            n = max(n, PIECE + 4096)
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            fill = np.full(n, _BASE, np.uint64)
            fill[0] = 1
            self.up = np.multiply.accumulate(fill)
            fill = np.full(n, inv, np.uint64)
            fill[0] = 1
            self.down = np.multiply.accumulate(fill)
            self.n = n
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Words:
    """Words of consecutive texts: ``bounds[i]:bounds[i + 1]`` are those of text i.

    ``start`` and ``end`` are byte positions in ``buffer``, where the
    lower-cased texts lie one after the other.
    """
    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def doc(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def text(self, first: int, last: int) -> list[bytes]:
        """Words first..last-1 as bytes."""
        return [self.buffer[s:e].tobytes() for s, e in zip(self.start[first:last], self.end[first:last])]


def _scan(buf: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in one piece."""
    kind = np.zeros(len(buf) + 2, kinds.dtype)
    kind[1:-1] = kinds[buf]
    change = kind[1:] != kind[:-1]
    start = np.flatnonzero(change & (kind[1:] != 0))
    end = np.flatnonzero(change & (kind[:-1] != 0))
    up, down = _POWERS.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[:len(buf)], out=total[1:])
    hashed = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return start, end, hashed


def words_of(texts: list[bytes | None], is_word: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of a list of UTF-8 texts (None: no words).

    ``is_word`` gives the kind of each byte: 0 (False) separates, and a word is
    a maximal run of bytes of one other kind.
    """
    buf = np.frombuffer(b"\n".join([t or b"" for t in texts]), np.uint8)
    if lower and len(buf):
        buf = LOWER[buf]
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    text_start = np.concatenate([[0], np.cumsum(lengths)])
    parts, at = [], 0
    while at < len(buf):
        stop = min(len(buf), at + PIECE)
        while stop < len(buf):          # end the piece on a separator
            gaps = np.flatnonzero(is_word[buf[stop:stop + 4096]] == 0)
            if len(gaps):
                stop += int(gaps[0])
                break
            stop += 4096
        stop = min(stop, len(buf))
        s, e, h = _scan(buf[at:stop], is_word)
        parts.append((s + at, e + at, h))
        at = stop
    if parts:
        start, end, hashed = (np.concatenate(x) for x in zip(*parts))
    else:
        start = end = np.zeros(0, np.int64)
        hashed = np.zeros(0, np.uint64)
    return Words(buf, start, end, hashed, np.searchsorted(start, text_start))


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                limit: int = 4 * PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The batch cut into slices of about ``limit`` bytes of text (one text at least)."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    first, size = 0, 0
    lengths = [0 if n is None else n for n in
               pa.compute.binary_length(col).to_pylist()]
    for i, n in enumerate(lengths):
        if i > first and size + n > limit:
            yield batch.slice(first, i - first), col.slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first), col.slice(first).to_pylist()


def shingle_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of words i..i+n-1 for every i (order matters)."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashed[:count].copy()
    for k in range(1, n):
        out = out * _BASE + hashed[k:k + count]
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark longs."""
    return x.astype(np.uint64, copy=False).view(np.int64)
