"""Vectorised views of text columns: byte spans, words, and rolling 64-bit hashes, all in numpy.

A text column arrives as an Arrow string array; its data buffer is used without a copy. Hashes of substrings come
from prefix sums modulo 2**64 of randomised byte values times powers of an odd base, brought back to a common power
by the base's inverse and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Two independent streams of hashes where 128 bits are compared.
SEEDS = (0x51F0A3C7, 0x9B1D4E25)
#: White space as the contracts define it: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def rows_within(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one longer text makes a slice of its own."""
    if not batch.num_rows:
        return
    offsets = text_buffers(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets (n + 1, int64, from 0 of the data) of a string or binary array; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the seed's odd base and of its inverse modulo 2**64; kept up to 2**22 of them."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = (seed * 0x9E3779B97F4A7C15 | 5) % (1 << 64)
        steps = [np.full(size, b, dtype=U64) for b in (base, pow(base, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
            np.multiply.accumulate(s, out=s)
        have = (steps[0], steps[1])
        if size <= 1 << 22:
            _powers[seed] = have
    return have[0][:n], have[1][:n]


def prefix_sums(values: np.ndarray, seed: int) -> np.ndarray:
    """n + 1 prefix sums of ``values`` (uint64) times the powers of the seed's base."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(seed, len(values))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(seed, len(prefix))[1][starts])


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U64)


_byte_values = {s: byte_values(s) for s in SEEDS}


def byte_prefix(data: np.ndarray, seed: int) -> np.ndarray:
    return prefix_sums(_byte_values[seed][data], seed)


class Words:
    """Words (maximal runs of non-delimiter bytes) of the texts of one batch.

    ``starts`` and ``ends`` are byte places, ``first`` the index of each text's first word (n + 1 entries).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~delimiter[data]
        edge = inside[1:] != inside[:-1]  # edge[i]: a run begins or ends before byte i
        begins, ends = edge & inside[1:], edge & inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a text ends inside a run
        begins[cuts] = True
        ends[cuts] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, seed: int = SEEDS[0], data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        return span_hashes(byte_prefix(data, seed), self.starts, self.ends, seed)


def window_hashes(values: np.ndarray, width: int, seed: int = SEEDS[0]) -> np.ndarray:
    """Hash of each ``width`` consecutive values; windows may cross texts, the caller masks those."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    starts = np.arange(n)
    return span_hashes(prefix_sums(values, seed), starts, starts + width, seed)


def window_inside(first: np.ndarray, n_values: int, width: int) -> np.ndarray:
    """For each window start: whether the window stays within one text."""
    n = max(n_values - width + 1, 0)
    ok = np.ones(n_values, dtype=bool)
    for k in range(1, width):
        ends = first[1:] - k  # the last width - 1 starts of each text
        ends = ends[(ends >= first[:-1])]
        ok[ends] = False
    return ok[:n]


def shingle_sets(words: Words, width: int = 5, seed: int = SEEDS[0], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each text, sorted within it: (hashes, first index by text, n + 1 entries).

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    h = words.hashes(seed, LOWER[words.data] if lower else None)
    counts = words.counts()
    doc = words.doc()
    out_hash, out_doc = [], []
    if len(h) >= width:
        ok = window_inside(words.first, len(h), width)
        out_hash.append(window_hashes(h, width, seed)[ok])
        out_doc.append(doc[: len(ok)][ok])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        pre = prefix_sums(h, seed)
        out_hash.append(span_hashes(pre, words.first[short], words.first[short + 1], seed) + counts[short].astype(U64))
        out_doc.append(short)
    if not out_hash:
        return np.zeros(0, U64), np.zeros(len(counts) + 1, np.int64)
    hashes, docs = np.concatenate(out_hash), np.concatenate(out_doc)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[keep], docs[keep]
    return hashes, np.searchsorted(docs, np.arange(len(counts) + 1))
