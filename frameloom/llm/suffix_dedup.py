"""Suffix-array deduplication of byte strings.

Sampled splitters range-partition suffixes by their leading bytes; each bucket sorts its suffixes by multikey
quicksort, taking eight bytes as one character, and runs of equal WINDOW-byte strings show which of them recur.

A sparse set of suffixes is enough: every WINDOW-byte string has one selected place, where the hash of GRAM bytes is
least (the leftmost of equals), and equal strings select the same place, so only suffixes at selected places move, with
the bytes around them, and only those whose GRAM bytes occur in several rows. That choice leaves suffixes out of the
sort, it removes nothing: each removal is decided by bytes that were sorted. A block sorts its own suffixes first and
sends equal surroundings once, so a text or passage that a third of all rows share costs one suffix per block.

Leading bytes that alone would fill buckets are hot, by the sample. The strings around a hot place are sent one by one,
each turned so that it starts at the selected place, and have splitters of their own over all WINDOW bytes. A string
that is more than one such splitter is dealt over the buckets between them; those buckets are compared across their
boundaries by the least rank that each has seen of it.

Defined results: a null text is empty; a null doc_id sorts after all others; rows with the same doc_id are not
smaller than each other; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import blocks as B
from frameloom.llm.bytesight import SEEDS, U64, byte_prefix, span_hashes
from frameloom.llm.storage import Scratch

WINDOW, GRAM = 50, 20
#: Gram starts in a window, and so windows by selected place at most.
REACH = WINDOW - GRAM + 1
#: Selected places per byte of text, about.
DENSITY = 2 / (REACH + 1)
LEAD = 16
#: Suffixes, and strings around hot places, in a bucket, about.
BUCKET_SUFFIXES, BUCKET_STRINGS = 1 << 14, 1 << 16
#: Ranges at most, and suffixes sampled at most, of all and of a block; beyond, a range is dealt by a hash of the lead.
RANGES, SAMPLE, BLOCK_SAMPLE = 1 << 13, 1 << 17, 32
#: Segments that multikey quicksort sorts without further partition.
SHORT = 1 << 10
NOTED = B.BLOCKS + ", n_places long, sample binary"
SUFFIXES = "bucket long, block_id long, bytes binary, shape binary, ranks binary"
#: block_id of the rows that tell what a bucket has seen of a string dealt over several.
BOUNDARY = -1
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


@dataclass
class Places:
    """Selected places ``at``; windows that select one start at ``first`` to ``first + n - 1``."""

    at: np.ndarray
    first: np.ndarray
    n: np.ndarray
    hashes: np.ndarray

    def take(self, which: np.ndarray) -> Places:
        return Places(self.at[which], self.first[which], self.n[which], self.hashes[which])


def places(block: B.Block) -> Places:
    size = len(block.data)
    none = np.zeros(0, np.int64)
    if size < WINDOW:
        return Places(none, none, none, none.astype(U64))
    starts = np.arange(size - GRAM + 1)
    h = span_hashes(byte_prefix(block.data, SEEDS[0]), starts, starts + GRAM, SEEDS[0])
    least = sliding_min((h >> U64(32)) << U64(32) | starts.astype(U64), REACH)
    room = np.zeros(size + 1, dtype=np.int64)  # windows start where their text has WINDOW bytes left
    begin, stop = block.offsets[:-1], block.offsets[1:] - WINDOW + 1
    fits = stop > begin
    np.add.at(room, begin[fits], 1)
    np.add.at(room, stop[fits], -1)
    windows = np.flatnonzero(np.cumsum(room)[: len(least)])
    at = (least[windows] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    head = np.flatnonzero(new)
    return Places(at[head], windows[head], np.diff(np.append(head, len(at))), h[at[head]])


def doc_of(block: B.Block, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(block.offsets, at, side="right") - 1


def _ask_grams(n_buckets: int):
    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for block in map(B.Block.of, rows):
            own = places(block)
            yield from B.ask(block, own.hashes, doc_of(block, own.at), n_buckets)

    return run


def _note(n_buckets: int):
    """Each block again, noting its shared places, how many differ, and a sample of those."""

    def run(block: B.Block, answers: list[dict]) -> Iterator[tuple]:
        own = places(block)
        own = own.take(B.heard(block, answers, own.hashes, doc_of(block, own.at), n_buckets))
        shape = own.at.astype(np.uint32).tobytes() + own.first.astype(np.uint32).tobytes() + own.n.astype(np.uint8).tobytes()
        distinct = np.unique(own.hashes, return_index=True)[1]
        rng = np.random.default_rng(block.block_id)
        picked = own.take(rng.choice(distinct, min(len(distinct), BLOCK_SAMPLE), replace=False))
        items = [
            bytes([n, at - first]) + block.data[first : first + n - 1 + WINDOW].tobytes().ljust(REACH + WINDOW, b"\0")
            for at, first, n in zip(picked.at.tolist(), picked.first.tolist(), picked.n.tolist(), strict=True)
        ]
        yield *block.noting(zstandard.ZstdCompressor(level=1).compress(shape)), len(distinct), b"".join(items)

    return run


def _noted(block: B.Block) -> Places:
    raw = zstandard.decompress(block.note)
    n = len(raw) // 9
    at, first = (np.frombuffer(raw[k * 4 * n : (k + 1) * 4 * n], np.uint32).astype(np.int64) for k in (0, 1))
    return Places(at, first, np.frombuffer(raw[8 * n :], np.uint8).astype(np.int64), np.zeros(n, U64))


def multikey_quicksort(characters: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows (of uint64 characters) that each row is in; runs ascend with their rows.

    A segment is parted by one character in less than, equal to and greater than its pivot, and the equal part goes on
    to the next character; short segments are sorted by the characters they have left.
    """
    size, width = characters.shape
    order, new = np.arange(size), np.zeros(size, dtype=bool)
    segments = [(0, size, 0)] if size else []
    while segments:
        i, j, c = segments.pop()
        if c == width or j - i == 1:
            new[i] = True
            continue
        part = order[i:j]
        if j - i <= SHORT:
            left = characters[part, c:]
            sort = np.lexsort(left.T[::-1])
            left = left[sort]
            order[i:j] = part[sort]
            new[i] = True
            new[i + 1 : j] = np.any(left[1:] != left[:-1], axis=1)
            continue
        key = characters[part, c]
        pivot = np.sort(key[:: (j - i) // 9])[4]
        less, same = key < pivot, key == pivot
        below, equal, above = part[less], part[same], part[~(less | same)]
        a, b = i + len(below), i + len(below) + len(equal)
        order[i:a], order[a:b], order[b:j] = below, equal, above
        segments += [(x, y, z) for x, y, z in ((i, a, c), (a, b, c + 1), (b, j, c)) if x < y]
    run = np.empty(size, dtype=np.int64)
    run[order] = np.cumsum(new) - 1
    return run


def as_characters(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The bytes from ``starts`` on as big-endian uint64 characters, zero beyond ``sizes``; width in bytes."""
    wide = -(-width // 8) * 8
    padded = np.concatenate([raw, np.zeros(wide, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, wide)[starts]
    out[np.arange(wide) >= sizes[:, None]] = 0
    return out.view(">u8").astype(U64)


def around(raw: np.ndarray, first: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Run of equal surroundings that each is in: the same bytes, windows and place."""
    shape = (n << 8 | before).astype(U64)[:, None]
    return multikey_quicksort(np.concatenate([as_characters(raw, first, n - 1 + WINDOW, REACH + WINDOW), shape], axis=1))


def expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of surroundings that have ``n``: which surrounding, and its number there."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def turned(raw: np.ndarray, start: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(windows, WINDOW + 1) bytes: each window from its selected place on, ``before`` bytes after its start, then what
    stands before that place, then ``before`` itself. Equal windows, and no others, have equal rows."""
    at = (start + before)[:, None] + np.arange(WINDOW)
    at -= WINDOW * (np.arange(WINDOW) >= (WINDOW - before)[:, None])
    return np.concatenate([raw[at], before.astype(np.uint8)[:, None]], axis=1)


def as_strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as byte strings that sort like them; a last byte keeps trailing zero bytes."""
    raw = np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], axis=1)
    return np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel()


def leads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LEAD bytes from each place; a selected place has GRAM bytes after it."""
    return as_strings(raw[at[:, None] + np.arange(LEAD)])


@dataclass
class Splits:
    """Splitters: ``cold`` between ranges of leads, each in ``parts``; ``hot`` leads, and ``strings`` between ranges of
    the strings around them."""

    cold: np.ndarray
    parts: int
    hot: np.ndarray
    strings: np.ndarray
    #: Strings that are several splitters, and the least rank of each, once all buckets are sorted.
    dealt: np.ndarray = field(init=False)
    least: B.Ranks | None = None

    def __post_init__(self):
        self.dealt = np.unique(self.strings[1:][self.strings[1:] == self.strings[:-1]])

    def is_hot(self, lead: np.ndarray) -> np.ndarray:
        return np.isin(lead, self.hot)

    def of_leads(self, lead: np.ndarray) -> np.ndarray:
        numbers = np.ascontiguousarray(lead).view(np.uint8).reshape(-1, LEAD + 1)[:, :LEAD].copy().view(U64)
        part = ((numbers[:, 0] * U64(0x9E3779B97F4A7C15) ^ numbers[:, 1]) * U64(0xD6E8FEB86659FD93) >> U64(33)).astype(np.int64) % self.parts
        return np.searchsorted(self.cold, lead, side="right") * self.parts + part

    @property
    def n_cold(self) -> int:
        return (len(self.cold) + 1) * self.parts

    def of_strings(self, strings: np.ndarray, block_id: int) -> np.ndarray:
        low, high = (np.searchsorted(self.strings, strings, side=side) for side in ("left", "right"))
        spread = block_id * 0x9E3779B97F4A7C15 % (1 << 64) >> 33
        return self.n_cold + np.where(high > low, low + 1 + spread % np.maximum(high - low, 1), low)


def find_splits(noted: DataFrame) -> Splits:
    """Splitters from a sample of bounded size."""
    total = noted.agg(F.sum("n_places")).first()[0] or 0
    step = 2 + REACH + WINDOW

    def priorities(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            items = [r["sample"][k : k + step] for k in range(0, len(r["sample"]), step)]
            # the least of n_places numbers drawn evenly between 0 and 1
            drawn = np.random.default_rng(r["block_id"]).exponential(size=len(items)).cumsum() / max(r["n_places"], 1)
            yield from zip(drawn.tolist(), items, strict=True)

    rows = B.map_rows(noted.select("block_id", "n_places", "sample"), priorities, "drawn double, item binary")
    items = np.frombuffer(b"".join(r["item"] for r in rows.orderBy("drawn", "item").limit(SAMPLE).collect()), np.uint8)
    each = total / max(len(items) // step, 1)  # suffixes that one of the sample stands for
    n, before = items[::step].astype(np.int64), items[1::step].astype(np.int64)
    first = np.arange(len(n)) * step + 2
    lead = np.sort(found := leads(items, first + before))
    names, counts = np.unique(lead, return_counts=True)
    hot = names[(counts >= 4) & (counts * each > 2 * BUCKET_SUFFIXES)]
    cold = lead[~np.isin(lead, hot)]
    buckets = int(len(cold) * each) // BUCKET_SUFFIXES + 1
    ranges = min(buckets, RANGES)
    picked = cold[np.linspace(0, len(cold) - 1, ranges + 1).astype(int)[1:-1]] if len(cold) else cold
    own = np.flatnonzero(np.isin(found, hot))
    which, step_of = expanded(n[own])
    strings = np.sort(as_strings(turned(items, first[own][which] + step_of, before[own][which] - step_of)))
    ranges = min(int(len(strings) * each) // BUCKET_STRINGS + 1, RANGES)
    between = strings[np.linspace(0, len(strings) - 1, ranges + 1).astype(int)[1:-1]] if len(strings) else strings
    return Splits(np.unique(picked), -(-buckets // min(buckets, RANGES)), hot, between)


class Suffixes:
    """A block's suffixes as sent: each distinct surrounding once, or its strings where its lead is hot, with the least
    rank that has it here; in order of their buckets."""

    def __init__(self, block: B.Block, own: Places, splits: Splits):
        self.ranks = block.ranks.take(doc_of(block, own.at))
        head, self.place = B.least_of_runs(self.ranks, around(block.data, own.first, own.n, own.at - own.first))
        self.sent, self.least = own.take(head), self.ranks.take(head)
        lead = leads(block.data, self.sent.at)
        is_hot = splits.is_hot(lead)
        cold = np.flatnonzero(~is_hot)
        bucket = splits.of_leads(lead[cold])
        order = np.argsort(bucket, kind="stable")
        self.cold = cold[order]
        self.buckets, self.bounds = B.occurring(bucket[order])
        # the strings around hot places
        self.hot = np.flatnonzero(is_hot)
        which, self.step = expanded(self.sent.n[self.hot])
        self.which = self.hot[which]
        start = self.sent.first[self.which] + self.step
        rows = turned(block.data, start, self.sent.at[self.which] - start)
        same = multikey_quicksort(as_characters(rows.ravel(), np.arange(len(rows)) * (WINDOW + 1), np.full(len(rows), WINDOW + 1), WINDOW + 1))
        head, place = B.least_of_runs(self.least.take(self.which), same)
        strings = as_strings(rows[head])
        bucket = splits.of_strings(strings, block.block_id)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.rows, self.strings, self.string_of = rows[head][order], strings[order], back[place]
        self.least_string = self.least.take(self.which[head[order]])
        self.hot_buckets, self.hot_bounds = B.occurring(bucket[order])


def _send(splits: Splits):
    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for block in map(B.Block.of, rows):
            own = Suffixes(block, _noted(block), splits)
            for k, b in enumerate(own.buckets.tolist()):
                part = own.cold[own.bounds[k] : own.bounds[k + 1]]
                sent = own.sent.take(part)
                size = sent.n - 1 + WINDOW
                begin = np.cumsum(size) - size
                raw = block.data[np.repeat(sent.first - begin, size) + np.arange(size.sum())]
                shape = sent.n.astype(np.uint8).tobytes() + (sent.at - sent.first).astype(np.uint8).tobytes()
                yield b, block.block_id, raw.tobytes(), shape, own.least.take(part).thin()
            for k, b in enumerate(own.hot_buckets.tolist()):
                i, j = own.hot_bounds[k], own.hot_bounds[k + 1]
                yield b, block.block_id, own.rows[i:j].tobytes(), b"", own.least_string.take(slice(i, j)).thin()

    return run


def _sort(splits: Splits):
    """Rows of ANSWERS: bits of the windows that a lesser rank has too, by surrounding or by string."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for group in B.grouped(rows, "bucket"):
            yield from _sort_strings(group, splits) if group[0]["bucket"] >= splits.n_cold else _sort_suffixes(group)

    return run


def _sort_suffixes(group: list[dict]) -> Iterator[tuple]:
    counts = [len(r["shape"]) // 2 for r in group]
    n = np.concatenate([np.frombuffer(r["shape"][:c], np.uint8) for r, c in zip(group, counts, strict=True)]).astype(np.int64)
    before = np.concatenate([np.frombuffer(r["shape"][c:], np.uint8) for r, c in zip(group, counts, strict=True)]).astype(np.int64)
    ranks = B.Ranks.joined([B.Ranks.thick(r["ranks"], c) for r, c in zip(group, counts, strict=True)])
    raw = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in group])
    size = n - 1 + WINDOW
    begin = np.cumsum(size) - size
    # equal surroundings first: only the least of each goes on
    head, place = B.least_of_runs(ranks, around(raw, begin, n, before))
    which, step = expanded(n[head])
    windows = multikey_quicksort(as_characters(raw, begin[head][which] + step, np.full(len(which), WINDOW), WINDOW))
    later = B.after_least(ranks.take(head[which]), windows)
    bits = np.zeros(len(head), dtype=U64)
    np.bitwise_or.at(bits, which[later], U64(1) << step[later].astype(U64))
    bits = np.where(ranks.after(ranks.take(head[place])), (U64(1) << n.astype(U64)) - U64(1), bits[place])
    at = 0
    for r, c in zip(group, counts, strict=True):
        yield r["block_id"], r["bucket"], bits[at : at + c].tobytes()
        at += c


def _sort_strings(group: list[dict], splits: Splits) -> Iterator[tuple]:
    counts = [len(r["bytes"]) // (WINDOW + 1) for r in group]
    ranks = B.Ranks.joined([B.Ranks.thick(r["ranks"], c) for r, c in zip(group, counts, strict=True)])
    raw = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in group])
    run = multikey_quicksort(as_characters(raw, np.arange(len(ranks.ids)) * (WINDOW + 1), np.full(len(ranks.ids), WINDOW + 1), WINDOW + 1))
    head, place = B.least_of_runs(ranks, run)
    later = ranks.after(ranks.take(head[place]))
    at = 0
    for r, c in zip(group, counts, strict=True):
        yield r["block_id"], r["bucket"], np.packbits(later[at : at + c]).tobytes()
        at += c
    # the first run may go on in the buckets before or after
    first = head[:1]
    rows = raw.reshape(-1, WINDOW + 1)[first]
    if np.isin(as_strings(rows), splits.dealt)[0]:
        yield BOUNDARY, group[0]["bucket"], rows.tobytes() + ranks.take(first).thin()


def compared(answers: DataFrame, splits: Splits) -> Splits:
    """``splits`` with the least rank of each dealt string over all its buckets: at most RANGES rows."""
    least: dict[bytes, tuple[bool, int]] = {}
    for r in answers.filter(F.col("block_id") == BOUNDARY).collect():
        rank = B.Ranks.thick(r["bytes"][WINDOW + 1 :], 1)
        seen = bool(rank.late[0]), int(rank.ids[0])
        name = r["bytes"][: WINDOW + 1]
        least[name] = min(least.get(name, seen), seen)
    names = sorted(least)
    out = Splits(splits.cold, splits.parts, splits.hot, splits.strings)
    out.dealt = as_strings(np.frombuffer(b"".join(names), np.uint8).reshape(-1, WINDOW + 1))
    out.least = B.Ranks(np.array([least[x][0] for x in names], dtype=bool), np.array([least[x][1] for x in names], dtype=np.int64))
    return out


def _bits(sent: Suffixes, answers: list[dict], splits: Splits) -> np.ndarray:
    """By distinct surrounding, the windows that a lesser rank than its least has too."""
    bits = np.zeros(len(sent.least.ids), dtype=U64)
    flags = np.zeros(len(sent.strings), dtype=bool)
    cold = [r for r in answers if r["bucket"] < splits.n_cold]
    for r, i, j in B.bounded(cold, sent.buckets, sent.bounds):
        bits[sent.cold[i:j]] = np.frombuffer(r["bytes"], U64)
    for r, i, j in B.bounded([r for r in answers if r["bucket"] >= splits.n_cold], sent.hot_buckets, sent.hot_bounds):
        flags[i:j] = np.unpackbits(np.frombuffer(r["bytes"], np.uint8), count=j - i)
    if len(splits.dealt):
        at = np.minimum(np.searchsorted(splits.dealt, sent.strings), len(splits.dealt) - 1)
        flags |= (splits.dealt[at] == sent.strings) & sent.least_string.after(splits.least.take(at))
    gone = flags[sent.string_of] | sent.least.take(sent.which).after(sent.least_string.take(sent.string_of))
    np.bitwise_or.at(bits, sent.which[gone], U64(1) << sent.step[gone].astype(U64))
    return bits


def _remove(splits: Splits, with_bytes: bool):
    def run(block: B.Block, answers: list[dict]) -> Iterator[tuple]:
        own = _noted(block)
        sent = Suffixes(block, own, splits)
        bits = _bits(sent, answers, splits)[sent.place]
        bits = np.where(sent.ranks.after(sent.least.take(sent.place)), (U64(1) << own.n.astype(U64)) - U64(1), bits)
        edges = np.zeros(len(block.data) + 1, dtype=np.int64)
        for step in range(REACH):
            gone = own.first[bits >> U64(step) & U64(1) == 1] + step
            np.add.at(edges, gone, 1)
            np.add.at(edges, gone + WINDOW, -1)
        sizes = np.diff(block.offsets)
        gone = np.cumsum(edges)[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        first = block.offsets[:-1][sizes > 0]
        begins[first] = gone[first]
        totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[block.offsets]).tolist() for x in (gone, begins)]
        raw = block.data[~gone].tobytes()
        cut = np.concatenate([[0], np.cumsum(~gone)])[block.offsets].tolist()
        for k, (i, size, n, spans) in enumerate(zip(block.doc_ids(), sizes.tolist(), *totals, strict=True)):
            kept = raw[cut[k] : cut[k + 1]]
            yield i, size, n, spans, sha256(kept).hexdigest(), kept if with_bytes else None

    return run


def suffix_dedup(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_bytes."""
    scratch = Scratch(docs.sparkSession, "suffix")
    packed = scratch.keep(B.pack(docs), "blocks", "uncompressed")
    n = B.buckets_for(packed, DENSITY)
    answers = B.map_rows(B.by_bucket(B.map_rows(packed, _ask_grams(n), B.QUESTIONS), n), B.answer, B.ANSWERS)
    noted = scratch.keep(B.meet(packed, answers, _note(n), NOTED), "noted", "uncompressed")
    scratch.drop("blocks")
    splits = find_splits(noted)
    noted = noted.drop("n_places", "sample")
    sent = B.map_rows(noted, _send(splits), SUFFIXES)
    answers = scratch.keep(B.map_rows(B.by_bucket(sent, splits.n_cold + len(splits.strings) + 1), _sort(splits), "block_id long, bucket long, bytes binary"), "answers")
    splits = compared(answers, splits)
    out = B.meet(noted, answers.filter(F.col("block_id") != BOUNDARY), _remove(splits, with_bytes), RESULT)
    return out if with_bytes else out.drop("kept_bytes")
