"""Substring deduplication on words by difference-cover anchors.

A repeated passage of WINDOW words is found without hashing each of its places against all others: hashes are taken
only of ANCHOR-word windows that start at cover positions, those whose place in the document modulo PERIOD is in
COVER. The differences of COVER's elements are all residues, so two copies of a passage, wherever they start, have an
anchor at the same distance from their starts. Anchors that several documents share mark candidates; each candidate
is then extended to the whole window, and windows are compared by 96 bits of independent hashes. Texts that repeat
whole take the same way; a block sends each distinct window once, so a copied text costs a window per block.

Defined results: a null text has no words; a null doc_id sorts after all others; rows with the same doc_id are not
smaller than each other, so neither removes the other's words; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from frameloom.llm import blocks as B
from frameloom.llm.bytesight import SEEDS, SPACE, U64, Words, window_hashes, window_inside
from frameloom.llm.storage import Scratch

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Keys per byte of text at most, about: anchors of words of some six bytes.
DENSITY = len(COVER) / PERIOD / 6
WINDOWS = "bucket long, block_id long, keys binary, more binary, ranks binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word places of the anchors, and their hashes."""
    h = words.hashes()
    inside = window_inside(words.first, len(h), ANCHOR)
    residue = (np.arange(len(inside)) - np.repeat(words.first[:-1], words.counts())[: len(inside)]) % PERIOD
    at = np.flatnonzero(inside & np.isin(residue, COVER))
    return at, window_hashes(h, ANCHOR)[at]


def candidates(words: Words, shared_at: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    n = int(words.first[-1])
    marks = np.zeros(n + PERIOD + 1, dtype=np.int64)
    marks[shared_at + 1] = 1
    seen = np.cumsum(marks)
    inside = window_inside(words.first, n, WINDOW)
    near = seen[PERIOD : PERIOD + len(inside)] > seen[: len(inside)]
    return np.flatnonzero(inside & near)


class Windows:
    """A block's candidate windows as sent: each distinct one once, with the least rank that has it here."""

    def __init__(self, block: B.Block, words: Words, at: np.ndarray, n_buckets: int):
        self.ranks = block.ranks.take(words.doc()[at])
        wide = window_hashes(words.hashes(), WINDOW)[at]
        narrow = window_hashes(words.hashes(SEEDS[1]), WINDOW, SEEDS[1])[at] & U64(0xFFFFFFFF)
        order = np.lexsort((self.ranks.ids, self.ranks.late, narrow, wide))  # buckets ascend with wide
        new = np.ones(len(order), dtype=bool)
        new[1:] = (wide[order][1:] != wide[order][:-1]) | (narrow[order][1:] != narrow[order][:-1])
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.cumsum(new) - 1
        first = order[new]
        self.wide, self.narrow, self.least = wide[first], narrow[first].astype(np.uint32), self.ranks.take(first)
        self.buckets, self.bounds = B.occurring((self.wide >> U64(32)) * U64(n_buckets) >> U64(32))


def _ask_anchors(n_buckets: int):
    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for block in map(B.Block.of, rows):
            words = Words(block.data, block.offsets)
            at, hashes = anchors(words)
            yield from B.ask(block, hashes, words.doc()[at], n_buckets)

    return run


def _note(n_buckets: int):
    """Each block again, noting its candidate windows."""

    def run(block: B.Block, answers: list[dict]) -> Iterator[tuple]:
        words = Words(block.data, block.offsets)
        at, hashes = anchors(words)
        shared = B.heard(block, answers, hashes, words.doc()[at], n_buckets)
        found = np.zeros(int(words.first[-1]), dtype=bool)
        found[candidates(words, at[shared])] = True
        yield block.noting(np.packbits(found).tobytes())

    return run


def _noted(block: B.Block, words: Words) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(block.note, np.uint8), count=int(words.first[-1])))


def _ask_windows(n_buckets: int):
    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for block in map(B.Block.of, rows):
            words = Words(block.data, block.offsets)
            own = Windows(block, words, _noted(block, words), n_buckets)
            for k, b in enumerate(own.buckets.tolist()):
                i, j = own.bounds[k], own.bounds[k + 1]
                yield b, block.block_id, own.wide[i:j].tobytes(), own.narrow[i:j].tobytes(), own.least.take(slice(i, j)).thin()

    return run


def _answer_windows(rows: Iterator[dict]) -> Iterator[tuple]:
    for group in B.grouped(rows, "bucket"):
        wide = np.concatenate([np.frombuffer(r["keys"], U64) for r in group])
        narrow = np.concatenate([np.frombuffer(r["more"], np.uint32) for r in group])
        order = np.lexsort((narrow, wide))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (wide[order][1:] != wide[order][:-1]) | (narrow[order][1:] != narrow[order][:-1])
        run = np.empty(len(order), dtype=np.int64)
        run[order] = np.cumsum(new)
        later = B.after_least(B.Ranks.joined([B.Ranks.thick(r["ranks"], len(r["keys"]) // 8) for r in group]), run)
        at = 0
        for r in group:
            n = len(r["keys"]) // 8
            yield r["block_id"], r["bucket"], np.packbits(later[at : at + n]).tobytes()
            at += n


def _remove(n_buckets: int, with_text: bool):
    def run(block: B.Block, answers: list[dict]) -> Iterator[tuple]:
        words = Words(block.data, block.offsets)
        at = _noted(block, words)
        own = Windows(block, words, at, n_buckets)
        flags = np.zeros(len(own.wide), dtype=bool)
        for r, i, j in B.bounded(answers, own.buckets, own.bounds):
            flags[i:j] = np.unpackbits(np.frombuffer(r["keys"], np.uint8), count=j - i)
        gone = at[flags[own.place] | own.ranks.after(own.least.take(own.place))]
        edges = np.zeros(int(words.first[-1]) + 1, dtype=np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + WINDOW, -1)
        yield from _results(block, words, np.cumsum(edges)[:-1] > 0, with_text)

    return run


def _results(block: B.Block, words: Words, removed: np.ndarray, with_text: bool) -> Iterator[tuple]:
    kept = np.flatnonzero(~removed)
    doc = words.doc()[kept]
    edges = np.zeros(len(block.data) + 1, dtype=np.int64)
    edges[words.starts[kept]] += 1
    np.add.at(edges, words.ends[kept], -1)
    mask = np.cumsum(edges)[:-1] > 0
    mask[words.ends[kept[:-1]][doc[1:] == doc[:-1]]] = True  # the delimiter after a kept word that is not the last
    clean = np.where(SPACE[block.data], np.uint8(0x20), block.data)
    sizes = np.concatenate([[0], np.cumsum(mask)])[block.offsets]
    raw = clean[mask].tobytes()
    n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.first])
    for k, (i, n, gone) in enumerate(zip(block.doc_ids(), words.counts().tolist(), n_removed.tolist(), strict=True)):
        text = raw[sizes[k] : sizes[k + 1]]
        yield i, n, gone, sha256(text).hexdigest(), text.decode() if with_text else None


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    scratch = Scratch(docs.sparkSession, "substring")
    packed = scratch.keep(B.pack(docs), "blocks", "uncompressed")
    n = B.buckets_for(packed, DENSITY)
    answers = B.map_rows(B.by_bucket(B.map_rows(packed, _ask_anchors(n), B.QUESTIONS), n), B.answer, B.ANSWERS)
    noted = scratch.keep(B.meet(packed, answers, _note(n), B.BLOCKS), "noted", "uncompressed")
    scratch.drop("blocks")
    asked = B.map_rows(noted, _ask_windows(n), WINDOWS)
    answers = B.map_rows(B.by_bucket(asked, n), _answer_windows, B.ANSWERS)
    out = B.meet(noted, answers, _remove(n, with_text), RESULT)
    return out if with_text else out.drop("kept_text")
