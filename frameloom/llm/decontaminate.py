"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a document's own MinHash says little about an item in it. Items are
partitioned by the size of their shingle set into classes of a factor two; for each class a document is cut into
overlapping stretches of three half-overlapping units that hold any such item whole, where its share of the stretch,
and with it the chance that a MinHash coordinate agrees, is at least a quarter or so. One agreeing coordinate of
COORDINATES makes a candidate. Each is verified: the share of the item's distinct word shingles that the whole
document has must reach the threshold.

The items are read in chunks of bounded size, and each chunk is sent to all tasks; more items mean more passes, each
written as a table before the next, so the driver holds one chunk at a time.

Defined results: a null or empty item, or one without words, is in no document; a null doc_id or item_id is carried
as null; an item shorter than five words is one shingle, found only in documents that are that sequence; repeated
rows give repeated pairs; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.bytesight import LOWER, U64, Words, mix, rows_within, shingle_sets, text_buffers, window_hashes, window_inside
from frameloom.llm.minhash_dedup import _ring
from frameloom.llm.storage import Scratch, text_column

THRESHOLD, SHINGLE = 0.8, 5
COORDINATES = 64
#: Bytes of item texts that are sent to tasks at once.
CHUNK_BYTES = 16 << 20
PAIRS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


class Items:
    """Shingle sets of a chunk of items, and their MinHash coordinates by size class."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, first = shingle_sets(Words(*text_buffers(pa.array(texts, pa.string()))), SHINGLE)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        self.ids = [ids[k] for k in full]
        self.sets = [hashes[first[k] : first[k + 1]] for k in full]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        level = np.log2(np.maximum(sizes[full], 1)).astype(int)
        for c in np.unique(level).tolist():
            own = np.flatnonzero(level == c)
            keys = np.concatenate([[k << 32 | int(_ring(scatter(self.sets[i]) + np.uint32(k)).min()) for k in range(COORDINATES)] for i in own]).astype(U64)
            order = np.argsort(keys, kind="stable")
            self.classes[c] = keys[order], np.repeat(own, COORDINATES)[order]


def scatter(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ U64(0x71C9E3A5B2D84F67)) >> U64(32)).astype(np.uint32)


def candidates(items: Items, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pairs (document, item) that agree in a coordinate; ``hashes`` are shingles in the documents' order."""
    found = [np.zeros((0, 2), np.int64)]
    counts = np.diff(first)
    layouts = {}
    for c in items.classes:
        units = (counts + (1 << c) - 1) >> c
        doc = np.repeat(np.arange(len(counts)), units)
        begin = np.repeat(first[:-1], units) + ((np.arange(len(doc)) - np.repeat(np.cumsum(units) - units, units)) << c)
        layouts[c] = doc, begin
    scattered = scatter(hashes)
    for k in range(COORDINATES):
        ring = _ring(scattered + np.uint32(k))
        for c, (keys, owner) in items.classes.items():
            doc, begin = layouts[c]
            unit = np.minimum.reduceat(ring, begin)
            least = unit.copy()
            for step in (1, 2):
                same = doc[step:] == doc[:-step]
                least[:-step] = np.where(same, np.minimum(least[:-step], unit[step:]), least[:-step])
            low = np.searchsorted(keys, key := least.astype(U64) | U64(k << 32))
            for at in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == key).tolist():
                high = np.searchsorted(keys, key[at], side="right")
                found.append(np.stack([np.full(high - low[at], doc[at]), owner[low[at] : high]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def found_pairs(items: Items, rows: pa.RecordBatch, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, shingles in common) of the rows and the items they hold."""
    words = Words(*text_buffers(rows.column("text")))
    distinct, bounds = shingle_sets(words, SHINGLE)
    h = words.hashes(data=LOWER[words.data])
    inside = window_inside(words.first, len(h), SHINGLE)
    ordered, doc = window_hashes(h, SHINGLE)[inside], words.doc()[: len(inside)][inside]
    first = np.searchsorted(doc, np.arange(len(bounds)))
    short = np.diff(first) == 0
    if short.any():  # a text of fewer words has its one shingle
        ordered = np.concatenate([ordered, distinct[bounds[:-1][short & (np.diff(bounds) > 0)]]])
        doc = np.concatenate([doc, np.flatnonzero(short & (np.diff(bounds) > 0))])
        order = np.argsort(doc, kind="stable")
        ordered, doc = ordered[order], doc[order]
        first = np.searchsorted(doc, np.arange(len(bounds)))
    if not len(ordered) or not items.sets:
        return
    for d, i in candidates(items, ordered, first).tolist():
        item = items.sets[i]
        n = int(np.isin(item, distinct[bounds[d] : bounds[d + 1]], assume_unique=True).sum())
        if n >= threshold * len(item):
            yield d, i, n


def _search(items: Items, threshold: float):
    kinds = [pa.int64()] * 4 + [pa.float64()]
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_within(batch, "text", 1 << 20):
                ids = rows.column("doc_id").to_pylist()
                out = [(ids[d], items.ids[i], n, len(items.sets[i]), n / len(items.sets[i])) for d, i, n in found_pairs(items, rows, threshold)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _without(items: Items, threshold: float):
    """The rows that hold no item, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_within(batch, "text", 1 << 20):
                clean = np.ones(rows.num_rows, dtype=bool)
                clean[[d for d, _, _ in found_pairs(items, rows, threshold)]] = False
                yield rows.filter(pa.array(clean))

    return run


def item_chunks(benchmark: DataFrame) -> Iterator[tuple[bool, Items]]:
    """The items in chunks of about CHUNK_BYTES, and whether there are several chunks."""
    items = text_column(benchmark, {"item_id": "long", "text": "string"}).fillna("", ["text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = size // CHUNK_BYTES + 1
    for c in range(chunks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect()
        yield chunks > 1, Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_shared, n_item, containment."""
    scratch = Scratch(docs.sparkSession, "leaks")
    texts = text_column(docs, {"doc_id": "long", "text": "string"})
    found = []
    for several, items in item_chunks(benchmark):
        part = texts.mapInArrow(_search(items, threshold), PAIRS)
        found.append(scratch.keep(part, f"part{len(found)}") if several else part)
    return reduce(DataFrame.unionAll, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; a row is judged by its own text, whatever its id,
    where it is, so nothing is shuffled."""
    scratch = Scratch(docs.sparkSession, "leakless")
    schema = docs.schema
    for k, (several, items) in enumerate(item_chunks(benchmark)):
        docs = docs.mapInArrow(_without(items, threshold), schema)
        docs = scratch.keep(docs, f"part{k}") if several else docs
    return docs
