"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse ternary index vector given by its hash; a word's context vector is the sum of the index
vectors of its neighbours over the whole corpus. Words are taken as written and, as a second kind, by their shape
(runs of lower-case letters, capitals, digits and each other sign), which has a context vector of its own. Both live
in hashed cells, so the tables are of fixed size. A document is the mean of its words' vectors; a two-layer network
in numpy, fitted on at most MAX_LABELLED labelled rows (those with the least hash of doc_id and vector, of the
documents with the least hash of doc_id), gives a score, and a temperature fitted on a part held back from the fit
calibrates it.

Defined results: a null or empty text has the zero vector and is scored like any other; without labels of both kinds
every score is the share of label 1, or a half with none; null labels teach nothing; rows with the same doc_id are
scored each by itself; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.blocks import as_batches, arrow_schema, map_rows
from frameloom.llm.bytesight import SEEDS, U64, Words, byte_prefix, rows_within, span_hashes, text_buffers
from frameloom.llm.storage import text_column

WORD_CELLS, SHAPE_CELLS, SIZE = 1 << 15, 1 << 12, 32
CELLS = WORD_CELLS + SHAPE_CELLS
STRIP = 1 << 11
NONZERO, HIDDEN, EPOCHS = 6, 32, 400
MAX_LABELLED = 20_000
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = ord("a")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x30:0x3A] = ord("0")


def index_vectors() -> np.ndarray:
    """(SIZE, CELLS) of -1, 0, 1."""
    rng = np.random.default_rng(8)
    out = np.zeros((CELLS, SIZE), dtype=np.float32)
    place = np.argsort(rng.random((CELLS, SIZE)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], dtype=np.float32), place.shape), 1)
    return np.ascontiguousarray(out.T)


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word cell and shape cell of each word, and each text's first word."""
    words = Words(data, offsets)
    word = (words.hashes() & U64(WORD_CELLS - 1)).astype(np.int64)
    kind = _CLASS[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    shape = span_hashes(byte_prefix(kind[new], SEEDS[1]), place[words.starts], place[words.ends], SEEDS[1])
    return word, WORD_CELLS + (shape & U64(SHAPE_CELLS - 1)).astype(np.int64), words.first


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    total = np.zeros((SIZE, CELLS))
    for batch in batches:
        for rows in rows_within(batch, "text", 1 << 20):
            word, shape, first = cells(*text_buffers(rows.column("text")))
            if not len(word):
                continue
            begins, ends = np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=bool)
            begins[first[:-1][np.diff(first) > 0]] = True
            ends[first[1:][np.diff(first) > 0] - 1] = True
            for d in range(SIZE):
                own = index[d][word] + index[d][shape]
                near = np.zeros(len(word), dtype=np.float32)
                near[1:] += np.where(begins[1:], 0, own[:-1])
                near[:-1] += np.where(ends[:-1], 0, own[1:])
                total[d] += np.bincount(word, near, CELLS)
                total[d] += np.bincount(shape, near, CELLS)
    strips = np.ascontiguousarray(total.T).reshape(-1, STRIP * SIZE)
    yield from as_batches(((k, s.tobytes()) for k, s in enumerate(strips)), arrow_schema("strip int, sums binary"))


def _unit(rows: Iterator[dict]) -> Iterator[tuple]:
    """The unit vectors of each strip, from the sums of all tasks."""
    for strip, parts in groupby(rows, lambda r: r["strip"]):
        total = np.zeros(STRIP * SIZE)
        for r in parts:
            total += np.frombuffer(r["sums"])
        total = total.reshape(STRIP, SIZE)
        yield strip, (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32).tobytes()


def context_vectors(docs: DataFrame) -> np.ndarray:
    """(CELLS, SIZE) of unit vectors, from the texts of all rows.

    They reach the driver as float32 in Arrow batches, which its JVM passes on: rows would be taken apart and pickled there.
    """
    strips = text_column(docs, {"text": "string"}).mapInArrow(_contexts, "strip int, sums binary")
    found = map_rows(strips.repartition("strip").sortWithinPartitions("strip"), _unit, "strip int, vectors binary").toArrow()
    out = np.zeros((CELLS // STRIP, STRIP * SIZE), dtype=np.float32)
    for k, v in zip(found["strip"], found["vectors"], strict=True):  # CELLS vectors in all
        out[k.as_py()] = np.frombuffer(v.as_buffer(), np.float32)
    return out.reshape(CELLS, SIZE)


def pooled(contexts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2 * SIZE + 1): mean word vector, mean shape vector, logarithm of the number of words."""
    word, shape, first = cells(data, offsets)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * SIZE + 1), dtype=np.float32)
    full = np.flatnonzero(n)
    if len(full):
        for k, c in enumerate((word, shape)):
            out[full, k * SIZE : (k + 1) * SIZE] = np.add.reduceat(contexts[c], first[full], axis=0) / n[full, None]
    out[:, -1] = np.log1p(n) / 10
    return out


class Network:
    """Two layers, fitted by Adam; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.flat = len(np.unique(y)) < 2
        self.temperature = 1.0
        if self.flat:
            return
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        back = np.arange(len(y)) % 5 == 4
        if len(np.unique(y[back])) < 2 or len(np.unique(y[~back])) < 2:
            back = np.zeros(len(y), dtype=bool)
        fitted = x[~back]
        fitted -= self.mean
        fitted /= self.scale
        self._fit(fitted, y[~back])
        if back.any():
            z = self.logit(x[back])
            grid = np.geomspace(0.25, 8, 60)
            self.temperature = float(grid[np.argmin([np.logaddexp(0, np.where(y[back] == 1, -z, z) / t).mean() for t in grid])])

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(0)
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for part in np.array_split(order, max(1, len(y) // 2048)):
                step += 1
                hidden = np.tanh(x[part] @ w[0] + w[1])
                miss = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(miss, w[2]) * (1 - hidden**2)
                grads = [x[part].T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ miss + 1e-4 * w[2], miss.sum(keepdims=True)]
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x.astype(np.float64) - self.mean) / self.scale
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


class Quality:
    def __init__(self, contexts: np.ndarray, network: Network):
        self.contexts, self.network = contexts, network


def learn(docs: DataFrame, labels: DataFrame) -> Quality:
    """``labels`` (doc_id, quality) may name rows of ``docs``; contexts come from all of ``docs``, labelled or not."""
    contexts = context_vectors(docs)
    known = text_column(labels, {"doc_id": "long", "quality": "int"}).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = text_column(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(known), "doc_id")  # MAX_LABELLED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_within(batch, "text", 1 << 20):
                x = pooled(contexts, *text_buffers(part.column("text")))
                columns = [part.column("doc_id"), part.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "x"])

    vectors = rows.mapInArrow(run, "doc_id long, quality int, x binary")
    # a doc_id that many rows share has all its rows join, so the rows are bounded too
    found = vectors.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(MAX_LABELLED).toArrow()
    found = found.sort_by([(c, "ascending") for c in ("doc_id", "quality", "x")])
    x = text_buffers(found["x"])[0].view(np.float32).reshape(len(found), 2 * SIZE + 1)
    return Quality(contexts, Network(x, found["quality"].to_numpy().astype(np.float64)))


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_within(batch, "text", 1 << 20):
                s = model.network.score(pooled(model.contexts, *text_buffers(rows.column("text"))))
                columns = [rows.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return text_column(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_rejected(docs: DataFrame, model: Quality) -> DataFrame:
    """The rows of ``docs`` with predicted 1, with all their columns; a row is judged by its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_within(batch, "text", 1 << 20):
                s = model.network.score(pooled(model.contexts, *text_buffers(rows.column("text"))))
                yield rows.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
