"""Texts in blocks, and questions that blocks ask each other about their contents.

Documents are packed once into blocks of a few megabytes, written as a shared table. A phase asks, for each of its
keys (hashes of places in the texts), whether another document has that key too. Blocks send each key once, so what
a hot key costs follows the number of blocks and not of its occurrences. Keys travel as packed arrays by bucket,
and the answers come back as bits in the order sent. The number of buckets follows the number of keys, and a block
sends a row for each bucket that its keys occur in, so it never sends more rows than keys.

A document's rank is the pair (late, id): a null doc_id is late, and comes after every id there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.bytesight import U64, rows_within, text_buffers
from frameloom.llm.storage import text_column

BLOCK_BYTES = 2 << 20
#: Keys per bucket, about.
BUCKET_KEYS = 1 << 18
#: Buckets or blocks that a task gets at least, about, as long as TASKS are enough; beyond, the session's number of
#: shuffle partitions decides.
EACH, TASKS = 4, 1 << 12
BLOCKS = "block_id long, ids binary, late binary, sizes binary, text binary, note binary"
QUESTIONS = "bucket long, block_id long, keys binary, more binary"
ANSWERS = "block_id long, bucket long, keys binary"


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(k) for k in range(len(names))]
        for k in range(batch.num_rows):
            yield {n: c[k].as_py() for n, c in zip(names, columns, strict=True)}


def as_batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size > limit or len(held) >= 4096:
            yield _as_batch(held, schema)
            held, size = [], 0
    if held:
        yield _as_batch(held, schema)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (c.split() for c in ddl.split(","))])


def map_rows(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[tuple]], ddl: str) -> DataFrame:
    """``f`` over the rows of each partition as they stream by; rows hold large values, so batches are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return as_batches(f(rows_of(batches)), arrow_schema(ddl))

    return df.mapInArrow(run, ddl)


@dataclass
class Ranks:
    """Ranks of documents; ``ids`` is 0 where ``late``."""

    late: np.ndarray
    ids: np.ndarray

    def take(self, which: np.ndarray) -> Ranks:
        return Ranks(self.late[which], self.ids[which])

    def after(self, other: Ranks) -> np.ndarray:
        return (self.late & ~other.late) | ((self.late == other.late) & (self.ids > other.ids))

    def thin(self) -> bytes:
        """Ids as offsets from the least, in the narrowest type that holds them: width, base, offsets, then late bits."""
        base = int(self.ids.min())
        span = int(self.ids.max()) - base
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if span <= np.iinfo(k).max)
        late = np.packbits(self.late).tobytes() if self.late.any() else b""
        return bytes([np.dtype(kind).itemsize]) + np.int64(base).tobytes() + (self.ids - base).astype(kind).tobytes() + late

    @classmethod
    def thick(cls, raw: bytes, n: int) -> Ranks:
        cut = 9 + raw[0] * n
        ids = np.frombuffer(raw[9:cut], f"u{raw[0]}").astype(np.int64) + np.frombuffer(raw[1:9], np.int64)[0]
        late = np.unpackbits(np.frombuffer(raw[cut:], np.uint8), count=n).astype(bool) if len(raw) > cut else np.zeros(n, bool)
        return cls(late, ids)

    @classmethod
    def joined(cls, parts: list[Ranks]) -> Ranks:
        return cls(np.concatenate([p.late for p in parts]), np.concatenate([p.ids for p in parts]))


@dataclass
class Block:
    block_id: int
    ranks: Ranks
    offsets: np.ndarray
    data: np.ndarray
    note: bytes

    @classmethod
    def of(cls, row: dict) -> Block:
        sizes = np.frombuffer(row["sizes"], np.int64)
        data = np.frombuffer(zstandard.decompress(row["text"], max_output_size=int(sizes.sum()) or 1), np.uint8)
        ranks = Ranks(np.frombuffer(row["late"], bool), np.frombuffer(row["ids"], np.int64))
        return cls(row["block_id"], ranks, np.concatenate([[0], np.cumsum(sizes)]), data, row["note"])

    def noting(self, note: bytes) -> tuple:
        """A row of BLOCKS: this block with another note."""
        text = zstandard.ZstdCompressor(level=1).compress(self.data.tobytes())
        return self.block_id, self.ranks.ids.tobytes(), self.ranks.late.tobytes(), np.diff(self.offsets).tobytes(), text, note

    def doc_ids(self) -> list[int | None]:
        return [None if late else i for late, i in zip(self.ranks.late.tolist(), self.ranks.ids.tolist(), strict=True)]


def pack(docs: DataFrame) -> DataFrame:
    """Blocks of the texts of ``docs`` (doc_id, text); a null text is empty."""
    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in rows_within(batch, "text", BLOCK_BYTES):
                data, offsets = text_buffers(rows.column("text"))
                ids = rows.column("doc_id")
                ranks = Ranks(ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False))
                yield _as_batch([Block((part << 32) + n, ranks, offsets, data, b"").noting(b"")], schema)
                n += 1

    return text_column(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, BLOCKS)


def buckets_for(blocks: DataFrame, keys_per_byte: float) -> int:
    """So many buckets that each gets about BUCKET_KEYS keys; compressed text is about a third of its bytes."""
    packed = blocks.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return int(packed * 3 * keys_per_byte / BUCKET_KEYS) + 1


# --- keys that other documents may share --------------------------------------------------------------------------


@dataclass
class Sent:
    """A block's keys by bucket: those of ``buckets[k]`` are ``keys[bounds[k]:bounds[k + 1]]`` (uint32, ascending),
    ``place`` leads from the original order to them."""

    keys: np.ndarray
    place: np.ndarray
    several: np.ndarray
    buckets: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, docs: np.ndarray, n_buckets: int) -> Sent:
        bucket = (hashes >> U64(32)) * U64(n_buckets) >> U64(32)
        keys, place = np.unique(bucket << U64(32) | hashes & U64(0xFFFFFFFF), return_inverse=True)
        low, high = np.full(len(keys), 1 << 62), np.full(len(keys), -1)
        np.minimum.at(low, place, docs)
        np.maximum.at(high, place, docs)
        buckets, bounds = occurring(keys >> U64(32))
        return cls((keys & U64(0xFFFFFFFF)).astype(np.uint32), place, low != high, buckets, bounds)


def occurring(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ascending array, and where each begins (one more entry: the end)."""
    new = np.ones(len(bucket), dtype=bool)
    new[1:] = bucket[1:] != bucket[:-1]
    begin = np.flatnonzero(new)
    return bucket[begin].astype(np.int64), np.append(begin, len(bucket))


def ask(block: Block, hashes: np.ndarray, docs: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Rows of QUESTIONS: is each key shared with another document?"""
    sent = Sent.of(hashes, docs, n_buckets)
    for k, b in enumerate(sent.buckets.tolist()):
        i, j = sent.bounds[k], sent.bounds[k + 1]
        yield b, block.block_id, sent.keys[i:j].tobytes(), np.packbits(sent.several[i:j]).tobytes()


def answer(rows: Iterator[dict]) -> Iterator[tuple]:
    """Rows of ANSWERS; ``rows`` of QUESTIONS come sorted by bucket."""
    for group in grouped(rows, "bucket"):
        keys = [np.frombuffer(r["keys"], np.uint32) for r in group]
        ends = np.cumsum([len(k) for k in keys])
        several = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(k)) for r, k in zip(group, keys, strict=True)])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        shared = several.astype(bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        begin = 0
        for r, end in zip(group, ends, strict=True):
            yield r["block_id"], r["bucket"], np.packbits(shared[begin:end]).tobytes()
            begin = end


def least_of_runs(ranks: Ranks, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, the element of least rank; and for each element, the position of its run among those."""
    order = np.lexsort((ranks.ids, ranks.late, run))
    new = np.ones(len(order), dtype=bool)
    new[1:] = run[order][1:] != run[order][:-1]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def after_least(ranks: Ranks, run: np.ndarray) -> np.ndarray:
    """For each element: whether another of its run has a lesser rank."""
    head, place = least_of_runs(ranks, run)
    return ranks.after(ranks.take(head[place]))


def grouped(rows: Iterable[dict], key: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in rows:
        if held and held[0][key] != row[key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def heard(block: Block, answers: list[dict], hashes: np.ndarray, docs: np.ndarray, n_buckets: int) -> np.ndarray:
    """For each hash whether it is shared."""
    sent = Sent.of(hashes, docs, n_buckets)
    shared = np.zeros(len(sent.keys), bool)
    for r, i, j in bounded(answers, sent.buckets, sent.bounds):
        shared[i:j] = np.unpackbits(np.frombuffer(r["keys"], np.uint8), count=j - i)
    return shared[sent.place]


def bounded(answers: list[dict], buckets: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[dict, int, int]]:
    """Each answer, and where what it answers begins and ends."""
    at = np.searchsorted(buckets, np.array([r["bucket"] for r in answers], dtype=np.int64))
    for r, k in zip(answers, at.tolist(), strict=True):
        yield r, bounds[k], bounds[k + 1]


def tasks_for(spark: SparkSession, n: int) -> int:
    """Shuffle partitions for ``n`` buckets or blocks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n // EACH, TASKS))


def by_bucket(questions: DataFrame, n_buckets: int) -> DataFrame:
    tasks = tasks_for(questions.sparkSession, n_buckets)
    return questions.repartition(tasks, "bucket").sortWithinPartitions("bucket", "block_id")


def meet(blocks: DataFrame, answers: DataFrame, f: Callable[[Block, list[dict]], Iterator[tuple]], ddl: str) -> DataFrame:
    """``f`` of each block and the answers to it, wherever they meet."""
    names = [*blocks.columns, *(c for c in answers.columns if c not in blocks.columns)]

    def wide(df: DataFrame, tag: int) -> DataFrame:
        kinds = dict(blocks.dtypes) | dict(answers.dtypes)
        return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names], F.lit(tag).alias("tag"))

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for group in grouped(rows, "block_id"):
            yield from f(Block.of(group[0]), group[1:])

    tasks = tasks_for(blocks.sparkSession, blocks.count())
    both = wide(blocks, 0).unionByName(wide(answers, 1)).repartition(tasks, "block_id").sortWithinPartitions("block_id", "tag")
    return map_rows(both, run, ddl)
