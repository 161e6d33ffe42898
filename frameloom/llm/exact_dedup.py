"""Exact deduplication by Grace hashing.

Each task first folds its own copies in a table of distinct contents, so a group that holds a third of all rows
crosses the network once per task and not once per row. What is left is hash-partitioned; each partition streams into
an open-addressing table that compares complete contents, and when the table outgrows its budget the rest is
partitioned again, by the next hash bits, to spill files of the task until every part fits. A record may carry its
row, so that the tables give back the rows that stay and no join is needed to find them.

Defined results: a null text counts as empty; equal texts are equal after each run of white space becomes one space;
a null doc_id sorts after all others; of repeated rows (same doc_id, same text) one is kept, of drop_copies the one
whose values, serialised, come first, so that a task that runs again keeps the same; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import random
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.skew import commonest, dealt_join
from frameloom.llm.storage import Scratch, text_column

#: Bytes of distinct contents that one table may hold: of a map task's pre-aggregation, and of a bucket.
LOCAL_BYTES, BUCKET_BYTES = 32 << 20, 64 << 20
FANOUT_BITS = 4
GROUPS = "sha binary, text string, late boolean, keep_id long, group_size long, row binary"
GROUP_NAMES = [c.split()[0] for c in GROUPS.split(", ")]
_HEAD = struct.Struct("<Q?qqII")

#: A document's rank, compared as a tuple: without a doc_id (which sorts after all others), doc_id or 0, its row.
Rank = tuple[bool, int, bytes]
Record = tuple[int, bytes, Rank, int]  # hash, content, least rank, rows


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, and entries compare whole contents."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, dtype=np.int64)
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, record: Record) -> None:
        h, content, rank, rows = record
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == h and entry[1] == content:
                entry[2] = min(entry[2], rank)
                entry[3] += rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, rank, rows])
        self.bytes += len(content) + len(rank[2]) + 300
        if len(self.entries) * 2 > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 4, -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for k, entry in enumerate(self.entries):
            at = entry[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace_groups(records: Iterable[Record], budget: int, folder: str, level: int = 0) -> Iterator[list]:
    """Groups of equal contents, in no order: [hash, content, least rank, rows]."""
    table, records = ContentTable(), iter(records)
    bits = FANOUT_BITS * level
    for record in records:
        table.add(record)
        if table.bytes > budget and len(table.entries) > 1 and bits + FANOUT_BITS <= 64:
            break
    else:
        yield from table.entries
        return
    names = [os.path.join(folder, f"{level}-{k}-{os.urandom(6).hex()}") for k in range(1 << FANOUT_BITS)]
    files = [open(n, "wb") for n in names]  # noqa: SIM115
    try:
        for part in (table.entries, records):
            for h, content, (late, doc_id, row), rows in part:
                out = files[h >> (64 - FANOUT_BITS - bits) & ((1 << FANOUT_BITS) - 1)]
                out.write(_HEAD.pack(h, late, doc_id, rows, len(content), len(row)))
                out.write(content)
                out.write(row)
    finally:
        for f in files:
            f.close()
    del table
    for n in names:
        yield from grace_groups(_spilled(n), budget, folder, level + 1)
        os.unlink(n)


def _spilled(name: str) -> Iterator[Record]:
    with open(name, "rb") as f:
        while head := f.read(_HEAD.size):
            h, late, doc_id, rows, size, wide = _HEAD.unpack(head)
            content = f.read(size)
            yield h, content, (late, doc_id, f.read(wide)), rows


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        shas, texts, late, ids, rows, held = (batch.column(c) for c in GROUP_NAMES)
        for k in range(batch.num_rows):
            rank = late[k].as_py(), ids[k].as_py(), held[k].as_py()
            yield int.from_bytes(shas[k].as_py()[:8], "big"), texts[k].as_buffer().to_pybytes(), rank, rows[k].as_py()


def _batches(groups: Iterable[list], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for group in groups:
        held.append(group)
        size += len(group[1]) + len(group[2][2])
        if size > limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(groups: list[list]) -> pa.RecordBatch:
    contents = [g[1] for g in groups]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([hashlib.sha256(c).digest() for c in contents], pa.binary()),
            pa.array(contents, pa.binary()).cast(pa.string()),
            pa.array([g[2][0] for g in groups]),
            pa.array([g[2][1] for g in groups], pa.int64()),
            pa.array([g[3] for g in groups], pa.int64()),
            pa.array([g[2][2] for g in groups], pa.binary()),
        ],
        GROUP_NAMES,
    )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = ContentTable()
    for record in _records(map(_serialised, batches)):
        table.add(record)
        if table.bytes > LOCAL_BYTES:
            yield from _batches(table.entries)
            table = ContentTable()
    yield from _batches(table.entries)


def _spill_folder() -> str | None:
    """One of the task's own Spark spill disks, where Spark names them, as Spark's own Python spilling uses them."""
    disks = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return random.choice(disks) if disks else None


def _serialised(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of GROUPS; further columns than the first five are the row, and become one column."""
    own = [c.to_pylist() for c in batch.columns[5:]]
    rows = [pickle.dumps(row, 5) for row in zip(*own, strict=True)] if own else [b""] * batch.num_rows
    return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows, pa.binary())], GROUP_NAMES)


def _grace(kinds: pa.Schema | None):
    """The groups, or with ``kinds`` the rows they carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(dir=_spill_folder()) as folder:
            for batch in _batches(grace_groups(_records(batches), BUCKET_BYTES, folder)):
                if kinds is None:
                    yield batch.select(["sha", "late", "keep_id", "group_size"])
                else:
                    columns = zip(*map(pickle.loads, batch.column("row").to_pylist()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return run


def _folded(rows: DataFrame) -> DataFrame:
    """``rows`` (the first five of GROUPS, and perhaps columns of a row), each group folded where it is before its
    content crosses the network."""
    return rows.mapInArrow(_fold, GROUPS).repartition("sha")


def _ranked(text: Column, doc_id: Column) -> list[Column]:
    """The first five of GROUPS of single rows."""
    doc_id = doc_id.cast("long")
    return [
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text.alias("text"),
        doc_id.isNull().alias("late"),
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    ]


def copy_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct text: sha (SHA-256 of the normalised text), keep_id, group_size."""
    rows = text_column(docs, {"doc_id": "long", "text": "string"}).select(normalised(F.col("text")).alias("text"), "doc_id")
    folded = _folded(rows.select(_ranked(F.col("text"), F.col("doc_id"))))
    groups = folded.mapInArrow(_grace(None), "sha binary, late boolean, keep_id long, group_size long")
    return groups.select("sha", F.when(~F.col("late"), F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows meet their group by its digest, which the commonest digests' rows do over many tasks. Repeated rows are counted
    where they are, so each task has one of them, the first of which is the one kept.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    groups = scratch.keep(copy_groups(docs), "groups")
    hot = scratch.keep(commonest(groups, ["sha"], "group_size"), "hot")
    rows = text_column(docs, {"doc_id": "long", "text": "string"})
    rows = rows.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"), F.spark_partition_id().alias("task"))
    rows = rows.groupBy("doc_id", "sha", "task").agg(F.count("*").alias("times"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("task")))
    out = dealt_join(rows, groups, hot, ["sha"], F.xxhash64("doc_id", "task"), "inner")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1) & (F.col("time") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns; each text crosses the network once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = _ranked(normalised(F.col("text")), F.col("doc_id"))
    rows = docs.select(*[k.alias(f"__key{n}") for n, k in enumerate(keys)], *[F.col(f"`{c}`") for c in docs.columns])
    return _folded(rows).mapInArrow(_grace(to_arrow_schema(docs.schema)), docs.schema)
