"""Best-two-fit packing of tokenised documents into sequences.

Documents are tokenised, ended with a separator and, if longer than a sequence, cut into pieces. Only the counts of
pieces by length are gathered: a table of as many rows as a sequence has tokens, at any size of the corpus. On the
counts, a bin is filled greedily with the longest length that fits; then its smallest document is replaced by the two
unpacked lengths that fill the widened gap best, if they fill it better. The bin's pattern is repeated while its
lengths last, so the patterns are few. Pieces find their place by their rank among those of their length.

Tokenising goes word by word: texts of plain Latin characters are split as the tokenizer would split them and each
distinct word is encoded once; any other text goes through the tokenizer whole.

Defined results: a null text is empty, and an empty text is one piece, the separator; rows with the same doc_id are
packed each by itself; which of equal lengths gets which place is by doc_id and piece; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.bytesight import rows_within
from frameloom.llm.storage import Scratch, text_column

CAPACITY, SEPARATOR = 2048, 0
#: Parts into which the pieces of one length are ranked; a hot length is spread over so many tasks.
PARTS = 64
CACHE_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
# How the tokenizer's vocabulary splits lower-cased text, for characters of plain Latin texts.
_PLAIN = re.compile("[\t-\r -~¡«»¿-ÖØ-öø-ÿ]*")
_SPLIT = re.compile("[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9À-ÖØ-öø-ÿ]+")
_END = "\0"  # stands for the separator among the words


class _Index(dict):
    """Words numbered as they are first met; ``fresh`` lists those without ids."""

    def __init__(self, words=()):
        super().__init__(words)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Token ids of texts, equal to the tokenizer's own.

    Words met before are kept with their ids, up to CACHE_WORDS; beyond, those least recently used go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.index = _Index({_END: 0})
        self.ids, self.sizes = np.array([SEPARATOR], dtype="<u4"), np.array([1])
        self.used, self.turn = np.zeros(1, dtype=np.int64), 0

    def _learn(self) -> None:
        words, self.index.fresh = self.index.fresh, []
        if not words:
            return
        ids = np.array(self.whole.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or last[-1] + 1 != len(ids):
            raise ValueError("the tokenizer does not end each word with one </w> token")
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, np.diff(last, prepend=-1)])
        self.used = np.concatenate([self.used, np.full(len(words), self.turn)])

    def _forget(self) -> None:
        if len(self.sizes) <= CACHE_WORDS:
            return
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE_WORDS // 2])
        keep = keep if keep[0] == 0 else np.concatenate([[0], keep])  # the separator stays number 0
        words = list(self.index)
        self.index = _Index((words[k], n) for n, k in enumerate(keep.tolist()))
        self.ids = self._gather(keep)
        self.sizes, self.used = self.sizes[keep], self.used[keep]

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        begin, size = np.cumsum(self.sizes) - self.sizes, self.sizes[codes]
        at = np.repeat(begin[codes] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return self.ids[at]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, and the separator."""
        self._forget()
        self.turn += 1
        plain = [k for k, t in enumerate(texts) if _PLAIN.fullmatch(t) and "<|" not in t]
        words: list[str] = []
        counts = []
        for k in plain:
            before = len(words)
            words += _SPLIT.findall(texts[k].lower())
            words.append(_END)
            counts.append(len(words) - before)
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._learn()
        self.used[codes] = self.turn
        bounds = np.concatenate([[0], np.cumsum(self.sizes[codes])])[np.concatenate([[0], np.cumsum(counts, dtype=int)])]
        ids = self._gather(codes)
        out: list = [None] * len(texts)
        for k, i, j in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = ids[i:j]
        for k, text in enumerate(texts):
            if out[k] is None:
                out[k] = np.array([*self.whole.encode(text, add_special_tokens=False).ids, SEPARATOR], dtype="<u4")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_within(batch, "text", 1 << 20):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                found = []
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoder(path).encode(texts), strict=True):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        raw = part.tobytes()
                        found.append((doc_id, k, start, len(part), zlib.crc32(raw), raw if with_ids else None))
                columns = list(zip(*found, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds, strict=False)], names[:keep])

    return run


def best_two(lengths: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum within ``room``; ``lengths`` ascend, counts are positive."""
    second = np.searchsorted(lengths, room - lengths, side="right") - 1
    own = np.arange(len(lengths))
    second = np.where((second == own) & (counts < 2), second - 1, np.minimum(second, own))
    second = np.where((second == own) & (counts < 2), second - 1, second)
    total = np.where(second >= 0, lengths + lengths[np.maximum(second, 0)], -1)
    k = int(np.argmax(total))
    return (int(lengths[k]), int(lengths[second[k]])) if total[k] >= 0 else None


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths from the longest) of each pattern; together they hold every piece once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    patterns = []
    while left.any():
        free, gap, held = left.copy(), capacity, []
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            held.append(int(fits[-1]))
            free[held[-1]] -= 1
            gap -= held[-1]
        if gap and len(held) > 1:
            smallest = held[-1]
            lengths = np.flatnonzero(free)
            two = best_two(lengths, free[lengths], smallest + gap) if len(lengths) else None
            if two and sum(two) > smallest:
                held[-1:] = two
        need = np.bincount(held, minlength=capacity + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left -= need * times
        patterns.append((times, sorted(held, reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """By length and rank: where a run of ranks begins, its first sequence, pieces per sequence, first offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for times, held in patterns:
        offset = 0
        for length in dict.fromkeys(held):
            each = held.count(length)
            begin = ranks.get(length, 0)
            rows.append((length << 44 | begin, sequence, each, offset))
            ranks[length] = begin + each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("key", "sequence", "each", "offset"), table.T, strict=True))


def _place(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            key = length << 44 | rank
            row = np.searchsorted(table["key"], key, side="right") - 1
            nth = key - table["key"][row]
            each = table["each"][row]
            names = [c for c in batch.schema.names if c != "rank"]
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array(table["sequence"][row] + nth // each), pa.array(table["offset"][row] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return run


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids
    (little-endian unsigned 32-bit)."""
    scratch = Scratch(docs.sparkSession, "packing")
    extra = ", ids binary" if with_ids else ""
    texts = text_column(docs, {"doc_id": "long", "text": "string"})
    pieces = scratch.keep(texts.mapInArrow(_pieces(tokenizer_path, capacity, with_ids), PIECES + extra), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(best_two_fit(counts, capacity))

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS))
    ranked = pieces.withColumn("part", part)
    sizes = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most PARTS rows for each of the ``capacity`` lengths
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = ranked.withColumn("nth", nth).join(base, ["length", "part"])
    names = [c.split()[0] for c in (PIECES + extra).split(", ")]
    ranked = ranked.select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(table), PIECES + extra + ", sequence_id long, offset long")
