"""Language identification as a mixture of languages per document.

Byte trigrams of the labelled documents give each language's trigram distribution, counted over all of them in hashed
cells and summed by aggregation. A document is its distinct cells and how often each occurs, so the work and memory
that a long text takes are bounded by the cells. Expectation-maximisation over all languages (STEPS steps from even
proportions) ranks them. The candidate sets are the first 1, 2, ... languages of that rank; for each the proportions are
fitted over the set alone, until none moves by more than TOLERANCE in a step, and the set with the best likelihood less
a penalty per language is chosen. Larger sets are left untried once the likelihood over all languages, which bounds that
of any set, could not make up for their penalty. The prediction is the chosen set's most likely language, the score its
proportion.

Defined results: a text that is null or has no letter is ``und`` with score 0; a null or missing lang teaches nothing;
with no language learned every text is ``und``; equal proportions go to the first language by name; rows with the same
doc_id are scored each by itself; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.bytesight import LOWER, rows_within, text_buffers
from frameloom.llm.blocks import grouped, map_rows
from frameloom.llm.storage import text_column

CELLS = 1 << 15
#: Cells of a language's counts that travel in one row.
STRIP = 1 << 12
STEPS = 8
TOLERANCE = 1e-4
#: Cost of each language in the set, times the logarithm of the number of trigrams.
PENALTY = 4.0
SMOOTHING = 0.5
#: Bytes of text taken apart into trigrams at once.
SPAN = 1 << 20
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double, langs string"
#: Letters and bytes of longer UTF-8 characters stay, in lower case; all else is a blank.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x80:] = 1
_FOLD = np.where(_FOLD[LOWER] == 1, LOWER, np.uint8(0x20))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams that begin with a letter, and each text's first (n + 1 entries)."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    b = _FOLD[data]
    wide = b.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    use = b[:-2] != 0x20
    ends = offsets[1:]
    for k in (1, 2):  # trigrams that would cross into the next text
        at = ends - k
        use[at[(at >= offsets[:-1]) & (at < len(use))]] = False
    at = np.flatnonzero(use)
    return ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64), np.searchsorted(at, offsets)


def cell_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct cells of each text, ascending, how often each occurs, and each text's first (n + 1 entries)."""
    if len(offsets) == 2 and len(data) > SPAN:
        total = np.zeros(CELLS, dtype=np.int64)
        for a in range(0, len(data), SPAN):  # a span and the two bytes that its last trigrams end in
            part = data[a : a + SPAN + 2]
            total += np.bincount(trigrams(part, np.array([0, len(part)]))[0], minlength=CELLS)
        cells = np.flatnonzero(total)
        return cells, total[cells], np.array([0, len(cells)])
    cells, first = trigrams(data, offsets)
    return distinct(cells, first)


def distinct(cells: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys, counts = np.unique(owner * CELLS + cells, return_counts=True)
    return keys % CELLS, counts, np.searchsorted(keys, np.arange(len(first)) * CELLS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows in rows_within(batch, "text", 1 << 20):
            cells, counts, first = cell_counts(*text_buffers(rows.column("text")))
            langs = np.array(rows.column("lang").to_pylist(), dtype=object)
            owner = np.repeat(np.arange(len(langs)), np.diff(first))
            for lang in set(langs):
                own = (langs == lang)[owner]
                totals[lang] = totals.get(lang, 0) + np.bincount(cells[own], counts[own], minlength=CELLS)
    for lang, counts in sorted(totals.items()):
        strips = counts.astype(np.int64).reshape(-1, STRIP)
        n = len(strips)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(range(n), pa.int32()), pa.array([s.tobytes() for s in strips], pa.binary())], ["lang", "strip", "counts"])


def _add(rows: Iterator[dict]) -> Iterator[tuple]:
    for group in grouped(rows, "lang"):
        for part in grouped(group, "strip"):
            yield part[0]["lang"], part[0]["strip"], sum(np.frombuffer(r["counts"], np.int64) for r in part).tobytes()


class Texts:
    """Texts that have a trigram each, as their cells' probabilities by language and how often the cells occur."""

    def __init__(self, p: np.ndarray, counts: np.ndarray, first: np.ndarray):
        self.p, self.counts, self.begin, self.cells = p, counts.astype(np.float64), first[:-1], np.diff(first)
        self.owner = np.repeat(np.arange(len(self.begin)), self.cells)
        self.n = np.add.reduceat(self.counts, self.begin)

    def take(self, which: np.ndarray) -> Texts:
        size = self.cells[which]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.begin[which] - first[:-1], size) + np.arange(first[-1])
        return Texts(self.p[at], self.counts[at], first)

    def mixed(self, share: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.p, share[self.owner])

    def pull(self, share: np.ndarray) -> np.ndarray:
        """What each language has of a text's trigrams, for its proportion: the likelihood's slope."""
        return np.add.reduceat(self.p * (self.counts / self.mixed(share))[:, None], self.begin, axis=0)

    def likelihood(self, share: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.counts * np.log(self.mixed(share)), self.begin)


class Languages:
    """Trigram probabilities by language: a bounded table, CELLS by languages."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T * CELLS

    def choose(self, cells: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that have a trigram each: proportions over the set with the best penalised likelihood, languages by
        falling proportion, and the set's size."""
        texts = Texts(self.p[cells], counts, first)
        share = np.full((len(first) - 1, len(self.names)), 1 / len(self.names))
        for _ in range(STEPS):
            share *= texts.pull(share) / texts.n[:, None]
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        # the likelihood is concave, so its slope here bounds its greatest value
        bound = texts.likelihood(share) + texts.pull(share).max(axis=1) - texts.n
        cost = PENALTY * np.log(texts.n + 1)
        best, size, chosen = np.full(len(share), -np.inf), np.ones(len(share), dtype=int), np.zeros_like(share)
        for m in range(1, len(self.names) + 1):
            going = np.flatnonzero(bound - cost * m > best)
            if not len(going):
                break
            part = texts.take(going)
            fit = fitted(part, np.where(rank[going] < m, share[going] + 1e-9, 0))
            value = part.likelihood(fit) - cost[going] * m
            better = value > best[going]
            best[going[better]], size[going[better]], chosen[going[better]] = value[better], m, fit[better]
        return chosen, np.argsort(np.where(rank < size[:, None], -chosen, 1), axis=1, kind="stable"), size


def fitted(texts: Texts, share: np.ndarray) -> np.ndarray:
    """Proportions fitted over the languages that have some in ``share``, from there on, each text's to TOLERANCE."""
    share = share / share.sum(axis=1, keepdims=True)
    going = np.flatnonzero((share > 0).sum(axis=1) > 1)
    while len(going):
        part = texts.take(going)
        live = np.ones(len(going), dtype=bool)
        while 2 * live.sum() > len(live):
            new = share[going] * part.pull(share[going]) / part.n[:, None]
            moved = np.abs(new - share[going]).max(axis=1) > TOLERANCE
            share[going[live]] = new[live]
            live &= moved
        going = going[live]
    return share


def learn(docs: DataFrame) -> Languages:
    """Languages of ``docs`` (text, lang); the counts come from all its rows."""
    rows = text_column(docs, {"text": "string", "lang": "string"}).filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(_count, "lang string, strip int, counts binary")
    summed = map_rows(counted.repartition("lang", "strip").sortWithinPartitions("lang", "strip"), _add, "lang string, strip int, counts binary")
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():  # CELLS counts for each language
        found.setdefault(r["lang"], np.zeros((CELLS // STRIP, STRIP)))[r["strip"]] = np.frombuffer(r["counts"], np.int64)
    names = sorted(found)
    return Languages(names, np.array([found[n].ravel() for n in names]).reshape(len(names), CELLS))


def _predict(languages: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_within(batch, "text", 1 << 19):
                cells, counts, first = cell_counts(*text_buffers(rows.column("text")))
                letters = np.array(rows.column("letters").to_pylist(), dtype=bool)
                names = np.array([UNKNOWN] * len(letters), dtype=object)
                sets, score = names.copy(), np.zeros(len(letters))
                if languages.names:
                    # a text of letters too short for a trigram has even proportions
                    full = np.flatnonzero(letters & (np.diff(first) > 0))
                    bare = letters & (np.diff(first) == 0)
                    names[bare], sets[bare], score[bare] = languages.names[0], ",".join(languages.names), 1 / len(languages.names)
                    if len(full):
                        keep = np.repeat(np.isin(np.arange(len(letters)), full), np.diff(first))
                        bounds = np.concatenate([[0], np.cumsum(np.diff(first)[full])])
                        share, order, size = languages.choose(cells[keep], counts[keep], bounds)
                        names[full] = np.array(languages.names, dtype=object)[order[:, 0]]
                        score[full] = np.clip(share[np.arange(len(full)), order[:, 0]], 0, 1)
                        sets[full] = [",".join(languages.names[k] for k in o[:m]) for o, m in zip(order.tolist(), size.tolist(), strict=True)]
                columns = [rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(sets, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "langs"])

    return run


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, langs (the chosen set, most likely first)."""
    rows = text_column(docs, {"doc_id": "long", "text": "string"})
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(_predict(languages), RESULT)


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
