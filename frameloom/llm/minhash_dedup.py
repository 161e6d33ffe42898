"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit ring make every signature coordinate: the first scatters the shingles, the second,
shifted by k places, gives coordinate k. Texts with equal shingle sets form one class and only its smallest document
goes on. Of each shared band key the documents are compared with the smallest one, the star of the band. What stays in
different components there is compared further, so no link between documents that share a band is lost: in a band of at
most TILE documents at one place, and for all larger bands together by an exact prefix filter. Similar sets share one of
their rarest shingles, so a document sends only the rarest few with their places in its order, and only documents that
meet there, in different components, and that have enough shingles left from there on, are compared. The number of bands makes the chance of missing a link at the threshold
itself MISS; more similar pairs fare better.

A node is the pair (late, id): doc_id, or for a row without one, late and a hash of its text.

Defined results: a null or empty text has no shingles and is linked with nothing; a text shorter than five words is
one shingle; a row without doc_id goes by its own text and sorts after all others; rows with the same doc_id are one
node; drop_near_copies keeps all texts of a node that stays, and of repeated rows (same doc_id, same text) the one with
the least hash of all its columns; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm import blocks as B
from frameloom.llm.bytesight import U64, Words, mix, rows_within, shingle_sets, text_buffers
from frameloom.llm.components import components
from frameloom.llm.skew import commonest, dealt_join
from frameloom.llm.storage import Scratch, fresh, text_column

ROWS_PER_BAND, MISS = 6, 1e-7
TILE = 256
#: Cells of the table of shingle frequencies that orders a set from its rarest shingle on.
CELLS = 1 << 18
SETS = pa.schema([("late", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS_PER_BAND))


def _ring(v: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    v = v ^ (v >> np.uint32(16))
    v *= np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(13)
    v *= np.uint32(0xC2B2AE35)
    v ^= v >> np.uint32(16)
    return v


def signatures(hashes: np.ndarray, first: np.ndarray, n_coordinates: int) -> np.ndarray:
    """(texts, coordinates) of uint32; every text has a shingle."""
    scattered = (mix(hashes ^ U64(0x2545F4914F6CDD1D)) >> U64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, n_coordinates), dtype=np.uint32)
    for k in range(n_coordinates):
        out[:, k] = np.minimum.reduceat(_ring(scattered + np.uint32(k)), first[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, bands) of int64; keys of different bands differ."""
    parts = signature.reshape(len(signature), -1, ROWS_PER_BAND).astype(U64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(ROWS_PER_BAND):
        key = mix(key * U64(0xC2B2AE3D27D4EB4F) + parts[:, :, r])
    return key.view(np.int64)


def _sets(n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_within(batch, "text", 1 << 19):
                hashes, first = shingle_sets(Words(*text_buffers(rows.column("text"))))
                n, raw, at = np.diff(first), hashes.tobytes(), (first * 8).tolist()
                full = np.flatnonzero(n)
                bands: list = [None] * len(n)
                if len(full):
                    found = band_keys(signatures(hashes, first[np.append(full, len(n))], n_bands * ROWS_PER_BAND))
                    for k, row in zip(full.tolist(), found, strict=True):
                        bands[k] = row
                keys = [blake2b(raw[a:b], digest_size=16).digest() if a < b else None for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("late"), rows.column("id"), pa.array(n), pa.array(keys, pa.binary()), pa.array(bands, SETS[4].type)], schema=SETS)

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in rows_within(batch, "text", 1 << 20):
            hashes, first = shingle_sets(Words(*text_buffers(rows.column("text"))))
            raw, at = hashes.tobytes(), (first * 8).tolist()
            found = pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("late"), rows.column("id"), found], ["late", "id", "shingles"])


def common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with each of several."""
    every = np.concatenate(many)
    place = np.minimum(np.searchsorted(one, every), len(one) - 1)
    sizes = np.array([len(m) for m in many])
    return np.add.reduceat((one[place] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def linked(one: np.ndarray, many: list[np.ndarray], percent: int) -> np.ndarray:
    sizes = np.array([len(m) for m in many])
    both = common(one, many)
    return 100 * both >= percent * (len(one) + sizes - both)


def _pair(a: dict, b: dict) -> tuple:
    """A row of PAIR."""
    return a["late"], a["id"], b["late"], b["id"]


PAIR = "a_late boolean, a_id long, b_late boolean, b_id long"


def _paired(rows: DataFrame) -> DataFrame:
    node = lambda c: F.struct(F.col(f"{c}_late").alias("late"), F.col(f"{c}_id").alias("id")).alias(c)
    return rows.select(node("a"), node("b"))


def _verify_stars(percent: int):
    """Rows (hub, part, role, node, shingles), the hub's own set first: links of the members with the hub."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        held: list[dict] = []
        at, centres = None, []

        def flush() -> Iterator[tuple]:
            if held:
                sets = [np.frombuffer(r["shingles"], U64) for r in held]
                ok = np.any([linked(c, sets, percent) for c in centres], axis=0)
                yield from (_pair(r["node"], at[0]) for r, good in zip(held, ok.tolist(), strict=True) if good)
                held.clear()

        for row in rows:
            if (row["hub"], row["part"]) != at:
                yield from flush()
                at, centres = (row["hub"], row["part"]), []
            if row["role"] == 0:
                centres.append(np.frombuffer(row["shingles"], U64))
            else:
                held.append(row)
                if len(held) >= TILE:
                    yield from flush()
        yield from flush()

    return run


def _verify_band(percent: int):
    """Rows (band, node, component, shingles): links that join components within a band of at most TILE rows."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for group in B.grouped(rows, "band"):
            names = [(r["component"]["late"], r["component"]["id"]) for r in group]
            parent = {n: n for n in names}

            def root(c: tuple, parent: dict = parent) -> tuple:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            sets = [np.frombuffer(r["shingles"], U64) for r in group]
            for k in range(1, len(group)):
                own = root(names[k])
                size = len(sets[k])
                others = [j for j in range(k) if root(names[j]) != own and 100 * min(len(sets[j]), size) >= percent * max(len(sets[j]), size)]
                if others:
                    for j in np.array(others)[linked(sets[k], [sets[j] for j in others], percent)].tolist():
                        parent[root(names[j])] = root(names[k])
                        yield _pair(group[k]["node"], group[j]["node"])

    return run


def _count_cells(rows: Iterator[dict]) -> Iterator[tuple]:
    total = np.zeros(CELLS, dtype=np.int64)
    for r in rows:
        total += np.bincount(cell(np.frombuffer(r["shingles"], U64)), minlength=CELLS)
    for k, strip in enumerate(total.reshape(64, -1)):
        yield k, strip.tobytes()


def _add_cells(rows: Iterator[dict]) -> Iterator[tuple]:
    for group in B.grouped(rows, "strip"):
        yield group[0]["strip"], sum(np.frombuffer(r["counts"], np.int64) for r in group).tobytes()


def cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles % U64(CELLS)).astype(np.int64)


def rarest(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which any set that is similar enough shares one among its own."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[cell(shingles)]))
    return shingles[order[: n + percent * n // -100 + 1]]


def _send_rarest(counts: np.ndarray, percent: int):
    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            shingles = np.frombuffer(r["shingles"], U64)
            for place, key in enumerate(rarest(shingles, counts, percent).view(np.int64).tolist()):
                yield key, r["node"]["late"], r["node"]["id"], r["component"]["late"], r["component"]["id"], len(shingles), len(shingles) - place

    return run


def _meet_rarest(percent: int):
    """Rows (cell, tile, node_late, node_id, component_late, component_id, n, left) sorted by cell: pairs of nodes in
    different components, of rows of one tile among each other, else of one tile with the other's.

    Sets that are similar enough have 100 * common >= percent * union. At the first shingle that two sets share, in the
    order of all shingles, neither can have more in common than it has ``left`` from there on.
    """

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for group in B.grouped(rows, "cell"):
            n, left, tile = (np.array([r[c] for r in group]) for c in ("n", "left", "tile"))
            component = np.unique([f"{r['component_late']} {r['component_id']}" for r in group], return_inverse=True)[1]
            across = tile.min() != tile.max()
            for k in range(1, len(group)):
                j = np.arange(k)
                ok = (component[j] != component[k]) & ((100 + percent) * np.minimum(left[j], left[k]) >= percent * (n[j] + n[k]))
                if across:
                    ok &= tile[j] != tile[k]
                for i in np.flatnonzero(ok).tolist():
                    a, b = sorted(((group[x]["node_late"], group[x]["node_id"]) for x in (i, k)), reverse=True)
                    yield *a, *b

    return run


def crowd_pairs(crowd: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b) of ``crowd`` (node, component, shingles; one row a node): pairs in different components that may be
    similar enough, and all that are.

    A shingle among the rarest of more than TILE sets has its sets dealt into tiles of about TILE.
    """
    strips = B.map_rows(crowd, _count_cells, "strip int, counts binary").repartition("strip").sortWithinPartitions("strip")
    counts = np.zeros((64, CELLS // 64), dtype=np.int64)
    for r in B.map_rows(strips, _add_cells, "strip int, counts binary").collect():  # CELLS numbers
        counts[r["strip"]] = np.frombuffer(r["counts"], np.int64)
    ddl = "shingle long, node_late boolean, node_id long, component_late boolean, component_id long, n long, left long"
    sent = scratch.keep(B.map_rows(crowd, _send_rarest(counts.ravel(), percent), ddl), "rarest")
    sizes = sent.groupBy("shingle").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = scratch.keep(sizes, "sizes")
    hot = scratch.keep(commonest(sizes, ["shingle"], "size"), "hot_shingles")
    spread = F.xxhash64("node_late", "node_id")
    dealt = dealt_join(sent, sizes, hot, ["shingle"], spread, "inner").withColumn("tiles", F.ceil(F.col("size") / TILE))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(F.lit(3), "node_late", "node_id"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.withColumn("cell", F.xxhash64("shingle", F.least("tile", "other"), F.greatest("tile", "other"))).drop("tiles", "other", "size")
    met = dealt.repartition("cell").sortWithinPartitions("cell", "node_late", "node_id")
    return _paired(B.map_rows(met, _meet_rarest(percent), PAIR)).distinct()


def node(doc_id: Column, text: Column) -> Column:
    """A row's node; without a doc_id its text gives the id."""
    return F.struct(doc_id.isNull().alias("late"), F.coalesce(doc_id, F.xxhash64(text)).alias("id"))


def least(name: str) -> Column:
    """The least node of a group, by aggregates that need no sorting."""
    known = F.min(F.when(~F.col(f"{name}.late"), F.col(f"{name}.id")))
    return F.struct(known.isNull().alias("late"), F.coalesce(known, F.min(f"{name}.id")).alias("id"))


def verified(stars: DataFrame, sides: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """Links (a, b) of ``stars`` (hub, node) that are similar enough; ``sides`` has the nodes' shingles. A star is dealt
    in parts of about TILE."""
    busy = scratch.keep(stars.groupBy("hub").agg(F.count("*").alias("size")), f"{name}_busy")
    hot = scratch.keep(commonest(busy, ["hub"], "size"), f"{name}_hot")
    stars = dealt_join(stars, busy, hot, ["hub"], F.xxhash64("node"), "inner")
    stars = stars.select("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / TILE)).alias("part"), "node")
    centres = stars.select("hub", "part").distinct().withColumn("node", F.col("hub")).join(sides, "node").withColumn("role", F.lit(0))
    arms = stars.join(sides, "node").withColumn("role", F.lit(1))
    columns = ["hub", "part", "role", "node", "shingles"]
    rows = centres.select(columns).unionAll(arms.select(columns)).repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return _paired(B.map_rows(rows, _verify_stars(percent), PAIR))


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """One row per row of ``docs``: node, n, component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = text_column(docs, {"doc_id": "long", "text": "string"}).select(node(F.col("doc_id"), F.col("text")).alias("node"), "text")
    flat = texts.select("node.late", "node.id", "text")
    own = F.struct("late", "id").alias("node")
    found = flat.mapInArrow(_sets(bands_for(percent / 100)), "late boolean, id long, n long, key binary, bands array<long>")
    sets = scratch.keep(found.select(own, "n", "key", "bands"), "sets")

    classes = sets.filter("key IS NOT NULL").groupBy("key").agg(least("node").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    leading = sets.join(classes, (sets["key"] == classes["key"]) & (sets["node"] == classes["rep"]), "left_semi")
    members = leading.select(F.col("node").alias("rep"), F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(least("rep").alias("hub"), F.count("*").alias("size"))
    hubs = scratch.keep(hubs.filter("size > 1"), "hubs")
    hot = scratch.keep(commonest(hubs, ["band"], "size"), "hot_bands")
    shared = scratch.keep(dealt_join(members, hubs, hot, ["band"], F.xxhash64("rep"), "inner").select("band", "rep", "hub"), "shared")

    # the full sets of all documents that share a band
    wanted = shared.select(F.col("rep").alias("node")).distinct()
    full = texts.join(wanted, "node", "left_semi").select("node.late", "node.id", "text")
    sides = scratch.keep(full.mapInArrow(_full_sets, "late boolean, id long, shingles binary").select(own, "shingles"), "full", "uncompressed")

    stars = shared.filter("rep <> hub").select("hub", F.col("rep").alias("node")).distinct()
    # rows with the same doc_id are one node, whatever their texts
    named = F.coalesce("key", F.lit(b""))
    several = sets.groupBy("node").agg(F.min(named).alias("low"), F.max(named).alias("high")).filter("low < high").select("node")
    same = sets.join(several, "node").join(classes, "key").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    links = scratch.keep(verified(stars, sides, scratch, "star", percent).unionAll(same), "links")
    found = components(links, scratch, "stars", least)

    # bands that still hold several components, of more documents than the star has compared
    labels = found.select(F.col("v").alias("rep"), F.col("w").alias("component"))
    placed = shared.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = scratch.keep(placed.select("band", "rep", "component"), "placed")
    open_bands = placed.groupBy("band").agg(
        F.count("*").alias("size"),
        F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("content"),
        F.min(F.xxhash64("component")).alias("low"),
        F.max(F.xxhash64("component")).alias("high"),
    )
    open_bands = open_bands.filter("size > 2 AND low < high").groupBy("size", "content").agg(F.min("band").alias("band"))
    open_bands = scratch.keep(open_bands.select("band", "size"), "open")
    in_open = dealt_join(placed, open_bands, hot, ["band"], F.xxhash64("rep"), "inner").select("band", F.col("rep").alias("node"), "component", "size")
    in_open = scratch.keep(in_open, "in_open")
    cells = in_open.filter(F.col("size") <= TILE).join(sides, "node").select("band", "node", "component", "shingles")
    more = _paired(B.map_rows(cells.repartition("band").sortWithinPartitions("band", "node"), _verify_band(percent), PAIR))
    crowd = in_open.filter(F.col("size") > TILE).select("node", "component").distinct()
    if crowd.limit(1).count():
        crowd = scratch.keep(crowd.join(sides, "node"), "crowd", "uncompressed")
        pairs = scratch.keep(crowd_pairs(crowd, scratch, percent).select(F.col("b").alias("hub"), F.col("a").alias("node")), "pairs")
        more = more.unionAll(verified(pairs, sides, scratch, "pair", percent))
    more = scratch.keep(more, "more")
    if more.limit(1).count():
        found = components(links.unionAll(more), scratch, "all", least)
    scratch.drop("hubs", "shared", "placed", "in_open", "full", "crowd", "rarest", "pairs")

    hot = scratch.keep(commonest(classes, ["key"], "copies"), "hot")
    unlinked = F.concat(F.lit("without words "), F.col("node.late").cast("string"), F.col("node.id").cast("string")).cast("binary")
    narrow = sets.select("node", "n", F.coalesce("key", unlinked).alias("key"))
    rows = dealt_join(narrow, classes.select("key", "rep"), hot, ["key"], F.xxhash64("node"), "left")
    rows = rows.select("node", "n", F.coalesce("rep", "node").alias("leader"))
    rows = rows.join(found, F.col("leader") == F.col("v"), "left")
    return rows.select("node", "n", F.coalesce("w", "leader").alias("component"))


def near_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; a link needs 100 * common >= percent * union."""
    visible = lambda c: F.when(~F.col(f"{c}.late"), F.col(f"{c}.id"))
    return _components(docs, percent).select(
        visible("node").alias("doc_id"), F.col("n").alias("n_shingles"), visible("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near copies, the one with the smallest doc_id; all columns.

    Rows are numbered and chosen by hashes; each text crosses the network once, and once more only where rows repeat.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kept = _components(docs, percent).filter("node = component").select("node").distinct()
    own, digest, order = fresh(docs, "__node", "__digest", "__order")
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(own, node(F.col("doc_id").cast("long"), F.col("text")))
    rows = rows.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn(order, F.sha2(F.to_json(F.struct(*every)), 256))
    stays = rows.groupBy(own, digest).agg(F.count("*").alias("times")).join(kept.withColumnRenamed("node", own), own, "left_semi")
    stays = scratch.keep(stays, "stays")
    hot = scratch.keep(commonest(stays, [own, digest], "times"), "hot")
    rows = dealt_join(rows, stays, hot, [own, digest], F.xxhash64(order), "inner")
    several = rows.filter("times > 1").groupBy(own, digest).agg(F.min_by(F.struct(*every), order).alias("row")).select("row.*")
    return rows.filter("times = 1").select(*every).unionAll(several)
