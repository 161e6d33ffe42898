"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

The spread of a line is the number of distinct sites it stands on. Each task sketches the sites of its lines in
HyperLogLog sketches per line hash, which aggregation merges; lines on a single site, seen from the least and largest
site hash, need no sketch. A line whose estimate lies near the threshold gets an exact distinct count. Lines that
reach the threshold are removed from every document. Places of the commonest lines are dealt over many tasks.

Lines are cut at line feeds and compared without white space at their ends, by 128 bits of hashes. Defined results:
blank lines are never boilerplate; a null text is empty, and an empty text has one, blank line; a null site is no
site; rows with the same doc_id are cleaned each by its own text; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.skew import commonest, dealt_join, dealt_keys, dealt_rows
from frameloom.llm.storage import Scratch, text_column

MIN_SITES = 5
#: Sketches of 2**LG_K registers; their relative error is about 1.04 / 2**(LG_K / 2).
LG_K = 8
#: Estimates within so many relative errors of the threshold are counted exactly.
NEAR = 4 * 1.04 / 2 ** (LG_K / 2)


def place() -> Column:
    """Tells the places of a line apart."""
    return F.xxhash64("doc_id", "digest", "at")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def exploded(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: doc_id, digest (of the document's text), at, k1, k2 (of the line), source."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "source", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("line", trimmed(F.col("line"))).filter("line <> ''")
    return rows.select("doc_id", "digest", "at", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2"), "source")


def line_counts(lines: DataFrame) -> DataFrame:
    """A row per line: k1, k2, n (its places), low and high (least and largest hash of its sites; null without one)."""
    site = F.when(F.col("source").isNotNull(), F.xxhash64("source"))
    return lines.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(site).alias("low"), F.max(site).alias("high"))


def boilerplate(lines: DataFrame, several: DataFrame, hot: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines (k1, k2) of ``several``, those on two sites or more, that stand on at least ``min_sites`` distinct sites."""
    if min_sites <= 2:
        return several.select("k1", "k2")
    keys = ["k1", "k2"]
    sites = dealt_rows(lines.filter("source IS NOT NULL"), hot, keys, place()).select(*keys, "salt", "source")
    sites = sites.join(dealt_keys(several.select(keys), hot, keys), [*keys, "salt"], "left_semi")
    sketches = sites.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LG_K))).alias("estimate"))
    sure = sketches.filter(F.col("estimate") > min_sites * (1 + NEAR)).select("k1", "k2")
    near = sketches.filter((F.col("estimate") <= min_sites * (1 + NEAR)) & (F.col("estimate") >= min_sites * (1 - NEAR) - 1))
    exact = sites.join(dealt_keys(near.select(keys), hot, keys), [*keys, "salt"], "left_semi").select("k1", "k2", "source").distinct()
    exact = exact.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("k1", "k2")
    return sure.unionAll(exact)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_sha256, kept_text."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = text_column(docs, {"doc_id": "long", "text": "string", "source": "string"})
    # read three times: for the counts, the sketches and the removal
    lines = scratch.keep(exploded(rows), "lines", "lz4")
    needed = "low < high" if min_sites > 1 else "low IS NOT NULL"
    several = scratch.keep(line_counts(lines).filter(needed).select("k1", "k2", "n"), "several")
    hot = scratch.keep(commonest(several, ["k1", "k2"]), "hot")
    found = scratch.keep(boilerplate(lines, several, hot, min_sites), "boilerplate")
    gone = dealt_join(lines.select("doc_id", "digest", "at", "k1", "k2"), found, hot, ["k1", "k2"], place(), "left_semi")
    gone = gone.groupBy("doc_id", "digest").agg(F.collect_set("at").alias("gone"))
    rows = rows.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), "text")
    match = rows["id"].eqNullSafe(gone["doc_id"]) & (rows["own"] == gone["digest"])
    out = rows.join(gone, match, "left").select(F.col("id").alias("doc_id"), lines_of(F.col("text")).alias("lines"), "gone")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    # a hashed difference, so a text with many lines and many of them gone costs no more than both
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(places, "gone"), lambda i: F.get("lines", i)))
    out = out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"))
    return out.select("doc_id", "n_lines", F.greatest("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")


SQL = rf"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, ls[i] AS raw, i, regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (b.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id
"""
