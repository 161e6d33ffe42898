"""The subpackage's entries of the query registry: thin queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, minhash_dedup, packing, quality, substring_dedup, suffix_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), with_bytes=False)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), with_text=False)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(documents(spark, sf_dir))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language_id.fold(F.col("doc_id"), 4) == 2
    found = language_id.identify(docs, language_id.learn(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = language_id.fold(F.col("doc_id"), 3) == 1
    found = quality.score(docs, quality.learn(docs, labels.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("places")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).drop("kept_text")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
}

SQL = {
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range((len(h) // 2 - 49 + 999) // 1000)) AS c FROM d WHERE len(h) >= 100)),
w AS (SELECT doc_id, c, unnest(range(least(1000, len(h) // 2 - 49))) AS j, h FROM c),
k AS (SELECT doc_id, 1000 * c + j AS i, min(doc_id) OVER (PARTITION BY substr(h, 2 * j + 1, 100)) < doc_id AS dup FROM w),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS begins FROM k WHERE dup),
r AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
q AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS z,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
      FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
""",
    "op6_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT doc_id, doc_id AS v FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.v),
c AS (SELECT doc_id, min(v) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 11, 1))) AS i, ws FROM d),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS dup FROM k),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(13) r(j) WHERE dup),
r AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
o AS (SELECT d.doc_id, ws, coalesce(ps, []) AS ps FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(ws) AS n_words, len(ps) AS n_removed,
       sha256(array_to_string([ws[x] FOR x IN range(1, len(ws) + 1) IF NOT list_contains(ps, x)], ' ')) AS kept_sha256
FROM o
""",
    "op5_license_scan": license_scan.scan_sql(),
    "op9_line_dedup": line_dedup.SQL,
    "op10_decontaminate": r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS s
      FROM (SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item,
       count(*)::DOUBLE / any_value(n.n) AS containment
FROM s d JOIN s i ON d.kind = 0 AND i.kind = 1 AND d.s = i.s JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n)
""",
}
