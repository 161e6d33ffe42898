"""Deduplication operators against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import blocks, exact_dedup, minhash_dedup, substring_dedup, suffix_dedup
from frameloom.llm.components import components
from frameloom.llm.storage import Scratch

LAST = 1 << 63
#: Extra columns whose names the operators use themselves.
CLASH = ("sha", "keep_id", "rep", "band", "key", "n", "part", "words", "gone", "score", "__sha", "__copy", "letters", "line")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def order(i):
    return LAST if i is None else i


def test_exact_dedup(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm, strict=True):
        groups[t].append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    want = Counter((r[0], min(groups[t], key=order), len(groups[t]), sha(t.encode())) for r, t in zip(rows, norm, strict=True))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(sha(t.encode()) for t in groups)


def test_drop_copies_keeps_columns_and_one_row_per_text(docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    found = kept.collect()
    assert len(found) == len(norm) and all(r[c] == 1 for r in found for c in CLASH)


def test_drop_copies_keeps_the_same_of_repeated_rows(spark):
    rows = [(1, "a  b", "x"), (1, "a b", "z"), (1, "a\tb", "y"), (2, "a b", "w"), (None, None, "n"), (None, "", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string").withColumn("more", F.struct(F.array("tag").alias("tags"), F.lit(1.5).alias("x")))
    runs = [sorted(map(str, exact_dedup.drop_copies(df.repartition(n, "tag")).collect())) for n in (1, 2, 6)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2
    assert exact_dedup.drop_copies(df).schema == df.schema


def test_grace_spills_and_compares_contents(tmp_path):
    records = [(hash(("h", k % 50)) & (2**64 - 1), f"text {k % 50} ".encode() * 40, (False, k, b"row"), 1) for k in range(500)]
    records += [(records[0][0], b"same hash, other content", (True, 0, b""), 1)]
    groups = list(exact_dedup.grace_groups(records, 2_000, str(tmp_path)))
    want = {f"text {k} ".encode() * 40: ((False, k, b"row"), 10) for k in range(50)} | {b"same hash, other content": ((True, 0, b""), 1)}
    assert {bytes(g[1]): (g[2], g[3]) for g in groups} == want
    assert len(groups) == 51 and not list(tmp_path.iterdir())


def test_grace_with_one_hash_for_all(tmp_path):
    records = [(0, f"content {k}".encode() * 20, (False, k, b""), 1) for k in range(30)]
    assert len(list(exact_dedup.grace_groups(records, 100, str(tmp_path)))) == 30


def removed_units(rows, units, width):
    """Per row: which units lie in a window that starts in a document with a smaller doc_id."""
    first = {}
    for r in rows:
        u = units(r)
        for k in range(len(u) - width + 1):
            w = tuple(u[k : k + width])
            first[w] = min(first.get(w, LAST + 1), order(r[0]))
    for r in rows:
        u = units(r)
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            if first[tuple(u[k : k + width])] < order(r[0]):
                gone[k : k + width] = [True] * width
        yield r, u, gone


def test_substring_dedup(docs, rows):
    words = lambda r: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
    want = Counter()
    for r, u, gone in removed_units(rows, words, 13):
        text = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        want[(r[0], len(u), sum(gone), sha(text.encode()), text)] += 1
    got = substring_dedup.substring_dedup(docs).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_removed for r in got) > 300


def test_suffix_dedup(docs, rows):
    small = [r for r in rows if len(r[1] or "") < 20_000]
    want = Counter()
    for r, u, gone in removed_units(small, lambda r: (r[1] or "").encode(), 50):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[(r[0], len(u), sum(gone), spans, sha(bytes(b for b, g in zip(u, gone, strict=True) if not g)))] += 1
    got = suffix_dedup.suffix_dedup(docs.filter("text IS NULL OR length(text) < 20000"), with_bytes=False).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_removed for r in got) > 1000


def test_suffix_dedup_handles_long_texts(docs):
    assert {r.n_bytes for r in suffix_dedup.suffix_dedup(docs).filter("n_bytes > 100000").collect()} == {149_999}


@pytest.mark.parametrize("size", [0, 1, 500, 20_000])
def test_multikey_quicksort_numbers_runs_in_order(size):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 6, (size, 6)).astype(np.uint64)
    run = suffix_dedup.multikey_quicksort(rows).tolist()
    numbers = {r: k for k, r in enumerate(sorted(set(map(tuple, rows.tolist()))))}
    assert run == [numbers[tuple(r)] for r in rows.tolist()]


@pytest.mark.parametrize("strings", [64, 1 << 16])
def test_suffix_dedup_with_one_lead_before_many_continuations(spark, monkeypatch, strings):
    """Each text starts a passage with the same bytes; most go on differently, some are copies."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", 64)
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRINGS", strings)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1 << 12)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(k, word(30) + "the very same leading bytes of all" + word(40)) for k in range(1500)]
    rows += [(5000 + k, rows[rng.randrange(1500)][1][rng.randrange(10) :]) for k in range(300)]
    rows += [(9000 + k, "head " + "the very same leading bytes of all, and what follows them is the same too " * 2) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    want = Counter((r[0], sum(gone)) for r, _, gone in removed_units(rows, lambda r: r[1].encode(), 50))
    assert Counter((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(df, with_bytes=False).collect()) == want


def test_suffix_dedup_strings_dealt_over_buckets():
    """Strings that are several splitters are dealt by block; the least rank is found across those buckets."""
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (40, suffix_dedup.WINDOW + 1)).astype(np.uint8)
    rows[10:] = rows[10]
    names = np.sort(suffix_dedup.as_strings(rows))
    splits = suffix_dedup.Splits(names[:0], 1, names[:0], names)
    assert len(splits.dealt) == 1
    where = {int(splits.of_strings(suffix_dedup.as_strings(rows[10:11]), block)[0]) for block in range(500)}
    low = int(np.searchsorted(names, splits.dealt[0]))
    assert where == set(range(splits.n_cold + low + 1, splits.n_cold + low + 31))


@pytest.mark.parametrize("n_buckets", [10, 10**6, 10**9])
def test_a_block_sends_no_more_rows_than_it_has_keys(n_buckets):
    data = np.random.default_rng(0).integers(97, 123, 20_000).astype(np.uint8)
    block = blocks.Block(1, blocks.Ranks(np.zeros(1, bool), np.zeros(1, np.int64)), np.array([0, len(data)]), data, b"")
    own = suffix_dedup.places(block)
    sent = list(blocks.ask(block, own.hashes, suffix_dedup.doc_of(block, own.at), n_buckets))
    assert len(sent) <= min(n_buckets, len(own.at)) and sum(len(r[2]) for r in sent) <= 4 * len(own.at)


EDGES = [None, -(1 << 63), -7, 0, 1 << 62, (1 << 62) + 1, (1 << 63) - 1]


@pytest.fixture(scope="module")
def edge_rows():
    """Ids at the ends of their range, each with texts that others have too, in every order."""
    rng = random.Random(11)
    texts = [" ".join(f"e{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    rows = [(i, t) for k, t in enumerate(texts) for i in EDGES[k % 3 :]]
    rows += [((1 << 63) - 1, "alone " + texts[0][:200]), ((1 << 63) - 1, texts[3]), (None, "only here " * 30), ((1 << 63) - 1, "a text that the largest id alone has, with words enough")]
    return [(i, t, None, None, None) for i, t in rows]


def test_ids_at_the_ends_of_their_range(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    groups = defaultdict(list)
    for r in edge_rows:
        groups[r[1]].append(r[0])
    got = exact_dedup.exact_dedup(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((r[0], min(groups[r[1]], key=order), len(groups[r[1]])) for r in edge_rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(sha(t.encode()) for t in groups)
    kept = exact_dedup.drop_copies(df).collect()
    assert sorted((order(r.doc_id), r.text) for r in kept) == sorted((order(min(ids, key=order)), t) for t, ids in groups.items())
    for f, units, width in ((suffix_dedup.suffix_dedup, lambda r: r[1].encode(), 50), (substring_dedup.substring_dedup, lambda r: r[1].split(), 13)):
        want = Counter((r[0], sum(gone)) for r, _, gone in removed_units(edge_rows, units, width))
        assert Counter((r.doc_id, r.n_removed) for r in f(df).collect()) == want
    got = Counter((order(r.doc_id), r.n_shingles, order(r.component_id)) for r in minhash_dedup.near_groups(df, 85).collect())
    assert got == near_reference(edge_rows, 85)
    kept = minhash_dedup.drop_near_copies(df).collect()
    assert all(r.text is not None for r in kept)
    roots = {i for _, _, i in near_reference(edge_rows, 80)}
    assert {order(r.doc_id) for r in kept} == roots


def near_reference(rows, percent):
    sets = defaultdict(set)
    by_row = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(UPPER))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        own = (LAST, r[1] or "") if r[0] is None else (r[0], "")
        by_row.append((own, s))
        sets[own].add(s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in by_row:
        for j, b in by_row:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i[0], len(s), root(i)[0]) for i, s in by_row)


@pytest.mark.parametrize("percent", [85, 60])
def test_minhash_dedup(docs, rows, percent):
    got = Counter((order(r.doc_id), r.n_shingles, order(r.component_id)) for r in minhash_dedup.near_groups(docs, percent).collect())
    assert got == near_reference(rows, percent)


def test_minhash_dedup_links_across_a_hub(spark):
    """Members of a band that are like each other but not like its smallest document are still linked."""
    words = [f"t{k}" for k in range(400)]
    texts = [words[k : k + 300] for k in (0, 20, 40, 60, 80)]
    rows = [(k, " ".join(t), None, None, None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.component_id for r in minhash_dedup.near_groups(df, 85).collect()} == {0}


def test_minhash_dedup_of_a_crowded_band_is_linear(spark, monkeypatch):
    """Thousands of documents that agree in bands and differ in sets: pairs are linked, and no table grows with the
    square of a band."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(60)]
    word = lambda: f"u{rng.randrange(10**9)}"
    rows = []
    for k in range(0, 8000, 2):
        own = [*base[:30], *(word() for _ in range(8)), *base[30:]]
        rows += [(k, " ".join([*own, word()])), (k + 1, " ".join([*own, word()]))]
    sizes = {}
    keep = Scratch.keep

    def counting(self, df, name, *rest):
        out = keep(self, df, name, *rest)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(df, 85).collect()}
    assert got == {k: k // 2 * 2 for k in range(8000)}
    assert sizes["crowd"] > 4000 and sizes["pairs"] < 2 * len(rows) and sizes["rarest"] < 20 * len(rows)


def test_drop_near_copies_keeps_one_of_each(docs):
    kept = minhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert all(r[c] == 1 for r in kept.collect() for c in CLASH)
    assert kept.filter("doc_id < 6").count() == 6 and kept.filter("doc_id BETWEEN 25 AND 33").count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (5, 1)]
    found = {r.v: r.w for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert found == {k: 0 for k in range(1, 41)} | {200: 100, 300: 100}


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, exact_dedup.drop_copies, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, minhash_dedup.near_groups, minhash_dedup.drop_near_copies])
def test_no_rows_give_no_rows(f, empty):
    assert f(empty).collect() == []
