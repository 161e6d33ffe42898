import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASH = ("sha", "keep_id", "rep", "band", "key", "n", "part", "words", "gone", "score", "__sha", "__copy", "letters", "line")


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):03d}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    passage = sentence(rng, 80, 100_000)
    base = [sentence(rng, rng.randrange(20, 200), 100_000) for _ in range(25)]
    texts = base + base[:6] + [t.replace(" ", " \t\n", 3) for t in base[:3]]
    texts += [f"{t} {passage} {u}" for t, u in zip(base[6:10], base[10:14], strict=True)]
    texts += [" ".join(["changed", *t.split()[1:]]) for t in base[14:18]]  # near copies
    texts += ["", " ", None, "a", "one two three", "one two three", "été çà là", "12 34 !!", "x" * 49, "x" * 50, "x" * 120, sentence(rng, 30_000, 50)]
    out = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 7}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(out)
    out += [out[0], out[0], (None, base[3], None, None, None), (None, None, None, None, None), (7, "another text of document seven", "en", "s1", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
