"""Joins on a key of which one value may have a large share of all rows.

The HOT_KEYS commonest keys are known by count, so there are few enough to be broadcast whatever the input; any other
key has at most one in HOT_KEYS of the rows. Rows of a hot key are dealt over SALTS tasks, and the other side, which
has one narrow row a key, repeats its hot keys as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS, SALTS = 1000, 256


def commonest(counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys of the HOT_KEYS rows of ``counted`` (a row per key) with the largest ``n``."""
    return counted.orderBy(F.desc(n), *keys).limit(HOT_KEYS).select(*keys)


def dealt_rows(many: DataFrame, hot: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """``many`` with its ``salt``; ``spread`` tells the rows of a key apart."""
    marked = F.broadcast(hot.withColumn("hot", F.lit(True)))  # HOT_KEYS rows
    salt = F.when(F.col("hot"), F.pmod(spread, F.lit(SALTS))).otherwise(0)
    return many.join(marked, keys, "left").withColumn("salt", salt).drop("hot")


def dealt_keys(one: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``one`` (a row per key, no null key) with every ``salt`` that a row of that key may have."""
    marked = F.broadcast(hot.withColumn("hot", F.lit(True)))  # HOT_KEYS rows
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return one.join(marked, keys, "left").withColumn("salt", F.explode(salts.cast("array<bigint>"))).drop("hot")


def dealt_join(many: DataFrame, one: DataFrame, hot: DataFrame, keys: list[str], spread: Column, how: str) -> DataFrame:
    """``many`` joined with ``one`` on ``keys``."""
    return dealt_rows(many, hot, keys, spread).join(dealt_keys(one, hot, keys), [*keys, "salt"], how).drop("salt")
