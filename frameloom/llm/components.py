"""Connected components of a link table, as joins: large-star and small-star until nothing moves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.storage import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("w").alias("v")).unionAll(edges.select(F.col("w").alias("u"), "v"))


def _large(edges: DataFrame, lowest: Callable[[str], Column]) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(lowest("v").alias("m")).withColumn("m", F.least("m", "u"))
    return near.filter("v > u").join(least, "u").filter("v <> m").select("v", F.col("m").alias("w"))


def _small(edges: DataFrame, lowest: Callable[[str], Column]) -> DataFrame:
    least = edges.groupBy("v").agg(lowest("w").alias("m"))
    to_least = least.select("v", F.col("m").alias("w"))
    return edges.join(least, "v").filter("w <> m").select(F.col("w").alias("v"), F.col("m").alias("w")).unionAll(to_least)


def components(links: DataFrame, scratch: Scratch, name: str, lowest: Callable[[str], Column] = F.min) -> DataFrame:
    """(v, w): each linked node but the least of its component, and that least node. ``links`` has columns a, b of any
    type with an order, of which ``lowest`` is the least of a group.

    Neighbours are never gathered: minima are aggregated and joined back, so a hot node is split like any skewed key.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct()
    edges, step, before = scratch.keep(edges, f"{name}0"), 0, None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "w").cast("decimal(20,0)"))).first())
        if mark == before or not mark[0]:
            return edges
        before, step = mark, step + 1
        edges = scratch.keep(_small(_large(edges, lowest).distinct(), lowest).distinct(), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
