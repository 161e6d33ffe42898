"""Joins that deal the commonest keys over tasks, against plain joins."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from frameloom.llm import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_dealt_join_is_the_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    many = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).alias("key"))
    one = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("double"))
    hot = skew.commonest(many.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    assert hot.count() == 3 and hot.filter("key = 0").count() == 1
    got = skew.dealt_join(many, one, hot, ["key"], F.xxhash64("id"), how)
    want = many.join(one, "key", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_dealt_rows_of_a_hot_key_have_many_salts(spark):
    many = spark.range(2000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("key"))
    hot = many.filter("key = 0").select("key").distinct()
    found = skew.dealt_rows(many, hot, ["key"], F.xxhash64("id"))
    assert found.filter("key = 0").select("salt").distinct().count() > skew.SALTS / 2
    assert found.filter("key <> 0 AND salt <> 0").count() == 0
    assert skew.dealt_keys(hot, hot, ["key"]).count() == skew.SALTS


def test_dealt_join_without_rows(spark):
    many, one = spark.range(0).select("id", F.col("id").alias("key")), spark.range(5).select(F.col("id").alias("key"))
    hot = skew.commonest(many.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    assert skew.dealt_join(many, one, hot, ["key"], F.col("id"), "left").collect() == []
