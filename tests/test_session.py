import math

from pyspark.sql import functions as F

from storyloom.operators import evaluate
from storyloom.session import hot_keys, salted_lookup


def test_salts_follow_the_share_of_a_key(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 3000, "hub").when(F.col("id") < 3300, "warm").when(F.col("id") == 8999, None).otherwise(F.col("id").cast("string")).alias("key"), "id")
    hot = hot_keys(df, "key", share=0.02, least=100)
    assert hot == {"hub": math.ceil(3000 / (8999 * 0.02)), "warm": 2} and hot_keys(df, "key", share=0.5) == {}
    lookup = df.where("key is not null").select("key").distinct().withColumn("n", F.length("key"))
    plain = {tuple(r) for r in df.join(lookup, "key", "left").collect()}
    assert {tuple(r) for r in salted_lookup(df, lookup, "key", hot, "left").collect()} == plain
    assert salted_lookup(df, lookup, "key", hot).count() == 8999 and hot_keys(df.where("false"), "key") == {}


def test_folds_hold_the_wanted_number_of_test_rows(spark):
    df = spark.range(1, 1234).select(F.col("id"), F.lit("x").alias("_h2"))
    out = evaluate.shuffle_split(df, "id", 7)
    per = {r.fold: (r.n, r.t) for r in out.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert per == {f: (1233, math.ceil(123.3)) for f in range(7)} and out.columns == ["id", "_h2", "fold", "is_test"]
    assert evaluate.shuffle_split(df.where("false"), "id", 3).count() == 0
