from pyspark.sql import functions as F

from loomgraph.operators import skew


def test_aggregate_and_running(spark):
    rows = [("hot", i, 1 if i % 3 else None) for i in range(3000)] + [(None, -1, 5), (None, -2, 6), ("cold", 0, 2)]
    df = spark.createDataFrame(rows, "k string, o int, v bigint")
    got = {r.k: (r.n, r.s) for r in skew.aggregate_ranges(df, ["k"], ["o"], [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")], 6).collect()}
    assert got == {"hot": (3000, 2000), None: (2, 11), "cold": (1, 2)}
    out = skew.running(df, ["k"], ["o"], "v", 6).collect()
    assert len(out) == len(rows)
    for k in ("hot", "cold", None):
        total = 0
        for i, r in enumerate(sorted((r for r in out if r.k == k), key=lambda r: r.o), 1):
            total += r.v or 0
            assert (r.running_rows, r.running_sum) == (i, total)


def test_hot_key_is_split(spark):
    df = spark.range(20000).select(F.lit("x").alias("k"), F.col("id").alias("o"))
    parts = skew.by_ranges(df, ["k"], ["o"], 8).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 20000 / 3


def test_empty_and_heavy(spark):
    df = spark.createDataFrame([], "k string, o int, v bigint")
    assert skew.aggregate_ranges(df, ["k"], ["o"], [F.count(F.lit(1)).alias("n")]).count() == 0
    assert skew.running(df, ["k"], ["o"], "v").count() == 0
    per = spark.createDataFrame([("a", 1), ("b", 99)], "k string, n bigint")
    assert {r.k for r in skew.heavy_keys(per, "n", 0.01, 100).collect()} == {"a", "b"}
    assert {r.k for r in skew.heavy_keys(per, "n", 0.011, 100).collect()} == {"b"}
