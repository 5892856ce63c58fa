"""Per-key results when a few keys hold most records.

Rows are range-partitioned on the composite key *and* a secondary order, so that the sampled
quantiles cut a heavy key into as many ranges as its share asks for.  Every range is reduced on
its own; states of a key that was cut are then stitched together.  No task ever sees more than
one range of raw rows, whatever share of all rows one key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import Scratch


#: Bytes of rows that one range should hold, by the optimizer's estimate of the input.
RANGE_BYTES = 128 << 20


def ranges_for(df: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Number of ranges: by the estimated size of ``df``, and at least as many as the session's shuffles have
    partitions, so that small inputs use all cores and large ones keep ranges small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an operator whose size nobody knows counts as endless; then the session's number holds
    return least if size >= 1 << 60 else max(least, -(-size // range_bytes))


def by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` split by sampled quantiles of (keys, order) into ``parts`` ranges, by default ``ranges_for`` it."""
    return df.repartitionByRange(parts or ranges_for(df), *keys, *order)


def aggregate_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggs: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Mergeable aggregates per key.

    Each range is reduced to one partial state per key it holds (map-side); only these states are
    exchanged, at most one per key and range, and merged.  Null keys form a group of their own, an
    empty table gives no rows, repeated rows all count.
    """
    return by_ranges(df, keys, order, parts).groupBy(*keys).agg(*aggs)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """``df`` plus ``running_rows`` and ``running_sum``: position of each row within its key by
    ``order``, and the sum of ``value`` (null counts as 0) up to and including it.

    ``order`` must order the rows of a key totally; tied rows are told apart arbitrarily.  The
    rows are ranged once and kept in the shared folder with their range number; a window runs
    within (range, key); keys that cross a range boundary get the totals of their earlier ranges
    added.  A range hands on at most its last key, so the stitched table has fewer rows than there
    are ranges, and that bound is why it may be broadcast.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "running")
    ranged = scratch.save(by_ranges(df, keys, order, parts).withColumn("_range", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    states = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"))
    # only keys with several ranges need stitching
    wk = Window.partitionBy(*keys)
    before = wk.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        states.withColumn("_k", F.count(F.lit(1)).over(wk))
        .where("_k > 1")
        .select("_range", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    )
    for k in keys:
        cut = cut.withColumnRenamed(k, f"_cut_{k}")
    cut = cut.withColumnRenamed("_range", "_cut_range")
    w = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_s", F.sum(v).over(w))
    on = F.col("_range") == F.col("_cut_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_cut_{k}"))
    return local.join(F.broadcast(cut), on, "left").select(
        *df.columns,
        (F.col("_n") + F.coalesce("_n0", F.lit(0))).alias("running_rows"),
        (F.col("_s") + F.coalesce("_s0", F.lit(0))).alias("running_sum"),
    )


def heavy_keys(per_key: DataFrame, n: str, share: float, total: int) -> DataFrame:
    """Rows of ``per_key`` whose ``n`` is at least ``share`` of ``total`` rows."""
    return per_key.where(F.col(n) >= F.lit(float(total)) * F.lit(share))
