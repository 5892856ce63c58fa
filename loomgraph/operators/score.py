"""Degrees, usage and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import CALL_TYPES
from loomgraph.session import Scratch

DAMPING, ITERATIONS = 0.85, 30


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree (sums of count) and usage_score (sum of count of calls to it), 0
    where there is no edge.  Both ends of an edge go through one exchange, reduced before it."""
    n = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    call = F.when(F.col("type").isin(*CALL_TYPES), n).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    ends = edges.select(
        F.explode(F.array(F.struct(F.col("dst").alias("id"), n.alias("i"), zero.alias("o"), call.cast("bigint").alias("u")), F.struct(F.col("src").alias("id"), zero.alias("i"), n.alias("o"), zero.alias("u")))).alias("x")
    )
    per = ends.groupBy("x.id").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"), F.sum("x.u").alias("u"))
    return nodes.select("id").join(per, "id", "left").select("id", F.coalesce("i", zero).alias("in_degree"), F.coalesce("o", zero).alias("out_degree"), F.coalesce("u", zero).cast("double").alias("usage_score"))


#: Iterations planned together between two writes to the shared folder.
UNROLL = 5


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """id, pagerank after a fixed number of iterations.

    All edge types count, parallel edges one by one; ends that are no nodes are skipped; the mass of
    nodes without out-edges is spread evenly.

    With A the damped transition, the ranks after k iterations are a sum of the vectors u_j = A^j 1
    whose coefficients depend on the sinks' mass only.  So the iterations push the u_j along the edges
    without asking for any scalar in between, several to a plan, and
    are kept.  Aggregates over the sinks then give all masses, and the coefficients follow from it.  Edges are
    reduced to one weight per pair and stay partitioned by src, so an iteration only exchanges ranks
    and inflow that is reduced per target first.
    """
    scratch = Scratch(nodes.sparkSession, "pagerank")
    ids = nodes.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = scratch.save(e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))
    out = pairs.groupBy("src").agg(F.sum("m").alias("k"))
    state = scratch.save(ids.select("id", F.lit(1.0).alias("v0")))
    n = state.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    # a row without weight hands a node's own values on, so a step reads the state once
    carry = state.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("w"))
    weights = pairs.join(out, "src").select("src", "dst", (F.lit(damping) * F.col("m") / F.col("k")).alias("w")).union(carry).repartition("src").persist()
    blocks: list[tuple[int, DataFrame, int]] = []  # first j, table, number of vectors
    done = 0
    while done < iterations:
        steps = min(UNROLL, iterations - done)
        for k in range(steps):
            last = F.col(f"v{k}")
            sent = weights.join(state.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").select("dst", (last * F.col("w")).alias("x"), *[F.when(F.col("w").isNull(), F.col(f"v{i}")).alias(f"v{i}") for i in range(k + 1)])
            state = sent.groupBy(F.col("dst").alias("id")).agg(*[F.max(f"v{i}").alias(f"v{i}") for i in range(k + 1)], F.coalesce(F.sum("x"), F.lit(0.0)).alias(f"v{k + 1}"))
        table = scratch.save(state)
        blocks.append((done, table, steps + 1))
        state = table.select("id", F.col(f"v{steps}").alias("v0"))
        done += steps
    # masses of the sinks: u_j for all j, of every block its own (the last is the next one's first)
    lost = [0.0] * (iterations + 1)
    sources = out.select(F.col("src").alias("id"))
    for first, table, k in blocks:
        got = table.join(sources, "id", "left_anti").agg(*[F.sum(f"v{i}") for i in range(k)]).first()
        for i in range(k):
            lost[first + i] = got[i] or 0.0
    coef = [1.0 / n]
    for _ in range(iterations):
        sink = sum(c * d for c, d in zip(coef, lost, strict=False))
        coef = [(1 - damping) / n + damping * sink / n, *coef]
    weights.unpersist()
    parts = None
    for first, table, k in blocks:
        own = sum((F.col(f"v{i}") * coef[first + i] for i in range(1 if first else 0, k)), F.lit(0.0))
        part = table.select("id", own.alias("x"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy("id").agg(F.sum("x").alias("pagerank"))
