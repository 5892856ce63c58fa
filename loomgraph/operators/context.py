"""Context for a task: retrieve, expand one hop, fuse scores, keep the best, pack under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.expr import estimate_tokens
from loomgraph.operators import lookup
from loomgraph.session import Scratch

CANDIDATES, KEEP, BODIES, SUMMARIES, BUDGET = 30, 30, 5, 15, 8000


def pinned(candidates: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The candidates (id, rank) as a small local table: at most ``most`` rows come to the driver, so
    that the search runs once and not in every step that needs them."""
    rows = candidates.select("id", "rank").orderBy("rank").limit(most).collect()
    out = candidates.sparkSession.createDataFrame([(r.id, r["rank"]) for r in rows], "id string, rank int")
    out._loom_ids = [r.id for r in rows]
    return out


def expand(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of the candidates (columns id, rank) and of the nodes beside them.  Pinned candidates become
    literals, so that one scan of the edges finds both ends and row groups can be skipped."""
    ids = getattr(candidates, "_loom_ids", None)
    touching = lookup.incident(edges, candidates) if ids is None else edges.where(F.col("src").isin(ids) | F.col("dst").isin(ids))
    return candidates.select("id").union(touching.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()


def fuse(nodes: DataFrame, ids: DataFrame, candidates: DataFrame, keep: int = KEEP) -> DataFrame:
    """The ``keep`` best nodes by 0.5/rank + 0.3 pagerank/max + 0.2 usage/max, ties by id; unknown
    scores count 0.  The two maxima are scalars over the expanded set."""
    pr = F.coalesce(F.when(~F.isnan("pagerank"), F.col("pagerank")), F.lit(0.0))
    us = F.coalesce(F.when(~F.isnan("usage_score"), F.col("usage_score")), F.lit(0.0))
    near = Scratch(nodes.sparkSession, "fuse").save(lookup.nodes_by_ids(nodes, ids))
    top = near.agg(F.greatest(F.lit(1e-9), F.max(pr)).alias("p"), F.greatest(F.lit(1e-9), F.max(us)).alias("u")).first()
    score = 0.5 * F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)) + 0.3 * pr / F.lit(top.p or 1e-9) + 0.2 * us / F.lit(top.u or 1e-9)
    return near.join(candidates.select("id", "rank"), "id", "left").withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "id").limit(keep)


def pack(best: DataFrame, blobs: DataFrame, query: str, budget: int = BUDGET, max_bodies: int = BODIES, summaries: int = SUMMARIES, include_blobs: bool = True) -> DataFrame:
    """One row: bodies and summaries (arrays of ids, in order of score), tokens, trimmed.

    The first ``max_bodies`` rows give their source; one that doesn't fit ends the packing.  The others,
    and those without source, give signature and documentation; one that doesn't fit is passed over.
    The fold runs over at most ``KEEP`` rows.
    """
    w = Window.orderBy(F.desc("score"), "id")
    cost = F.struct(
        (F.row_number().over(w) - 1).alias("i"),
        F.col("id"),
        F.when(F.col("source").isNotNull(), F.floor((F.octet_length("source") + 3) / 4)).cast("bigint").alias("body"),
        estimate_tokens(F.concat(F.coalesce("signature", F.lit("")), F.lit(" "), F.coalesce("doc_comment", F.lit("")))).alias("summary"),
    )
    rows = best.join(blobs.select(F.col("node_id").alias("id"), "source"), "id", "left").select(cost.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    start = F.struct(F.lit((len(query.encode()) + 3) // 4).cast("bigint").alias("tokens"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("bodies"), F.array().cast("array<string>").alias("texts"))

    def step(acc, r):
        body = F.lit(include_blobs) & (r["i"] < max_bodies) & r["body"].isNotNull()
        fits_body = acc["tokens"] + r["body"] <= budget
        fits_text = (F.size(acc["texts"]) < summaries) & (acc["tokens"] + r["summary"] <= budget)
        made_body = F.struct((acc["tokens"] + r["body"]).alias("tokens"), F.lit(False).alias("over"), F.concat(acc["bodies"], F.array(r["id"])).alias("bodies"), acc["texts"].alias("texts"))
        ended = F.struct(acc["tokens"].alias("tokens"), F.lit(True).alias("over"), acc["bodies"].alias("bodies"), acc["texts"].alias("texts"))
        made_text = F.struct((acc["tokens"] + r["summary"]).alias("tokens"), F.lit(False).alias("over"), acc["bodies"].alias("bodies"), F.concat(acc["texts"], F.array(r["id"])).alias("texts"))
        return F.when(acc["over"], acc).when(body & fits_body, made_body).when(body, ended).when(fits_text, made_text).otherwise(acc)

    got = rows.select(F.aggregate("rs", start, step).alias("x"))
    return got.select(F.col("x.bodies").alias("bodies"), F.col("x.texts").alias("summaries"), F.col("x.tokens").alias("tokens"), (F.col("x.tokens") >= budget).alias("trimmed"))


def adjacency(best: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends kept, as one array [src, dst, type]."""
    return lookup.induced(edges, best).select(F.array("src", "dst", "type").alias("edge"))
