"""Breadth-first traversals as semi-naive frontier joins.

Only ids travel through the rounds; node attributes are joined at the end.  Each round's result is
written to the shared folder, so plans stay short and nothing is computed twice.  The engine picks
the join by the frontier's measured size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import lookup
from loomgraph.session import Scratch

SEED_LIMIT = 100
VISIBLE_LIMIT, VISIBLE_DEPTH = 500, 6


@dataclass
class Neighborhood:
    """ids: (id, depth); edges: the edges followed, each once per direction."""

    ids: DataFrame
    edges: DataFrame

    def nodes(self, nodes: DataFrame) -> DataFrame:
        return lookup.nodes_by_ids(nodes, self.ids)


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, types: Sequence[str] | None = None) -> Neighborhood:
    """From ``seeds`` (column id) along edges, or against them.  Depth 0 gives the seeds alone; the
    edges are those of the nodes expanded, that is of all but the last level."""
    scratch = Scratch(edges.sparkSession, "bfs")
    e = edges.where(F.col("type").isin(*types)) if types else edges
    near, far = ("dst", "src") if reverse else ("src", "dst")
    front = scratch.save(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    levels, taken = front, e.limit(0)
    pairs = e.select(F.col(near).alias("near"), F.col(far).alias("far"))
    for d in range(1, depth + 1):
        if not front.limit(1).count():
            break
        taken = taken.unionByName(e.join(front.select(F.col("id").alias(near)), near, "left_semi").select(*edges.columns))
        step = pairs.join(front.select(F.col("id").alias("near")), "near", "left_semi").select(F.col("far").alias("id")).distinct()
        front = scratch.save(step.join(levels.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        levels = levels.union(front)
    return Neighborhood(levels, taken)


def neighborhood(nodes: DataFrame, edges: DataFrame, qname: str, depth: int, reverse: bool = False, types: Sequence[str] | None = None) -> Neighborhood:
    """From the nodes of a qualified name; an unknown one gives nothing."""
    return bfs(edges, lookup.find_symbol(nodes, qname, limit=SEED_LIMIT).select("id"), depth, reverse, types)


def subgraph(nodes: DataFrame, edges: DataFrame, qname: str, depth: int, distinct_edges: bool = False) -> Neighborhood:
    """Forward and backward neighbourhood together; edges as a bag unless ``distinct_edges``."""
    # the seeds are found once for both directions
    seeds = Scratch(nodes.sparkSession, "seeds").save(lookup.find_symbol(nodes, qname, limit=SEED_LIMIT).select("id"))
    a, b = bfs(edges, seeds, depth), bfs(edges, seeds, depth, True)
    ids = a.ids.union(b.ids).groupBy("id").agg(F.min("depth").alias("depth"))
    both = a.edges.unionByName(b.edges)
    return Neighborhood(ids, both.dropDuplicates(["id"]) if distinct_edges else both)


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    # each round of a search makes its frontier distinct, so repeated edges need no exchange of their own
    return e.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).withColumn("type", F.lit(""))


def hop_distance(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth): least number of edges from a seed, whatever their direction."""
    return bfs(undirected(edges), seeds, max_depth).ids


def visible_with_hits(visible: DataFrame, hits: DataFrame) -> DataFrame:
    """Ids shown after a search: what was visible, and what was found."""
    return visible.select("id").union(hits.select("id")).distinct()


def visible_set(nodes: DataFrame, edges: DataFrame, anchor: str | None, depth: int, limit: int = VISIBLE_LIMIT) -> DataFrame:
    """What a viewer shows around an anchor: the ``limit`` nearest nodes, ties by id; without anchor
    the packages."""
    if anchor is None:
        return nodes.where("type = 'Package'").select("id", F.lit(0).alias("depth")).orderBy("id").limit(limit)
    seeds = nodes.where(F.col("id") == anchor).select("id")
    near = hop_distance(edges, seeds, min(depth, VISIBLE_DEPTH))
    return near.join(nodes.select("id"), "id", "left_semi").orderBy("depth", "id").limit(limit)
