"""Point, list and name lookups over nodes, edges and trees.

Lists of ids come as DataFrames and become semi joins, so they may be of any length; an empty list
gives no rows, unknown ids are passed over.  Limits order by id first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expr import like_escape


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def roots(nodes: DataFrame, limit: int = 5000) -> DataFrame:
    return nodes.where("type = 'Package'").orderBy("id").limit(clamp(limit))


def clamp(limit: int) -> int:
    """Limits of listings: out of 1..50000 means 5000."""
    return limit if 0 < limit <= 50_000 else 5000


def edges_by_type(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("type") == edge_type)


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids`` (column id), each once."""
    hit = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    also = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").join(ids.select(F.col("id").alias("src")), "src", "left_anti").select(*edges.columns)
    return hit.unionByName(also)


def edges_from(edges: DataFrame, ids: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    e = edges.where(F.col("type").isin(*types)) if types else edges
    return e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)


def edges_to(edges: DataFrame, ids: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    e = edges.where(F.col("type").isin(*types)) if types else edges
    return e.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def nodes_by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_semi").select(*nodes.columns)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return edges_to(edges_from(edges, ids), ids)


def find_symbol(nodes: DataFrame, name: str, exact: bool = True, language: str | None = None, limit: int = 100) -> DataFrame:
    """By qualified name, or (not exact) also by its last part, without case."""
    q = F.col("qualified_name")
    hit = q == name
    if not exact:
        hit = hit | F.lower(q).endswith("." + name.lower())
    got = nodes.where(hit)
    if language:
        got = got.where(F.col("language") == language)
    return got.orderBy("id").limit(limit)


def search_substring(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Name or qualified name contains the text, without case."""
    pattern = f"%{like_escape(text)}%"
    return nodes.where(F.col("name").ilike(pattern) | F.col("qualified_name").ilike(pattern)).orderBy("id").limit(limit)


def children_of(nodes: DataFrame, pkg_tree: DataFrame, parent: str, limit: int = 5000) -> DataFrame:
    kids = pkg_tree.where(F.col("parent_id") == parent).select(F.col("child_id").alias("id")).distinct()
    return nodes_by_ids(nodes, kids).orderBy("id").limit(clamp(limit))


def parents_of(tree: DataFrame, child: str) -> DataFrame:
    """Rows of a tree whose child is ``child``: its parents and level."""
    return tree.where(F.col("child_id") == child)


def hierarchy(kind: str, tree: DataFrame) -> DataFrame:
    """Rows of either tree in one shape; any other kind is an error."""
    if kind == "pkg":
        return tree.select(F.coalesce("parent_id", F.lit("")).alias("parent_id"), "child_id", "level", F.lit("").alias("topic_label"))
    if kind == "topic":
        return tree.select(F.coalesce("parent_id", F.lit("")).alias("parent_id"), "child_id", F.col("resolution").alias("level"), F.coalesce("topic_label", F.lit("")).alias("topic_label"))
    raise ValueError(f"unknown hierarchy {kind!r}")


def tool_shape(nodes: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Columns of answers about symbols; with ``blobs`` their sources, null where there is none."""
    cols = ["id", "type", "name", F.col("qualified_name").alias("qname"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), "confidence", F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("usage_score", F.lit(0.0)).alias("usage_score")]
    if blobs is None:
        return nodes.select(*cols)
    return nodes.join(blobs.select(F.col("node_id").alias("id"), "source"), "id", "left").select(*cols, "source")


def node_ref(nodes: DataFrame, score: str = "score") -> DataFrame:
    return nodes.select("id", "name", "type", F.col("qualified_name").alias("qname"), score)


def incident_counts(edges: DataFrame) -> DataFrame:
    """Rows of edges in and out per node id; one pass, both ends of an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))
