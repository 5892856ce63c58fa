"""The property graph: two DataFrames, and what builds and checks them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import CONFIDENCES, EDGE_COLS, EDGE_TYPES, NODE_COLS, NODE_TYPES
from loomgraph.sources.tables import table


class InvalidGraph(ValueError):
    """A graph breaks the schema's rules; the message names the first violation."""


def latest(nodes: DataFrame, key: str = "id", order: Sequence[str] = ("built_at",)) -> DataFrame:
    """One row per key: the last by ``order``; where several are last, the greatest by all columns.
    Rows without key are dropped.  The pick is a mergeable maximum, so repeated ids are reduced
    before they are exchanged."""
    rest = [x for x in nodes.columns if x not in order]
    top = F.max(F.struct(*[F.col(x) for x in (*order, *rest)])).alias("_top")
    return nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(top).select(*[F.col(f"_top.{x}").alias(x) for x in nodes.columns])


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges with type and end points trimmed and in lower case."""
    fix = {x: F.lower(F.trim(x)) for x in ("src", "dst", "type")}
    return edges.select(*[fix[x].alias(x) if x in fix else F.col(x) for x in EDGE_COLS])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type), the first by id."""
    rest = [x for x in edges.columns if x != "id"]
    return edges.groupBy("src", "dst", "type").agg(F.min(F.struct("id", *rest)).alias("_e")).select(*[F.col(f"_e.{x}").alias(x) for x in edges.columns])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes: edge_id, end ('src' or 'dst'), node_id."""
    ids = nodes.select(F.col("id").alias("node_id"))
    ends = edges.select(F.col("id").alias("edge_id"), F.explode(F.array(F.struct(F.lit("src").alias("end"), F.col("src").alias("node_id")), F.struct(F.lit("dst").alias("end"), F.col("dst").alias("node_id")))).alias("x")).select("edge_id", "x.end", "x.node_id")
    return ends.join(ids, "node_id", "left_anti").select("edge_id", "end", "node_id")


def domain_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows whose type or confidence isn't one of the fixed values: kind, id, field, value."""

    def bad(df, kind, field, allowed):
        return df.where(~F.coalesce(F.col(field), F.lit("")).isin(allowed)).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.lit(field).alias("field"), F.col(field).alias("value"))

    return bad(nodes, "node", "type", NODE_TYPES).union(bad(nodes, "node", "confidence", CONFIDENCES)).union(bad(edges, "edge", "type", EDGE_TYPES)).union(bad(edges, "edge", "confidence", CONFIDENCES))


@dataclass
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> PropertyGraph:
        """The driver's nodes (newest row per id) and edges (cleaned)."""
        return cls(latest(table(spark, sf_dir, "nodes")).select(*NODE_COLS), clean_edges(table(spark, sf_dir, "edges")))

    @classmethod
    def union(cls, *graphs: PropertyGraph) -> PropertyGraph:
        """All graphs together: of nodes with one id the last graph's row holds, edges are kept as a bag."""
        nodes = None
        for i, g in enumerate(graphs):
            own = g.nodes.withColumn("_ord", F.lit(i))
            nodes = own if nodes is None else nodes.unionByName(own)
        edges = graphs[0].edges
        for g in graphs[1:]:
            edges = edges.unionByName(g.edges)
        return cls(latest(nodes, order=("_ord",)).drop("_ord"), edges)

    def connected(self) -> DataFrame:
        """Edges with both ends among the nodes."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def validate(self) -> None:
        """Raise InvalidGraph for the first bad type, confidence or dangling end."""
        v = domain_violations(self.nodes, self.edges).orderBy(F.desc("kind"), "id").limit(1).collect()
        if v:
            raise InvalidGraph(f"{v[0].kind} {v[0].id}: bad {v[0].field} {v[0].value!r}")
        d = dangling(self.edges, self.nodes).orderBy("edge_id", "end").limit(1).collect()
        if d:
            raise InvalidGraph(f"edge {d[0].edge_id}: dangling {d[0].end} {d[0].node_id}")
