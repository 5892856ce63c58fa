"""Python facade over a persisted graph: the questions tools and viewers ask."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import context, lookup, text, traverse
from loomgraph.schema import CALL_TYPES
from loomgraph.sources import store


class Graph:
    """Tables are read lazily; every answer is a DataFrame, or a dict where the shape is fixed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.nodes, self.edges, self.pkg_tree, self.topic_tree, self.blobs, self.postings = (store.load(spark, path, t) for t in ("nodes", "edges", "pkg_tree", "topic_tree", "blobs", "postings"))

    def manifest(self, current_commit: str | None = None, current_mtime_sum: int | None = None) -> dict:
        """The manifest, and whether the sources changed since: another commit, or another sum of
        modification times where that is the graph's method; unknown present values say nothing."""
        m = json.loads(store.get_text(self.spark, f"{self.path}/manifest.json"))
        by_git = m.get("staleness_method") == "git" and current_commit is not None and m.get("src_commit") != current_commit
        by_time = m.get("staleness_method") == "mtime" and current_mtime_sum is not None and m.get("staleness_mtime_sum") != current_mtime_sum
        stale = by_git or by_time
        return m | {"current_commit": current_commit, "graph_stale": stale}

    def hierarchy(self, kind: str = "pkg") -> DataFrame:
        return lookup.hierarchy(kind, self.pkg_tree if kind == "pkg" else self.topic_tree)

    def children(self, parent: str = "", limit: int = 5000) -> DataFrame:
        return lookup.children_of(self.nodes, self.pkg_tree, parent, limit) if parent else lookup.roots(self.nodes, limit)

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def nodes_by_ids(self, ids: list[str]) -> DataFrame:
        return lookup.nodes_by_ids(self.nodes, self._ids(ids))

    def edges_of(self, ids: list[str]) -> DataFrame:
        return lookup.incident(self.edges, self._ids(ids))

    def blob(self, node_id: str) -> bytes | None:
        got = self.blobs.where(F.col("node_id") == node_id).collect()
        return bytes(got[0].source) if got else None

    def find_symbol(self, name: str, language: str | None = None, exact: bool = True, include_blobs: bool = False) -> DataFrame:
        return lookup.tool_shape(lookup.find_symbol(self.nodes, name, exact, language), self.blobs if include_blobs else None)

    def _around(self, qname: str, depth: int, reverse: bool, include_blobs: bool) -> tuple[DataFrame, DataFrame]:
        h = traverse.neighborhood(self.nodes, self.edges, qname, depth, reverse, CALL_TYPES)
        return lookup.tool_shape(h.nodes(self.nodes), self.blobs if include_blobs else None), h.edges

    def find_callers(self, qname: str, depth: int = 1, include_blobs: bool = False) -> tuple[DataFrame, DataFrame]:
        return self._around(qname, depth, True, include_blobs)

    def find_callees(self, qname: str, depth: int = 1, include_blobs: bool = False) -> tuple[DataFrame, DataFrame]:
        return self._around(qname, depth, False, include_blobs)

    def get_subgraph(self, qname: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        h = traverse.subgraph(self.nodes, self.edges, qname, depth)
        return lookup.tool_shape(h.nodes(self.nodes)), h.edges

    def search_text(self, query: str, top_k: int = 10, language: str | None = None, rank: str = "bm25") -> DataFrame:
        if not query.strip():
            return lookup.tool_shape(self.nodes.limit(0))
        return lookup.tool_shape(text.search(self.nodes, self.postings, query, top_k, rank, language))

    def context_for_task(self, task: str, budget_tokens: int = context.BUDGET, language: str | None = None, include_blobs: bool = True, max_bodies: int = context.BODIES) -> dict:
        cand = context.pinned(text.search(self.nodes, self.postings, task, context.CANDIDATES, "bm25", language))
        if not cand.limit(1).count():
            return {"not_found": True, "bodies": [], "summaries": [], "subgraph": [], "tokens": (len(task.encode()) + 3) // 4, "trimmed": False}
        best = context.fuse(self.nodes, context.expand(cand, self.edges), cand)
        row = context.pack(best, self.blobs, task, budget_tokens, max_bodies, include_blobs=include_blobs).first()
        links = [tuple(r.edge) for r in context.adjacency(best, self.edges).collect()]
        refs = [r.asDict() for r in lookup.node_ref(best).collect()]
        return {"not_found": False, "nodes": refs, "bodies": list(row.bodies), "summaries": list(row.summaries), "subgraph": links, "tokens": row.tokens, "trimmed": row.trimmed}

    def export(self, out: str) -> None:
        store.export(out, self.nodes, self.edges, self.pkg_tree, self.topic_tree, self.blobs, self.manifest())
