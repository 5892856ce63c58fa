"""From a source tree to a scored, persisted graph."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import PropertyGraph, latest
from loomgraph.operators import community, packages, resolve, score, text
from loomgraph.parse import extract
from loomgraph.schema import EDGE_COLS, NODE_COLS, NODES_DDL
from loomgraph.session import Scratch
from loomgraph.sources import store, tree

VERSION = "0.1.0"
_NODE = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in (NODES_DDL + ", ord INT").split(", "))
_EDGE = "src: STRING, dst: STRING, type: STRING, file_path: STRING, line: INT, count: INT, confidence: STRING"
_PENDING = "src_id: STRING, edge_type: STRING, target_qname: STRING, hint_file: STRING, line: INT, ord: INT"
PARSED_DDL = f"file_path STRING, language STRING, nodes ARRAY<STRUCT<{_NODE}>>, edges ARRAY<STRUCT<{_EDGE}>>, pending ARRAY<STRUCT<{_PENDING}>>, error STRING"
_PA = {"STRING": pa.string(), "INT": pa.int32(), "DOUBLE": pa.float64()}


def _arrow(spec: str) -> pa.DataType:
    return pa.list_(pa.struct([pa.field(a.strip(), _PA[b.strip()]) for a, b in (x.split(":") for x in spec.split(","))]))


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file (file_path, content as text or bytes) of a known language: its nodes, edges and
    pending references, or the error because of which it is skipped.  Files are parsed where they lie."""
    kinds = [_arrow(x) for x in (_NODE, _EDGE, _PENDING)]

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if extract.lex.extension(p) is None or c is None:
                    continue
                lang = extract.lex.EXTENSIONS[extract.lex.extension(p)][0]
                lang = "ts" if lang == "js" else lang
                try:
                    got = extract.parse_file(p, c.decode("utf-8", "replace") if isinstance(c, bytes) else c)
                    rows.append((p, lang, *got.rows(), None))
                except Exception as e:  # noqa: BLE001  a bad file is counted and skipped
                    rows.append((p, lang, [], [], [], str(e)[:200]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *[pa.array(list(x), k) for x, k in zip(cols[2:5], kinds, strict=True)], pa.array(cols[5], pa.string())],
                names=["file_path", "language", "nodes", "edges", "pending", "error"],
            )

    return files.select("file_path", "content").mapInArrow(run, T._parse_datatype_string(PARSED_DDL))


def _rows(parsed: DataFrame, what: str) -> DataFrame:
    return parsed.select(F.col("file_path").alias("_file"), F.inline(what))


def resolve_parsed(parsed: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """The graph of parsed files with references resolved per language, and the references left over."""
    nodes = _rows(parsed, "nodes").withColumn("file_ord", F.array_join(tree.walk_order("_file"), "\x00")).drop("_file")
    edges = _rows(parsed, "edges").drop("_file").withColumn("id", F.lit(None).cast("bigint"))
    pending = _rows(parsed, "pending").drop("_file", "ord").withColumn("_ref", F.xxhash64("src_id", "edge_type", "target_qname", "line"))
    go_calls = pending.where("edge_type = 'calls'")
    go_nodes, sol_nodes = nodes.where("language = 'go'"), nodes.where("language = 'sol'")
    made = resolve.resolve_go(resolve.lift_callsites(go_calls, go_nodes), go_nodes)
    made = made.unionByName(resolve.resolve_sol(pending.where("edge_type <> 'calls'"), sol_nodes))
    made = made.withColumn("file_path", F.lit(None).cast("string")).withColumn("id", F.lit(None).cast("bigint"))
    clean = latest(nodes, order=("file_ord", "ord")).select(*NODE_COLS)
    both = edges.select(*EDGE_COLS).unionByName(made.select(*EDGE_COLS))
    links = resolve.link_contracts(clean).withColumn("file_path", F.lit(None).cast("string")).withColumn("line", F.lit(None).cast("int")).withColumn("id", F.lit(None).cast("bigint"))
    names = nodes.where("type in ('Function', 'Method')").select(F.explode(F.array("qualified_name", F.substring_index("qualified_name", ".", -1))).alias("target_qname")).union(sol_nodes.select(F.when(F.col("type") == "Mapping", F.concat("name", F.lit(":mapping"))).otherwise(F.col("name")))).distinct()
    left = pending.join(names, "target_qname", "left_anti")
    return PropertyGraph(clean, both.unionByName(links.select(*EDGE_COLS))), left


def scored(graph: PropertyGraph) -> DataFrame:
    """Nodes with degrees, usage and PageRank."""
    d = score.degrees(graph.nodes, graph.edges)
    p = score.pagerank(graph.nodes, graph.edges)
    rest = graph.nodes.drop("in_degree", "out_degree", "usage_score", "pagerank")
    return rest.join(d, "id").join(p, "id").select(*[F.col(c).cast("int") if c in ("in_degree", "out_degree") else F.col(c) for c in NODE_COLS])


def topic_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labelled communities at three resolutions in the topic tree's shape; equal labels keep all members."""
    member = community.communities(nodes, edges)
    key = F.concat_ws("|", F.col("resolution"), "community")
    named = member.withColumn("comm", key).join(nodes.select(F.col("id").alias("node_id"), "name", "qualified_name", "pagerank"), "node_id").withColumn("id", F.col("node_id"))
    label = community.labels(named.select("comm", "id", "name", "qualified_name", "pagerank"))
    return named.join(label, "comm").select(F.lit(None).cast("string").alias("parent_id"), F.col("node_id").alias("child_id"), "resolution", F.col("label").alias("topic_label"))


def commit_of(root: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip() or None
    except (OSError, subprocess.CalledProcessError):
        return None


def from_source(spark: SparkSession, root: str, languages: Sequence[str] | None = None) -> PropertyGraph:
    """The resolved, validated graph of a source tree in memory, without scores, communities or a store."""
    files = tree.source_files(tree.read_tree(spark, root), (), languages)
    graph, _ = resolve_parsed(Scratch(spark, "source").save(parse_files(files)))
    graph.validate()
    return graph


def build(spark: SparkSession, root: str, out: str, languages: Sequence[str] | None = None) -> dict:
    """Scan, parse, resolve, link, validate, cluster, score and persist; returns the manifest."""
    scratch = Scratch(spark, "build")
    ignore_file = os.path.join(root, ".ckgignore")  # fixed value: name of the ignore file
    patterns = tree.parse_ignore(store.get_text(spark, ignore_file)) if store.exists(spark, ignore_file) else []
    files = tree.source_files(tree.read_tree(spark, root), patterns, languages)
    parsed = scratch.save(parse_files(files))
    graph, left = resolve_parsed(parsed)
    graph = PropertyGraph(scratch.save(graph.nodes), scratch.save(graph.edges))
    graph.validate()
    nodes = scratch.save(scored(graph))
    edges = scratch.save(store.number_edges(graph.edges.select(*EDGE_COLS)))
    topics = topic_tree(nodes, edges)
    pkg = scratch.save(packages.package_tree(nodes))
    blobs = tree.blobs(nodes, files.select("file_path", "content"))
    stats = parsed.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).collect()
    commit = commit_of(root)
    # fixed values: the manifest's keys
    manifest = {
        "schema_version": "1.0", "ckg_version": VERSION, "build_timestamp": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "src_root": root, "staleness_method": "git" if commit else "mtime",
        "languages": {r.language: r.n for r in stats}, "stats": {"nodes": nodes.count(), "edges": edges.count(), "pkg_edges": pkg.count(), "parse_errors": sum(r.bad for r in stats)}, "parse_errors_count": sum(r.bad for r in stats), "unresolved_refs_count": left.count(), "clustering_status": "ok", "ckgignore": patterns,
    }
    if commit:
        manifest["src_commit"] = commit
    else:
        mark = tree.fingerprint(files).first()
        manifest |= {"staleness_files": mark.files or [], "staleness_mtime_sum": mark.mtime_sum or 0}
    store.save(out, {"nodes": nodes, "edges": edges, "pkg_tree": pkg, "topic_tree": topics, "blobs": blobs, "postings": text.postings(nodes, "id", text.NODE_FIELDS)}, manifest)
    return manifest
