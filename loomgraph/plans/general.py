"""Queries of the general operators over the driver's tables (names p2_..., p6_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy, skew
from loomgraph.sources.tables import table

HEAVY_SHARE = 0.01


def tree_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of both trees: tree, resolution (-1 for pkg), parent_id, child_id."""
    pkg = table(spark, d, "pkg_tree", "parent_id", "child_id").select(F.lit("pkg").alias("tree"), F.lit(-1).alias("resolution"), "parent_id", "child_id")
    topic = table(spark, d, "topic_tree", "parent_id", "child_id", "resolution").select(F.lit("topic").alias("tree"), "resolution", "parent_id", "child_id")
    return pkg.union(topic)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_nodes(tree_links(spark, d), ["tree", "resolution"], "parent_id", "child_id")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(tree_links(spark, d), ["tree", "resolution"], "parent_id", "child_id")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(tree_links(spark, d), ["tree", "resolution"], "parent_id", "child_id")


def clean_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with dst and type trimmed and in lower case."""
    e = table(spark, d, "edges", "id", "dst", "type", "count")
    return e.select("id", F.lower(F.trim("dst")).alias("dst"), F.lower(F.trim("type")).alias("type"), "count")


def p6_per_target(spark: SparkSession, d: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("count").cast("bigint")).alias("sum_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id")]
    return skew.aggregate_ranges(clean_edges(spark, d), ["dst", "type"], ["id"], aggs)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = clean_edges(spark, d).select("dst", "type", "id")
    per = skew.aggregate_ranges(rows, ["dst", "type"], ["id"], [F.count(F.lit(1)).alias("n")])
    total = table(spark, d, "edges", "id").count()
    return skew.heavy_keys(per, "n", HEAVY_SHARE, total).select("dst", "type")


def p6_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each edge's position among the edges of its target, and the count summed up to it."""
    rows = clean_edges(spark, d).withColumn("count", F.col("count").cast("bigint"))
    return skew.running(rows, ["dst", "type"], ["id"], "count").select("id", "dst", "type", "running_rows", "running_sum")


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p6_found, p6_per_target, p6_positions)}

_LINKS = """
links AS (
  SELECT 'pkg' AS tree, -1 AS resolution, parent_id AS p, child_id AS c FROM pkg_tree
  UNION SELECT 'topic', resolution, parent_id, child_id FROM topic_tree)"""

ORACLE = {
    "p2_found": f"""
WITH RECURSIVE {_LINKS},
l AS (SELECT * FROM links WHERE p IS NOT NULL AND c IS NOT NULL),
reach AS (
  SELECT tree, resolution, p AS a, c AS n FROM l
  UNION SELECT r.tree, r.resolution, r.a, l.c FROM reach r JOIN l ON l.tree = r.tree AND l.resolution = r.resolution AND l.p = r.n)
SELECT tree, resolution, a AS node_id FROM reach WHERE a = n""",
    "p2_hierarchy": f"""
WITH RECURSIVE {_LINKS},
l AS (SELECT * FROM links WHERE p IS NOT NULL AND c IS NOT NULL AND p <> c),
nodes_ AS (SELECT tree, resolution, c AS n FROM links WHERE c IS NOT NULL UNION SELECT tree, resolution, p FROM links WHERE c IS NOT NULL AND p IS NOT NULL),
roots AS (
  SELECT tree, resolution, n FROM nodes_ WHERE (tree, resolution, n) NOT IN (SELECT tree, resolution, c FROM l)
  UNION SELECT tree, resolution, c FROM links WHERE p IS NULL AND c IS NOT NULL),
r(tree, resolution, n, depth) USING KEY (tree, resolution, n) AS (
  SELECT tree, resolution, n, 0 FROM roots
  UNION SELECT r.tree, r.resolution, l.c, min(r.depth + 1) FROM r JOIN l ON l.tree = r.tree AND l.resolution = r.resolution AND l.p = r.n
  WHERE (l.tree, l.resolution, l.c) NOT IN (SELECT (q.tree, q.resolution, q.n) FROM recurring.r q) GROUP BY 1, 2, 3),
lv AS (SELECT * FROM r),
pa AS (
  SELECT k.tree, k.resolution, k.n, min(l.p) AS p FROM lv k JOIN l ON l.tree = k.tree AND l.resolution = k.resolution AND l.c = k.n
  JOIN lv q ON q.tree = l.tree AND q.resolution = l.resolution AND q.n = l.p AND q.depth = k.depth - 1 GROUP BY 1, 2, 3),
pt AS (
  SELECT tree, resolution, n, CAST(NULL AS VARCHAR) AS up, [n] AS path FROM lv WHERE depth = 0
  UNION ALL SELECT pa.tree, pa.resolution, pa.n, pa.p, list_append(pt.path, pa.n) FROM pa JOIN pt ON pt.tree = pa.tree AND pt.resolution = pa.resolution AND pt.n = pa.p)
SELECT tree, resolution, n AS node_id, up AS parent_id, path[1] AS root_id, CAST(len(path) - 1 AS INTEGER) AS depth, path
FROM nodes_ LEFT JOIN pt USING (tree, resolution, n)""",
    "p2_descendants": f"""
WITH RECURSIVE {_LINKS},
l AS (SELECT * FROM links WHERE p IS NOT NULL AND c IS NOT NULL),
reach AS (
  SELECT tree, resolution, p AS a, c AS n FROM l
  UNION SELECT r.tree, r.resolution, r.a, l.c FROM reach r JOIN l ON l.tree = r.tree AND l.resolution = r.resolution AND l.p = r.n)
SELECT tree, resolution, a AS ancestor_id, n AS node_id FROM reach""",
    "p6_found": """
SELECT lower(trim(dst)) AS dst, lower(trim(type)) AS type FROM edges
GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)""",
    "p6_per_target": """
SELECT lower(trim(dst)) AS dst, lower(trim(type)) AS type, count(*) AS n_edges, CAST(sum(count) AS BIGINT) AS sum_count,
       min(id) AS first_id, max(id) AS last_id FROM edges GROUP BY 1, 2""",
    "p6_positions": """
SELECT id, lower(trim(dst)) AS dst, lower(trim(type)) AS type,
       row_number() OVER w AS running_rows, CAST(sum(count) OVER w AS BIGINT) AS running_sum
FROM edges WINDOW w AS (PARTITION BY lower(trim(dst)), lower(trim(type)) ORDER BY id ROWS UNBOUNDED PRECEDING)""",
}
