"""Queries p1, p3, p4, p5, p7, p8 and p9 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, docpairs, handwritten, mixing, parsing, rank_walk, residue
from loomgraph.sources.tables import table

SCORES = ("in_degree", "out_degree", "pagerank", "usage_score")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All nodes (newest row per id) in one ranking: id, probability, rank.  pagerank sums to 1 in each
    repository, so it is taken relative to the mean of its repository before repositories are compared."""
    n = table(spark, d, "nodes", "id", "file_path", "built_at", *SCORES)
    new = rank_walk.newest(n, "id", "built_at", [*SCORES, "file_path"]).withColumn("repo", F.substring_index("file_path", "/", 1))
    sizes = new.groupBy("repo").agg(F.count(F.lit(1)).alias("repo_nodes"))
    scored = new.join(sizes, new.repo.eqNullSafe(sizes.repo)).withColumn("pagerank", F.col("pagerank") * F.col("repo_nodes"))
    return rank_walk.rank(scored, "id", SCORES)


def p1_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The ranking's probabilities, which SQL can compute by windows over all nodes."""
    return p1_ranking(spark, d).select("id", F.round("probability", 9).alias("probability"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.refused(table(spark, d, "source_files", "file_id", "file_path", "content")).select("file_id").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """First error per file: file_id, language, error_line."""
    return parsing.refused(table(spark, d, "source_files", "file_id", "file_path", "content")).distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(table(spark, d, "source_files", "file_id", "repo", "file_path", "content"), table(spark, d, "manifest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_files", "file_id", "repo", "content")).select("file_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_files", "file_id", "repo", "content"))


def _pairs(spark: SparkSession, d: str, code: bool = False) -> DataFrame:
    cols = ("type", "name", "qualified_name", "signature", "doc_comment", "file_path", "start_line")
    nodes = rank_walk.newest(table(spark, d, "nodes", "id", "built_at", *cols), "id", "built_at", cols)
    return docpairs.documented(nodes, table(spark, d, "source_files", "file_path", "content"), code)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, code=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_ranking, p1_probabilities, p3_found, p3_errors, p3_rates, p4_found, p4_reasons, p5_found, p5_pairs, p7_ids, p8_mix, p8_shares, p9_found, p9_reasons)}


def _walk_sql(steps: int = 45) -> str:
    """The chain over items, step by step: each score's inflow is a running sum over items up to its value."""
    last = ", ".join(f"{c} DESC NULLS LAST" for c in (*SCORES, "file_path"))
    out = [
        f"n AS (SELECT * FROM (SELECT id, file_path, {', '.join(SCORES)}, row_number() OVER (PARTITION BY id ORDER BY built_at DESC NULLS LAST, {last}) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)",
        "q AS (SELECT id, in_degree::DOUBLE AS a0, out_degree::DOUBLE AS a1, pagerank * count(*) OVER (PARTITION BY split_part(file_path, '/', 1)) AS a2, usage_score AS a3 FROM n)",
        "k AS (SELECT id, " + ", ".join(f"CASE WHEN isnan(a{i}) OR a{i} < 0 THEN NULL ELSE a{i} END AS s{i}" for i in range(4)) + " FROM q)",
        "w AS MATERIALIZED (SELECT *, count(*) OVER () AS n, " + ", ".join(f"count(s{i}) OVER ()::DOUBLE / count(*) OVER () / count(s{i}) OVER (ORDER BY s{i} DESC NULLS LAST) AS f{i}" for i in range(4)) + " FROM k)",
        "r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE / n AS p FROM w)",
    ]
    for t in range(steps):
        each = " + ".join(f"CASE WHEN s{i} IS NULL THEN sum(p) OVER () / n ELSE sum(p * f{i}) OVER (PARTITION BY s{i} IS NULL ORDER BY s{i}) + coalesce(sum(p) FILTER (s{i} IS NULL) OVER (), 0) / n END" for i in range(4))
        out.append(f"r{t + 1} AS MATERIALIZED (SELECT * EXCLUDE (p), 0.15::DOUBLE / n + 0.85::DOUBLE / 4 * ({each}) AS p FROM r{t})")
    return "WITH " + ",\n".join(out) + f" SELECT id, round(p, 9) AS probability FROM r{steps}"


ORACLE: dict[str, str] = {"p1_probabilities": _walk_sql()}
