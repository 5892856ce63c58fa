"""The package tree: every file under its nearest package, declarations under files, blocks under
functions.  Longest-prefix matching is an equality join on all prefixes of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expr import before_hash, depth_of, dirname
from loomgraph.schema import BLOCK_TYPES, DECLARATION_TYPES


def package_of_file(nodes: DataFrame) -> DataFrame:
    """file_id, package_id, package: the package with the longest qualified name that is the file's
    folder or one above it; files without one don't appear.  Of packages with one name the greatest
    id holds."""
    packages = nodes.where("type = 'Package'").groupBy(F.col("qualified_name").alias("package")).agg(F.max("id").alias("package_id"))
    parts = F.split(dirname("file_path"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tries = nodes.where("type = 'File'").select(F.col("id").alias("file_id"), F.explode(prefixes).alias("package"))
    best = tries.join(packages, "package").groupBy("file_id").agg(F.max(F.struct(F.length("package").alias("n"), "package", "package_id")).alias("x"))
    return best.select("file_id", "x.package_id", "x.package")


def package_tree(nodes: DataFrame) -> DataFrame:
    """parent_id, child_id, level.  A package's own level is its depth; a file is one below its
    package, declarations one below their file, blocks one below their function.  A file without a
    package has level 2 and no row."""
    of = package_of_file(nodes).withColumn("level", depth_of("package") + 1)
    files = nodes.where("type = 'File'").groupBy("file_path").agg(F.max("id").alias("file_id"))
    levels = files.join(of.select("file_id", "level"), "file_id", "left").select("file_path", "file_id", F.coalesce("level", F.lit(2)).alias("level"))
    file_rows = of.select(F.col("package_id").alias("parent_id"), F.col("file_id").alias("child_id"), "level")
    decl = nodes.where(F.col("type").isin(DECLARATION_TYPES)).select("id", "file_path").join(levels, "file_path")
    decl_rows = decl.select(F.col("file_id").alias("parent_id"), F.col("id").alias("child_id"), (F.col("level") + 1).alias("level"))
    calls = nodes.where("type in ('Function', 'Method')").groupBy(F.col("qualified_name").alias("q")).agg(F.max(F.struct("id", "file_path")).alias("x")).select("q", F.col("x.id").alias("call_id"), F.col("x.file_path").alias("file_path"))
    call_level = calls.join(levels.select("file_path", "level"), "file_path", "left").select("q", "call_id", (F.coalesce("level", F.lit(2)) + 1).alias("level"))
    blocks = nodes.where(F.col("type").isin(BLOCK_TYPES) & (F.instr("qualified_name", "#") > 0)).select("id", before_hash("qualified_name").alias("q")).join(call_level, "q")
    block_rows = blocks.select(F.col("call_id").alias("parent_id"), F.col("id").alias("child_id"), (F.col("level") + 1).alias("level"))
    return file_rows.union(decl_rows).union(block_rows).distinct()
