"""References by name to edges, per language, and contracts to the classes that bind them.

The order-dependent picks (first or last definition wins) are minima and maxima over explicit ordinals
``file_ord`` and ``ord``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.expr import before_hash, simple_name

# Kinds of nodes that references of a language may mean, and path hints of bindings.
GO_KINDS, TS_KINDS, SOL_KINDS = ("Function", "Method"), ("Function", "Method", "Class"), ("Event", "Modifier", "Mapping")
BINDING_HINTS = ("typechain", "contracts", "abi")


def _edges(df: DataFrame, dst: str, confidence) -> DataFrame:
    return df.select(F.col("src_id").alias("src"), F.col(dst).alias("dst"), F.col("edge_type").alias("type"), "line", F.lit(1).alias("count"), confidence.alias("confidence"))


def resolve_go(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """By qualified or simple name, the last definition wins; references found nowhere are dropped.
    ``nodes`` carry file_ord and ord."""
    keys = nodes.where(F.col("type").isin(*GO_KINDS)).select("id", "file_ord", "ord", F.explode(F.array_distinct(F.array("qualified_name", simple_name("qualified_name")))).alias("target_qname"))
    index = keys.groupBy("target_qname").agg(F.max(F.struct("file_ord", "ord", "id")).alias("x")).select("target_qname", F.col("x.id").alias("dst"))
    return _edges(pending.join(index, "target_qname"), "dst", F.lit("EXTRACTED"))


def lift_callsites(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """A call site's reference becomes its function's: the last definition, in the same file, of the
    name before '#'; without one it stays."""
    sites = nodes.where("type = 'CallSite'").select(F.col("id").alias("src_id"), "file_path", before_hash("qualified_name").alias("q"))
    funcs = nodes.where("type in ('Function', 'Method')").groupBy("file_path", F.col("qualified_name").alias("q")).agg(F.max(F.struct("ord", "id")).alias("x")).select("file_path", "q", F.col("x.id").alias("parent"))
    lifted = sites.join(funcs, ["file_path", "q"]).select("src_id", "parent")
    return pending.join(lifted, "src_id", "left").withColumn("src_id", F.coalesce("parent", "src_id")).drop("parent").select(*pending.columns)


def resolve_ts(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """By name, the first definition wins."""
    index = nodes.where(F.col("type").isin(*TS_KINDS)).groupBy(F.col("name").alias("target_qname")).agg(F.min(F.struct("file_ord", "ord", "id")).alias("x")).select("target_qname", F.col("x.id").alias("dst"))
    return _edges(pending.join(index, "target_qname"), "dst", F.lit("INFERRED"))


def resolve_sol(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """By name among the kinds that the edge asks for, the first wins; INFERRED across files."""
    kinds = F.when(F.col("type") == "Event", "emits_event").when(F.col("type") == "Modifier", "has_modifier").when(F.col("type") == "Mapping", "writes_mapping")
    key = F.when(F.col("type") == "Mapping", F.concat("name", F.lit(":mapping"))).otherwise(F.col("name"))
    index = nodes.where(F.col("type").isin(*SOL_KINDS)).groupBy(kinds.alias("edge_type"), key.alias("target_qname")).agg(F.min(F.struct("file_ord", "ord", "id", "file_path")).alias("x"))
    index = index.select("edge_type", "target_qname", F.col("x.id").alias("dst"), F.col("x.file_path").alias("dst_file"))
    src = nodes.select(F.col("id").alias("src_id"), F.col("file_path").alias("src_file"))
    j = pending.join(index, ["edge_type", "target_qname"]).join(src, "src_id", "left")
    return _edges(j, "dst", F.when(F.col("src_file").eqNullSafe(F.col("dst_file")), "EXTRACTED").otherwise("INFERRED"))


def abi(nodes: DataFrame) -> DataFrame:
    """id, contract, function: every function of a Solidity file belongs to the last contract that begins
    before it; functions before any contract have none.  One window per file."""
    w = Window.partitionBy("file_path").orderBy("start_byte", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.where("language = 'sol' and type in ('Contract', 'Function')").withColumn("contract", F.last(F.when(F.col("type") == "Contract", F.col("name")), ignorenulls=True).over(w))
    return own.where("type = 'Function' and contract is not null").select("id", "contract", F.col("name").alias("function"))


def link_contracts(nodes: DataFrame) -> DataFrame:
    """binds_to edges from each contract to the class of its name whose path hints most at generated
    bindings, ties to the smallest id."""
    contracts = nodes.where("type = 'Contract' and language = 'sol'").select(F.col("id").alias("src"), "name")
    p = F.lower("file_path")
    hints = sum((F.contains(p, F.lit(h)).cast("int") for h in BINDING_HINTS), F.lit(0))
    classes = nodes.where("type = 'Class' and language = 'ts'").groupBy("name").agg(F.min(F.struct((-hints).alias("h"), F.col("id"))).alias("x")).select("name", F.col("x.id").alias("dst"))
    return contracts.join(classes, "name").select("src", "dst", F.lit("binds_to").alias("type"), F.lit(1).alias("count"), F.lit("INFERRED").alias("confidence"))
