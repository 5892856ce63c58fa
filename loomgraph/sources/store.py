"""The persisted graph: Parquet tables, manifest, chunked export, and their readers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import lookup
from loomgraph.schema import BLOBS_DDL, EDGES_DDL, MANIFEST_KEYS, NODES_DDL, PKG_TREE_DDL, TOPIC_TREE_DDL
from loomgraph.session import Scratch

TABLES = {"nodes": NODES_DDL, "edges": EDGES_DDL, "pkg_tree": PKG_TREE_DDL, "topic_tree": TOPIC_TREE_DDL, "blobs": BLOBS_DDL, "postings": "token STRING, id STRING, col STRING, pos INT"}
#: Manifest keys whose values are JSON or numbers, with their types; all others are text.
MANIFEST_JSON = {"staleness_files": "array<string>", "languages": "map<string,int>", "stats": "map<string,bigint>", "ckgignore": "array<string>", "staleness_mtime_sum": "bigint", "parse_errors_count": "bigint", "unresolved_refs_count": "bigint"}
NODE_CHUNK, EDGE_CHUNK = 5000, 10_000


def save(out: str, tables: Mapping[str, DataFrame], manifest: Mapping[str, object] | None = None) -> None:
    """Write tables anew; nodes are sorted by id, postings by token, so that readers skip row groups."""
    order = {"nodes": ["id"], "edges": ["src"], "postings": ["token"], "pkg_tree": ["parent_id"]}
    for name, df in tables.items():
        if name in order:
            df = df.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    if manifest is not None:
        spark = next(iter(tables.values())).sparkSession
        put_text(spark, f"{out}/manifest.json", json.dumps(manifest, indent=2, ensure_ascii=False))


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``, each row's number from 0 in ``order``: a range-partitioned sort, written once,
    then the rows of earlier partitions added; no task sees all rows.  Rows tied in ``order`` are told
    apart arbitrarily, but once for all."""
    ordered = Scratch(df.sparkSession, "numbers").save(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for p, n in sorted(ordered.groupBy(part.alias("p")).count().collect()):  # one row per partition
        before.append((p, total))
        total += n
    first = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    return ordered.withColumn("_part", part.cast("bigint")).join(F.broadcast(first), "_part").withColumn(name, F.col("_before") + row).drop("_at", "_part", "_before")


def number_edges(edges: DataFrame) -> DataFrame:
    """Surrogate ids from 1 in the order of (src, dst, type, line) and the other columns."""
    rest = [c for c in edges.columns if c not in ("id", "src", "dst", "type", "line")]
    return numbered(edges.drop("id"), ["src", "dst", "type", "line", *rest], "_n").withColumn("id", F.col("_n") + 1).select(*edges.columns)


def chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with ``chunk``, the number of their file when each holds ``size`` rows in the order of
    ``key`` (distinct values)."""
    return numbered(df, [key], "_n").withColumn("chunk", F.floor(F.col("_n") / size).cast("int")).drop("_n")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, on whatever file system the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def uri_of(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark resolves it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def _writer(uri: str, name, body):
    """For foreachPartition: each row becomes a file below ``uri``, on the file system that it names."""

    def put(rows):
        fs, base = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{base}/{name(r)}") as f:
                f.write(body(r))

    return put


def export(out: str, nodes: DataFrame, edges: DataFrame, pkg: DataFrame, topic: DataFrame, blobs: DataFrame, manifest: Mapping[str, object]) -> None:
    """A folder a static viewer can read: manifest, both hierarchies as JSON arrays, nodes and edges in
    numbered JSON chunks, one text file per blob.

    The tasks that hold the rows write the files to the file system of ``out``.  A hierarchy is an array in
    parts of ``EDGE_CHUNK`` rows, numbered from the second on."""
    spark = nodes.sparkSession
    uri = uri_of(spark, out)
    put_text(spark, f"{out}/manifest.json", json.dumps(manifest, indent=2, ensure_ascii=False))

    def write(folder, df, order, size, name):
        body = F.to_json(F.struct(*df.columns))
        at = numbered(df, order, "_n").withColumn("chunk", F.floor(F.col("_n") / size).cast("int"))
        per = at.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("_n", body.alias("j")))).alias("rows"))  # at most ``size`` rows
        per = per.select("chunk", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["j"]), ",\n"), F.lit("]\n")).alias("body"))
        per.foreachPartition(_writer(f"{uri}/{folder}", lambda r: name(r.chunk), lambda r: r.body.encode("utf-8")))

    write("nodes", nodes, ["id"], NODE_CHUNK, lambda k: f"chunk_{k:04d}.json")
    write("edges", edges, ["id"], EDGE_CHUNK, lambda k: f"chunk_{k:04d}.json")
    for kind, tree in (("pkg", pkg), ("topic", topic)):
        write("hierarchy", tree, ["parent_id", "child_id"], EDGE_CHUNK, lambda k, kind=kind: f"{kind}_tree_{k:04d}.json" if k else f"{kind}_tree.json")
    blobs.foreachPartition(_writer(f"{uri}/blobs", lambda r: f"{r.node_id}.txt", lambda r: bytes(r.source)))


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes or edges of an exported folder."""
    return spark.read.schema(TABLES[kind]).json(f"{path}/{kind}/*.json", multiLine=True)


def is_static(spark: SparkSession, path: str) -> bool:
    """Is the folder an export, as against a persisted graph?"""
    return exists(spark, f"{path}/manifest.json") and exists(spark, f"{path}/hierarchy")


class Export:
    """Queries over an exported folder: roots, children, hierarchy, nodes and edges by id; search finds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.nodes, self.edges = read_export(spark, path, "nodes"), read_export(spark, path, "edges")
        self.manifest = json.loads(get_text(spark, f"{path}/manifest.json"))

    def hierarchy(self, kind: str = "pkg") -> DataFrame:
        tree = self.spark.read.schema(TABLES[f"{kind}_tree"]).json(f"{self.path}/hierarchy/{kind}_tree*.json", multiLine=True)
        return lookup.hierarchy(kind, tree)

    def children(self, parent: str = "", limit: int = 5000) -> DataFrame:
        return lookup.children_of(self.nodes, self.hierarchy("pkg"), parent, limit) if parent else lookup.roots(self.nodes, limit)

    def nodes_by_ids(self, ids: Sequence[str]) -> DataFrame:
        return self.nodes.where(F.col("id").isin(list(ids)))

    def edges_of(self, ids: Sequence[str]) -> DataFrame:
        return self.edges.where(F.col("src").isin(list(ids)) | F.col("dst").isin(list(ids)))

    def search(self, text: str) -> DataFrame:
        return self.nodes.limit(0)


def manifest_rows(spark: SparkSession, manifest: Mapping[str, object]) -> DataFrame:
    """Key-value rows of a manifest: JSON for what isn't text."""
    rows = [(k, manifest[k] if isinstance(manifest[k], str) else json.dumps(manifest[k], ensure_ascii=False)) for k in MANIFEST_KEYS if k in manifest]
    return spark.createDataFrame(rows, "key string, value string")


def read_manifest(kv: DataFrame, group: str | None = "repo") -> DataFrame:
    """One typed row per group from key-value rows.  A repeated key takes its greatest value; missing
    keys, null values and values that don't read as their type are null; other keys are ignored."""
    first = kv.groupBy(*([group] if group else [])).pivot("key", MANIFEST_KEYS).agg(F.max("value"))
    typed = []
    for k in MANIFEST_KEYS:
        t = MANIFEST_JSON.get(k)
        col = F.col(k)
        typed.append((F.expr(f"try_cast({k} as bigint)") if t == "bigint" else F.from_json(col, t) if t else col).alias(k))
    return first.select(*([group] if group else []), *typed)


def staleness(manifest: DataFrame, current_commit: str | None, mtime_sum: int | None = None) -> DataFrame:
    """graph_stale: by git, if the commit differs; by mtime, if the fingerprint's sum differs."""
    git = (F.col("staleness_method") == "git") & (F.coalesce("src_commit", F.lit("")) != F.lit(current_commit or ""))
    mtime = (F.col("staleness_method") == "mtime") & (F.lit(mtime_sum is not None) & (F.coalesce("staleness_mtime_sum", F.lit(0)) != F.lit(mtime_sum or 0)))
    return manifest.withColumn("current_commit", F.lit(current_commit)).withColumn("graph_stale", F.coalesce(git | mtime, F.lit(False)))


def ranked_first(df: DataFrame, part: str, *order) -> DataFrame:
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
