"""Scan of a source tree: files, languages, ignore rules, order, and source slices of nodes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.expr import basename, language_of


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """file_path (relative), content (binary), modified: every file below ``root``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace("path", r"^file:/*", "/")
    return df.select(F.substring(path, F.lit(len(base) + 2), F.length(path)).alias("file_path"), "content", F.col("modificationTime").alias("modified"))


def walk_order(path: str | Column = "file_path") -> Column:
    """Sort key of a walk that goes folder by folder: parts compare one by one."""
    return F.split(path if isinstance(path, Column) else F.col(path), "/")


def source_files(files: DataFrame, ignore: Sequence[str] = (), languages: Sequence[str] | None = None) -> DataFrame:
    """Files of the known languages that no ignore pattern matches, with ``language`` by extension.
    The filters run before any content is read."""
    out = files.withColumn("language", language_of("file_path")).where("language is not null")
    if languages:
        out = out.where(F.col("language").isin(*languages))
    if ignore:
        out = out.where(~ignored(F.col("file_path"), ignore))
    return out


def parse_ignore(text: str | None) -> list[str]:
    """Patterns of an ignore file: blank lines and lines that begin with # are none."""
    return [x.strip() for x in (text or "").splitlines() if x.strip() and not x.strip().startswith("#")]


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[:1] in "^!" else body) + "]"
            i = j
        else:
            out += re.escape(ch)
        i += 1
    return f"^{out}$"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """'dir/' matches below a folder at the root (or the folder itself); others match the base name
    or the whole path as globs whose * stops at a slash."""
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            hit = hit | F.startswith(path, F.lit(p)) | (path == p[:-1])
        else:
            g = _glob(p)
            hit = hit | basename(path).rlike(g) | path.rlike(g)
    return hit


def blobs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """node_id, source: the bytes [start_byte, end_byte) of each node's file; packages, empty spans
    and spans beyond the file have none.  ``files``: file_path, content (binary), one row per path."""
    n = nodes.where("type <> 'Package' and start_byte >= 0 and end_byte > start_byte")
    # a file's spans meet its content once; only the slices go on
    spans = n.groupBy("file_path").agg(F.collect_list(F.struct("id", "start_byte", "end_byte")).alias("spans"))
    j = spans.join(files.select("file_path", "content"), "file_path")
    cut = F.expr("transform(filter(spans, x -> x.end_byte <= octet_length(content)), x -> struct(x.id as node_id, substring(content, x.start_byte + 1, x.end_byte - x.start_byte) as source))")
    return j.select(F.inline(cut))


def fingerprint(files: DataFrame, limit: int = 5) -> DataFrame:
    """files (first ``limit`` in walk order) and the sum of their modification times in ns."""
    first = files.orderBy(walk_order()).limit(limit)
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', modified)") if dict(files.dtypes)["modified"] == "timestamp_ntz" else F.unix_micros("modified")
    return first.agg(F.sort_array(F.collect_list("file_path")).alias("files"), F.sum(micros * 1000).alias("mtime_sum"))


def dump(files: DataFrame, limit: int = 5, size: int = 4000) -> DataFrame:
    """The first files in walk order, cut to ``size`` bytes."""
    return files.orderBy(walk_order()).limit(limit).select("file_path", F.expr(f"substring(content, 1, {int(size)})").alias("content"))
