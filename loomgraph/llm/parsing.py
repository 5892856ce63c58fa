"""Source files that do not parse: refused files, and rates per repository and language."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.syntax.parser import first_error
from loomgraph.parse.lex import EXTENSIONS, extension


def _checked(files: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, language (by extension) and error_line (0: accepted) of each file with a known
    extension and a content that isn't null."""
    n = len(keep)
    kinds = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", language string, error_line int"

    def run(batches):
        for b in batches:
            rows, langs, lines = [], [], []
            for i, (p, c) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)):
                ext = extension(p)
                if ext is None or c is None:
                    continue
                rows.append(i)
                langs.append(EXTENSIONS[ext][0])
                lines.append(first_error(p, c) or 0)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(x).take(at) for x in range(n)] + [pa.array(langs, pa.string()), pa.array(lines, pa.int32())], names=[*keep, "language", "error_line"])

    return files.select(*keep, F.col("file_path").alias("_path"), F.col("content").alias("_content")).mapInArrow(run, schema)


def refused(files: DataFrame) -> DataFrame:
    """file_id, language, error_line of the files that the grammar of their extension refuses, one row
    for each row of ``files`` that is refused.  Files of other extensions and null contents are none."""
    return _checked(files, ("file_id",)).where("error_line > 0")


def rates(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per repository and language: n_files, n_refused, rate; and reported_errors, what manifest says
    of the repository (the largest value of a repeated key, null where it is missing or no number).
    A file that comes again counts once."""
    one = _checked(files, ("file_id", "repo")).distinct()
    per = one.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum((F.col("error_line") > 0).cast("bigint")).alias("n_refused"))
    said = manifest.where("key = 'parse_errors_count'").groupBy(F.col("repo").alias("_repo")).agg(F.max(F.expr("try_cast(value as bigint)")).alias("reported_errors"))
    return per.join(said, per.repo.eqNullSafe(said._repo), "left").select("repo", "language", "n_files", "n_refused", F.round(F.col("n_refused") / F.col("n_files"), 6).alias("rate"), "reported_errors")
