"""Session settings and the shared scratch area used to cut lineage.

Iterative operators write each intermediate result once to the folder that all executors
share and read it back.  The folder is taken from ``spark.checkpoint.dir``; only where that
is unset (tests on one machine) a local one is made.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and ``bench.py``."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("loomgraph").config("spark.driver.memory", memory)
    for k, v in {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(cpus), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``, else the
    context's checkpoint folder, else (local master only) a new temporary one."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomgraph-")
    atexit.register(shutil.rmtree, made, True)
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Intermediate tables of one operator run.

    ``save`` writes a DataFrame as Parquet and returns it read back, so later steps neither
    recompute it nor depend on executors that held it.  ``drop`` removes a table that no later
    step reads.  What a returned lazy result still reads stays until the session ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.n = spark, 0
        self.base = f"{shared_dir(spark).rstrip('/')}/loom-{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def measured(self, df: DataFrame, **aggs: Column) -> tuple[DataFrame, dict]:
        """``save``, and aggregates over the rows taken while they are written, without a job of their own."""
        seen = Observation()
        out = self.save(df.observe(seen, *[a.alias(k) for k, a in aggs.items()]))
        return out, seen.get

    def together(self, dfs: Sequence[DataFrame]) -> DataFrame:
        """The rows of several saved tables of one schema, in one scan."""
        return self.spark.read.schema(dfs[0].schema).parquet(*[df._loom_path for df in dfs])

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_loom_path", None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is None:
                return
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may already be gone
            local = path.removeprefix("file://").removeprefix("file:")
            if os.path.isdir(local):
                shutil.rmtree(local, True)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, where their path doesn't lead to it already (it does
    if the repository is in PYTHONPATH or is the working directory of a local session)."""
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in paths or spark.sparkContext.master.startswith("local[") and Path.cwd() == root:
        return
    if any("loomgraph-code" in str(f) for f in spark.sparkContext._python_includes):
        return
    made = tempfile.mkdtemp(prefix="loomgraph-code-")
    atexit.register(shutil.rmtree, made, True)
    target = f"{made}/loomgraph-code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "loomgraph").rglob("*")):
            if f.suffix in (".py", ".txt", ".json"):
                z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(target)  # the driver serves it to every executor
