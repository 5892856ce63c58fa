"""Mixing sources to target weights, interleaved by proportionate-fair scheduling.

The mixture is as large as the caps allow with every share met: no source is asked for more than
its tokens times its cap.  A source is read in passes over its documents in a fixed pseudo-random
order; all documents are used equally often, except that the last pass stops at the source's quota.

The interleaving gives each source blocks of equal size.  Block k of a source with weight w may
start from slot floor(k / w) on and must be placed before slot ceil((k + 1) / w); each slot takes
the released block with the earliest deadline.  Every prefix of the mixture then holds each source
to less than one block of its target.  The schedule has ``n_blocks`` entries (plus one per source
at most), whatever the size of the data, so it is made by the driver and broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bpe
from loomgraph.operators import skew
from loomgraph.session import Scratch

N_BLOCKS = 4096
#: Sources of a target table; it is a parameter of the mixture and read by the driver.
MAX_SOURCES = 10_000


def schedule(weights: Mapping[str, float], blocks: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) for ``blocks[s]`` blocks of each source, earliest deadline first among
    the released ones.  Ties go to the source that comes first by name."""
    total = sum(weights[s] for s in blocks)
    w = {s: weights[s] / total for s in blocks}
    # exact enough: a tiny slack keeps k / w of whole numbers from falling below them
    release = lambda s, k: math.floor(k / w[s] + 1e-9)
    deadline = lambda s, k: math.ceil((k + 1) / w[s] - 1e-9)
    waiting = [(release(s, 0), s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out, slot = [], 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, k), s, k))
        if ready:
            _, s, k = heapq.heappop(ready)
            out.append((s, k, slot))
            if k + 1 < blocks[s]:
                heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
        slot += 1
    return out


def targets_of(df: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, cap), sources without case and outer blanks; rows without source, with a
    null or non-positive share or cap are no targets; of repeated sources shares add up and the
    smallest cap holds."""
    got = df.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share"), F.min("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    return {s: (w, m) for s, w, m in sorted(got)}


class Mixture:
    """The plan of a mixture: sizes, quotas and schedule; ``documents`` and ``shares`` use it."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_blocks: int = N_BLOCKS):
        self.spark, self.key = docs.sparkSession, key
        self.targets = targets_of(targets)
        scratch = Scratch(self.spark, "mix")
        named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lower(F.trim(F.col(source))).alias("source"))
        known = named.where(F.col("source").isin(*self.targets)) if self.targets else named.limit(0)
        # texts without tokens have no size and can't be used
        self.sized = scratch.save(bpe.encode(known, "id", "text", counts_only=True, keep=("source",)).where("n_tokens > 0"))
        self.tokens = {r.source: (r.t, r.n) for r in self.sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
        present = {s: w for s, (w, _) in self.targets.items() if s in self.tokens}
        total = sum(present.values())
        self.weights = {s: w / total for s, w in present.items()}
        self.total = min((self.tokens[s][0] * self.targets[s][1] / w for s, w in self.weights.items()), default=0.0)
        self.block = max(1.0, self.total / n_blocks)
        self.quota = {s: min(w * self.total, float(self.tokens[s][0] * self.targets[s][1])) for s, w in self.weights.items()}
        self.passes = {s: int((q + 1e-6) // self.tokens[s][0]) for s, q in self.quota.items()}
        self.blocks = {s: max(1, math.ceil(q / self.block - 1e-9)) for s, q in self.quota.items()}

    def documents(self) -> DataFrame:
        """One row per use: slot, source, position (tokens of the source before it), key, copy
        (from 0) and n_tokens."""
        plan = self.spark.createDataFrame([(s, float(self.quota[s]), self.passes[s], self.tokens[s][0]) for s in self.weights], "source string, quota double, passes int, of bigint")
        slots = self.spark.createDataFrame(schedule(self.weights, self.blocks), "source string, block bigint, slot bigint")
        ordered = self.sized.withColumn("h", F.xxhash64("id", F.lit("mix")))
        run = skew.running(ordered, ["source"], ["h", "id"], "n_tokens")
        used = run.join(F.broadcast(plan), "source").withColumn("copies", F.col("passes") + (F.col("running_sum") + F.col("passes") * F.col("of") <= F.col("quota") + 1e-6).cast("int"))
        each = used.where("copies > 0").select("source", "id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "running_sum", "of")
        each = each.withColumn("position", F.col("copy") * F.col("of") + F.col("running_sum") - F.col("n_tokens")).withColumn("block", F.floor(F.col("position") / F.lit(self.block)))
        return each.join(F.broadcast(slots), ["source", "block"]).select("slot", "source", "position", F.col("id").alias(self.key), "copy", "n_tokens")

    def shares(self) -> DataFrame:
        """One row per target source: source, target_share, actual_share, n_documents (distinct),
        n_uses, n_tokens, most_uses and max_repeats; a source without documents has zeros."""
        made = self.documents().groupBy("source", self.key).agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("t"))
        per = {r.source: r for r in made.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"), F.sum("t").alias("t"), F.max("uses").alias("most")).collect()}
        all_tokens = sum(r.t for r in per.values()) or 1
        rows = [(s, w, per[s].t / all_tokens, per[s].n, per[s].uses, per[s].t, per[s].most, m) if s in per else (s, w, 0.0, 0, 0, 0, 0, m) for s, (w, m) in self.targets.items()]
        return self.spark.createDataFrame(rows, "source string, target_share double, actual_share double, n_documents bigint, n_uses bigint, n_tokens bigint, most_uses bigint, max_repeats int")
