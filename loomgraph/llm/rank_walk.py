"""One ranking out of several scores on unlike scales: a random walk over ranks.

From an item the walk picks a score (by weight, equal by default) and jumps uniformly to an item
that this score ranks at least as high; with probability 1 - damping it starts anew anywhere.  Items
are ordered by their stationary probability.  Only ranks enter, so no score decides by its range.

All distinct values of every score count.  Items of equal scores are one state.  The states lie in
blocks, cut and sorted by the score with most distinct values; a step sends each block's total
along and adds prefix sums within blocks, so no task sees all states.  The other scores' inflows, one
number per distinct value, are summed over blocks and sent to the tasks with each step.  That is for
scores of at most ``DRIVER_VALUES`` distinct values in all: counts have few, as D of them that differ sum
to D (D - 1) / 2 at least, so a trillion edges give at most 1.5 million different degrees.  Where the other
scores have more, each step groups, prefix-sums and joins every score's values in blocks of their own, and
the driver holds one number per block.  Both are the same walk.  Items of equal probability are ordered by
their mean place among the known values of their scores, then by id.

With ``levels`` given, the walk sees a score only through so many rank levels, cut at sampled
quantiles; that is another, coarser walk, which iterates over 4 x levels numbers on the driver.

Unknown scores (null, NaN, below 0) are neutral: by such a score an item receives the mean inflow,
and the walk leaves it uniformly to any item.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import Scratch

#: States that one block may hold, about 20 MB.
BLOCK = 200_000
#: Distinct values of all scores but the widest that the driver may hold, 32 MB.
DRIVER_VALUES = 4_000_000
DAMPING = 0.85
TOLERANCE = 1e-12
MAX_STEPS = 500


def newest(df: DataFrame, key: str, at: str, cols: Sequence[str]) -> DataFrame:
    """One row per non-null ``key``: the columns of the row with the latest ``at`` (a null ``at`` is
    oldest); where several rows are latest, the one greatest in the order of ``cols``."""
    pick = F.max(F.struct(F.col(at).alias("_at"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(pick).select(F.col("_key").alias(key), *[F.col(f"_r._{i}").alias(c) for i, c in enumerate(cols)])


def known(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(None).cast("double")).otherwise(x)


def stationary(counts: dict[tuple[int, int], np.ndarray], single: list[np.ndarray], weights: Sequence[float], damping: float = DAMPING) -> list[np.ndarray]:
    """Per score the inflow g[level] of an item (last entry: unknown), summing over scores, with the
    restart mass, to its stationary probability.

    single[s][l]: items on level l of score s, the last entry those unknown.
    counts[s, t]: array of (l, m, n), n items on level l of s and m of t, for s < t.
    """
    n = float(single[0].sum())
    k = len(single)
    share = [w / sum(weights) for w in weights]
    higher = [np.cumsum(c[:-1][::-1])[::-1] for c in single]
    mass = [c / n for c in single]
    g = [np.zeros_like(c, dtype=float) for c in single]
    for _ in range(MAX_STEPS):
        for s in range(k):
            m, c = mass[s], single[s]
            unknown = c[-1] / n
            flow = np.divide(m[:-1] * (1 - unknown), higher[s], out=np.zeros(len(c) - 1), where=higher[s] > 0)
            inflow = np.append(np.cumsum(flow), m[:-1].sum() / n) + m[-1] / n
            g[s] = damping * share[s] * inflow
        restart = (1 - damping) / n
        new = [single[s] * (g[s] + restart) for s in range(k)]
        for (s, t), cells in counts.items():
            a, b, x = cells
            new[s] += np.bincount(a, weights=x * g[t][b], minlength=len(new[s]))
            new[t] += np.bincount(b, weights=x * g[s][a], minlength=len(new[t]))
        moved = max(np.abs(x - y).sum() for x, y in zip(new, mass, strict=True))
        mass = new
        if moved < TOLERANCE:
            break
    return g


def _blocks(states: DataFrame, main: int, rest: Sequence[int], values: dict[int, np.ndarray], spark) -> DataFrame:
    """One row per block of states, ordered by score ``main``: arrays as bytes."""
    n = states.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // BLOCK))
    ordered = states.repartitionByRange(parts, f"s{main}").sortWithinPartitions(f"s{main}")

    def pack(frames):
        all_ = [f for f in frames if len(f)]
        if not all_:
            return
        f = pd.concat(all_)
        v, n = f[f"s{main}"].to_numpy(dtype=float), f["n"].to_numpy(dtype=float)
        gone = np.isnan(v)
        # a block of its own for the unknown, which has no place in the order
        for part, at in ((0, gone), (1, ~gone)):
            if not at.any():
                continue
            u, w = np.unique(v[at], return_inverse=True) if part else (np.array([-1.0]), np.zeros(int(at.sum()), dtype=int))
            out = {"low": [u[0]], "value": [u.tobytes()], "w": [w.astype("int32").tobytes()], "n": [n[at].tobytes()], "items": [n[at].sum()]}
            for t in rest:
                x = f[f"s{t}"].to_numpy(dtype=float)[at]
                out[f"o{t}"] = [np.where(np.isnan(x), len(values[t]), np.searchsorted(values[t], x)).astype("int32").tobytes()]
            yield pd.DataFrame({**out, "g": [np.zeros(len(u)).tobytes()], "m": [np.zeros(len(u)).tobytes()], "total": [0.0], "mass": [0.0], "moved": [0.0], "sums": [b""]})

    cols = ", ".join(f"o{t} binary" for t in rest)
    return ordered.mapInPandas(pack, f"low double, value binary, w binary, n binary, items double, {cols + ', ' if cols else ''}g binary, m binary, total double, mass double, moved double, sums binary")


def _chain(base: DataFrame, k: int, weights: Sequence[float], damping: float, scratch: Scratch, driver_values: int = DRIVER_VALUES) -> DataFrame:
    """s0.., p, place of each distinct combination of scores, by the chain over all values."""
    spark = base.sparkSession
    cols = [f"s{i}" for i in range(k)]
    states = scratch.save(base.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")))
    wide = states.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    main = max(range(k), key=lambda i: wide[i])
    rest = [i for i in range(k) if i != main]
    if sum(wide[i] for i in rest) > driver_values:
        return _chain_joins(states, k, weights, damping, scratch)
    share = [w / sum(weights) for w in weights]
    values, single = {}, {}
    for t in rest:
        rows = states.groupBy(f"s{t}").agg(F.sum("n").alias("n")).toPandas()
        v, c = rows[f"s{t}"].to_numpy(dtype=float), rows["n"].to_numpy(dtype=float)
        known_, order = ~np.isnan(v), np.argsort(v)
        values[t] = v[order][: int(known_.sum())]
        single[t] = np.append(c[order][: int(known_.sum())], c[~known_].sum())
    blocks = scratch.save(_blocks(states, main, rest, values, spark))
    heads = sorted((r.low, r.items) for r in blocks.select("low", "items").collect())  # one row per block
    n = sum(x for _, x in heads)
    n_known = sum(x for low, x in heads if low >= 0)
    above, left = {}, n_known
    for low, x in heads:
        if low >= 0:
            left -= x
            above[low] = left
    restart = (1 - damping) / n
    # what each item receives: start from the uniform distribution
    inflow = {t: np.zeros(len(single[t])) for t in rest}
    start, lone, first = dict.fromkeys(above, 0.0), 0.0, True

    def arrays(r):
        return np.frombuffer(r.w, "int32"), np.frombuffer(r.n), [np.frombuffer(getattr(r, f"o{t}"), "int32") for t in rest]

    def probability(r, w, others, inflow, start, lone):
        p = np.full(len(w), restart)
        p += lone if r.low < 0 else start[r.low] + np.frombuffer(r.g)[w]
        for t, o in zip(rest, others, strict=True):
            p += inflow[t][o]
        return p

    def higher_of(r, w, c):
        return above[r.low] + np.cumsum(np.bincount(w, c)[::-1])[::-1]

    def step(inflow, start, lone, first):
        def run(frames):
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    w, c, others = arrays(r)
                    mass = c * (np.full(len(w), 1 / n) if first else probability(r, w, others, inflow, start, lone))
                    m = np.bincount(w, mass)
                    g, total = np.zeros(len(m)), 0.0
                    if r.low >= 0:
                        g = damping * share[main] * np.cumsum(m * (n_known / n) / higher_of(r, w, c))
                        total = float(g[-1])
                    sums = np.concatenate([np.bincount(o, mass, len(single[t])) for t, o in zip(rest, others, strict=True)] or [np.zeros(0)])
                    out.append(r._replace(g=g.tobytes(), m=m.tobytes(), total=total, mass=float(m.sum()), moved=float(np.abs(m - np.frombuffer(r.m)).sum()), sums=sums.tobytes()))
                yield pd.DataFrame(out, columns=f.columns)

        return run

    old = {t: np.zeros(len(single[t])) for t in rest}
    for _ in range(MAX_STEPS):
        done = scratch.save(blocks.mapInPandas(step(inflow, start, lone, first), blocks.schema))
        scratch.drop(blocks)
        blocks, first = done, False
        told = sorted(blocks.select("low", "total", "mass", "moved", "sums").collect())  # one row per block
        unknown = sum(x.mass for x in told if x.low < 0)
        everywhere, at, start = damping * share[main] * unknown / n, 0.0, {}
        for x in told:
            if x.low >= 0:
                start[x.low] = everywhere + at
                at += x.total
        lone = everywhere + damping * share[main] * sum(x.mass for x in told if x.low >= 0) / n
        sums = np.sum([np.frombuffer(x.sums) for x in told], axis=0)
        moved, cut = sum(x.moved for x in told), 0
        for t in rest:
            c = single[t]
            m, cut = sums[cut : cut + len(c)], cut + len(c)
            higher = np.cumsum(c[:-1][::-1])[::-1]
            inflow[t] = damping * share[t] * (np.append(np.cumsum(m[:-1] * (1 - c[-1] / n) / higher), m[:-1].sum() / n) + m[-1] / n)
            moved, old[t] = max(moved, np.abs(m - old[t]).sum()), m
        if moved < TOLERANCE:
            break

    def finish(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                w, c, others = arrays(r)
                p = probability(r, w, others, inflow, start, lone)
                place, seen, out = np.zeros(len(w)), np.zeros(len(w)), {}
                if r.low >= 0:
                    place, seen = place + 1 - higher_of(r, w, c)[w] / n_known, seen + 1
                out[f"s{main}"] = np.frombuffer(r.value)[w] if r.low >= 0 else np.full(len(w), -1.0)
                for t, o in zip(rest, others, strict=True):
                    size, v = single[t], np.append(values[t], -1.0)
                    up = np.append(np.cumsum(size[:-1][::-1])[::-1] / max(size[:-1].sum(), 1), 1.0)
                    place, seen = place + 1 - up[o], seen + (o < len(size) - 1)
                    out[f"s{t}"] = v[o]
                # the last bits depend on the order of sums
                out["p"] = [float(f"{x:.10e}") for x in p]
                out["place"] = np.where(seen > 0, place / np.maximum(seen, 1), 0.5)
                yield pd.DataFrame(out)[[*cols, "p", "place"]]

    return blocks.mapInPandas(finish, ", ".join(f"{c} double" for c in [*cols, "p", "place"]))


def _higher(c: str, later: dict[int, float]):
    """For a block's values: the items at least as high, those of later blocks included."""

    def run(f):
        f = f.sort_values(c)
        return f.assign(higher=f["c"].to_numpy()[::-1].cumsum()[::-1] + later[f["blk"].iloc[0]])

    return run


def _flow(c: str, part: float):
    """For a block's values: the prefix sums of what each hands to an item above it."""

    def run(f):
        f = f.sort_values(c)
        return f[[c, "blk"]].assign(g=(f["m"] * part / f["higher"]).cumsum())

    return run


def _chain_joins(states: DataFrame, k: int, weights: Sequence[float], damping: float, scratch: Scratch) -> DataFrame:
    """``_chain`` for scores of any number of distinct values: nothing but block totals reaches the driver."""
    cols = [f"s{i}" for i in range(k)]
    share = [w / sum(weights) for w in weights]
    n = states.agg(F.sum("n")).first()[0]
    values, unknown_items = [], []
    for c in cols:
        own = states.groupBy(c).agg(F.sum("n").cast("double").alias("c"))
        gone = own.where(F.col(c).isNull()).first()
        unknown_items.append(gone.c if gone else 0.0)
        known_ = scratch.save(own.where(F.col(c).isNotNull()))
        parts = max(1, -(-known_.count() // BLOCK))
        blocks = scratch.save(known_.repartitionByRange(parts, c).withColumn("blk", F.spark_partition_id()))
        later, total = {}, 0.0
        for r in sorted(blocks.groupBy("blk").agg(F.sum("c").alias("c")).collect(), reverse=True):  # one row per block
            later[r.blk], total = total, total + r.c

        values.append(scratch.save(blocks.groupBy("blk").applyInPandas(_higher(c, later), f"{c} double, c double, blk int, higher double")))
    restart = (1 - damping) / n
    state = scratch.save(states.withColumn("p", F.lit(1.0 / n)))
    for _ in range(MAX_STEPS):
        out = state.withColumnRenamed("p", "old").withColumn("p", F.lit(restart))
        for i, c in enumerate(cols):
            mass = scratch.save(state.groupBy(c).agg(F.sum(F.col("n") * F.col("p")).alias("m")))
            gone = mass.where(F.col(c).isNull()).first()
            lone = gone.m if gone else 0.0

            sums = scratch.save(values[i].join(mass, c).groupBy("blk").applyInPandas(_flow(c, 1 - unknown_items[i] / n), f"{c} double, blk int, g double"))
            start, at = [], lone / n
            for r in sorted(sums.groupBy("blk").agg(F.max("g").alias("g")).collect()):  # one row per block
                start.append((r.blk, at))
                at += r.g
            first = state.sparkSession.createDataFrame(start, "blk int, start double")
            scale = damping * share[i]
            got = sums.join(F.broadcast(first), "blk").select(c, (F.lit(scale) * (F.col("g") + F.col("start"))).alias("_g"))
            # the mass of all known values and of the unknown reaches the unknown evenly
            out = out.join(got, c, "left").withColumn("p", F.col("p") + F.coalesce("_g", F.lit(scale / n))).drop("_g")
        new, seen = scratch.measured(out.select(*cols, "n", "p", "old"), moved=F.sum(F.col("n") * F.abs(F.col("p") - F.col("old"))))
        scratch.drop(state)
        state = new.drop("old")
        if seen["moved"] < TOLERANCE:
            break
    out, place, seen = state, F.lit(0.0), F.lit(0)
    for i, c in enumerate(cols):
        out = out.join(values[i].select(c, F.col("higher").alias(f"_h{i}")), c, "left")
        place = place + F.coalesce(1 - F.col(f"_h{i}") / F.lit(max(n - unknown_items[i], 1.0)), F.lit(0.0))
        seen = seen + F.col(c).isNotNull().cast("int")
    mean = F.when(seen > 0, place / seen).otherwise(0.5)
    return out.select(*[F.coalesce(c, F.lit(-1.0)).alias(c) for c in cols], F.format_string("%.10e", "p").cast("double").alias("p"), mean.alias("place"))


def rank(items: DataFrame, key: str, scores: Sequence[str], weights: Sequence[float] | None = None, levels: int | None = None, damping: float = DAMPING, driver_values: int = DRIVER_VALUES) -> DataFrame:
    """``key``, ``probability`` and ``rank`` (1 is best, no rank twice) for each row of ``items``,
    whose keys are distinct and not null.  An empty table gives no rows; with all scores unknown all
    items are equal and the key decides."""
    spark = items.sparkSession
    scratch = Scratch(spark, "rankwalk")
    k = len(scores)
    weights = list(weights or [1.0] * k)
    base = scratch.save(items.select(F.col(key).alias("id"), *[known(c).alias(f"s{i}") for i, c in enumerate(scores)]))
    if not base.limit(1).count():
        return base.select(F.col("id").alias(key), F.lit(0.0).alias("probability"), F.lit(0).cast("bigint").alias("rank"))
    if levels is None:
        cols = [f"s{i}" for i in range(k)]
        items_ = base.select("id", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in cols])
        return _numbered(items_.join(_chain(base, k, weights, damping, scratch, driver_values), cols).select("id", "p", "place"), key, scratch)
    at = [(j + 1) / levels for j in range(levels - 1)]
    cuts = base.agg(*[F.percentile_approx(f"s{i}", at, 10_000).alias(f"s{i}") for i in range(k)]).first()
    bounds = [np.unique(np.array(cuts[i] or [], dtype=float)) for i in range(k)]
    names = [f"l{i}" for i in range(k)]

    def level(frames):
        for f in frames:
            out, place, seen = {"id": f["id"]}, np.zeros(len(f)), np.zeros(len(f))
            for i in range(k):
                v, b = f[f"s{i}"].to_numpy(dtype=float), bounds[i]
                gone = np.isnan(v)
                # level j holds values up to bounds[j]
                lv = np.searchsorted(b, v, side="left")
                lo = np.where(lv > 0, b[np.maximum(lv - 1, 0)] if len(b) else 0.0, 0.0)
                hi = np.where(lv < len(b), b[np.minimum(lv, len(b) - 1)] if len(b) else 0.0, np.inf)
                with np.errstate(invalid="ignore", divide="ignore"):
                    part = np.where(np.isinf(hi), 1 - 1 / (1 + np.maximum(v - lo, 0)), np.where(hi > lo, (v - lo) / (hi - lo), 0.0))
                place += np.where(gone, 0.0, (lv + np.nan_to_num(part)) / (len(b) + 1))
                seen += ~gone
                out[f"l{i}"] = np.where(gone, len(b) + 1, lv).astype("int32")
            out["place"] = np.where(seen > 0, place / np.maximum(seen, 1), 0.5)
            yield pd.DataFrame(out)

    id_type = dict(base.dtypes)["id"]
    placed = scratch.save(base.mapInPandas(level, f"id {id_type}, {', '.join(f'{x} int' for x in names)}, place double"))
    pairs = list(combinations(range(k), 2)) or [(0, 0)]
    cells = (
        placed.select(F.explode(F.array(*[F.struct(F.lit(j).alias("pair"), F.col(names[a]).alias("a"), F.col(names[b]).alias("b")) for j, (a, b) in enumerate(pairs)])).alias("x"))
        .groupBy("x.pair", "x.a", "x.b")
        .count()
        .toPandas()
    )
    size = [len(b) + 2 for b in bounds]
    counts, single = {}, [np.zeros(x) for x in size]
    for j, (a, b) in enumerate(pairs):
        x = cells[cells["pair"] == j]
        table = (x["a"].to_numpy(), x["b"].to_numpy(), x["count"].to_numpy(dtype=float))
        single[a] = np.bincount(table[0], weights=table[2], minlength=size[a])
        single[b] = np.bincount(table[1], weights=table[2], minlength=size[b])
        if a != b:
            counts[a, b] = table
    g = stationary(counts, single, weights, damping)
    restart = (1 - damping) / float(single[0].sum())

    @F.pandas_udf(T.DoubleType())
    def probability(*cols: pd.Series) -> pd.Series:
        total = np.full(len(cols[0]), restart)
        for x, c in zip(g, cols, strict=True):
            total += x[c.to_numpy()]
        # the last bits depend on the order of sums
        return pd.Series(np.array([float(f"{v:.10e}") for v in total]))

    return _numbered(placed.select("id", probability(*names).alias("p"), "place"), key, scratch)


def _numbered(scored: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    # global order: range partitions, then the number of rows in earlier partitions
    ordered = scratch.save(scored.orderBy(F.desc("p"), F.desc("place"), "id").withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for p, n in sorted(ordered.groupBy(part.alias("p")).count().collect()):  # one row per partition
        before.append((p, total))
        total += n
    first = scored.sparkSession.createDataFrame(before, "part bigint, before bigint")
    return ordered.withColumn("part", part.cast("bigint")).join(F.broadcast(first), "part").select(F.col("id").alias(key), F.col("p").alias("probability"), (row + F.col("before") + 1).alias("rank"))
