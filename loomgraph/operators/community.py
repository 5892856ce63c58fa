"""Communities: weighted undirected graph, local moving in rounds, aggregation, labels.

Local moving is synchronous: in a round every node sees the communities as they stand and, if its
hash admits it to the round, moves to the one with the greatest gain (ties to the smallest id).  All
resolutions run side by side as a key of the same joins; levels that one task can hold, and aggregated
graphs soon are such, go through the same rounds in arrays (``moving``), as a round in joins takes
several jobs, however small its graph is.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.expr import common_prefix, package_part
from loomgraph.operators import moving
from loomgraph.schema import COMMUNITY_TYPES
from loomgraph.session import Scratch
from loomgraph.sources.store import numbered

GAMMAS = (0.5, 1.0, 2.0)
#: Pairs of one resolution that a task's arrays may hold.
HELD = 24_000_000


def community_edges(edges: DataFrame, types: Sequence[str] | None = COMMUNITY_TYPES) -> DataFrame:
    """a < b and w, the number of edges between them; loops are dropped."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    return e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("w"))


def weighted_degrees(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "w")
    return ends.groupBy("id").agg(F.sum("w").alias("k"))


def community_weights(degree: DataFrame, member: DataFrame) -> DataFrame:
    """comm, weight: sum of the members' degrees."""
    return member.join(degree, "id", "left").groupBy("comm").agg(F.sum(F.coalesce("k", F.lit(0))).alias("weight"))


def neighbour_weights(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """id, comm, w: weight of a node's edges into each community beside it."""
    both = pairs.select("a", "b", "w").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.join(member.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"), "comm").agg(F.sum("w").alias("w"))


def supergraph(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """Communities as nodes: a <= b, w; inner edges stay as loops."""
    m = pairs.join(member.select(F.col("id").alias("a"), F.col("comm").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("comm").alias("cb")), "b")
    return m.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))


def _move(scratch: Scratch, both: DataFrame, degree: DataFrame, two_m: float, max_rounds: int) -> tuple[DataFrame, bool]:
    """Local moving from singletons: (g, id, comm) and whether anything moved.  ``both`` has (g, a, b,
    w) in both directions without loops; ``degree`` (g, id, k)."""
    state = scratch.save(degree.select("g", "id", F.col("id").alias("comm"), "k"))
    moved = False
    for r in range(max_rounds):
        total = state.groupBy("g", "comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("n"))
        beside = both.join(state.select("g", F.col("id").alias("b"), "comm"), ["g", "b"]).select("g", F.col("a").alias("id"), "comm", "w")
        own = state.select("g", "id", F.col("comm").alias("own"), "k")
        stay = state.select("g", "id", "comm").withColumn("w", F.lit(0.0))
        options = beside.unionByName(stay).groupBy("g", "id", "comm").agg(F.sum("w").alias("w"))
        scored = options.join(own, ["g", "id"]).join(total, ["g", "comm"])
        mine = F.col("comm") == F.col("own")
        # times two_m, so that it is made of whole numbers; moving.Level has the same terms in the same order
        gain = F.col("w") * F.lit(two_m) - (F.col("g") * F.col("k")) * (F.col("tot") - F.when(mine, F.col("k")).otherwise(F.lit(0.0)))
        # of two singletons that want each other only the one with the greater id moves
        allowed = mine | ~((F.col("n") == 1) & (F.col("comm") > F.col("own")))
        w = Window.partitionBy("g", "id").orderBy(F.desc("gain"), F.desc("mine"), "comm")
        best = scored.withColumn("mine", mine).where(allowed).withColumn("gain", gain).withColumn("rn", F.row_number().over(w)).where("rn = 1")
        admitted = F.shiftright(F.xxhash64("id"), r % 64).bitwiseAND(F.lit(1)) == 0
        new = best.select("g", "id", F.when(F.col("mine") | admitted, F.col("comm")).otherwise(F.col("own")).alias("comm"), "k", "own", F.col("mine").alias("stays"))
        new, seen = scratch.measured(new, wishes=F.sum((~F.col("stays")).cast("int")), changed=F.sum((F.col("comm") != F.col("own")).cast("int")))
        scratch.drop(state)
        state = new.select("g", "id", "comm", "k")
        state._loom_path = new._loom_path
        moved |= bool(seen["changed"])
        if not seen["wishes"]:
            break
    else:
        _warn(moving.ROUNDS, 0, max_rounds)
    return state.select("g", "id", "comm"), moved


def _warn(short: int, max_levels: int, max_rounds: int) -> None:
    if short & moving.ROUNDS:
        warnings.warn(f"nodes still want to move after {max_rounds} rounds", stacklevel=3)
    if short & moving.LEVELS:
        warnings.warn(f"communities still change after {max_levels} levels", stacklevel=3)


def communities(nodes: DataFrame, edges: DataFrame, gammas: Sequence[float] = GAMMAS, types: Sequence[str] | None = COMMUNITY_TYPES, max_levels: int = 50, max_rounds: int = 50, held: int = HELD) -> DataFrame:
    """resolution (index of gamma), node_id, community (smallest member's id): every node once per
    resolution, isolated ones alone.  Levels and rounds go on until nothing wants to move; where one of
    the limits is hit before, a warning says so.  A level of more than ``held`` pairs at some
    resolution is moved in joins, the first smaller one and all above it in arrays, one task per
    resolution, with the same rounds and the same result."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "communities")
    gs = {i: float(x) for i, x in enumerate(gammas)}
    index = F.explode(F.array(*[F.lit(i) for i in gs])).alias("r")
    gamma = F.element_at(F.array(*[F.lit(x) for x in gs.values()]), F.col("r") + 1)
    # numbers in the order of ids stand for them: smaller, and compared alike
    number = numbered(nodes.select("id").distinct(), ["id"], "n").select("id", "n")
    ends = edges.join(number.select(F.col("id").alias("src"), F.col("n").alias("s")), "src").join(number.select(F.col("id").alias("dst"), F.col("n").alias("t")), "dst")
    base, seen = scratch.measured(community_edges(ends.select(F.col("s").alias("src"), F.col("t").alias("dst"), "type"), types), m=F.sum("w"), pairs=F.count(F.lit(1)))
    if not seen["pairs"]:
        return number.select(index.alias("resolution"), F.col("id").alias("node_id"), F.col("id").alias("community"))
    two_m = 2.0 * seen["m"]
    counts = dict.fromkeys(gs, seen["pairs"])
    pairs = base.select(index, "a", "b", "w")
    member, level = None, 0
    if max(counts.values()) > held:
        pairs = scratch.save(pairs.withColumn("g", gamma).select("r", "g", "a", "b", F.col("w").cast("double").alias("w")))
        degree = scratch.save(pairs.select("r", "g", F.explode(F.array("a", "b")).alias("id"), "w").groupBy("r", "g", "id").agg(F.sum("w").alias("k")))
    while max(counts.values()) > held:
        if level == max_levels:
            _warn(moving.LEVELS, max_levels, max_rounds)
            break
        both = pairs.where("a <> b").select("g", "a", "b", "w")
        both = scratch.save(both.union(both.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "w")))
        got, moved = _move(scratch, both, degree, two_m, max_rounds)
        scratch.drop(both)
        if not moved:
            break
        got = scratch.save(got)
        up = got.select("g", F.col("id").alias("comm"), F.col("comm").alias("to"))
        member = scratch.save(member.join(up, ["g", "comm"]).select("r", "g", "id", F.col("to").alias("comm")) if member else degree.join(got, ["g", "id"]).select("r", "g", "id", "comm"))
        ca, cb = got.select("g", F.col("id").alias("a"), F.col("comm").alias("ca")), got.select("g", F.col("id").alias("b"), F.col("comm").alias("cb"))
        pairs = scratch.save(pairs.join(ca, ["g", "a"]).join(cb, ["g", "b"]).groupBy("r", "g", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        degree = scratch.save(degree.join(got, ["g", "id"]).groupBy("r", "g", F.col("comm").alias("id")).agg(F.sum("k").alias("k")))
        counts = {x.r: x["count"] for x in pairs.groupBy("r").count().collect()}
        level += 1
    else:
        rows = pairs.select("r", "a", "b", F.col("w").cast("bigint").alias("w")).repartitionById(len(gs), F.col("r"))
        got, seen = scratch.measured(rows.mapInArrow(moving.in_tasks(counts, gs, two_m, max_levels - level, max_rounds), "r int, id bigint, comm bigint, short int"), short=F.bit_or("short"))
        _warn(seen["short"] or 0, max_levels, max_rounds)
        up = got.select("r", F.col("id").alias("comm"), F.col("comm").alias("to"))
        member = member.join(up, ["r", "comm"]).select("r", "id", F.col("to").alias("comm")) if member else got.select("r", "id", "comm")
    if member is None:
        member = degree.select("r", "id", F.col("id").alias("comm"))
    first = member.groupBy("r", "comm").agg(F.min("id").alias("first")).join(number.select(F.col("n").alias("first"), F.col("id").alias("community")), "first")
    named = member.join(first, ["r", "comm"]).select("r", F.col("id").alias("n"), "community")
    return number.select(index, "n", "id").join(named, ["r", "n"], "left").select(F.col("r").alias("resolution"), F.col("id").alias("node_id"), F.coalesce("community", "id").alias("community"))


def modularity(pairs: DataFrame, member: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row, ``modularity`` of a partition (id, comm): the share of weight within communities less
    ``gamma`` times what their degrees would give by chance; null without edges."""
    ca, cb = member.select(F.col("id").alias("a"), F.col("comm").alias("ca")), member.select(F.col("id").alias("b"), F.col("comm").alias("cb"))
    linked = pairs.join(ca, "a").join(cb, "b").select("a", "b", "w", "ca", "cb")
    # weight within, and degrees, per community; one row per community goes on
    inner = F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(F.lit(0))
    ends = linked.select(F.explode(F.array(F.struct(F.col("ca").alias("comm"), inner.alias("i"), "w"), F.struct(F.col("cb").alias("comm"), F.lit(0).cast("bigint").alias("i"), "w"))).alias("x"))
    per = ends.groupBy("x.comm").agg(F.sum("x.i").alias("i"), F.sum("x.w").alias("k"))
    total = F.sum("k")
    return per.agg((F.lit(2.0) * F.sum("i") / total - F.lit(gamma) * F.sum(F.col("k").cast("double") * F.col("k")) / (total * total)).alias("modularity"))


def dense_labels(member: DataFrame, order: str = "id") -> DataFrame:
    """comm, label: communities numbered from 0 by the first of their members in ``order``."""
    first = member.groupBy("comm").agg(F.min(order).alias("_first"))
    return numbered(first, ["_first", "comm"], "label").select("comm", "label")


def dominant_package(members: DataFrame) -> DataFrame:
    """comm, package, n: the commonest part before the last dot of the members' qualified names,
    ties to the smallest; communities without dotted names don't appear."""
    n = members.select("comm", package_part("qualified_name").alias("package")).where("package <> ''").groupBy("comm", "package").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("comm").agg(F.min(F.struct((-F.col("n")).alias("m"), "package")).alias("x"))
    return best.select("comm", F.col("x.package").alias("package"), (-F.col("x.m")).alias("n"))


def name_prefix(members: DataFrame) -> DataFrame:
    """comm, prefix: what the three smallest names have in common, if there are three members and it
    is three bytes or longer.  The three are kept by a window's rank, never by collecting a group."""
    w = Window.partitionBy("comm").orderBy("name", "id")
    three = members.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("comm").agg(F.array_sort(F.collect_list("name")).alias("names"))
    p = three.where("size(names) = 3").select("comm", common_prefix(F.col("names")).alias("prefix"))
    return p.where(F.octet_length("prefix") >= 3)


def top_member(members: DataFrame) -> DataFrame:
    """comm, top: name of the member with the greatest pagerank, ties to the smallest id."""
    score = F.coalesce(F.when(F.isnan("pagerank"), None).otherwise(F.col("pagerank")), F.lit(0.0))
    best = members.groupBy("comm").agg(F.min(F.struct((-score).alias("s"), "id", "name")).alias("x"))
    return best.select("comm", F.col("x.name").alias("top"))


def labels(members: DataFrame) -> DataFrame:
    """comm, label from dominant package, common prefix and top member, as 'package — prefix* + top'.
    ``members``: comm, id, name, qualified_name, pagerank."""
    j = members.select("comm").distinct().join(dominant_package(members).select("comm", "package"), "comm", "left").join(name_prefix(members), "comm", "left").join(top_member(members), "comm", "left")
    tail = F.when(F.col("prefix").isNotNull(), F.concat(F.col("prefix"), F.lit("* + "), F.coalesce("top", F.lit("")))).otherwise(F.coalesce("top", F.lit("")))
    text = F.concat_ws(" — ", F.col("package"), F.when(tail != "", tail))
    return j.select("comm", F.when(text == "", "(unnamed)").otherwise(text).alias("label"))
