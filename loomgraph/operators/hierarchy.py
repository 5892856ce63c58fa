"""Parent-child rows to full hierarchies: paths, depths, roots, descendants and cycles.

``links`` is any DataFrame with group columns (for instance tree and resolution), a parent and a
child.  A hierarchy lives within one group.  Nodes are strings, compared as they stand.

Everything is joins, at every size.  The frontier of the joins doubles its reach with each round: a
node with one parent hands on its jump to its parent's jump, so chains of length d take log2(d)
rounds.  Jumps end at roots and at joints (nodes with several parents); what is left is the graph of
joints, which goes round again.  Nodes whose jumps never end are unreached and reveal cycles.

Defined results: a row with a null child is ignored; a row with a null parent makes its child a
top; repeated rows count once; a row whose parent is its own child is a cycle of one and gives no
parent; a child with several parents takes the one by which it is reached first from a root (the
smallest id where several do at once) for path, depth and root, while descendants and cycles count
every row; nodes that no root reaches have null root, depth and path.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch


#: Levels of leaves taken off before cycles are sought.  It saves work and changes no result.
LEAF_ROUNDS = 2


def _key(group: Sequence[str]):
    """The groups as one string; null and empty ones differ."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in group]) if group else F.lit("")


def _plain(links: DataFrame, group: Sequence[str], parent: str, child: str) -> DataFrame:
    """Columns g (groups as one string), p, c and the groups' values; distinct; the child is never null."""
    return (
        links.select(_key(group).alias("g"), F.col(parent).cast("string").alias("p"), F.col(child).cast("string").alias("c"), *[F.col(x).alias(f"_g{i}") for i, x in enumerate(group)])
        .where("c is not null")
        .distinct()
    )


def _groups(n: int) -> list[str]:
    return [f"_g{i}" for i in range(n)]


def _union(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _by_parents(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of distinct links (g, p, c): the nodes with one parent (g, n, up), and the joints (g, n)."""
    deg = scratch.save(links.groupBy("g", F.col("c").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("p").alias("up")))
    return deg.where("k = 1").select("g", "n", "up"), deg.where("k > 1").select("g", "n")


def _climb(rows: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Jumps of rows (g, n, top and maybe seg, the nodes below ``top`` down to ``n``) whose tops may be nodes of other rows.

    Table k of the result has the nodes that aren't at an end after table k - 1, their tops moved
    2**k links up or to the end, and whether that is the end (done).  It ends when all nodes are done
    or a round brings no node to its end: one farther away than 2**k has an ancestor that this round
    would have brought there, so the nodes left have no end; they are on or below a cycle.
    """
    seg = "seg" in rows.columns
    open_ = F.count(F.when(~F.col("done"), 1))
    go = rows.select("g", F.col("n").alias("top"), F.lit(True).alias("_goes"))
    first, seen = scratch.measured(rows.join(go, ["g", "top"], "left").select(*rows.columns, F.col("_goes").isNull().alias("done")), left=open_)
    steps, left = [first], seen["left"]
    while left:
        now = steps[-1].where("not done")
        # tables before the last are read for their ends only
        table = scratch.together(steps).where("done").unionByName(now)
        table = table.select("g", F.col("n").alias("top"), F.col("top").alias("_top"), F.col("done").alias("_done"), *[F.col("seg").alias("_seg")] * seg)
        both = now.drop("done").join(table, ["g", "top"]).select("g", "n", F.col("_top").alias("top"), *[F.concat("_seg", "seg").alias("seg")] * seg, F.col("_done").alias("done"))
        new, seen = scratch.measured(both, left=open_)
        steps.append(new)
        if seen["left"] == left:
            break
        left = seen["left"]
    return steps


def _ended(steps: Sequence[DataFrame], scratch: Scratch) -> DataFrame:
    return scratch.together(steps).where("done").drop("done")


def _on_rings(steps: Sequence[DataFrame], scratch: Scratch) -> DataFrame | None:
    """(g, n): nodes on the cycles that the jumps without an end run into, or None without such jumps.

    Only nodes that jumps land on jump on.  Once a round lands on as many as the one before, jumps
    of this width map the nodes one to one onto themselves, so all of them lie on cycles.
    """
    lost = steps[-1].where("not done").select("g", "n", "top")
    if not _any(lost):
        return None
    rows = F.count(F.lit(1))
    ends, seen = scratch.measured(lost.select("g", F.col("top").alias("n")).distinct(), n=rows)
    while True:
        jump = lost.join(ends, ["g", "n"], "left_semi")
        lost = scratch.save(jump.join(jump.select("g", F.col("n").alias("top"), F.col("top").alias("_top")), ["g", "top"]).select("g", "n", F.col("_top").alias("top")))
        n = seen["n"]
        ends, seen = scratch.measured(lost.select("g", F.col("top").alias("n")).distinct(), n=rows)
        if seen["n"] == n:
            return ends


def _flipped(links: DataFrame) -> DataFrame:
    return links.select("g", F.col("c").alias("p"), F.col("p").alias("c"))


def _cyclic_links(links: DataFrame, scratch: Scratch, turned: bool = False) -> DataFrame:
    """The links (g, p, c), distinct and without links of a node to itself, that lie on cycles.

    Nodes with one parent jump up to a joint, a root, or nowhere: the last give the cycles without
    joints.  A cycle with joints is one of the graph that has a link from joint to joint for each
    chain between them; its chains are marked by the jumps again, widest first.
    """
    single, joints = _by_parents(links, scratch)
    steps = _climb(single.withColumnRenamed("up", "top"), scratch)
    found = []
    if (ring := _on_rings(steps, scratch)) is not None:
        found.append(scratch.save(single.join(ring, ["g", "n"], "left_semi").select("g", F.col("up").alias("p"), F.col("n").alias("c"))))
    ends = _ended(steps, scratch).select("g", F.col("n").alias("p"), F.col("top").alias("a")).unionByName(joints.select("g", F.col("n").alias("p"), F.col("n").alias("a")))
    ends = ends.join(joints.withColumnRenamed("n", "a"), ["g", "a"], "left_semi")
    via = scratch.save(links.join(joints.withColumnRenamed("n", "c"), ["g", "c"], "left_semi").join(ends, ["g", "p"]).select("g", "a", "p", "c"))
    good = [via.where("a = c")]
    outer = via.where("a <> c").select("g", F.col("a").alias("p"), "c").distinct()
    # a joint that leads to no other is on no cycle of joints
    outer, seen = scratch.measured(outer.join(outer.select("g", F.col("p").alias("c")).distinct(), ["g", "c"], "left_semi").select("g", "p", "c"), n=F.count(F.lit(1)))
    n = seen["n"]
    if n:
        if n < links.count():
            sub = _cyclic_links(outer, scratch)
        elif not turned:
            sub = _flipped(_cyclic_links(_flipped(outer), scratch, True))
        else:
            sub = _core_links(outer, scratch)
        good.append(via.join(sub.select("g", F.col("p").alias("a"), "c"), ["g", "a", "c"], "left_semi"))
    hit = scratch.save(_union(good))
    marked = hit.where("p <> a").select("g", F.col("p").alias("n")).distinct()
    if _any(marked):
        for i, s in reversed(list(enumerate(steps))):
            up = s.where("not done").join(marked, ["g", "n"], "left_semi").select("g", F.col("top").alias("n"))
            marked = marked.union(up).distinct()
            if i % 2 == 0:
                marked = scratch.save(marked)
        found.append(single.join(marked, ["g", "n"], "left_semi").select("g", F.col("up").alias("p"), F.col("n").alias("c")))
    return scratch.save(_union([*found, hit.select("g", "p", "c")]).distinct())


def _core_links(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The links on cycles of a graph all of whose nodes have several parents and children.

    Each pass lets the smallest id flow along the links until nothing changes; a node whose own
    id comes back to it by links between nodes of that colour is on a cycle together with all that
    reach it within the colour.  These components leave, the rest goes round again.
    """
    rest, done = links, []
    while True:
        ids = rest.select("g", F.col("p").alias("n")).union(rest.select("g", F.col("c").alias("n"))).distinct()
        colour = scratch.save(ids.withColumn("k", F.col("n")))
        while True:
            sent = rest.join(colour.withColumnRenamed("n", "p"), ["g", "p"]).select("g", F.col("c").alias("n"), "k")
            new = scratch.save(colour.select("g", "n", "k", F.col("k").alias("o")).unionByName(sent.withColumn("o", F.lit(None).cast("string"))).groupBy("g", "n").agg(F.min("k").alias("k"), F.min("o").alias("o")))
            changed = _any(new.where("k <> o"))
            scratch.drop(colour)
            colour = new.select("g", "n", "k")
            if not changed:
                break
        kp, kc = colour.select("g", F.col("n").alias("p"), F.col("k").alias("kp")), colour.select("g", F.col("n").alias("c"), "k")
        inner = scratch.save(rest.join(kp, ["g", "p"]).join(kc, ["g", "c"]).where("kp = k").select("g", "k", "p", "c"))
        back = scratch.save(colour.where("n = k").select("g", "k", "n"))
        front = back
        while True:
            front = scratch.save(inner.join(front.withColumnRenamed("n", "c"), ["g", "k", "c"]).select("g", "k", F.col("p").alias("n")).distinct().join(back, ["g", "k", "n"], "left_anti"))
            if not _any(front):
                break
            back = scratch.save(back.union(front))
        own = inner.join(back.withColumnRenamed("n", "p"), ["g", "k", "p"], "left_semi").join(back.withColumnRenamed("n", "c"), ["g", "k", "c"], "left_semi")
        done.append(scratch.save(own.select("g", "p", "c")))
        gone = back.select("g", "n")
        rest = scratch.save(rest.join(gone.withColumnRenamed("n", "p"), ["g", "p"], "left_anti").join(gone.withColumnRenamed("n", "c"), ["g", "c"], "left_anti").select("g", "p", "c"))
        if not _any(rest):
            return _union(done)


def cycle_nodes(links: DataFrame, group: Sequence[str], parent: str, child: str) -> DataFrame:
    """One row (``group`` columns, ``node_id``) for each node that lies on a cycle of links."""
    scratch = Scratch(links.sparkSession, "cycles")
    plain = scratch.save(_plain(links, group, parent, child).where("p is not null"))
    names = _groups(len(group))
    inner = plain.where("p <> c").select("g", "p", "c")
    for _ in range(LEAF_ROUNDS):
        # most nodes of a tree are leaves, and none of them is on a cycle
        inner = scratch.save(inner.join(inner.select("g", F.col("p").alias("c")).distinct(), ["g", "c"], "left_semi").select("g", "p", "c"))
    found = _cyclic_links(inner, scratch).select("g", "c").distinct()
    # the group's own values come back from one of the node's links
    hits = plain.join(found, ["g", "c"], "left_semi").select("g", "c", *names)
    both = hits.union(plain.where("p = c").select("g", "c", *names)).dropDuplicates(["g", "c"])
    return both.select(*[F.col(a).alias(b) for a, b in zip(names, group, strict=True)], F.col("c").alias("node_id"))


def _shortest(via: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, n, d): links from the next root to each joint that one reaches, over chains (g, a, c, w) of w
    links.  Rounds of relaxation in joins, as many as a shortest way has joints."""
    best, front = None, roots.select("g", "n", F.lit(0).alias("d"))
    while True:
        new = via.join(front.withColumnRenamed("n", "a"), ["g", "a"]).groupBy("g", F.col("c").alias("n")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        if best is not None:
            new = new.join(best.withColumnRenamed("d", "o"), ["g", "n"], "left").where("o is null or d < o").select("g", "n", "d")
        front = scratch.save(new)
        if best is not None and not _any(front):
            return best
        best = front if best is None else scratch.save(best.join(front, ["g", "n"], "left_anti").unionByName(front))


def paths(links: DataFrame, group: Sequence[str], parent: str, child: str) -> DataFrame:
    """One row per node: ``group`` columns, ``node_id``, ``parent_id``, ``root_id``, ``depth``
    (0 at a root) and ``path`` (array from the root to the node).

    A root is a node that is nobody's child, or a child whose parent is null.  Jumps carry the nodes
    they pass; joints choose their parent by the shortest way from a root, then jump on from there.
    """
    scratch = Scratch(links.sparkSession, "paths")
    names = _groups(len(group))
    plain = scratch.save(_plain(links, group, parent, child))
    ids = plain.select("g", F.col("c").alias("n"), *names, F.lit(1).alias("is_c"), F.col("p").isNull().cast("int").alias("top"), (F.col("p") == F.col("c")).alias("own"))
    ids = ids.unionByName(plain.where("p is not null").select("g", F.col("p").alias("n"), *names, F.lit(0).alias("is_c"), F.lit(0).alias("top"), F.lit(False).alias("own")))
    # a link to itself doesn't make its node a child
    nodes = scratch.save(ids.withColumn("is_c", F.when(F.col("own"), 0).otherwise(F.col("is_c"))).groupBy("g", "n", *names).agg(F.max("is_c").alias("is_c"), F.max("top").alias("top")))
    roots = nodes.where("is_c = 0 or top = 1").select("g", "n")
    real = scratch.save(plain.where("p is not null and p <> c").select("g", "p", "c").join(roots.withColumnRenamed("n", "c"), ["g", "c"], "left_anti"))
    single, joints = _by_parents(real, scratch)
    chains = _ended(_climb(single.select("g", "n", F.col("up").alias("top"), F.array("n").alias("seg")), scratch), scratch)
    found = [roots.select("g", "n", F.lit(None).cast("string").alias("up"), F.array("n").alias("path"))]
    below = chains.join(roots.withColumnRenamed("n", "top"), ["g", "top"], "left_semi").select("g", "n", F.concat(F.array("top"), "seg").alias("path"))
    if _any(joints):
        anchors = roots.union(joints)
        ends = chains.select("g", F.col("n").alias("p"), F.col("top").alias("a"), "seg").unionByName(anchors.select("g", F.col("n").alias("p"), F.col("n").alias("a"), F.array().cast("array<string>").alias("seg")))
        via = scratch.save(real.join(joints.withColumnRenamed("n", "c"), ["g", "c"], "left_semi").join(ends, ["g", "p"]).select("g", "a", "p", "c", "seg", (F.size("seg") + 1).alias("w")))
        best = _shortest(via, roots, scratch)
        known = roots.select("g", F.col("n").alias("a"), F.lit(0).alias("da")).unionByName(best.select("g", F.col("n").alias("a"), F.col("d").alias("da")))
        fits = via.join(known, ["g", "a"]).join(best.withColumnRenamed("n", "c"), ["g", "c"]).where("da + w = d")
        chosen = scratch.save(fits.groupBy("g", "c").agg(F.min(F.struct("p", "a", "seg")).alias("x")).select("g", F.col("c").alias("n"), F.col("x.p").alias("up"), F.col("x.a").alias("top"), F.concat("x.seg", F.array("c")).alias("seg")))
        ways = _ended(_climb(chosen.drop("up"), scratch), scratch).select("g", "n", F.concat(F.array("top"), "seg").alias("path"))
        ways = scratch.save(ways)
        found.append(ways.join(chosen.select("g", "n", "up"), ["g", "n"]).select("g", "n", "up", "path"))
        below = below.unionByName(chains.join(ways.select("g", F.col("n").alias("top"), "path"), ["g", "top"]).select("g", "n", F.concat("path", "seg").alias("path")))
    found.append(below.join(single, ["g", "n"]).select("g", "n", "up", "path"))
    return nodes.join(_union(found), ["g", "n"], "left").select(
        *[F.col(a).alias(b) for a, b in zip(names, group, strict=True)],
        F.col("n").alias("node_id"),
        F.col("up").alias("parent_id"),
        F.col("path")[0].alias("root_id"),
        (F.size("path") - 1).alias("depth"),
        "path",
    )


def _leaders(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, n): the smallest node of each component that the links (g, p, c) connect.  Each round takes
    the smallest label among neighbours, then the label of that label."""
    ways = scratch.save(links.select("g", F.col("p").alias("n"), F.col("c").alias("m")).union(links.select("g", "c", "p")).distinct())
    label = scratch.save(ways.select("g", "n", F.col("n").alias("k")).distinct())
    while True:
        told = ways.join(label.withColumnRenamed("n", "m"), ["g", "m"]).select("g", "n", "k")
        near = told.union(label.select("g", "n", "k")).groupBy("g", "n").agg(F.min("k").alias("k"))
        far = near.join(near.select("g", F.col("n").alias("k"), F.col("k").alias("k2")), ["g", "k"]).select("g", "n", F.col("k2").alias("k"))
        new = scratch.save(far.join(label.withColumnRenamed("k", "o"), ["g", "n"]))
        if not _any(new.where("k <> o")):
            return new.where("n = k").select("g", "n")
        label = new.select("g", "n", "k")


def _rootless(links: DataFrame, lost: DataFrame, names: Sequence[str], scratch: Scratch) -> DataFrame:
    """``paths`` (g, group values, n, up, path) of the nodes in ``lost`` (g, n), which no root reaches.

    All their parents are lost too, so each is on or below a cycle.  Of each group of nodes that
    cycles connect the smallest stands in for a root.
    """
    own = scratch.save(links.join(lost.select("g", F.col("n").alias("c")), ["g", "c"], "left_semi"))
    starts = _leaders(_cyclic_links(own.where("p <> c").select("g", "p", "c"), scratch), scratch)
    plain = own.select("p", "c", F.col("g").alias("k"), *names)
    values = own.select("g", F.col("c").alias("n"), *names).dropDuplicates(["g", "n"])
    rooted = plain.union(values.join(starts, ["g", "n"], "left_semi").select(F.lit(None).cast("string"), "n", "g", *names))
    return paths(rooted, ["k", *names], "p", "c").select(F.col("k").alias("g"), *names, F.col("node_id").alias("n"), F.col("parent_id").alias("up"), "path")


def descendants(links: DataFrame, group: Sequence[str], parent: str, child: str, tree: DataFrame | None = None) -> DataFrame:
    """One row (``group`` columns, ``ancestor_id``, ``node_id``) for each node and each of its
    proper ancestors by any rows; a node on a cycle is its own.

    Ancestor pairs along the tree come out of the paths.  The closure of the links outside the tree
    (second parents, links back) is found level by level over these links and then joined with the
    pairs above and below each.  Each pair of that closure is a pair of the result too, so it never
    outgrows it.
    """
    scratch = Scratch(links.sparkSession, "pairs")
    names = _groups(len(group))
    tree = scratch.save(paths(links, group, parent, child) if tree is None else tree)
    flat = tree.where("path is not null").select(_key(group).alias("g"), *[F.col(x).alias(y) for x, y in zip(group, names, strict=True)], F.col("node_id").alias("n"), F.col("parent_id").alias("up"), "path")
    linked = scratch.save(_plain(links, group, parent, child).where("p is not null"))
    lost = tree.where("path is null").select(_key(group).alias("g"), F.col("node_id").alias("n"))
    if _any(lost):
        flat = flat.unionByName(_rootless(linked, lost, names, scratch))
    flat = scratch.save(flat)
    self_and_up = scratch.save(flat.select("g", F.explode("path").alias("a"), "n"))
    plain = linked.select("g", "p", "c")
    extra = scratch.save(plain.join(flat.select("g", F.col("n").alias("c"), "up"), ["g", "c"]).where("up is null or p <> up").select("g", F.col("p").alias("a"), F.col("c").alias("n")))
    pairs = self_and_up.where("a <> n")
    if _any(extra):
        # from the head of one such link, down the tree, to the tail of the next
        tails = extra.select("g", F.col("a").alias("n"), F.col("n").alias("n2"))
        hops = scratch.save(extra.select("g", F.col("n").alias("a")).distinct().join(self_and_up, ["g", "a"]).join(tails, ["g", "n"]).select("g", F.col("a").alias("from"), F.col("n2").alias("to")).distinct())
        reach = front = extra
        while True:
            front = scratch.save(front.join(hops.withColumnRenamed("from", "n"), ["g", "n"]).select("g", "a", F.col("to").alias("n")).distinct().join(reach, ["g", "a", "n"], "left_anti"))
            if not _any(front):
                break
            reach = scratch.save(reach.union(front))
        over = self_and_up.select("g", F.col("a").alias("top"), F.col("n").alias("a"))
        below = self_and_up.select("g", F.col("a").alias("n"), F.col("n").alias("end"))
        more = reach.join(over, ["g", "a"]).select("g", "top", "n").distinct().join(below, ["g", "n"]).select("g", F.col("top").alias("a"), F.col("end").alias("n"))
        pairs = pairs.union(more).distinct()
    return pairs.join(flat.select("g", "n", *names), ["g", "n"]).select(*[F.col(a).alias(b) for a, b in zip(names, group, strict=True)], F.col("a").alias("ancestor_id"), F.col("n").alias("node_id"))
