"""Hierarchies against a plain walk."""

import random

from loomgraph.operators import hierarchy as h

LINKS = "tree string, parent_id string, child_id string, node_id int"


def df(spark, rows):
    # node_id is an extra column whose name clashes with one of the results
    return spark.createDataFrame([(*r, 7) for r in rows], LINKS)


def truth(rows):
    kids, nodes, child, top = {}, set(), set(), set()
    for g, p, c in set(rows):
        if c is None:
            continue
        nodes.add((g, c))
        if p is None:
            top.add((g, c))
            continue
        nodes.add((g, p))
        kids.setdefault((g, p), set()).add(c)
        if p != c:
            child.add((g, c))
    reach = {}
    for n in nodes:
        seen, todo = set(), list(kids.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids.get((n[0], x), ())
        reach[n] = seen
    cycles = {n for n in nodes if n[1] in reach[n]}
    paths, front = {}, sorted((n for n in nodes if n not in child or n in top), key=str)
    for g, n in front:
        paths[g, n] = [n]
    while front:
        new = {}
        for g, n in front:
            for c in kids.get((g, n), ()):
                if (g, c) not in paths and c != n and ((g, c) not in new or n < new[g, c]):
                    new[g, c] = n
        for (g, c), p in new.items():
            paths[g, c] = [*paths[g, p], c]
        front = sorted(new, key=str)
    return nodes, cycles, paths, {(g, a, d) for (g, a) in nodes for d in reach[g, a]}


def check(spark, rows):
    links = df(spark, rows)
    nodes, cycles, paths, below = truth(rows)
    got = {(r.tree, r.node_id) for r in h.cycle_nodes(links, ["tree"], "parent_id", "child_id").collect()}
    assert got == cycles
    tree = h.paths(links, ["tree"], "parent_id", "child_id").cache()
    out = tree.collect()
    assert {(r.tree, r.node_id) for r in out} == nodes and len(out) == len(nodes)
    for r in out:
        want = paths.get((r.tree, r.node_id))
        assert (list(r.path) if r.path else None) == want
        assert (r.depth, r.root_id) == ((len(want) - 1, want[0]) if want else (None, None))
    pairs = h.descendants(links, ["tree"], "parent_id", "child_id", tree).collect()
    assert {(r.tree, r.ancestor_id, r.node_id) for r in pairs} == below and len(pairs) == len(below)


CASES = {
    "chain and repeats": [("t", "a", "b"), ("t", "b", "c"), ("t", "a", "b"), ("u", "b", "a")],
    "nulls": [("t", None, "a"), ("t", "a", None), ("t", None, None), ("t", "a", "b"), (None, "x", "y")],
    "cycle reached and cycle alone": [("t", "r", "a"), ("t", "a", "b"), ("t", "b", "a"), ("t", "b", "c"), ("t", "p", "q"), ("t", "q", "p"), ("t", "q", "z")],
    "own parent and two parents": [("t", "a", "a"), ("t", "a", "b"), ("t", "x", "b"), ("t", "b", "c"), ("t", "y", "c"), ("t", "x", "y")],
    "empty": [],
}


def random_links(seed, nodes, links):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(nodes)]
    return [(r.choice("tu"), r.choice(names) if r.random() < 0.97 else None, r.choice(names)) for _ in range(links)]


def test_graphs(spark):
    """All graphs at once, each in groups of its own: forest-like ones, a dense one with a core in which
    every node has several parents and children, and a ladder of joints."""
    graphs = {**CASES, "sparse": random_links(2, 60, 75), "forest": random_links(3, 300, 330), "dense": random_links(4, 30, 120)}
    graphs["ladder"] = [("t", f"{a}{i:02}", f"{b}{i + 1:02}") for i in range(8) for a in "ab" for b in "ab"]
    check(spark, [(g and f"{name} {g}", p, c) for name, rows in graphs.items() for g, p, c in rows])


def test_no_rows(spark):
    links = df(spark, [])
    assert h.cycle_nodes(links, ["tree"], "parent_id", "child_id").count() == h.paths(links, ["tree"], "parent_id", "child_id").count() == 0


def test_long_chain_and_long_cycle(spark):
    rows = [("t", f"c{i:03}", f"c{i + 1:03}") for i in range(500)] + [("t", "c100", "x0"), ("t", "x0", "c300")]
    rows += [("t", f"k{i:03}", f"k{(i + 1) % 150:03}") for i in range(150)] + [("t", "k075", "tail"), ("t", "tail", "k149"), ("t", "tail", "end")]
    links = df(spark, rows)
    nodes, cycles, paths, below = truth(rows)
    assert {(r.tree, r.node_id) for r in h.cycle_nodes(links, ["tree"], "parent_id", "child_id").collect()} == cycles
    tree = h.paths(links, ["tree"], "parent_id", "child_id").cache()
    assert {(r.tree, r.node_id): list(r.path) for r in tree.collect() if r.path} == paths and len(paths["t", "c500"]) == 303
    pairs = h.descendants(links, ["tree"], "parent_id", "child_id", tree)
    assert pairs.count() == pairs.distinct().count() == len(below)


ROOTLESS = [
    ("t", "p", "q"), ("t", "q", "p"), ("t", "q", "z"), ("t", "z", "y"),  # a cycle alone and what hangs below
    ("t", "z", "u"), ("t", "u", "v"), ("t", "v", "u"), ("t", "v", "v"),  # a second cycle below the first
    ("t", "r", "a"), ("t", "a", "b"), ("t", "q", "b"), ("t", "b", "c"),  # b below a root and below the cycle
    (None, "p", "q"), (None, "q", "p"), ("s", "p", "q"),
]


def test_descendants_without_a_root(spark):
    kids = {}
    for g, p, c in ROOTLESS:
        kids.setdefault((g, p), set()).add(c)
    want = set()
    for g, a in kids:
        todo = [a]
        while todo:
            for c in kids.get((g, todo.pop()), ()):
                if (g, a, c) not in want:
                    want.add((g, a, c))
                    todo.append(c)
    got = h.descendants(df(spark, ROOTLESS), ["tree"], "parent_id", "child_id").collect()
    assert {(r.tree, r.ancestor_id, r.node_id) for r in got} == want and len(got) == len(want)
    assert {("t", "p", "p"), ("t", "z", "y"), ("t", "p", "c"), (None, "q", "q")} <= want


def test_query_has_descendants_of_every_node(spark, tmp_path):
    from loomgraph.plans import general

    spark.createDataFrame([(p, c) for _, p, c in ROOTLESS[:4]], "parent_id string, child_id string").write.parquet(f"{tmp_path}/pkg_tree.parquet")
    spark.createDataFrame([("r", "a", 0)], "parent_id string, child_id string, resolution int").write.parquet(f"{tmp_path}/topic_tree.parquet")
    got = {(r.ancestor_id, r.node_id) for r in general.p2_descendants(spark, str(tmp_path)).collect()}
    assert got == {("r", "a"), ("z", "y")} | {(a, n) for a in "pq" for n in "pqzy"}
