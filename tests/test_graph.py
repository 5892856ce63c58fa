"""Small graphs with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.graph import InvalidGraph, PropertyGraph, distinct_edges, latest
from loomgraph.operators import community, lookup, moving, packages, resolve, score, text, traverse
from loomgraph.schema import EDGES_DDL, NODE_COLS, NODES_DDL


def node(i, type_="Function", q=None, path="p/x.go", lang="go", **kw):
    base = dict.fromkeys(NODE_COLS) | {"id": i, "type": type_, "name": (q or i).rsplit(".", 1)[-1], "qualified_name": q or i, "file_path": path, "start_line": 1, "end_line": 1, "start_byte": 0, "end_byte": 1, "language": lang, "in_degree": 0, "out_degree": 0, "pagerank": 0.0, "usage_score": 0.0, "confidence": "EXTRACTED"}
    return tuple((base | kw)[c] for c in NODE_COLS)


def edge(i, s, d, t="calls", n=1):
    return (i, s, d, t, None, None, n, "EXTRACTED")


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([node("P", "Package", "mypkg", "mypkg"), node("A", q="mypkg.FuncA", signature="func FuncA(...)", doc_comment="Adds a crate."), node("B", q="mypkg.FuncB"), node("C", q="pkg2.FuncC")], NODES_DDL)
    edges = spark.createDataFrame([edge(1, "P", "A", "contains"), edge(2, "A", "B", n=3), edge(3, "B", "C")], EDGES_DDL)
    return PropertyGraph(nodes, edges)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_bfs(small):
    n, e = small.nodes, small.edges
    assert ids(traverse.neighborhood(n, e, "mypkg.FuncA", 1).ids) == ["A", "B"]
    assert ids(traverse.neighborhood(n, e, "mypkg.FuncA", 2).ids) == ["A", "B", "C"]
    assert ids(traverse.neighborhood(n, e, "pkg2.FuncC", 2, True).ids) == ["A", "B", "C"]
    assert ids(traverse.neighborhood(n, e, "pkg2.FuncC", 0, True).ids) == ["C"]
    assert ids(traverse.neighborhood(n, e, "no.such", 3).ids) == []
    assert ids(traverse.neighborhood(n, e, "mypkg.FuncA", 1).edges) == [2]
    sub = traverse.subgraph(n, e, "mypkg.FuncA", 99)
    assert ids(sub.ids) == ["A", "B", "C", "P"] and sub.edges.count() == 3
    both = set(ids(traverse.neighborhood(n, e, "mypkg.FuncB", 2).ids)) | set(ids(traverse.neighborhood(n, e, "mypkg.FuncB", 2, True).ids))
    assert set(ids(traverse.subgraph(n, e, "mypkg.FuncB", 2).ids)) == both
    hop = {r.id: r.depth for r in traverse.hop_distance(e, n.where("id = 'B'").select("id"), 5).collect()}
    assert hop == {"B": 0, "A": 1, "C": 1, "P": 2}
    assert ids(traverse.visible_set(n, e, None, 1)) == ["P"] and ids(traverse.visible_set(n, e, "B", 1, 2)) == ["A", "B"]


def test_lookups(spark, small):
    n, e = small.nodes, small.edges
    assert ids(lookup.find_symbol(n, "mypkg.FuncA")) == ["A"] and ids(lookup.find_symbol(n, "funcb", exact=False)) == ["B"]
    assert ids(lookup.find_symbol(n, "FuncA", exact=False, language="ts")) == []
    assert ids(lookup.search_substring(n, "func")) == ["A", "B", "C"] and ids(lookup.search_substring(n, "%")) == []
    some = spark.createDataFrame([("A",), ("?",)], "id string")
    assert ids(lookup.incident(e, some)) == [1, 2] and ids(lookup.edges_from(e, some)) == [2] and ids(lookup.edges_to(e, some, ["contains"])) == [1]
    none = some.limit(0)
    assert lookup.incident(e, none).count() == lookup.nodes_by_ids(n, none).count() == 0
    with pytest.raises(ValueError):
        lookup.hierarchy("other", e)
    assert lookup.clamp(0) == lookup.clamp(50_001) == 5000 and lookup.clamp(7) == 7


def test_build_and_validate(spark, small):
    small.validate()
    twice = PropertyGraph.union(small, PropertyGraph(spark.createDataFrame([node("A", q="new.Name")], NODES_DDL), small.edges))
    assert twice.nodes.count() == 4 and twice.edges.count() == 6
    assert twice.nodes.where("id = 'A'").first().qualified_name == "new.Name"
    with pytest.raises(InvalidGraph, match="dangling"):
        PropertyGraph(small.nodes, spark.createDataFrame([edge(9, "A", "gone")], EDGES_DDL)).validate()
    with pytest.raises(InvalidGraph, match="type"):
        PropertyGraph(spark.createDataFrame([node("Z", "Thing")], NODES_DDL), small.edges.limit(0)).validate()
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", None, "x"), (None, 3, "y"), ("a", 2, "new")], "id string, built_at int, v string")
    assert [(r.id, r.v) for r in latest(rows).collect()] == [("a", "new")]
    assert latest(rows.limit(0)).count() == 0
    dup = spark.createDataFrame([edge(2, "a", "b"), edge(1, "a", "b"), edge(3, "a", "b", "defines")], EDGES_DDL)
    assert ids(distinct_edges(dup)) == [1, 3]


def test_scores(spark):
    n = spark.createDataFrame([node(x) for x in "ABC"], NODES_DDL)
    e = spark.createDataFrame([edge(1, "A", "B"), edge(2, "B", "C"), edge(3, "C", "A"), edge(4, "C", "gone")], EDGES_DDL)
    d = {r.id: (r.in_degree, r.usage_score) for r in score.degrees(n, e).collect()}
    assert d == {"A": (1, 1.0), "B": (1, 1.0), "C": (1, 1.0)}
    pr = [r.pagerank for r in score.pagerank(n, e, iterations=5).collect()]
    assert abs(sum(pr) - 1) < 1e-9 and max(pr) - min(pr) < 1e-9
    sink = score.pagerank(n, e.where("id = 1"), iterations=8).collect()
    assert abs(sum(r.pagerank for r in sink) - 1) < 1e-9
    assert score.pagerank(n.limit(0), e).count() == 0


def test_two_cliques(spark):
    left, right = ["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"]
    pairs = [(x, y) for g in (left, right) for i, x in enumerate(g) for y in g[i + 1 :]] + [("a4", "b1")]
    n = spark.createDataFrame([node(x) for x in (*left, *right, "alone")], NODES_DDL)
    e = spark.createDataFrame([edge(i, a, b) for i, (a, b) in enumerate(pairs)], EDGES_DDL)
    got = community.communities(n, e, gammas=[1.0]).collect()
    assert len(got) == 9
    groups = {}
    for r in got:
        groups.setdefault(r.community, set()).add(r.node_id)
    assert sorted(map(sorted, groups.values())) == [left, ["alone"], right]


def _tangle(spark, n=300, m=900):
    """A graph with clusters, a hub, repeated edges, loops and isolated nodes."""
    rng = random.Random(7)
    ends = [(i, rng.choice([0, i // 30 * 30 + rng.randrange(30), i // 30 * 30 + rng.randrange(30), rng.randrange(n)])) for i in (rng.randrange(n) for _ in range(m))]
    return spark.createDataFrame([node(f"n{i:03}") for i in range(n + 5)], NODES_DDL), spark.createDataFrame([edge(i, f"n{a:03}", f"n{b:03}") for i, (a, b) in enumerate(ends)], EDGES_DDL)


def test_communities_take_few_jobs(spark):
    n, e = _tangle(spark)
    sc = spark.sparkContext
    sc.setJobGroup("communities", "")
    got = community.communities(n, e).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("communities"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 3 * n.count() and jobs < 40


@pytest.mark.parametrize("held", [0, 100])
def test_communities_in_joins_and_in_arrays_are_the_same(spark, held):
    """held 0: all levels in joins; 100: the first in joins, the others in arrays."""
    n, e = _tangle(spark, 60, 150)
    want = {(r.resolution, r.node_id, r.community) for r in community.communities(n, e, gammas=[0.5, 2.0]).collect()}
    assert {(r.resolution, r.node_id, r.community) for r in community.communities(n, e, gammas=[0.5, 2.0], held=held).collect()} == want


def test_moving_in_arrays(spark, monkeypatch):
    assert [r.h % 2**64 for r in spark.range(-3, 1000).select(F.xxhash64("id").alias("h")).collect()] == moving.spark_hash(np.arange(-3, 1000)).tolist()
    rng = np.random.default_rng(3)
    a, b, w = rng.integers(0, 200, 700), rng.integers(0, 200, 700), rng.integers(1, 5, 700)

    def levels(scale=1):
        return moving.levels([a * scale, b * scale, w.copy()], 1.0, 2.0 * w.sum(), 50, 50)

    ids, comm, _ = levels()
    assert set(ids) == set(a) | set(b) and len(set(comm)) < 40 and set(comm) <= set(ids)
    far = levels(10**14)  # ids too far apart for a table of them; other hashes, so other rounds
    assert list(far[0]) == list(ids * 10**14) and set(far[1]) <= set(far[0])
    monkeypatch.setattr(moving, "CHUNK", 50)  # chunks of a few nodes
    assert list(levels()[1]) == list(comm)
    monkeypatch.setattr(moving, "_by_key", lambda key, w, most, top: (key[o := np.argsort(key, kind="stable")], w[o]))
    assert list(levels()[1]) == list(comm)


def test_labels(spark):
    rows = [("c", "1", "validateA", "pkg.validateA", 0.1), ("c", "2", "validateB", "pkg.validateB", 0.5), ("c", "3", "validateC", "pkg.validateC", None), ("d", "4", "x", "x", float("nan"))]
    m = spark.createDataFrame(rows, "comm string, id string, name string, qualified_name string, pagerank double")
    assert {r.comm: r.label for r in community.labels(m).collect()} == {"c": "pkg — validate* + validateB", "d": "x"}


def test_package_tree(spark):
    rows = [node("p1", "Package", "core", "core"), node("p2", "Package", "core/types", "core/types"), node("f", "File", "core/types/x.go", "core/types/x.go"), node("g", "File", "other/y.go", "other/y.go"), node("d", "Function", "core.Foo", "core/types/x.go"), node("b", "IfStmt", "core.Foo#IfStmt@3", "core/types/x.go")]
    got = {(r.parent_id, r.child_id, r.level) for r in packages.package_tree(spark.createDataFrame(rows, NODES_DDL)).collect()}
    assert got == {("p2", "f", 2), ("f", "d", 3), ("d", "b", 4)}


def test_text(spark, small):
    index = text.postings(small.nodes, "id", text.NODE_FIELDS)
    assert text.rewrite("gene").terms == (("gene", True),) and text.rewrite("g").terms == (("g", False),)
    assert text.rewrite("where is a crate weighed first").terms == (("where", True), ("crate", True), ("weighed", True), ("first", True))
    assert text.rewrite("a b").mode == "all" and text.rewrite('"x y"').mode == "phrase" and text.rewrite("검색").mode == "substring"
    assert ids(text.match(index, text.rewrite("func"))) == ["A", "B", "C"]
    assert ids(text.match(index, text.rewrite('"adds a crate"'))) == ["A"] and ids(text.match(index, text.rewrite('"a adds"'))) == []
    assert ids(text.search(small.nodes, index, "crate")) == ["A"] and ids(text.search(small.nodes, index, "...")) == []
    assert ids(text.search(small.nodes, index, "mypkg.FuncB", rank="id")) == ["B"]


def test_column_filters(spark, small):
    index = text.postings(small.nodes, "id", text.NODE_FIELDS)
    assert text.rewrite("{name doc_comment}: crate*") == text.Query("all", (("crate", True),), ("name", "doc_comment"))
    assert ids(text.match(index, text.rewrite("doc_comment: crate"))) == ["A"] and ids(text.match(index, text.rewrite("name: crate"))) == []
    assert ids(text.match(index, text.rewrite('doc_comment: "a crate"'))) == ["A"] and text.rewrite("pkg::name").cols == ()


def test_modularity_of_cliques(spark):
    pairs = [(x, y) for g in ("abcd", "efgh") for i, x in enumerate(g) for y in g[i + 1 :]] + [("d", "e")]
    p = spark.createDataFrame([(*x, 1) for x in pairs], "a string, b string, w bigint")
    two = spark.createDataFrame([(x, "1" if x < "e" else "2") for x in "abcdefgh"], "id string, comm string")
    assert abs(community.modularity(p, two).first()[0] - (12 / 13 - 0.5)) < 1e-12
    assert community.modularity(p.limit(0), two).first()[0] is None
    assert {(r.comm, r.label) for r in community.dense_labels(two).collect()} == {("1", 0), ("2", 1)}


def test_numbers_and_ranges(spark):
    from loomgraph.operators import skew
    from loomgraph.sources import store

    e = spark.createDataFrame([edge(None, "b", "a"), edge(None, "a", "b"), edge(None, "a", "b"), edge(None, "a", "a", "defines")], EDGES_DDL)
    assert [(r.src, r.dst) for r in store.number_edges(e).orderBy("id").collect()] == [("a", "a"), ("a", "b"), ("a", "b"), ("b", "a")]
    assert ids(store.number_edges(e)) == [1, 2, 3, 4] and store.number_edges(e.limit(0)).count() == 0
    rows = spark.range(10_000)
    assert skew.ranges_for(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and skew.ranges_for(rows, 1000) == 80


def test_resolution(spark):
    cols = NODES_DDL + ", file_ord STRING, ord INT"
    n = spark.createDataFrame([(*node("f1", q="a.Do", path="1.go"), "1", 1), (*node("f2", q="b.Do", path="2.go"), "2", 1), (*node("s", "CallSite", "a.Run#CallSite@9", "1.go"), "1", 5), (*node("r", q="a.Run", path="1.go"), "1", 3)], cols)
    p = spark.createDataFrame([("s", "calls", "Do", "1.go", 4), ("s", "calls", "Nowhere", "1.go", 5)], "src_id string, edge_type string, target_qname string, hint_file string, line int")
    got = resolve.resolve_go(resolve.lift_callsites(p, n), n).collect()
    assert [(r.src, r.dst, r.confidence) for r in got] == [("r", "f2", "EXTRACTED")]
    assert [r.dst for r in resolve.resolve_ts(p.withColumn("target_qname", F.lit("Do")), n).limit(1).collect()] == ["f1"]
    link = spark.createDataFrame([node("k", "Contract", "Vault", "V.sol", "sol"), node("c1", "Class", "Vault", "src/Vault.ts", "ts"), node("c2", "Class", "Vault", "src/TypeChain/contracts/Vault.ts", "ts")], NODES_DDL)
    assert [(r.src, r.dst) for r in resolve.link_contracts(link).collect()] == [("k", "c2")]


def test_walk_order_numbers_every_file(spark, tmp_path):
    from loomgraph.plans import reference

    paths = [f"r{i % 3}/d{'.' * (i % 2)}x/f{i:03}.go" for i in range(250)]
    spark.createDataFrame([(p,) for p in paths * 2], "file_path string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = {r.file_path: r.ord for r in reference.walk_order(spark, str(tmp_path)).collect()}
    assert got == {p: i + 1 for i, p in enumerate(sorted(paths, key=lambda p: p.split("/")))}
