"""From the mini tree to answers."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph import evaluate
from loomgraph.api import Graph
from loomgraph.functions import expr as X
from loomgraph.parse import extract
from loomgraph.pipeline import build
from loomgraph.sources import store, tree

MINI = Path(__file__).parent / "fixtures" / "mini"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("graph"))
    return build(spark, str(MINI), out), Graph(spark, out), out


def test_go_rows():
    f = extract.parse_file("go/store/shelf.go", (MINI / "go/store/shelf.go").read_text())
    kinds = [n["type"] for n in f.nodes]
    assert {k: kinds.count(k) for k in ("IfStmt", "LoopStmt", "SwitchStmt", "ReturnStmt", "Goroutine", "Struct", "Field", "Import")} == {"IfStmt": 1, "LoopStmt": 2, "SwitchStmt": 1, "ReturnStmt": 2, "Goroutine": 1, "Struct": 1, "Field": 2, "Import": 2}
    assert [n["sub_kind"] for n in f.nodes if n["type"] == "CallSite" and n["sub_kind"]] == ["send", "recv"]
    add = next(n for n in f.nodes if n["qualified_name"] == "store.Shelf.Add")
    assert add["signature"] == "func (Shelf) Add(...) ..." and add["doc_comment"] == "Add puts a crate on the shelf." and add["visibility"] == "exported"
    src = (MINI / "go/store/shelf.go").read_bytes()
    assert src[add["start_byte"] : add["end_byte"]].startswith(b"func (s *Shelf) Add") and src[: add["end_byte"]].endswith(b"return nil\n}")
    for n in f.nodes:
        if n["type"] == "CallSite" and not n["sub_kind"]:
            assert src[n["start_byte"] : n["end_byte"]].endswith(b")")


def test_ts_and_sol_rows():
    f = extract.parse_file("web/depot.ts", (MINI / "web/depot.ts").read_text())
    assert {(n["type"], n["qualified_name"]) for n in f.nodes} >= {("Class", "Depot"), ("Method", "Depot.fill"), ("Interface", "Crate"), ("TypeAlias", "Label"), ("Enum", "Mode"), ("Function", "pack"), ("Decorator", "sealed"), ("Import", "import:./log")}
    s = extract.parse_file("contracts/Depot.sol", (MINI / "contracts/Depot.sol").read_text())
    assert {(n["type"], n["qualified_name"]) for n in s.nodes} >= {("Contract", "Depot"), ("Function", "Depot.fill"), ("Modifier", "positive"), ("Event", "Filled"), ("Mapping", "held:mapping"), ("Field", "total")}
    assert {(r["edge_type"], r["target_qname"]) for r in s.pending} == {("has_modifier", "positive"), ("emits_event", "Filled"), ("writes_mapping", "held:mapping")}
    assert extract.PARSERS.of("a/B.SOL")[0] == "sol" and extract.PARSERS.of("a.txt") is None and extract.PARSERS.of(None) is None
    with pytest.raises(ValueError, match="already"):
        extract.PARSERS.register(".Go", "go", extract.go)
    many = "class A {\n" + "".join(f"  m{i}(a: number): {' | '.join(['B'] * 150)} {{ return {{ inner() {{}} }} }}\n" for i in range(3)) + "}\n"
    assert [n["qualified_name"] for n in extract.parse_file("a.ts", many).nodes if n["type"] == "Method"] == ["A.m0", "A.m1", "A.m2"]


def test_abi(spark):
    from loomgraph.operators import resolve

    rows = [("f0", "Function", "free", 1), ("c1", "Contract", "A", 5), ("f1", "Function", "x", 9), ("c2", "Contract", "B", 20), ("f2", "Function", "y", 30), ("f3", "Function", "z", 40)]
    n = spark.createDataFrame([(*r, "a.sol", "sol") for r in rows] + [("g", "Function", "w", 1, "b.sol", "sol")], "id string, type string, name string, start_byte int, file_path string, language string")
    assert {(r.contract, r.function) for r in resolve.abi(n).collect()} == {("A", "x"), ("B", "y"), ("B", "z")}
    assert resolve.abi(n.limit(0)).count() == 0


def test_from_source(spark):
    from loomgraph.pipeline import from_source

    g = from_source(spark, str(MINI), ["go"])
    assert {r.language for r in g.nodes.select("language").distinct().collect()} == {"go"} and g.edges.where("type = 'calls'").count() == 1


def test_build(built):
    m, g, out = built
    assert m["parse_errors_count"] == 1 and m["languages"] == {"go": 2, "ts": 1, "sol": 1} and m["stats"]["nodes"] == g.nodes.count()
    types = {r.type for r in g.edges.select("type").distinct().collect()}
    assert types >= {"contains", "defines", "imports", "calls", "spawns", "sends_to", "recvs_from", "has_modifier", "emits_event", "writes_mapping", "binds_to"}
    assert sorted(r.id for r in g.edges.select("id").collect()) == list(range(1, g.edges.count() + 1))
    assert abs(g.nodes.agg(F.sum("pagerank")).first()[0] - 1) < 1e-6
    call = g.edges.where("type = 'calls'").collect()
    names = {r.id: r.qualified_name for r in g.nodes.collect()}
    assert {(names[e.src], names[e.dst]) for e in call} == {("store.Shelf.Add", "store.Report")}
    assert g.topic_tree.groupBy("resolution").count().count() == 3 and g.topic_tree.where("topic_label = ''").count() == 0


def test_facade(built):
    _, g, _ = built
    assert [r.qname for r in g.find_symbol("Report", exact=False, include_blobs=True).collect()] == ["store.Report"]
    callers, edges = g.find_callers("store.Report")
    assert {r.qname for r in callers.collect()} == {"store.Shelf.Add", "store.Report"} and edges.count() == 1
    assert "Depot" in {r.name for r in g.search_text("depot").collect()} and g.search_text("").count() == 0
    c = g.context_for_task("puts a crate on the shelf")
    assert not c["not_found"] and c["bodies"] and c["tokens"] < 8000
    assert g.context_for_task("shelf", budget_tokens=1)["trimmed"] and not g.context_for_task("shelf", include_blobs=False)["bodies"]
    assert g.context_for_task("zzzz")["not_found"]
    n = g.find_symbol("store.Report").first()
    assert g.blob(n.id).startswith(b"func Report") and g.blob("none") is None
    assert g.manifest("other", 1)["graph_stale"] and not g.manifest()["graph_stale"] and g.hierarchy("topic").count() > 0


def test_export(built, spark, tmp_path):
    _, g, _ = built
    g.export(str(tmp_path))
    assert store.is_static(spark, str(tmp_path)) and store.read_export(spark, str(tmp_path), "nodes").count() == g.nodes.count()
    assert store.read_export(spark, str(tmp_path), "edges").count() == g.edges.count()
    assert json.loads((tmp_path / "manifest.json").read_text())["schema_version"] == "1.0"
    assert len(list((tmp_path / "blobs").iterdir())) == g.blobs.count()
    tree_file = json.loads((tmp_path / "hierarchy" / "pkg_tree.json").read_text())
    assert len(tree_file) == g.pkg_tree.count() and set(tree_file[0]) <= {"parent_id", "child_id", "level"}
    e = store.Export(spark, str(tmp_path))
    assert e.hierarchy("pkg").count() == g.pkg_tree.count() and e.hierarchy("topic").count() == g.topic_tree.count() and e.search("depot").count() == 0
    one = g.find_symbol("store.Report").first().id
    assert [r.id for r in e.nodes_by_ids([one]).collect()] == [one] and e.edges_of([one]).count() == g.edges_of([one]).count()
    assert sorted(r.id for r in e.children().collect()) == sorted(r.id for r in g.children().collect())


def test_ignore(spark):
    p = spark.createDataFrame([(x,) for x in ("vendor/x.go", "a/vendor/x.go", "a/b.generated.go", "build", "build/q.ts", "src/m.go")], "file_path string")
    got = {r.file_path for r in p.where(tree.ignored(F.col("file_path"), tree.parse_ignore("# c\n\nvendor/\n*.generated.*\nbuild/\n"))).collect()}
    assert got == {"vendor/x.go", "a/b.generated.go", "build", "build/q.ts"}


def test_eval_command(spark, tmp_path, capsys):
    from loomgraph.cli import main

    (tmp_path / "t.yaml").write_text('id: T1\nexpected:\n  symbols:\n    - "a.b"\nscoring:\n  type: precision_recall\n')
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"task_id": "T1", "baseline": b, "output": "a.b", "input_tokens": n}) for b, n in (("alpha", 10), ("delta", 4))))
    assert main(["eval", "--tasks", str(tmp_path / "*.yaml"), "--answers", str(tmp_path / "a.jsonl"), "--out", str(tmp_path / "out"), "--baselines", "alpha,delta"]) == 0
    assert "H1 token saving: 60.0%" in capsys.readouterr().out
    rows = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert {(r.baseline, r.score) for r in rows} == {("alpha", "1.0000"), ("delta", "1.0000")} and len(rows[0]) == 9


def test_manifest_round_trip(spark):
    m = {"schema_version": "1.0", "languages": {"go": 2}, "ckgignore": ["a"], "parse_errors_count": 3}
    row = store.read_manifest(store.manifest_rows(spark, m), None).first()
    assert (row.schema_version, row.languages, row.ckgignore, row.parse_errors_count, row.stats) == ("1.0", {"go": 2}, ["a"], 3, None)


def test_evaluation(spark):
    t = evaluate.read_task('id: T1\ndescription: |\n  one\n  two\nexpected:\n  symbols:\n    - "a.b"\n    - c.d\n  rubric:\n    - "uses mapping"\nscoring:\n  type: precision_recall\n')
    assert (t.id, t.description, t.symbols, t.rubric, t.scoring) == ("T1", "one\ntwo", ["a.b", "c.d"], ["uses mapping"], "precision_recall")

    def answer(task, baseline):
        if baseline == "gamma":
            raise RuntimeError("no answer")
        return {"output": "see `a.b`, x.y and .z", "input_tokens": 100 if baseline == "alpha" else 40}

    res = evaluate.run(spark, [t], answer)
    assert {r.baseline: r.score for r in res.collect()} == {"alpha": 0.5, "beta": 0.5, "delta": 0.5}
    assert "H1 token saving: 60.0%" in evaluate.report(res) and "H2 score difference: +0.000" in evaluate.report(res)
    h = evaluate.hypotheses(res).first()
    assert (h.h1_text, h.h2_text) == ("60.0%", "+0.000") and evaluate.hypotheses(res.limit(0)).count() == 0
    one = spark.createDataFrame([("The contract uses mapping here", "uses mapping"), (None, "uses mapping"), ("x", "a b")], "o string, r string")
    assert [r[0] for r in one.select(X.rubric_hit(F.col("o"), F.col("r"))).collect()] == [True, False, False]
