"""Each operator on small inputs with known or brute-force results, nulls, ties and empty tables."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, docpairs, handwritten, mixing, parsing, rank_walk, residue

# --- rankings ---------------------------------------------------------------------------------------


def chain(rows, damping=0.85):
    """The walk as a full matrix."""
    n, k = len(rows), len(rows[0])
    p = np.zeros((n, n))
    for s in range(k):
        known = [i for i in range(n) if rows[i][s] is not None]
        unknown = [i for i in range(n) if rows[i][s] is None]
        for i in range(n):
            if rows[i][s] is None:
                p[i] += 1 / (n * k)
                continue
            up = [j for j in known if rows[j][s] >= rows[i][s]]
            for j in up:
                p[i, j] += (len(known) / n) / len(up) / k
            for j in unknown:
                p[i, j] += 1 / (n * k)
    pi = np.full(n, 1 / n)
    for _ in range(400):
        pi = damping * pi @ p + (1 - damping) / n
    return pi


def test_rank_walk_is_the_chain(spark):
    r = random.Random(3)
    rows = [(r.choice([0, 1, 2, 900]), r.random() if r.random() < 0.8 else None, float(r.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame([(f"k{i:02}", *x, "clash") for i, x in enumerate(rows)], "id string, a int, b double, c double, s0 string")
    got = {x.id: x for x in rank_walk.rank(df, "id", ["a", "b", "c"]).collect()}
    want = chain(rows)
    assert len(got) == 60 and sorted(x["rank"] for x in got.values()) == list(range(1, 61))
    for i, w in enumerate(want):
        assert abs(got[f"k{i:02}"].probability - w) < 1e-8
    order = sorted(got.values(), key=lambda x: x["rank"])
    assert all(a.probability >= b.probability for a, b in zip(order, order[1:], strict=False))


def test_rank_walk_scale_does_not_matter(spark):
    rows = [(i, (i * 7) % 30, float((i * 11) % 30)) for i in range(30)]
    a = spark.createDataFrame([(str(i), *x) for i, x in enumerate(rows)], "id string, a int, b int, c double")
    b = a.withColumn("a", F.pow(F.lit(1.7), "a")).withColumn("c", F.col("c") / 1e9)
    ranks = [{x.id: x["rank"] for x in rank_walk.rank(d, "id", ["a", "b", "c"]).collect()} for d in (a, b)]
    assert ranks[0] == ranks[1]


def test_rank_walk_edges(spark):
    df = spark.createDataFrame([("b", -1, float("nan")), ("a", None, None)], "id string, a int, b double")
    assert [x.id for x in rank_walk.rank(df, "id", ["a", "b"]).orderBy("rank").collect()] == ["a", "b"]
    assert rank_walk.rank(df.limit(0), "id", ["a", "b"]).count() == 0
    rows = spark.createDataFrame([("x", 1, 5), ("x", 3, 7), ("x", None, 9), ("x", 3, 7), (None, 9, 1)], "id string, at int, v int")
    assert [(r.id, r.v) for r in rank_walk.newest(rows, "id", "at", ["v"]).collect()] == [("x", 7)]


def test_coarse_levels_keep_the_order(spark):
    n = 3000
    r = random.Random(5)
    df = spark.createDataFrame([(f"{i:05}", r.lognormvariate(0, 3), r.random()) for i in range(n)], "id string, a double, b double")
    fine = {x.id: x["rank"] for x in rank_walk.rank(df, "id", ["a", "b"], levels=4000).collect()}
    coarse = {x.id: x["rank"] for x in rank_walk.rank(df, "id", ["a", "b"], levels=256).collect()}
    x, y = np.array([fine[i] for i in sorted(fine)]), np.array([coarse[i] for i in sorted(fine)])
    assert np.corrcoef(x, y)[0, 1] > 0.999


def test_many_values_are_the_chain(spark):
    r = random.Random(8)
    rows = [(r.lognormvariate(0, 2) if r.random() < 0.9 else None, float(r.randrange(700)), float(r.randrange(3)) if r.random() < 0.9 else None) for _ in range(1500)]
    df = spark.createDataFrame([(f"{i:04}", *x) for i, x in enumerate(rows)], "id string, a double, b double, c double")
    got = {x.id: x for x in rank_walk.rank(df, "id", ["a", "b", "c"]).collect()}
    want = chain(rows)
    assert sorted(x["rank"] for x in got.values()) == list(range(1, 1501))
    for i, w in enumerate(want):
        assert abs(got[f"{i:04}"].probability / w - 1) < 1e-7
    best = sorted(range(1500), key=lambda i: -want[i])[:50]
    assert [got[f"{i:04}"]["rank"] for i in best] == list(range(1, 51))


# --- tokens -----------------------------------------------------------------------------------------


def reference_tokenizer():
    import public_tokenizers
    import tiktoken

    e = bpe.encoder(bpe.vocabulary_path(), public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


TEXTS = ["", None, "Hello, world!  <|endoftext|>\n\t x", "한국어 텍스트와 code_42", "a" * 3000, " " * 500 + "x", "🚀👩‍💻🧪", "don't we'll I'D", "\x00\x01", "ﬁ é é", "=" * 200 + "\r\n" * 20]


def test_encoding_is_exact(spark):
    tok = reference_tokenizer()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "z"), (None, "x", "z")], "doc_id bigint, text string, ids string")
    got = bpe.encode(df, "doc_id", "text").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert list(r.ids) == tok.encode_ordinary("x" if r.doc_id is None else TEXTS[r.doc_id] or "")
    counts = {r.doc_id: r.n_tokens for r in bpe.encode(df, "doc_id", "text", counts_only=True).collect()}
    assert counts[0] == counts[1] == 0 and counts[4] == len(tok.encode_ordinary(TEXTS[4]))
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_encoding_random():
    tok = reference_tokenizer()
    import public_tokenizers

    e = bpe.TrieEncoder(bpe.vocabulary_path(), public_tokenizers.PATTERN)
    r = random.Random(1)
    texts = ["".join(r.choice("abcdeéß한🚀\n\t  ABC12-_=") for _ in range(r.randrange(200))) for _ in range(400)]
    flat, off = e.encode_batch(texts)
    assert [flat[a:b] for a, b in zip(off, off[1:], strict=False)] == [tok.encode_ordinary(t) for t in texts]


# --- mixing -----------------------------------------------------------------------------------------


def test_schedule_deviates_less_than_a_block():
    w = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    plan = sorted(mixing.schedule(w, {s: round(1000 * x) for s, x in w.items()}), key=lambda x: x[2])
    assert [p[2] for p in plan] == list(range(1000))
    seen = Counter()
    for s, k, slot in plan:
        assert seen[s] == k
        seen[s] += 1
        for x in w:
            assert abs(seen[x] - w[x] * (slot + 1)) < 1


def test_mixture(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["word"] * r.randrange(20, 60)), r.choice(["Big", "big ", "BIG"])) for i in range(400)]
    rows += [(1000 + i, " ".join(["term"] * 40), "small") for i in range(10)] + [(2000, None, "small"), (2001, "", "small"), (2002, "text", None), (2003, "text", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copy", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.8, 2), (" Small", 0.2, 5), ("absent", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mixture(docs, targets, n_blocks=64)
    got = mix.documents().collect()
    uses = Counter(x.doc_id for x in got)
    assert not set(uses) & {2000, 2001, 2002, 2003}
    assert max(n for i, n in uses.items() if i >= 1000) <= 5 and max(n for i, n in uses.items() if i < 1000) <= 2
    assert {uses[1000 + i] for i in range(10)} <= {4, 5} and len({(x.doc_id, x.copy) for x in got}) == len(got)
    shares = {x.source: x for x in mix.shares().collect()}
    assert abs(shares["big"].actual_share - 0.8) < 0.03 and abs(shares["small"].actual_share - 0.2) < 0.03
    assert shares["absent"].n_tokens == 0 and sum(x.actual_share for x in shares.values()) == pytest.approx(1)
    # every prefix of slots stays near the targets
    per = Counter()
    for x in sorted(got, key=lambda x: (x.slot, x.source, x.position)):
        per[x.source] += x.n_tokens
    assert sum(per.values()) == sum(x.n_tokens for x in got)
    empty = mixing.Mixture(docs.limit(0), targets)
    assert empty.documents().count() == 0 and {x.n_tokens for x in empty.shares().collect()} == {0}


# --- files that don't parse -------------------------------------------------------------------------


def test_refused_and_rates(spark):
    rows = [(1, "r", "r/a.go", "package a\n"), (2, "r", "r/b.go", "package"), (2, "r", "r/b.go", "package"), (3, "r", "r/c.ts", "let x = ("), (4, "q", "q/d.txt", "("), (5, "q", None, "("), (6, "q", "q/e.sol", None), (None, None, "x.sol", "contract {")]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, content string").withColumn("language", F.lit("clash"))
    got = {(r.file_id, r.language, r.error_line) for r in parsing.refused(files).collect()}
    assert got == {(2, "go", 1), (3, "ts", 1), (None, "sol", 1)}
    manifest = spark.createDataFrame([("r", "parse_errors_count", "7"), ("r", "parse_errors_count", "x"), ("r", "stats", "{}")], "repo string, key string, value string")
    rates = {(r.repo, r.language): (r.n_files, r.n_refused, r.reported_errors) for r in parsing.rates(files, manifest).collect()}
    assert rates == {("r", "go"): (2, 1, 7), ("r", "ts"): (1, 1, 7), (None, "sol"): (1, 1, None)}
    assert parsing.refused(files.limit(0)).count() == 0


# --- files not written by hand ----------------------------------------------------------------------

BODY = "package a\n\n" + "\n".join(f"func step{w}(ctx Ctx, item{w} *Item) error {{\n\tresult{w} := item{w}.load(ctx, \"{w}\")\n\treturn result{w}\n}}" for w in "alpha beta gamma delta epsilon zeta eta theta".split())


def other(words):
    return "package b\n\n" + "\n".join(f"func make{w}(in In{w}) Out{w} {{\n\tout := convert{w}(in, true)\n\treturn out.finish{w}()\n}}" for w in words)


def test_marks_and_composition():
    j = handwritten.judge
    assert j("r", "// Code generated by x. DO NOT EDIT.\npackage a\n") == "generated"
    assert j("r", "// written by hand; do not edit the vendored folder\npackage a\n") is None
    assert j("r", "// Helpers to detect machine-generated files.\npackage a\n") is None
    assert j("r", "//" + " long words" * 500 + "\n// This file is generated by the schema compiler.\npackage a\n") == "generated"
    assert j("r", "package a\n\nconst banner = \"// Code generated by %s. DO NOT EDIT.\"\n") is None
    assert j("r", "// this stub used to be generated code, rewritten by hand since\npackage a\n") is None
    assert j("r", "// Copyright 2023 the r authors.\npackage a\n") is None
    assert j("r", "// Copyright (c) 2018 libfoo contributors. See its licence.\npackage a\n") == "third-party"
    assert j("r", "/*! libfoo v1.2 */\nvar a = 1\n") == "third-party"
    assert j("r", "export const t = [\n" + "\n".join("  " + ", ".join(str(i * 17 + k) for k in range(9)) + "," for i in range(9)) + "\n];\n") == "data"
    assert j("r", "package a\n\nvar small = []byte{0x01, 0x02, 0x03}\n\n" + BODY) is None
    assert j("r", "library T { bytes constant RAW = hex\"" + "ab" * 300 + "\"; }\n") == "data"
    assert j("r", "".join(f"function a{i}(e,t){{return e?t.b{i}:{i}}}" for i in range(40))) == "minified"
    assert j("r", "".join(f"export function enc{i}(w, x) {{\n  w.put(x[{i}]);\n  return w;\n}}\n\n" for i in range(20))) == "generated"
    assert j("r", BODY) is None and j("r", None) is None and j("r", " \n") is None
    assert j("r", "// minified? no: a long help text\nexport const help = '" + "plain words of help " * 40 + "';\n" + "const a = 1;\nconst b = go(a);\n" * 4) is None


def test_copies(spark):
    edited = BODY.replace("stepbeta", "stepBETA").replace("return resultalpha", "return wrap(resultalpha)") + "\n// changed here for us\n"
    rows = [(1, "p", "p/x.go", BODY), (2, "q", "q/deep/y.go", edited), (3, "s", "s/own.go", other(["One", "Two", "Three", "Four", "Five"])), (4, "p", "p/again.go", other(["Six", "Seven", "Eight", "Nine"])), (5, "p", "p/again2.go", other(["Six", "Seven", "Eight", "Nine"])), (1, "p", "p/x.go", BODY), (6, None, None, None), (7, "z", "z/e.go", ""), (8, "w", "w/x.go", BODY)]
    rows += [(100 + i, f"o{i % 7}", "f.go", other([f"Only{i}{k}" for k in "abcdef"])) for i in range(40)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, content string")
    assert sorted(r.file_id for r in handwritten.copies(df).collect()) == [1, 2, 8]
    got = {r.file_id: r.reason for r in handwritten.not_handwritten(df).collect()}
    assert got == {1: "copy", 2: "copy", 8: "copy"}
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_many_exact_copies(spark):
    # far more files than a rare line may have hold the same text
    rows = [(i, f"r{i % 9}", BODY) for i in range(60)] + [(100 + i, f"r{i % 9}", other([f"Only{i}{k}" for k in "abcdef"])) for i in range(20)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, content string")
    assert sorted(r.file_id for r in handwritten.copies(df).collect()) == list(range(60))


def test_copies_beside_the_own_repository(spark):
    parts = ["Aa", "Bb", "Cc", "Dd", "Ee", "Ff"]
    edited = other(parts) + "\nvar changedHere = true\n"
    # the largest class with these lines lies in the copy's own repository
    rows = [(1, "p", edited), (2, "q", other(parts) + "\nvar inAnotherPlace = 1\n")] + [(10 + i, "p", other(parts)) for i in range(4)]
    # no line names one partner for all: every file changes another part, each part is in 30 files
    many = [(100 + i, f"m{i % 5}", other([w for k, w in enumerate(["Gg", "Hh", "Ii", "Jj", "Kk", "Ll"]) if k != i % 6]) + f"\nvar newHere{i} = true\n") for i in range(36)]
    rows += many + [(200 + i, f"o{i % 7}", other([f"Only{i}{k}" for k in "abcdef"])) for i in range(10)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, content string")
    found = {r.file_id for r in handwritten.copies(df).collect()}
    assert {1, 2, 10, 11, 12, 13} <= found and not found & set(range(200, 210))
    # frequent lines whose holders are versions of one file
    assert {x[0] for x in many} <= found


# --- documentation ----------------------------------------------------------------------------------

GO = '''package p

// Add sums both numbers and wraps past 63 bits.
func Add(a, b int) int {
	s := "func Fake() {" // not a function
	return a + b
}

// apart from the next one

func Lone() {}

x := 1 // trailing comment
func Next() {
}

/*
Rejects a { nil receiver.
*/
func (s *Set) Put(v int) error { return nil }
'''


def test_declarations():
    got = {d.name: (d.line, d.end_line, d.doc) for d in docpairs.declarations("go", GO)}
    assert got == {"Add": (4, 7, "Add sums both numbers and wraps past 63 bits."), "Lone": (11, 11, None), "Next": (14, 15, None), "Put": (20, 20, "Rejects a { nil receiver.")}
    ts = "export class A {\n  /** Waits for the lock. */\n  async take(n: number): Promise<void> {\n    if (n) { go(n); }\n  }\n}\n\n// Runs once.\nexport async function run(a: any) {\n  const r = /[{(]+\\d{2}$/;\n}\n"
    assert {(d.name, d.line, d.end_line, d.doc) for d in docpairs.declarations("ts", ts)} == {("take", 3, 5, "Waits for the lock."), ("run", 9, 11, "Runs once.")}
    sol = "contract C {\n    /// @notice Locks it.\n    /// Twice is an error.\n    function a(uint256 x) external {\n    }\n    modifier m() { _; }\n}\n"
    assert {(d.name, d.line, d.doc) for d in docpairs.declarations("sol", sol)} == {("a", 4, "@notice Locks it.\nTwice is an error."), ("m", 6, None)}


@pytest.mark.parametrize("doc", ["Returns nil after Close.", "Panics on a nil vault.", "TODO: speed this up. loadVault copies every vault first.", "nolint:x\nOverflow wraps silently past 63 bits.", "@notice TODO: speed this up. loadVault copies every vault first.", "@dev Rejects a vault that was signed twice.", "@param v the stale vault to start from", "빈 vault 이면 오류 대신 기본값을 돌려준다.", "Verwirft Einträge, die älter als 5 Runden sind.", "Deprecated: ignores limits; prefer storeVault.", "See the note on vaults: the lock given here is freed on return."])
def test_informative(doc):
    assert docpairs.informative(doc, "loadVault", "func loadVault(...)")


@pytest.mark.parametrize("doc", [None, "", "  \n", "TODO", "FIXME add docs", "loadVault", "loadVault loads vault.", "Loads the vault.", "This function loads vaults.", "@param vault", "@param vault the vault", "@returns", "@dev", "@notice loadVault", "@notice TODO: document", "go:noinline", "eslint-disable-next-line no-empty", "----------", "if ok { return vault; }", "return nil, err", "vault.load(x)", "see above", "{@link storeVault}", "Copyright 2022 the authors. All rights are kept by them and their heirs.", "SPDX-License-Identifier: X", "Beschreibung folgt.", "설명 추가 예정", "Description of the function.", "#region loadVault", "*", "...", "<p></p>", "tbd", "helper"])
def test_trivial(doc):
    assert not docpairs.informative(doc, "loadVault", "func loadVault(...)")


def test_documented(spark):
    files = spark.createDataFrame([("p/a.go", GO), ("p/a.go", GO), ("p/b.go", None), (None, GO)], "file_path string, content string").withColumn("id", F.lit("clash"))
    cols = "id string, type string, name string, qualified_name string, signature string, doc_comment string, file_path string, start_line int"
    nodes = spark.createDataFrame([("1", "Function", "Add", "p.Add", None, None, "p/a.go", 4), ("2", "Function", "Lone", "p.Lone", None, None, "p/a.go", 11), ("3", "Method", "Put", "p.Set.Put", None, "TODO", "p/a.go", 20), ("4", "Function", "Gone", "p.Gone", None, None, "p/a.go", 1), ("5", "Struct", "Add", "p.Add", None, "Says a lot about nothing here.", "p/a.go", 4), ("6", "Modifier", "m", "C.m", None, "Only the owner may pass.", None, None), ("7", "Function", "Put", "p.Put", None, None, "p/a.go", None), ("8", "Function", None, None, None, "", "p/a.go", 1)], cols)
    assert sorted(r.id for r in docpairs.documented(nodes, files).collect()) == ["1", "6", "7"]
    assert docpairs.documented(nodes.limit(0), files).count() == 0 and sorted(r.id for r in docpairs.documented(nodes, files.limit(0)).collect()) == ["6"]


# --- residue ----------------------------------------------------------------------------------------

LEFT = [
    ("# {headerTitle}\n\nSummary: {owner}", "placeholder"),
    ("Real text. Contact: [project_name goes here]", "placeholder"),
    ("Dear {{ owner }}, the build ended.", "placeholder"),
    ("Welcome to <%= offset_count %>.", "placeholder"),
    ("Team: __project_name__", "placeholder"),
    ("# Notes\n\nText goes here.", "filler"),
    ("Mipen sorat perum ommo brenit mipen brenit tesquin asti untem relit sorat relit holten gravis sorat nullo brenit cando ommo.", "filler"),
    ("blah blah blahblah blah", "filler"),
    ("여기에 내용을 입력하세요", "filler"),
    ("Home > Docs > X\n\n404 - page not found\nThe address you asked for doesn't exist on this server. Go back to the start page.\n\nHelp | Contact", "error"),
    ("<html><head><title>X</title></head><body><h1>Oops! Access denied.</h1></body></html>", "error"),
    ("Bitte aktivieren Sie JavaScript, um den Graph zu sehen.", "error"),
    ("Checking your browser before you go on. This takes up to 5 seconds.", "error"),
]
KEPT = [
    None, "", " \n ",
    "The page template prints `{{ .Token }}` for every packet.",
    "```sh\nexport X={{ owner }}\n```\nSet it first.",
    "GET /api/blob/{id} answers 404 when the node has no source, and the viewer then shows an empty panel.",
    "In the schema, `__init__` and `%s` are plain names and {braces} mark a set of offsets.",
    "Users saw \"page not found\" after we renamed the route. Fixed by redirecting the old address.",
    "The static viewer needs JavaScript. Without it we render a plain list.",
    "HTTP 503 is what the proxy sends while it restarts, so check() waits 24 seconds and asks again.",
    "| code | when |\n|---|---|\n| 404 | no such voucher |",
    "Test data used to contain filler such as \"text goes here\"; the check now refuses it.",
    "The parser skips files it can't read and counts them.",
    "- add: build takes $(OUT) from the Makefile",
    "See [the guide](guide.md) and [1]; `a[i]` and list[int] too.",
    "<|endoftext|> session",
]


@pytest.mark.parametrize(("text", "why"), LEFT)
def test_residue(text, why):
    assert residue.residue(text) == why


@pytest.mark.parametrize("text", KEPT)
def test_no_residue(text):
    assert residue.residue(text) is None


def test_residue_table(spark):
    rows = [(i, t) for i, t in enumerate([x for x, _ in LEFT] + KEPT)] + [(0, LEFT[0][0]), (None, "Text goes here.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("reason", F.lit("clash"))
    got = residue.found(df).collect()
    assert len(got) == len(LEFT) + 2 and {r.doc_id for r in got} == {*range(len(LEFT)), None}
    assert residue.found(df.limit(0)).count() == 0


def test_delimiters_all_count():
    for a, b in [("{{", "}}"), ("{{ ", " }}"), ("<%= ", " %>"), ("@@", "@@"), ("%%", "%%"), ("#{", "}"), ("%{", "}"), ("${", "}"), ("{$", "}"), ("[[", "]]"), ("__", "__"), ("<insert ", " here>"), ("<Your ", ">"), ("[", " goes here]"), ("<TODO: ", ">"), ("{", "}"), ("[", "]")]:
        for name, ctx in product(("owner", "cursor_count", "epochTitle", "release date"), ("Written by {} today.", "| {} | x |")):
            assert residue.residue(ctx.replace("{}", a + name + b)) == "placeholder", (a, name, b)


def test_documented_code(spark):
    cols = "id string, type string, name string, qualified_name string, signature string, doc_comment string, file_path string, start_line int"
    rows = [("1", "Function", "Add", "p.Add", "func Add", None, "p/a.go", 4), ("2", "Method", "Put", "p.Put", "func Put", "Rejects values beyond the quota.", "p/a.go", 20), ("3", "Function", "Gone", "p.Gone", "func Gone", "Rejects values beyond the quota.", "p/none.go", 1), ("4", "Function", "Lone", "p.Lone", "func Lone", None, "p/a.go", 11)]
    nodes, files = spark.createDataFrame(rows, cols), spark.createDataFrame([("p/a.go", GO), ("p/a.go", GO)], "file_path string, content string")
    got = {r.id: r.code for r in docpairs.documented(nodes, files, code=True).collect()}
    assert got == {"1": "\n".join(GO.split("\n")[3:7]), "2": "func (s *Set) Put(v int) error { return nil }", "3": None}
    assert set(got) == {r.id for r in docpairs.documented(nodes, files).collect()}


def test_owners_and_long_lists():
    go = "package a\n\n// Closes the file.\nfunc (f *File) Close() error {\n\treturn nil\n}\n\n// Closes the lock.\nfunc (Lock) Close() {\n}\n"
    assert [(d.owner, d.name, d.line, d.end_line, d.doc) for d in docpairs.declarations("go", go)] == [("File", "Close", 4, 6, "Closes the file."), ("Lock", "Close", 9, 10, "Closes the lock.")]
    many = ", ".join(f"a{i} = 'x)' /* ( */" for i in range(1500))
    ts = f"class A extends B {{\n  run({many}) {{\n    return 1\n  }}\n}}\nclass C {{\n  run() {{}}\n}}\nfunction run() {{}}\n"
    assert [(d.owner, d.name, d.line) for d in docpairs.declarations("ts", ts)] == [("A", "run", 2), ("C", "run", 7), (None, "run", 9)]


def test_pairs_take_the_owners_declaration(spark):
    go = "package a\n\n// Closes the file after flushing it.\nfunc (f *File) Close() {\n\tflush()\n}\n\n// Gives the lock back to its pool.\nfunc (Lock) Close() {\n}\n"
    files = spark.createDataFrame([("r/a.go", go)], "file_path string, content string")
    cols = "id string, type string, name string, qualified_name string, signature string, doc_comment string, file_path string, start_line int"
    # the stale line of the first lies at the second
    nodes = spark.createDataFrame([("1", "Method", "Close", "r/a.File.Close", None, None, "r/a.go", 9), ("2", "Method", "Close", "Close", None, "Waits until all readers are gone.", "r/a.go", 9), ("3", "Function", None, None, None, None, None, None)], cols)
    got = {r.id: r for r in docpairs.documented(nodes, files).collect()}
    assert set(got) == {"1", "2"} and got["1"].documentation == "Closes the file after flushing it." and (got["1"].first_line, got["1"].last_line) == (4, 6)
    assert got["1"].code.startswith("func (f *File) Close()") and got["1"].code.endswith("}") and got["2"].first_line == 9


@pytest.mark.parametrize(("doc", "says"), [("License checks are skipped for trial users whose plan ended.", True), ("Copyright notices are stripped from texts before hashing.", True), ("Idempotent.", True), ("古い索引を消してから書き込む。", True), ("Getter for the property count field.", False), ("No description available yet sorry.", False), ("Copyright 2020 The Example Authors", False), ("Licensed under the Example License 2.0", False)])
def test_what_says_something(doc, says):
    assert docpairs.informative(doc, "count") is says


def test_index_alone_finds_edited_vendored_copies(spark):
    """Recall of the index without marks and composition: each library file lies edited in 1 to 40 repositories."""
    r = random.Random(4)
    rows, made = [], set()
    for lib in range(12):
        lines = [f"    value{lib}_{i} = transform(step_{r.randrange(10**6)}, {i})" for i in range(40)]
        for copy in range(r.choice([2, 3, 8, 40])):
            edited = [x if r.random() > 0.1 else f"    edited_{r.randrange(10**9)} = local()" for x in lines]
            made.add(len(rows))
            rows.append((len(rows), f"repo{lib}_{copy}", "\n".join(edited)))
    for k in range(300):
        own = "\n".join(f"    own_{k}_{i} = compute(base_{r.randrange(10**6)})" for i in range(25)) + "\n    if err != nil {\n        return nil, err\n"
        rows.append((len(rows), f"team{k % 30}", own))
    df = spark.createDataFrame(rows, "file_id bigint, repo string, content string")
    got = {x.file_id for x in handwritten.copies(df).collect()}
    assert len(got & made) >= 0.9 * len(made) and not got - made


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("Just a moment...", "error"),
        ("Error establishing a database connection", "error"),
        ("Attention Required! | Cloudflare", "error"),
        ("403 - Verboten", "error"),
        ("Questo sito richiede JavaScript.", "error"),
        ("Для просмотра включите JavaScript", "error"),
        ("ページが見つかりません", "error"),
        ("```\n404 Not Found\n```", "error"),
        ("La page n'existe plus. " * 200, "error"),
        ("# Report\n\nName: TBD\n\nThe rest is as planned.", "placeholder"),
        ("Contact: ________", "placeholder"),
        ("Dear {{ name }}, your order left us.", "placeholder"),
        ("In Jinja the syntax {{ name }} prints a variable.", None),
        ("The syntax {{ a }} prints a.\nThe syntax {{ b }} and its braces print b.\nSo this {{ user_name }} greets the one who reads the page after all the other lines were rendered by it once.", None),
        ("A server answers 404 where a page is missing, and the cache keeps that answer for a minute before it asks once more.", None),
        ("```\nreturn 404\nx := load()\n```\nPage not found.", None),
    ],
)
def test_residue_by_shape(text, why):
    assert residue.residue(text) == why


def test_rank_walk_of_wide_scores(spark):
    """The way without values on the driver is the same walk."""
    r = random.Random(9)
    rows = [(r.lognormvariate(0, 2) if r.random() < 0.9 else None, float(r.randrange(12)), r.random() if r.random() < 0.8 else None) for _ in range(150)]
    df = spark.createDataFrame([(f"{i:04}", *x) for i, x in enumerate(rows)], "id string, a double, b double, c double")
    got = {x.id: x for x in rank_walk.rank(df, "id", ["a", "b", "c"], damping=0.05, driver_values=0).collect()}
    want = chain(rows, 0.05)
    assert sorted(x["rank"] for x in got.values()) == list(range(1, 151))
    for i, w in enumerate(want):
        assert abs(got[f"{i:04}"].probability / w - 1) < 1e-7
