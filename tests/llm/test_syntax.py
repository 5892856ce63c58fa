"""Accepted and refused files per grammar."""

import pytest

from loomgraph.llm.syntax.parser import first_error

GOOD = {
    "a.go": [
        "package a\n",
        "\ufeffpackage a\r\n\r\nimport (\r\n\t\"fmt\"\r\n\t. \"os\"\r\n)\r\n",
        "package a\nfunc f[T any, K ~int | ~string](x T, ys ...K) (n int, err error) {\n\tif v, ok := m[x]; ok && v == (T{}) {\n\t\treturn 1, nil\n\t} else if p := (T{1}); p != nil {\n\t}\n\tfor i := range []int{1, 2} {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch t := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\tcase ch <- 1:\n\t}\nL:\n\tfor {\n\t\tbreak L\n\t}\n\tdefer func() { recover() }()\n\tx.y[1:2:3] = map[string][]struct{ A, B int }{\"k\": {{1, 2}}}\n\treturn\n}",
        "package a\n\ntype (\n\tS struct {\n\t\t*E\n\t\tp.Q `tag`\n\t\ta, b func(int) (string, error)\n\t}\n\tI interface {\n\t\tM(x int) error\n\t\t~int | string\n\t}\n\tG[T any] []T\n\tA = chan<- int\n)\n\nconst (\n\tx = iota\n\ty\n)\n\nvar z, w = 0x1F, 'a'\n",
        "package a\nfunc f() { if x := g(func() int { return 1 }); x > 0 { for ; ; { } } }\n",
    ],
    "a.ts": [
        "",
        "// only a comment",
        "import type { A } from './a'\nimport b, * as c from \"b\"\nexport type { A }\nexport abstract class C<T extends A = A> extends B<T> implements I, J {\n  private readonly x?: number = 1\n  static #y = 2;\n  constructor(private a: string, public b?: number) { super() }\n  get v(): number { return this.#z }\n  async *gen<T>(this: C<T>, ...r: T[]): AsyncGenerator<T> { yield* r }\n  [key: string]: unknown\n  abstract m(): void\n}",
        "type M<T> = { readonly [K in keyof T as `x${K}`]?: T[K] extends (infer U)[] ? U : never } & { a: 1 } | null\nfunction is(x: unknown): x is string { return typeof x === 'string' }\nconst f = async <T,>(a: T, { b = 1, ...c }: { b?: number } = {}): Promise<T> => ({ ...a })!\nlet y = <number>z as const; enum E { A = 1, B }\ndeclare module 'm' { export const q: number }\nnamespace N.M { export = x }",
        "for (const [a, b] of Object.entries(x)) if (/[/]\\/{2}/.test(a)) continue; else break\nlabel: do { i++ } while (i < 3)\nconst g = a < b && c > (d) ? f<T>(x) : `t${`n${1}`}`\n",
    ],
    "a.tsx": ["export const V = ({ a }: P) => <A.B x=\"1\" {...a} on={() => a < 2}>t &amp; {a ? <b/> : null}<></></A.B>;", "const f = <T,>(x: T) => x; const e = a < b;"],
    "a.js": [
        "const x = a / b / c\nlet re = /x/g, o = { get a() { return 1 }, async *b() {}, ['c']: 1, d, ...e }\nif (a) /re/.test(b)\nexport default function () {}\n",
        "a = b\n++c\nvar f = function () { return }\nx = { if: 1 }.if\nclass A { static { this.x = 1 } 'q' = 2\n y\n async z() {} }",
        "!function(){a$=b||{};a$.c=!0}();u=v?w:void 0;if(m&&n){p(q,'r')}var e=function(n){for(var i=0;i<n;i++)x[i]=n<<4};",
        "import { a as b } from 'c' with { type: 'json' }; await import('x'); new Foo.Bar(1)(2); a?.b?.[c]?.(d) ?? e ** 2",
        "switch (a) { case 1: { } case 2: b(); break; default: }\ntry { throw x } catch { } finally { }\nconst j = <div className=\"a-b\">x</div>",
    ],
    "a.sol": [
        "",
        "// SPDX\npragma solidity ^0.8.19;\nimport {A as B} from \"./a.sol\";\nabstract contract C is D, E(1) {\n  using L for uint256;\n  mapping(address => mapping(uint => bool)) public m;\n  uint[] constant xs = [1, 2];\n  event Ev(address indexed a, uint);\n  error Bad(uint x);\n  struct S { uint a; bytes32[2] b; }\n  enum K { X, Y }\n  modifier only(uint x) virtual { require(x > 0, \"no {\"); _; }\n  constructor(uint x) E(x) payable {}\n  receive() external payable {}\n  function f(uint a, string memory s) public view override(D, E) only(a) returns (uint, bool b) {\n    (uint x, ) = g{value: 1 ether}(a);\n    for (uint i = 0; i < a; i++) { if (i == 1) continue; else break; }\n    unchecked { total += x; }\n    try this.h() returns (uint v) { delete m[a]; } catch Error(string memory r) { revert Bad({x: 1}); }\n    emit Ev(msg.sender, a);\n    assembly { let z := add(1, mload(0x40)) if z { revert(0, 0) } }\n    return (x ** 2, true);\n  }\n}\n",
    ],
}
BAD = {
    "a.go": ["", "// nothing", "package a\nfunc f() {", "package a\nfunc f() { x := }\n", "package a\n<<<<<<< HEAD\nvar x = 1\n", "package a\nvar x = “q”\n", "func f() {}\n", "package a\nif x { }\n", "package a\nvar s = \"abc\n", "pragma solidity ^0.8.0;"],
    "a.ts": ["let x = ;", "function f( {", "const a = `x${1}", "package main\n\nfunc main() {}", "export class { ", "if (a { }", "let x: = 1", "<<<<<<< HEAD\nlet a\n=======\nlet b\n>>>>>>> x", "a b c", "const label = `${a}:${b ? \"{\" : \"}\"}`;\n  }"],
    "a.tsx": ["const a = <A><b></A>;", "const a = <A>"],
    "a.js": ["interface A { b: string; }", "let x: number = 1", "def f(x):\n  return x", "{ \"name\": \"x\", \"n\": 1 }", "function f() { return 1", "var a = 'b", "#!/bin/sh\nset -e\nfor f in *.x; do", "return = 1", "x = 08"],
    "a.sol": ["contract C {", "contract C { function f() public { x = ; } }", "package a", "import „./a.sol“;", "contract C { uint x }", "<!DOCTYPE html>", "bytes constant R = hex\"abc\";"],
}


@pytest.mark.parametrize(("name", "src"), [(n, s) for n, ss in GOOD.items() for s in ss])
def test_accepted(name, src):
    assert first_error(name, src) is None


@pytest.mark.parametrize(("name", "src"), [(n, s) for n, ss in BAD.items() for s in ss])
def test_refused(name, src):
    assert first_error(name, src) is not None


def test_lines_and_names():
    assert first_error("x/a.go", "package a\n\nfunc f() {\n\tx := )\n}\n") == 4
    assert first_error("a.txt", "((") is None and first_error("A.GO", "((") == 1


def body(x):
    return f"package p\nfunc f() {{\n{x}\n}}\n"


@pytest.mark.parametrize("x", ["go x", "go (x())", "defer 1", "x := 08", "x := 1_", "x := 1__0", "var g func(a int, b)", "x := 0x"])
def test_go_refuses(x):
    assert first_error("a.go", body(x)) == 3


@pytest.mark.parametrize("x", ["go x()", "go func() {}()", "defer a.b(c...)", "x := 0b1_0 + 0x_fp1 + 1_000.5e3 + 08.5 + 0_7 + 08i", "go a[b](c)", "defer int(x)", "f(func(a, b int, c ...string) (x int, err error) { return })", "var f func(int, ...string) (int, error)"])
def test_go_accepts(x):
    assert first_error("a.go", body(x)) is None


JS_BAD = ["const x;", "let {a};", "++a++", "(a, b) = 1", "f() = 1", "function f(...a, b) {}", "(...a, b) => 1", "a ?? b || c", "-1 ** 2", "({get a(b) {}})", "1__0", "/a(/", "'\\u{110000}'", "let [...a, b] = c", "a?.b = 1", "1 = 2", "'\\1'", "/+a/"]
JS_GOOD = [
    "const x = 1", "let {a} = b, c", "a++", "++a.b", "(a).b = 1", "[a, b] = [b, a]", "({a} = b)", "function f(a, ...b) {}", "(a, ...b) => 1", "(a ?? b) || c", "a || b && c", "(-1) ** 2", "a ** -b", "({get a() {}, set a(b) {}, get() {}})", "1_0.5e1_0",
    "/a(b)[(]\\(/", "'\\u{10ffff}\\x41\\0'", "for (const [a, b] of c) {}", "for (a.b of c) {}", "for (x in y) {}", "a[b] += c", "(a) = 1", "x = async y => y", "let f = ({a, b = 1, ...c}, [d,, e], ...g) => {}", "new Foo().bar = 1", "this.x = 1", "let {a = 1, b: {c}} = d",
    "((a)) = 2", "a = b = c", "(function() {})()", "x = {a, b, c() {}, ['d']: 1, ...e}", "[a.b, c[d]] = e", "throw new Error(`x ${a}`)",
]
TS_GOOD = [
    "type A = import('x').Y<Z>", "using x = y;", "await using x = y", "let a: number", "a! = 1", "(a as any) = 1", "(<any>a) = 1", "class A { get x(): number { return 1 } set x(v: number) {} private m?(a?: string, ...r: any[]): void {} }", "declare const x: number", "x = a as B ?? c",
    "abstract class A { abstract get x(): number; set y(v) {} }", "export const { a, b }: T = c", "(a.b as T).c = d", "function f(this: Foo, a = 1, { b }: X = {}) {}", "let using = 1", "new Map<string, A>()",
]


@pytest.mark.parametrize("x", JS_BAD)
def test_js_refuses(x):
    # TypeScript leaves constants without a value to the check of ambient declarations
    assert first_error("a.js", x + "\n") == 1 and (x == "const x;" or first_error("a.ts", x + "\n") == 1)


@pytest.mark.parametrize("x", JS_GOOD + TS_GOOD)
def test_ts_accepts(x):
    assert first_error("a.ts", x + "\n") is None and (x in TS_GOOD or first_error("a.js", x + "\n") is None)


@pytest.mark.parametrize("x", ["break", "return 1", "function f() { break }", "if (a) { continue }", "for (;;) { f(function () { break }) }"])
def test_stray_jumps(x):
    assert first_error("a.js", x + "\n") == first_error("a.ts", x + "\n") == 1


@pytest.mark.parametrize(
    "x",
    [
        "for(;;) break", "for (;;) { if (a) { break } }", "switch (a) { case 1: { break } default: break }", "function f() { return 1 }", "x = () => { return }", "class A { m() { return 1 } get return() { return 2 } }", "a: { break a }",
        "while (1) if (x) continue", "f(function () { return })", "x = { return: 1, m() { return 3 } }", "for await (const x of y) { break }", "do { break } while (1)", "try { f() } catch { g() }\nx.return()", "const f = async function* () { for (;;) { return } }",
    ],
)
def test_jumps_in_place(x):
    assert first_error("a.js", x + "\n") is None and first_error("a.ts", x + "\n") is None


@pytest.mark.parametrize("x", ["function f(): { a: number } { return x }", "class A { m(): B { for (;;) { break } return 1 } }", "const f = (a): A => { return 1 }", "namespace N { function g() { return 1 } }"])
def test_jumps_in_typed_functions(x):
    assert first_error("a.ts", x + "\n") is None
