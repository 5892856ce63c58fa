"""Declarations, blocks and references of source files, from their tokens.

One file gives nodes, edges and pending references.  Offsets are bytes.  Brackets are matched by the
lexers' tokens, so strings, comments and templates never mislead.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from loomgraph.parse import lex

_OPEN = {"(": ")", "[": "]", "{": "}", "BLK": "}", "o{": "}", "TPLH": "TPLT"}
_CLOSE = frozenset(_OPEN.values())


def make_id(qname: str, language: str, start: int) -> str:
    return hashlib.sha256(f"{qname}|{language}|{start}".encode()).hexdigest()[:16]


class _File:
    """Collects the rows of one file."""

    def __init__(self, path: str, src: str, language: str, toks: lex.Tokens):
        self.path, self.src, self.language = path, src, language
        self.k, self.b, self.e = toks.kind, toks.begin, toks.end
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.pending: list[dict] = []
        self.lines = [0]
        at = src.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = src.find("\n", at + 1)
        self.ascii = src.isascii()
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        stack: list[int] = []
        for i, k in enumerate(self.k):
            if k in _OPEN:
                stack.append(i)
            elif k in _CLOSE:
                while stack and _OPEN[self.k[stack[-1]]] != k:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.close[j], self.open[i] = i, j
        self.comments = {self.line(max(a, b - 1)): (a, b) for a, b in toks.comments}

    def text(self, i: int) -> str:
        return self.src[self.b[i] : self.e[i]]

    def line(self, pos: int) -> int:
        return bisect_right(self.lines, pos)

    def byte(self, pos: int) -> int:
        return pos if self.ascii else len(self.src[:pos].encode("utf-8", "surrogatepass"))

    def kind(self, i: int) -> str:
        return self.k[i] if 0 <= i < len(self.k) else ""

    def doc(self, pos: int) -> str:
        """The comment that ends on the line above."""
        ln, parts = self.line(pos) - 1, []
        while ln in self.comments:
            a, b = self.comments[ln]
            if self.src[self.lines[self.line(a) - 1] : a].strip():
                break
            parts.append(self.src[a:b])
            if self.src.startswith("/*", a):
                break
            ln -= 1
        lines = [re.sub(r"^\s*(?:/\*+|//+|\*+(?!/))?\s?|\s*\*+/\s*$", "", x) for p in reversed(parts) for x in p.splitlines()]
        return "\n".join(x.rstrip() for x in lines).strip()

    def node(self, type_: str, name: str, qname: str, a: int | None, b: int | None, doc: str = "", signature: str = "", visibility: str = "", sub_kind: str = "", id_at: int | None = None) -> str:
        start, end = (0, 0) if a is None else (self.byte(a), self.byte(b))
        node_id = make_id(qname, self.language, start if id_at is None else id_at)
        self.nodes.append(
            {
                "id": node_id, "type": type_, "name": name, "qualified_name": qname, "file_path": self.path, "start_line": 1 if a is None else self.line(a), "end_line": 1 if a is None else self.line(max(a, b - 1)), "start_byte": start, "end_byte": end,
                "language": self.language, "visibility": visibility or None, "signature": signature or None, "doc_comment": doc or None, "complexity": None, "in_degree": 0, "out_degree": 0, "pagerank": 0.0, "usage_score": 0.0, "confidence": "EXTRACTED", "sub_kind": sub_kind or None,
                "ord": len(self.nodes),
            }
        )
        return node_id

    def edge(self, src: str, dst: str, type_: str) -> None:
        self.edges.append({"src": src, "dst": dst, "type": type_, "file_path": None, "line": None, "count": 1, "confidence": "EXTRACTED"})

    def ref(self, src: str, type_: str, target: str, pos: int) -> None:
        self.pending.append({"src_id": src, "edge_type": type_, "target_qname": target, "hint_file": self.path, "line": self.line(pos), "ord": len(self.pending)})

    def rows(self) -> tuple[list[dict], list[dict], list[dict]]:
        return self.nodes, self.edges, self.pending


# --- Go -------------------------------------------------------------------------------------------

_GO_VALUE = frozenset({"IDENT", ")", "]", "}", "NUM", "STR", "RUNE"})


class GoSyntaxError(ValueError):
    pass


def go(path: str, src: str) -> _File:
    """A file without a package clause, or whose brackets don't match, doesn't parse."""
    f = _File(path, src, "go", lex.go(src))
    n = len(f.k)
    if f.kind(0) != "package" or f.kind(1) != "IDENT":
        raise GoSyntaxError("no package clause")
    if lex.ERROR in f.k or any(k in _OPEN and i not in f.close for i, k in enumerate(f.k)):
        raise GoSyntaxError("bad token or bracket")
    pkg = f.text(1)
    package = f.node("Package", pkg, pkg, None, None)
    file_id = f.node("File", path.rsplit("/", 1)[-1], f"{pkg}/{path}", None, None)
    f.edge(package, file_id, "contains")
    i = 0
    while i < n:
        k = f.k[i]
        if k == "func" and f.kind(i - 1) in (";", ""):
            i = _go_func(f, i, pkg, file_id)
            continue
        if k in ("import", "const", "var", "type"):
            _go_decl(f, i, pkg, file_id)
        i += 1
    return f


def _go_type_name(f: _File, i: int, end: int) -> str:
    """Name of a receiver's type between two parentheses: generic ones have none."""
    names = [j for j in range(i, end) if f.k[j] == "IDENT"]
    if not names or "]" in f.k[i:end]:
        return ""
    return f.text(names[-1])


def _go_func(f: _File, i: int, pkg: str, file_id: str) -> int:
    start = f.b[i]
    j, recv = i + 1, None
    if f.kind(j) == "(":
        recv = _go_type_name(f, j + 1, f.close[j])
        j = f.close[j] + 1
    if f.kind(j) != "IDENT":
        return i + 1
    name = f.text(j)
    j += 1
    if f.kind(j) == "[":
        j = f.close[j] + 1
    if f.kind(j) != "(":
        return j
    j = f.close[j] + 1
    results = f.kind(j) not in ("{", ";", "")
    while j < len(f.k) and not (f.k[j] == "{" and f.kind(j - 1) not in ("struct", "interface")) and f.k[j] != ";":
        j = f.close[j] + 1 if j in f.close else j + 1
    body = j if f.kind(j) == "{" else None
    last = f.close[body] if body is not None else j - 1
    qname = f"{pkg}.{recv}.{name}" if recv is not None else f"{pkg}.{name}"
    sig = "func " + (f"({recv}) " if recv is not None else "") + f"{name}(...)" + (" ..." if results else "")
    vis = "exported" if "A" <= name[:1] <= "Z" else "private"
    fid = f.node("Method" if recv is not None else "Function", name, qname, start, f.e[last], f.doc(start), sig, vis)
    f.edge(file_id, fid, "defines")
    if body is not None:
        _go_body(f, body + 1, last, qname, fid)
        for x in range(body + 1, last):
            if f.k[x] in ("const", "var", "type"):
                _go_decl(f, x, pkg, file_id)
    return last + 1


def _go_specs(f: _File, i: int):
    """Token ranges of the specs after a declaration's keyword."""
    if f.kind(i + 1) == "(":
        j, end = i + 2, f.close[i + 1]
    else:
        j, end = i + 1, len(f.k)
    while j < end:
        a = j
        while j < end and f.k[j] != ";":
            j = f.close[j] + 1 if j in f.close else j + 1
        if j > a:
            yield a, j
        if f.kind(i + 1) != "(":
            return
        j += 1


def _go_decl(f: _File, i: int, pkg: str, file_id: str) -> None:
    word, doc = f.k[i], f.doc(f.b[i])
    for a, z in _go_specs(f, i):
        if word == "import":
            s = next((x for x in range(a, z) if f.k[x] == "STR"), None)
            if s is None:
                continue
            p = f.text(s)[1:-1]
            f.edge(file_id, f.node("Import", p, f"import:{p}", f.b[a], f.e[s]), "imports")
            continue
        if f.k[a] != "IDENT":
            continue
        name = f.text(a)
        vis = "exported" if "A" <= name[:1] <= "Z" else "private"
        if word == "type":
            t = a + 1
            if f.kind(t) == "[" and f.kind(t + 1) == "IDENT" and f.kind(t + 2) not in ("]", "."):
                t = f.close[t] + 1
            if f.kind(t) == "=":
                t += 1
            kind = {"struct": "Struct", "interface": "Interface"}.get(f.kind(t), "TypeAlias")
            q = f"{pkg}.{name}"
            tid = f.node(kind, name, q, f.b[a], f.e[z - 1], doc, "", vis)
            f.edge(file_id, tid, "defines")
            if kind != "TypeAlias" and f.kind(t + 1) == "{":
                _go_members(f, t + 2, f.close[t + 1], kind, q, tid)
            continue
        x = a
        while x < z and f.k[x] == "IDENT":
            nm = f.text(x)
            v = "exported" if "A" <= nm[:1] <= "Z" else "private"
            vid = f.node("Constant" if word == "const" else "Variable", nm, f"{pkg}.{nm}", f.b[x], f.e[z - 1], doc, "", v)
            f.edge(file_id, vid, "defines")
            if f.kind(x + 1) != ",":
                break
            x += 2


def _go_members(f: _File, i: int, end: int, kind: str, q: str, tid: str) -> None:
    while i < end:
        a = i
        while i < end and f.k[i] != ";":
            i = f.close[i] + 1 if i in f.close else i + 1
        z = i
        i += 1
        if z == a or f.k[a] != "IDENT":
            continue
        if kind == "Interface":
            if f.kind(a + 1) == "(":
                nm = f.text(a)
                f.edge(tid, f.node("Method", nm, f"{q}.{nm}", f.b[a], f.e[z - 1], f.doc(f.b[a]), "", "exported" if "A" <= nm[:1] <= "Z" else "private"), "defines")
            continue
        names = [a]
        while f.kind(names[-1] + 1) == "," and f.kind(names[-1] + 2) == "IDENT":
            names.append(names[-1] + 2)
        after = names[-1] + 1
        if after >= z or f.kind(after) in (".", "STR"):
            continue  # embedded
        for x in names:
            nm = f.text(x)
            f.edge(tid, f.node("Field", nm, f"{q}.{nm}", f.b[x], f.e[z - 1], f.doc(f.b[a]), "", "exported" if "A" <= nm[:1] <= "Z" else "private"), "defines")


def _go_statement_end(f: _File, i: int, end: int) -> int:
    """Last token of the simple statement that begins at ``i``."""
    j = i
    while j < end and f.k[j] not in (";", "}", "BLK", ":") and not (f.k[j] in ("case", "default") and j > i):
        j = f.close[j] + 1 if j in f.close else j + 1
    return j - 1


def _go_primary_start(f: _File, i: int) -> int:
    """First token of the operand that ends with token ``i``."""
    while True:
        k = f.k[i]
        if k in (")", "]", "}") and i in f.open:
            j = f.open[i]
            p = f.kind(j - 1)
            if k == "}":
                x = j - 1
                while x >= 0 and f.k[x] not in ("func", ";", "struct", "map"):
                    x = f.open[x] - 1 if x in f.open else x - 1
                    if x >= 0 and f.k[x] in ("(", "[", "{", "BLK", ","):
                        break
                if x >= 0 and f.k[x] in ("func", "map"):
                    return x
                i = j - 1
                continue
            if p == "func":
                return j - 1
            if p in ("IDENT", ")", "]") or p == "}" and k == ")":
                i = j - 1
                continue
            if f.kind(j - 1) == "." and k == ")":
                i = j - 2
                continue
            return j
        if k == "IDENT":
            if f.kind(i - 1) == "." and i >= 2:
                i -= 2
                continue
            if f.kind(i - 1) == "]" and (i - 1) in f.open and f.kind(f.open[i - 1] - 1) not in ("IDENT", ")", "]"):
                j = f.open[i - 1]
                return j - 1 if f.kind(j - 1) == "map" else j
            if f.kind(i - 1) == "map":
                return i - 1
        return i


def _go_block_end(f: _File, i: int) -> int:
    """Closing brace of the body of the statement that begins at ``i``."""
    j = i + 1
    while j < len(f.k) and f.k[j] != "BLK":
        j = f.close[j] + 1 if j in f.close else j + 1
    return f.close.get(j, len(f.k) - 1)


def _go_body(f: _File, i: int, end: int, parent_q: str, parent: str) -> None:
    def block(kind, a, b, sub=""):
        q = f"{parent_q}#{kind}@{f.byte(f.b[a])}"
        nid = f.node(kind, kind, q, f.b[a], f.e[b], "", "", "", sub)
        f.edge(parent, nid, "contains")
        return nid

    for j in range(i, end):
        k = f.k[j]
        if k == "if":
            z = _go_block_end(f, j)
            while f.kind(z + 1) == "else":
                z = _go_block_end(f, z + 2) if f.kind(z + 2) == "if" else f.close.get(z + 2, z + 1)
            block("IfStmt", j, z)
        elif k == "for":
            z = _go_block_end(f, j)
            head = f.k[j : next((x for x in range(j, z) if f.k[x] == "BLK"), j)]
            block("LoopStmt", j, z, "range" if "range" in head else "for")
        elif k == "switch":
            z = _go_block_end(f, j)
            head = f.k[j : next((x for x in range(j, z) if f.k[x] == "BLK"), j)]
            block("SwitchStmt", j, z, "type" if any(head[x : x + 2] == ["(", "type"] for x in range(len(head))) else "")
        elif k == "return":
            block("ReturnStmt", j, max(j, _go_statement_end(f, j, end)))
        elif k == "go":
            f.edge(parent, block("Goroutine", j, _go_statement_end(f, j, end)), "spawns")
        elif k == "<-":
            before = f.kind(j - 1)
            if before == "chan" or f.kind(j + 1) == "chan":
                continue
            if before in _GO_VALUE and f.kind(j - 1) != "":
                f.edge(parent, block("CallSite", _go_primary_start(f, j - 1), _go_statement_end(f, j, end), "send"), "sends_to")
            else:
                z = j + 1
                while f.kind(z) in ("<-", "*", "&"):
                    z += 1
                while z < end:
                    z = f.close.get(z, z)
                    if f.kind(z + 1) == "." or f.kind(z) == ".":
                        z += 1
                    elif f.kind(z + 1) in ("(", "["):
                        z = f.close.get(z + 1, z + 1)
                    else:
                        break
                f.edge(parent, block("CallSite", j, z, "recv"), "recvs_from")
        elif k == "(" and j in f.close:
            p = f.kind(j - 1)
            if p not in ("IDENT", ")", "]", "}"):
                continue
            if p == ")" and f.kind(f.open.get(j - 1, 0) - 1) == "func":
                continue  # results of a function literal
            if p == "IDENT" and f.kind(j - 2) == "func":
                continue
            a = _go_primary_start(f, j - 1)
            nid = block("CallSite", a, f.close[j])
            f.ref(nid, "calls", f.text(j - 1) if p == "IDENT" and f.kind(j - 2) not in ("]", "map") else "", f.b[a])


# --- TypeScript and JavaScript --------------------------------------------------------------------

_TS_WORDS = {"class": "Class", "interface": "Interface", "function": "Function", "asyncfn": "Function", "enum": "Enum", "type": "TypeAlias"}


def ts(path: str, src: str) -> _File:
    """Declarations span their names only.  Plain JavaScript has no classes, interfaces, types and
    enums among its rows."""
    ext = lex.extension(path)
    script = ext in (".ts", ".tsx")
    f = _File(path, src, "ts", lex.EXTENSIONS[ext][1](src))
    file_id = f.node("File", path.rsplit("/", 1)[-1], f"file:{path}", None, None)
    n = len(f.k)
    scopes: list[tuple[int, int, str]] = []  # body's first and last token and name of open classes
    inner = _innermost(f)

    def name_of(j):
        return j if f.kind(j) == "IDENT" or f.kind(j) in lex.TS_CONTEXT else None

    for i in range(n):
        k = f.k[i]
        while scopes and i > scopes[-1][1]:
            scopes.pop()
        before = f.kind(i - 1)
        if k in _TS_WORDS and before not in (".", "?."):
            j = name_of(i + 2 if f.kind(i + 1) == "*" else i + 1)
            if j is None or k == "type" and f.kind(j + 1) not in ("=", "<") or k in ("interface", "enum") and f.kind(j + 1) not in ("{", "<", "extends"):
                continue
            if k == "class":
                x = j + 1
                while x < n and f.k[x] != "{":
                    x = f.close[x] + 1 if x in f.close else x + 1
                if x in f.close:
                    scopes.append((x, f.close[x], f.text(j)))
            declares = before in ("", ";", "}", "{", "export", "default", "declare", "abstract", "const", "async", ")", "]", "STR", "IDENT") or f.line(f.b[i]) != f.line(f.b[i - 1])
            if not declares or not script and k in ("class", "interface", "enum", "type"):
                continue
            f.edge(file_id, f.node(_TS_WORDS[k], f.text(j), f.text(j), f.b[j], f.e[j]), "defines")
        elif k == "import" and before not in (".",) and f.kind(i + 1) not in ("(", "."):
            s = i + 1
            while s < n and f.k[s] not in ("STR", ";") and f.k[s] not in ("import", "export", "function"):
                s = f.close[s] + 1 if s in f.close else s + 1
            if f.kind(s) == "STR":
                p = f.text(s)[1:-1]
                f.edge(file_id, f.node("Import", p, f"import:{p}", f.b[i], f.e[s]), "imports")
        elif k == "@" and name_of(i + 1) is not None and f.kind(i + 2) == "(":
            f.edge(file_id, f.node("Decorator", f.text(i + 1), f.text(i + 1), f.b[i + 1], f.e[i + 1]), "defines")
        elif k == "(" and i in f.close and scopes and i >= 1:
            # a method: name ( ... ) [: type] { directly in a class body
            j = i - 1
            if f.kind(j) == ">":
                while j > 0 and f.k[j] != "<":
                    j -= 1
                j -= 1
            inside = j >= 0 and inner[j] == scopes[-1][0]
            if not inside or name_of(j) is None and f.kind(j) not in lex.JS_RESERVED or f.kind(j) in ("if", "for", "while", "switch", "catch"):
                continue
            x = f.close[i] + 1
            if f.kind(x) == ":":
                x += 1
                while x < n and f.k[x] not in ("{", ";", "}"):
                    x = f.close[x] + 1 if x in f.close and f.k[x] != "{" else x + 1
            if f.kind(x) == "{":
                f.edge(file_id, f.node("Method", f.text(j), f"{scopes[-1][2]}.{f.text(j)}", f.b[j], f.e[j]), "defines")
    return f


def _innermost(f: _File) -> list[int]:
    """Per token the bracket that stands open around it, -1 for none; unmatched brackets don't count."""
    out, stack = [], [-1]
    for i in range(len(f.k)):
        if i in f.open:
            stack.pop()
        out.append(stack[-1])
        if i in f.close:
            stack.append(i)
    return out


# --- Solidity -------------------------------------------------------------------------------------


def sol(path: str, src: str) -> _File:
    f = _File(path, src, "sol", lex.sol(src))
    file_id = f.node("File", path.rsplit("/", 1)[-1], path, None, None)
    n = len(f.k)
    ident = lambda j: f.kind(j) == "IDENT" or f.kind(j) in ("error", "from", "global", "revert", "layout", "at", "transient")

    def declare(kind, j, qname):
        nid = f.node(kind, f.text(j), qname, f.b[j], f.e[j])
        f.edge(file_id, nid, "defines")
        return nid

    contracts = [(i + 1, x) for i in range(n) if f.k[i] in ("contract", "interface", "library") and ident(i + 1) for x in [next((y for y in range(i, n) if f.k[y] == "{"), n)] if x in f.close]
    spans = [(o, f.close[o], f.text(j)) for j, o in contracts]
    for j, _ in contracts:
        if f.k[j - 1] == "contract":
            declare("Contract", j, f.text(j))

    starts = [a for a, _, _ in spans]

    def within(i):
        # contracts don't nest: the last that opens before
        at = bisect_right(starts, i) - 1
        return spans[at][2] if at >= 0 and spans[at][0] < i < spans[at][1] else None

    functions: list[tuple[int, int, int, str]] = []
    for i in range(n):
        if f.k[i] == "function" and ident(i + 1):
            owner = within(i)
            q = f"{owner}.{f.text(i + 1)}" if owner else f.text(i + 1)
            nid = declare("Function", i + 1, q)
            x = i + 2
            while x < n and f.k[x] not in ("{", ";"):
                x = f.close[x] + 1 if x in f.close else x + 1
            functions.append((i, x, f.close.get(x, x), nid))
    for word, kind in (("modifier", "Modifier"), ("event", "Event"), ("struct", "Struct"), ("enum", "Enum")):
        for i in range(n):
            if f.k[i] == word and ident(i + 1):
                declare(kind, i + 1, f.text(i + 1))
    mappings = []
    for a, b, _ in spans:
        i = a + 1
        while i < b:
            s = i
            braced = False
            while i < b and f.k[i] != ";":
                if f.k[i] == "{":
                    i = f.close.get(i, b) + 1
                    braced = True
                    break
                i = f.close[i] + 1 if i in f.close else i + 1
            if not braced:
                words = f.k[s:i]
                if words and words[0] in ("mapping", "TYPE", "IDENT") and "function" not in words[:1]:
                    stop = next((x for x in range(s, i) if f.k[x] == "="), i)
                    if stop - 1 > s and ident(stop - 1):
                        nm = f.text(stop - 1)
                        if words[0] == "mapping":
                            declare("Mapping", stop - 1, f"{nm}:mapping")
                            mappings.append(nm)
                        else:
                            declare("Field", stop - 1, nm)
                i += 1
    names = set(mappings)
    for start, opened, closed, nid in functions:
        x = start + 2
        x = f.close.get(x, x) + 1
        while x < opened:
            if f.k[x] == "returns":
                x = f.close.get(x + 1, x) + 1
                continue
            if f.k[x] == "IDENT":
                f.ref(nid, "has_modifier", f.text(x), f.b[x])
                if f.kind(x + 1) == "(":
                    x = f.close.get(x + 1, x)
            x += 1
        for y in range(opened, closed):
            if f.k[y] == "emit" and ident(y + 1):
                f.ref(nid, "emits_event", f.text(y + 1), f.b[y + 1])
            elif f.k[y] == "ASG" and f.kind(y - 1) == "]":
                o = f.open.get(y - 1)
                while o is not None and f.kind(o - 1) == "]":
                    o = f.open.get(o - 1)
                if o is not None and f.kind(o - 1) == "IDENT" and f.text(o - 1) in names:
                    f.ref(nid, "writes_mapping", f"{f.text(o - 1)}:mapping", f.b[o - 1])
    return f


class Registry:
    """Extension -> (language, parser).  An extension has one parser."""

    def __init__(self):
        self._by_ext: dict[str, tuple[str, object]] = {}

    def register(self, ext: str, language: str, parser) -> None:
        ext = ext.lower()
        if ext in self._by_ext:
            raise ValueError(f"{ext} already has a parser")
        self._by_ext[ext] = (language, parser)

    def of(self, path: str | None) -> tuple[str, object] | None:
        """Language and parser of a path, None if its extension has none."""
        m = re.search(r"\.[^./\\]+$", path or "")
        return self._by_ext.get(m.group().lower()) if m else None


PARSERS = Registry()
for _ext, (_language, _) in lex.EXTENSIONS.items():
    PARSERS.register(_ext, "ts" if _language == "js" else _language, {"go": go, "sol": sol}.get(_language, ts))


def parse_file(path: str, content: str) -> _File:
    got = PARSERS.of(path)
    if got is None:
        raise ValueError(f"no parser for {path}")
    return got[1](path, content)
