"""Functions paired with their documentation.

A string- and comment-aware state machine walks each source file, matches braces to delimit
functions and attaches the comment that ends on the line directly above a declaration.  Documentation
counts if, sentence by sentence, something is left after marks, stock phrases, code and the words of
name and signature are taken off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.parse.lex import extension

# --- the state machine ----------------------------------------------------------------------------

_STR = r'"(?:[^"\\\n]|\\.)*"'
_CHR = r"'(?:[^'\\\n]|\\.)*'"
_COMMENT = r"(?P<com>//[^\n]*|/\*.*?(?:\*/|\Z))"
#: What moves the machine; everything between is passed over.
_SCAN = {
    "go": re.compile(_COMMENT + r"|`[^`]*(?:`|\Z)|" + _STR + "|" + _CHR + r"|(?P<br>[{}()\[\]])|(?P<decl>\bfunc\b)", re.S),
    "sol": re.compile(_COMMENT + "|" + _STR + "|" + _CHR + r"|(?P<br>[{}()\[\]])|(?P<decl>\b(?:function|modifier)\b)", re.S),
    # a regular expression begins after an operator or an opening bracket
    "ts": re.compile(
        _COMMENT + r"|`(?:[^`\\]|\\.)*(?:`|\Z)|" + _STR + "|" + _CHR + r"|(?<=[=(,:\[!&|?{};])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
        r"|(?P<br>[{}()\[\]])|(?P<decl>\bfunction\b)|^[ \t]*(?:(?:export|default|public|private|protected|static|override|abstract|readonly|async|get|set)[ \t]+)*\*?[ \t]*(?P<meth>[\w$#]+)[ \t]*(?:<[^<>()\n]*>)?(?=\()"
        r"|\b(?:const|let|var)[ \t]+(?P<arrow>[\w$]+)[^=\n;]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^()\n]*\)[^=\n;{}]*=>|[\w$]+[ \t]*=>)",
        re.S | re.M,
    ),
}
_GO_NAME = re.compile(r"\s*(?:\(\s*(?:[^\W\d]\w*\s+)?\*?\s*(?P<owner>[^\W\d][\w.]*)?[^()]*\)\s*)?(?P<name>[^\W\d]\w*)\s*[\[(]")
_NAME = re.compile(r"\s*\*?\s*([\w$]+)\s*[(<{]?")
#: Type or contract whose braces hold the functions after it.
_OWNER = {"sol": re.compile(r"\b(?:contract|interface|library)\s+([\w$]+)[^{};]*\Z"), "ts": re.compile(r"\bclass\s+([\w$]+)[^{};]*\Z")}
_NOT_METHODS = frozenset("if for while switch catch return function with super await new typeof import require do else throw".split())
_AFTER_PARAMS = re.compile(r"\s*(?::[^;{}=()]*(?:\{[^{}]*\}[^;{}=()]*)?)?\{")
_MARK = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//+!?)?[ \t]?|[ \t]*\*+/[ \t]*$")


@dataclass
class Declaration:
    name: str
    owner: str | None
    line: int
    end_line: int
    doc: str | None


def clean(comment: str) -> str:
    """A comment's text without its marks."""
    lines = []
    for x in comment.replace("\r", "").split("\n"):
        x = x.strip()
        if x.endswith("*/"):
            x = x[:-2].rstrip()
        if x.startswith("/*"):
            x = x[2:].lstrip("*!")
        elif x.startswith("//"):
            x = x[2:].lstrip("/!")
        elif x.startswith("*"):
            x = x[1:]
        lines.append(x.strip())
    return "\n".join(lines).strip()


def declarations(language: str, src: str) -> Iterator[Declaration]:
    """Functions, methods and modifiers of a file, in order of their ends."""
    scan = _SCAN[language]
    starts = [0]
    at = src.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = src.find("\n", at + 1)
    line_of: dict[int, int] = {}
    # comment that ends on a line, if nothing but it stands there: line -> (first line, text)
    ends: dict[int, tuple[int, str]] = {}
    depth, open_paren = 0, 0
    waiting: list[Declaration] = []  # declared, body not yet open
    bodies: list[tuple[int, Declaration]] = []
    owners: list[tuple[int, str]] = []  # depth and name of open types
    owner_of, last_end = _OWNER.get(language), 0  # where the last brace ended: a head stands between two
    at_line = 0
    n_lines = len(starts)

    def line(pos: int) -> int:
        nonlocal at_line
        while at_line + 1 < n_lines and starts[at_line + 1] <= pos:
            at_line += 1
        while starts[at_line] > pos:
            at_line -= 1
        return at_line

    def doc_above(ln: int) -> str | None:
        got = ends.get(ln - 1)
        if got is None:
            return None
        first, text = got
        if text.startswith("//"):
            parts = [text]
            while (up := ends.get(first - 1)) and up[1].startswith("//"):
                first = up[0]
                parts.append(up[1])
            text = "\n".join(reversed(parts))
        return clean(text)

    for m in scan.finditer(src):
        g = m.lastgroup
        if g is None:
            continue
        if g == "com":
            a, b = m.span()
            la, lb = line(a), line(b - 1 if b > a else a)
            if not src[starts[la] : a].strip("﻿ \t"):
                tail = src[b : starts[lb + 1] if lb + 1 < n_lines else len(src)]
                if not tail.strip():
                    ends[lb] = (la, m.group())
            continue
        if g == "br":
            c = m.group()
            if c == "{":
                if waiting and open_paren == 0:
                    bodies.append((depth, waiting.pop()))
                    waiting.clear()
                elif owner_of and (head := owner_of.search(src, last_end, m.start())):
                    owners.append((depth, head.group(1)))
                depth += 1
                last_end = m.end()
            elif c == "}":
                depth -= 1
                open_paren = 0
                last_end = m.end()
                while owners and owners[-1][0] >= depth:
                    owners.pop()
                while bodies and bodies[-1][0] >= depth:
                    d = bodies.pop()[1]
                    d.end_line = line(m.start()) + 1
                    yield d
            elif c in "([":
                open_paren += 1
            else:
                open_paren = max(0, open_paren - 1)
            continue
        a = m.start()
        if g == "decl":
            got = (_GO_NAME if language == "go" else _NAME).match(src, m.end())
            if not got:
                continue
            name = got["name"] if language == "go" else got.group(1)
        else:
            name = m.group(g)
            if g == "meth":
                if name in _NOT_METHODS or open_paren:
                    continue
                if not _opens_body(src, m.end()):
                    continue
            a = m.start(g)
        ln = line(a)
        if language == "go" and src[starts[ln] : a].strip("﻿ \t"):
            continue  # a literal or a type within a line
        open_paren = 0
        owner = (got["owner"] if g == "decl" else None) if language == "go" else owners[-1][1] if owners else None
        waiting = [Declaration(name, owner, ln + 1, ln + 1, doc_above(ln))]
    for _, d in reversed(bodies):
        d.end_line = n_lines
        yield d
    yield from waiting


def _opens_body(src: str, at: int) -> bool:
    """Is the ( at ``at`` a parameter list before a body?  Strings, comments and expressions among the
    parameters are passed over; a list of any length is read to its end."""
    depth = 0
    for m in _SCAN["ts"].finditer(src, at):
        c = m["br"]
        if c is None:
            continue
        if c in "([{":
            depth += 1
        else:
            depth -= 1
            if not depth:
                return c == ")" and _AFTER_PARAMS.match(src, m.end()) is not None
    return False


_LANGUAGES = {".go": "go", ".sol": "sol"}


DECLARED = pa.schema([("file_path", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("doc", pa.string()), ("code", pa.string())])


def declared(files: DataFrame, path: str = "file_path", content: str = "content", code: bool = True) -> DataFrame:
    """file_path, name, owner (type or contract it belongs to), line, end_line, doc (null without comment) and
    code (its whole lines, null if not asked for) of every function, method and modifier in the files,
    where they lie; null and other contents give no rows."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in DECLARED]
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ext = extension(p)
                if ext is None or not c:
                    continue
                rows = c.split("\n") if code else None
                for d in declarations(_LANGUAGES.get(ext, "ts"), c):
                    for x, v in zip(out, (p, d.name, d.owner, d.line, d.end_line, d.doc, "\n".join(rows[d.line - 1 : d.end_line]) if code else None), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, DECLARED, strict=True)], schema=DECLARED)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, "file_path string, name string, owner string, line int, end_line int, doc string, code string")


# --- does documentation say something? -----------------------------------------------------------

_DIRECTIVE = re.compile(
    r"^(?:go:\w+|nolint\b|lint:|eslint\b|eslint-|tslint:|prettier-ignore|istanbul\b|c8 |v8 ignore|@ts-|ts-ignore|solhint|slither|noinspection|pylint|biome-ignore|jshint|jslint|webpack\w*:|sourceMappingURL|#?(?:end)?region\b|#?pragma\b|\+build|export \w+$|jscpd|coverage:|fallthrough$|use strict)",
    re.I,
)
_TODO = re.compile(r"^[\W_]*(?:todo|fixme|xxx|tbd|hack|wip)\b", re.I)
#: A notice has the shape of one: a mark with a year or holder, or a phrase that grants or keeps rights.
_LEGAL = re.compile(
    r"^\W*(?:copyright|©|\(c\))\W*(?:\(c\)|©)?\s*(?:\d{4}|(?:by|of)\b)|^\W*spdx-|\ball rights\b.*\b(?:reserved|kept|held)\b|^\W*(?:licen[cs]ed under|released under|distributed under|published under|this (?:file|code) is (?:licen[cs]ed|part of|released|governed))\b|^\W*licen[cs]e\s*:"
    r"|^(?:created|written|authored|added|maintained) (?:by|on)\b|^@?(?:author|since|version|copyright|license)\b(?!\s+\w+\s+(?:is|are|was|were|has|have|must|may|can)\b)",
    re.I,
)
_POINTER = re.compile(r"^(?:\(?\s*(?:see|cf\.?|siehe|voir|v[ée]ase|refer to|as)\s+(?:also\s+)?(?:the\s+)?(?:above|below|oben|unten|ci-dessus|ci-dessous|arriba|abajo|there|dort|[\w.#/:-]+(?:\(\))?|\{?@?\w*\s*[\w.]+\}?)\s*\)?[.!]?|\{@(?:link|see|inheritdoc)[^}]*\}[.!]?|위 참고\S*|위와 같음\S*|@see\b.*|@inheritdoc\b.*|https?://\S+)$", re.I)
_STOCK = re.compile(
    r"^[\W_]*(?:(?:no|without|missing) (?:comment|documentation|docs?|description)(?: (?:yet|available|provided|here|so far|sorry))*|(?:getter|setter|accessor)(?: (?:for|of))?(?: (?:the|a))?(?: [\w$]+){0,2}(?: (?:property|field|value|attribute))+|undocumented|generated stub\b.*|(?:please )?replace this text.*|(?:a |the )?(?:description|documentation|summary|doc)(?: of (?:the|this) (?:function|method|modifier))?(?: goes here| follows| here)?"
    r"|beschreibung(?: folgt)?|folgt|à compléter|description à venir|por hacer|descripci[oó]n pendiente|설명 ?(?:추가 )?예정|설명 없음|추후 작성|(?:begin|start|end|end of)(?: of)? (?:section|function|method|block|file|region|\w+)|helper(?: function| method)?|internal(?: use only)?|misc|utils?|function|method|modifier|add docs?|document(?: me| this)?|none|n/?a|self[- ]explanatory|obvious)[\W_]*$",
    re.I,
)
_CODE = re.compile(r"^(?:[\w$.\[\]]+\s*(?::=|[-+*/|&]?=)\s*\S.*|(?:const|let|var|func|function|type|import|package)\s+\w+\s*[=({:].*|(?:if|for|while|switch)\b[^.]*[{(].*|return(?:\s+[\w.$\"'()]+(?:\s*,\s*[\w.$\"'()]+)*)?\s*;?|[\w$]+(?:\.[\w$]+)*\([^)]*\)\s*[;{]?|.*[;{}]\s*|//.*|\w+\+\+)$")
_CODE_WORDS = frozenset("nil null err error true false undefined this self ok".split())
_TAG = re.compile(r"^@(\w+)\b[ \t:]*")
#: Tags that open ordinary sentences.
_PROSE_TAGS = frozenset("notice dev desc description summary brief details remarks title".split())
#: Scripts that write without blanks: two signs count as a word.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_DENSE}]{{1,2}}|[^\W\d_{_DENSE}]+(?:['’][^\W\d_]+)?|\d+")
_PARTS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_A-Za-z]+")
#: Words that tell nothing of their own.
_EMPTY = frozenset(
    "a an the this that these those it its is are was be been being called named does do of to and or for with in on by as at which who will can may should"
    " function functions method methods modifier func implementation impl helper routine procedure implements performs handles given param parameter returns return arg argument value values object instance"
    " new name type begin end start section 함수 메서드 메소드 함수입니다 이다 funktion methode fonction función método die der das ein eine le la les un une el los".split()
)
_ALONE = re.compile(r"[^\W\d_]{6,}[.。]")
_RETURNING = frozenset({"returns", "return"})


def _stem(w: str) -> str:
    for end in ("izes", "ises", "ing", "ies", "ied", "es", "ed", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def _stems(word: str) -> set[str]:
    """Stems of an identifier's parts, doubled last letters made single."""
    out = set()
    for p in _PARTS.findall(word):
        s = _stem(p.lower())
        out |= {s, s[:-1] if len(s) > 3 and s[-1:] == s[-2:-1] else s}
    return out


def _units(doc: str) -> Iterator[str]:
    """Sentences and tag lines of a documentation text, without directives, ornaments and code."""
    text: list[str] = []

    def sentences() -> Iterator[str]:
        if text:
            yield from re.split(r"(?<=[.!?。])\s+", " ".join(text))
            text.clear()

    fenced = False
    for raw in doc.replace("\r", "").split("\n"):
        x = raw.strip().lstrip("*/#!").strip() if not raw.strip().startswith("#region") else ""
        if raw.strip().startswith("```"):
            fenced = not fenced
            continue
        if fenced or not x:
            yield from sentences()
            continue
        x = re.sub(r"</?\w+[^>]*>", " ", x).strip()
        if _DIRECTIVE.match(x) or not _WORD.search(x):
            continue
        if m := _TAG.match(x):
            yield from sentences()
            if m.group(1).lower() in _PROSE_TAGS:
                if _WORD.search(rest := x[m.end() :]) and not _DIRECTIVE.match(rest):
                    text.append(rest)
            else:
                yield x
            continue
        text.append(x)
    yield from sentences()


def informative(doc: str | None, name: str | None, signature: str | None = None, qualified_name: str | None = None) -> bool:
    """Does the documentation tell something beyond name and signature?  Null and empty ones don't."""
    if not doc or not doc.strip():
        return False
    own = _stems(name or "")
    full = set(_EMPTY)
    for u in _units(doc):
        tag = _TAG.match(u)
        known = set(own)
        if tag:
            what = tag.group(1).lower()
            rest = u[tag.end() :]
            if what in ("see", "inheritdoc", "author", "since", "version", "license", "copyright", "public", "private", "internal", "override", "virtual", "ts"):
                if what not in ("internal", "public", "private") or not rest:
                    continue
            if what == "param":
                m = re.match(r"(?:\{[^}]*\}\s*)?\[?([\w$.]+)\]?\s*-?\s*", rest)
                if m:
                    known |= _stems(m.group(1))
                    rest = rest[m.end() :]
            u = rest
        if not u or _TODO.match(u) or _LEGAL.search(u) or _POINTER.match(u) or _STOCK.match(u):
            continue
        if _CODE.match(u):
            words = [w.lower() for w in _WORD.findall(u)]
            if not u.startswith("return") or all(w in _CODE_WORDS or w == "return" or not w.isalpha() or _stem(w) in own for w in words) or u.endswith(";") or len(words) <= 2:
                continue
        if name:
            u = re.sub(r"(?<![\w$])" + re.escape(name) + r"(?![\w$])", " ", u)
        left, seen = 0, set()
        for w in _WORD.findall(u):
            lw = w.lower()
            if lw in full and lw not in _RETURNING or lw in _RETURNING and not tag and left == 0 and len(u.split()) < 3:
                continue
            s = _stem(lw)
            s = s[:-1] if len(s) > 3 and s[-1:] == s[-2:-1] else s
            if s in known or lw in known or s in seen:
                continue
            seen.add(s)
            left += 1
        # one word that isn't in the name is enough for a sentence of its own
        if left >= 2 or left == 1 and _ALONE.fullmatch(u.strip()):
            return True
    return False


@F.pandas_udf(T.BooleanType())
def says_something(doc, name, signature, qualified_name):
    import pandas as pd

    return pd.Series([informative(d, n, s, q) for d, n, s, q in zip(doc, name, signature, qualified_name, strict=True)], dtype=bool)


KINDS = ("Function", "Method", "Modifier")


def documented(nodes: DataFrame, files: DataFrame, code: bool = True) -> DataFrame:
    """id, qualified_name, signature, documentation, code, first_line and last_line of the functions, methods and
    modifiers (one row per id in ``nodes``) whose documentation says something.

    All functions of all files go through the state machine.  A node takes the declaration of its name in
    its file: one of the same owner before others, then the one nearest to ``start_line``.  ``doc_comment``
    counts if it isn't null; else the comment directly above that declaration.  ``code`` is the text of
    the declaration to the brace that ends it; code and lines are null if the file or the name isn't
    found, code also if not asked for.  Contents of files never move: only the declarations found in them
    are joined.  Where a file occurs repeatedly any copy serves.
    """
    own = nodes.where(F.col("type").isin(*KINDS)).select("id", "name", "qualified_name", "signature", "doc_comment", "file_path", "start_line")
    # what a node itself says in vain needs no source
    told = own.where(F.col("doc_comment").isNull() | says_something("doc_comment", "name", "signature", "qualified_name"))
    decl = declared(files, code=code).select("file_path", "name", "owner", F.col("line").alias("first_line"), F.col("end_line").alias("last_line"), "doc", "code")
    # a name of one part has no owner
    found = told.withColumn("_q", F.concat(F.lit("."), F.coalesce("qualified_name", F.lit(""))))
    other = ~F.coalesce(F.col("owner") == F.element_at(F.split("_q", "[.]"), -2), F.lit(False))
    near = F.struct(other.alias("other"), F.abs(F.col("first_line") - F.coalesce("start_line", F.lit(0))).alias("far"), "first_line", "last_line", "doc", "code")
    best = found.join(decl, ["file_path", "name"], "left").groupBy("id").agg(
        F.min(F.when(F.col("first_line").isNotNull(), near)).alias("x"), *[F.min(c).alias(c) for c in ("name", "qualified_name", "signature", "doc_comment")]
    )
    out = best.select("id", "name", "qualified_name", "signature", F.coalesce("doc_comment", "x.doc").alias("documentation"), F.col("x.code").alias("code"), F.col("x.first_line").alias("first_line"), F.col("x.last_line").alias("last_line"), F.col("doc_comment").isNotNull().alias("sure"))
    out = out.where("documentation is not null").where(F.col("sure") | says_something("documentation", "name", "signature", "qualified_name"))
    return out.drop("name", "sure")
