"""Lexers for Go, TypeScript/JavaScript (with JSX) and Solidity.

Each returns a ``Tokens``: parallel lists of token kinds, begins and ends (character offsets), and
whether a line end stands before the token.  Comments are kept apart.  A character or literal that
the language does not have gives the kind ``ERROR`` and the lexer goes on after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ERROR = "ERROR"


@dataclass
class Tokens:
    kind: list[str] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    newline: list[bool] = field(default_factory=list)
    #: JavaScript only: may a semicolon be inserted before this token (not within ( or [)
    loose: list[bool] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)


def _ops(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# --- Go ---------------------------------------------------------------------------------------

_GO_ESC = r"\\(?:[abfnrtv\\%s]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})"
_GO = re.compile(
    r"[ \t\r]*(?:(?P<nl>\n)|(?P<com>//[^\n]*|/\*.*?\*/)|(?P<id>[^\W\d]\w*)"
    r"|(?P<num>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?[\d_]+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?[\d_]+)?)i?)"
    r'|(?P<str>`[^`]*`|"(?:[^"\\\n]|' + _GO_ESC % '"' + r')*")|(?P<rune>\'(?:[^\'\\\n]|' + _GO_ESC % "'" + r")\')"
    "|(?P<op>" + _ops("+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! != <= >= := ... ( ) [ ] { } , ; . : ~") + "))",
    re.S,
)
_GO_BLANK = re.compile(r"[ \t\r]*")
_GO_D = r"\d(?:_?\d)*"
_GO_NUM = re.compile(
    rf"(?:0|[1-9](?:_?\d)*|0(?:_?[0-7])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0[xX](?:_?[\da-fA-F])+)i?|{_GO_D}i|(?:{_GO_D}\.(?:{_GO_D})?(?:[eE][+-]?{_GO_D})?|{_GO_D}[eE][+-]?{_GO_D}|\.{_GO_D}(?:[eE][+-]?{_GO_D})?)i?"
    rf"|0[xX](?:(?:_?[\da-fA-F])+\.?(?:[\da-fA-F](?:_?[\da-fA-F])*)?|\.[\da-fA-F](?:_?[\da-fA-F])*)[pP][+-]?{_GO_D}i?"
)
GO_KEYWORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_GO_ENDS = _words("IDENT NUM STR RUNE break continue fallthrough return ++ -- ) ] }")
_GO_ASSIGN = _words("= := += -= *= /= %= &= |= ^= <<= >>= &^=")
_GO_BINARY = _words("|| && == != < <= > >= | / % << >> &^")


def go(src: str) -> Tokens:
    """Semicolons are inserted by the rule for line ends.  ``BLK`` is the brace that opens the body
    of an if, for, switch or select, told from a composite literal's by the bracket depth."""
    t = Tokens()
    kind, begin, end, nl = t.kind, t.begin, t.end, t.newline
    depth, clauses, funcs = 0, [], []
    last, line = "", False
    pos, n, match = 1 if src[:1] == "﻿" else 0, len(src), _GO.match

    def add(k, a, b):
        nonlocal last, line
        kind.append(k)
        begin.append(a)
        end.append(b)
        nl.append(line)
        last, line = k, False

    while pos < n:
        m = match(src, pos)
        if m is None:
            pos = _GO_BLANK.match(src, pos).end()
            if pos < n:
                add(ERROR, pos, pos + 1)
                pos += 1
            continue
        g = m.lastgroup
        a, pos = m.span(g)
        if g == "com" or g == "nl":
            if g == "com":
                t.comments.append((a, pos))
                if src[a + 1] == "/" or "\n" not in m[g]:
                    continue
            if last in _GO_ENDS:
                add(";", a, a)
            line = True
            continue
        if g == "id":
            w = m[g]
            if w in GO_KEYWORDS:
                add(w, a, pos)
                if w in ("if", "for", "switch", "select"):
                    clauses.append(depth)
                elif w == "func":
                    funcs.append(depth)
            else:
                add("IDENT", a, pos)
        elif g == "op":
            w = m[g]
            if w in "([{":
                if w == "{" and clauses and clauses[-1] == depth:
                    if last in ("struct", "interface") or _literal_type(kind):
                        pass
                    elif funcs and funcs[-1] == depth and len(funcs) and funcs[-1] >= clauses[-1] and _func_open(kind, begin, clauses, funcs):
                        funcs.pop()
                    else:
                        clauses.pop()
                        w = "BLK"
                elif w == "{" and funcs and funcs[-1] == depth and last not in ("struct", "interface"):
                    funcs.pop()
                depth += 1
            elif w in ")]}":
                depth -= 1
                while clauses and clauses[-1] > depth:
                    clauses.pop()
                while funcs and funcs[-1] > depth:
                    funcs.pop()
            elif w == ";" and funcs and funcs[-1] == depth:
                funcs.pop()
            elif w in _GO_ASSIGN:
                w = "ASG" if w not in ("=", ":=") else w
            elif w in _GO_BINARY:
                w = "BIN"
            add(w, a, pos)
        elif g == "num" and not ((w := m[g]).isdigit() and (w[0] != "0" or len(w) == 1)) and not _GO_NUM.fullmatch(w):
            add(ERROR, a, pos)
        else:
            add({"num": "NUM", "str": "STR", "rune": "RUNE"}[g], a, pos)
    if last in _GO_ENDS:
        add(";", n, n)
    return t


def _literal_type(kind: list[str]) -> bool:
    """Do the tokens end with a type that only a composite literal can follow: []T, [n]T, map[K]V or
    a struct type?"""
    i = len(kind) - 1
    if i >= 0 and kind[i] == "}":
        depth = 0
        for j in range(i, -1, -1):
            depth += (kind[j] == "}") - (kind[j] in ("{", "BLK"))
            if depth == 0:
                return j > 0 and kind[j - 1] == "struct"
        return False
    while i >= 0 and kind[i] in ("IDENT", ".", "*"):
        i -= 1
    if i < 0 or kind[i] != "]" or i == len(kind) - 1:
        return False
    depth = 0
    for j in range(i, -1, -1):
        depth += (kind[j] == "]") - (kind[j] == "[")
        if depth == 0:
            return j == 0 or kind[j - 1] not in ("IDENT", ")", "]", "STR", "}")
    return False


def _func_open(kind: list[str], begin: list[int], clauses: list[int], funcs: list[int]) -> bool:
    """Is a func of this depth newer than the clause keyword?"""
    for k in reversed(kind):
        if k == "func":
            return True
        if k in ("if", "for", "switch", "select"):
            return False
    return False


# --- JavaScript and TypeScript ------------------------------------------------------------------

_JS_ID = r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_JS_BLANK = re.compile(r"[ \t\v\f\xa0﻿  -   　]*")
_JS = re.compile(
    _JS_BLANK.pattern + r"(?:(?P<nl>[\n\r  ])|(?P<com>//[^\n\r  ]*|/\*.*?\*/)|(?P<id>" + _JS_ID + r")|(?P<priv>\#" + _JS_ID + ")"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+)n?(?![\w$])|(?:\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?![\w$]))"
    r'|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|\'(?:[^\'\\\n\r]|\\(?:\r\n|.))*\')'
    r"|(?P<op>\?\.(?!\d)|" + _ops("{ } ( ) [ ] ... . ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => @") + "))",
    re.S,
)
_JS_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r  ]|\\[^\n\r  ]|\[(?:[^\]\\\n\r  ]|\\[^\n\r  ])*\])+/[\w$]*")
_JSX_TEXT = re.compile(r"[^<{]+")
_JSX_ID = re.compile(r"[^\W\d][\w-]*|[$][\w$-]*")
_JSX_STR = re.compile(r"\"[^\"]*\"|'[^']*'", re.S)
JS_RESERVED = _words("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let")
#: Words that are keywords only where the grammar asks for them.
JS_CONTEXT = _words("async of get set static as from target meta")
TS_CONTEXT = JS_CONTEXT | _words("type interface namespace module declare abstract readonly public private protected override implements is asserts infer keyof unique satisfies accessor require global out using")
_JS_VALUE_ENDS = _words("IDENT NUM STR TPL TPLT REGEX PRIV ) ] } this super null true false ++ -- J/> J>")
_JS_ASSIGN = _words("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=")
_JS_BINARY = _words("<= >= == != === !== / % <<")
_JS_JOINS = {"&&": "LOG", "||": "LOG", "??": "NUL", "**": "POW"}
#: Escapes that a string of a module may hold.
_JS_TEXT = re.compile(r"(?:[^\\]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|u\{0*(?:10[\da-fA-F]{4}|[\da-fA-F]{1,5})\}|0(?!\d)|\r\n|[^xu\d]))*", re.S)
_JS_GAPS = re.compile(r"__|_(?:$|[.eEn+-])|[.eExXbBoO+-]_")
_JS_OPENS = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|[()]")


def _js_regex(text: str) -> bool:
    """Has the regular expression something to repeat, and does each of its round brackets close?"""
    body, depth = text[1 : text.rindex("/")], 0
    for m in _JS_OPENS.finditer(body):
        depth += (m.group() == "(") - (m.group() == ")")
        if depth < 0:
            return False
    return not depth and body[0] not in "*+?"


#: Before a bracket whose block belongs to the statements around it.
_JS_HEADS = _words("if while for with switch catch await")
_JS_LOOPS = _words("for while do switch")
_JS_LABEL = re.compile(r"[ \t]+[^\W\d]")
_JS_BLOCK_BEFORE = _words("; { } => else do try finally")


def js(src: str, ts: bool, jsx: bool) -> Tokens:
    """Templates come as TPL or TPLH TPLM* TPLT around their expressions; a slash begins a regular
    expression where no value stands before it; ``<`` begins JSX there (with ``jsx``), whose marks
    are J<, J</, J>, J/> and whose text is JSXT."""
    t = Tokens()
    kind, begin, end, nl, loose = t.kind, t.begin, t.end, t.newline, t.loose
    context = TS_CONTEXT if ts else JS_CONTEXT
    n, line, last = len(src), False, ""
    pos = 0
    if src.startswith("#!"):
        pos = src.find("\n") if "\n" in src else n
    # open brackets: (kind, value) where value says whether the bracket's end ends a value
    stack: list[tuple[str, bool]] = []
    tags: list[str] = []
    value = False  # does a value end here?
    closed = ""  # what stood before the ( that was closed last
    loops = [False]  # per function that surely is one: did a loop or switch begin in it?

    def astray(word: str, at: int) -> bool:
        """Is a return surely outside of functions, or a break or continue surely outside of loops?"""
        for x in reversed(stack):
            if x[0] != "{" or x[2] == "?":
                return False
            if x[2] == "f":
                break
        else:
            if word == "return":
                return True
        return word != "return" and not loops[-1] and not _JS_LABEL.match(src, at)

    def add(k, a, b, val=False):
        nonlocal last, line, value
        kind.append(k)
        begin.append(a)
        end.append(b)
        nl.append(line)
        loose.append(not stack or stack[-1][0] not in "([")
        last, line, value = k, False, val

    def template(a, head):
        m = _JS_TPL.match(src, a)
        b = m.end()
        if b >= n:
            return n, ERROR
        if src[b] == "`":
            return b + 1, "TPL" if head else "TPLT"
        return b + 2, "TPLH" if head else "TPLM"

    def jsx_tag(pos):
        """From a < on: a whole tag; True if children follow."""
        a = pos
        closing = src.startswith("</", pos)
        pos += 2 if closing else 1
        add("J</" if closing else "J<", a, pos)
        name, first = "", True
        while pos < n:
            c = src[pos]
            if c.isspace():
                pos += 1
                continue
            if src.startswith("/*", pos) or src.startswith("//", pos):
                e = src.find("*/", pos) + 2 if src[pos + 1] == "*" else src.find("\n", pos)
                if e <= 1:
                    return n, None, name
                pos = e
                continue
            if c == ">":
                add("J>", pos, pos + 1)
                return pos + 1, "close" if closing else "open", name
            if src.startswith("/>", pos) and not closing:
                add("J/>", pos, pos + 2, True)
                return pos + 2, "self", name
            if c == "{":
                return pos, "brace", name
            if m := _JSX_ID.match(src, pos):
                add("JID", pos, m.end())
                if first:
                    name += m.group()
                pos = m.end()
                if first and pos < n and src[pos] in ".:":
                    name += src[pos]
                    continue
                first = False
                continue
            if c in ".:=":
                add(c, pos, pos + 1)
                pos += 1
                continue
            if m := _JSX_STR.match(src, pos):
                add("STR", pos, m.end())
                pos = m.end()
                continue
            return pos, None, name
        return pos, None, name

    def jsx_run(pos, name):
        """Continue within a tag or among children until an expression opens or all is closed."""
        while True:
            if stack and stack[-1][0] == "tag":
                a = pos
                pos, what, more = jsx_tag_rest(pos)
                name = name or more
                if what == "brace":
                    stack.append(("jsx{", False))
                    add("o{", pos, pos + 1)
                    return pos + 1
                stack.pop()
                if what == "open":
                    tags.append(name)
                    stack.append(("kids", False))
                elif what == "self":
                    if not (stack and stack[-1][0] == "kids"):
                        return pos
                else:
                    add(ERROR, a, pos)
                    return max(pos, a + 1)
            m = _JSX_TEXT.match(src, pos)
            if m:
                if ">" in m.group() or "}" in m.group():
                    add(ERROR, pos, m.end())
                else:
                    add("JSXT", pos, m.end())
                pos = m.end()
            if pos >= n:
                add(ERROR, n, n)
                return n
            if src[pos] == "{":
                stack.append(("jsx{", False))
                add("o{", pos, pos + 1)
                return pos + 1
            a = pos
            pos, what, name = jsx_tag(pos)
            if what == "close":
                stack.pop()
                if tags.pop() != name:
                    add(ERROR, a, pos)
                if not (stack and stack[-1][0] == "kids"):
                    value_end()
                    return pos
            elif what == "open":
                tags.append(name)
                stack.append(("kids", False))
            elif what == "self":
                pass
            elif what == "brace":
                stack.append(("tag", False))
                names.append(name)
                stack.append(("jsx{", False))
                add("o{", pos, pos + 1)
                return pos + 1
            else:
                add(ERROR, a, pos)
                return max(pos, a + 1)

    names: list[str] = []

    def value_end():
        nonlocal value
        value = True

    def jsx_tag_rest(pos):
        """The rest of a tag after an expression in it."""
        name = names[-1] if names else ""
        while pos < n:
            c = src[pos]
            if c.isspace():
                pos += 1
            elif c == ">":
                add("J>", pos, pos + 1)
                names and names.pop()
                return pos + 1, "open", name
            elif src.startswith("/>", pos):
                add("J/>", pos, pos + 2, True)
                names and names.pop()
                return pos + 2, "self", name
            elif c == "{":
                return pos, "brace", name
            elif m := _JSX_ID.match(src, pos):
                add("JID", pos, m.end())
                pos = m.end()
            elif c in ".:=":
                add(c, pos, pos + 1)
                pos += 1
            elif m := _JSX_STR.match(src, pos):
                add("STR", pos, m.end())
                pos = m.end()
            else:
                return pos, None, name
        return pos, None, name

    match = _JS.match
    while pos < n:
        m = match(src, pos)
        if m is None:
            pos = _JS_BLANK.match(src, pos).end()
            if pos >= n:
                break
            if src[pos] == "`":
                a = pos
                pos, k = template(pos + 1, True)
                add(k, a, pos, k == "TPL")
                if k == "TPLH":
                    stack.append(("tpl", False))
                continue
            add(ERROR, pos, pos + 1)
            pos += 1
            continue
        g = m.lastgroup
        a = m.start(g)
        if g == "nl":
            pos, line = m.end(), True
            continue
        if g == "com":
            pos = m.end()
            t.comments.append((a, pos))
            if src[a + 1] == "*" and ("\n" in m[g] or "\r" in m[g]):
                line = True
            continue
        if g == "id":
            pos, w = m.end(), m[g]
            if last in (".", "?."):
                add(w if w in JS_RESERVED or w in context else "IDENT", a, pos, True)
            elif w in JS_RESERVED:
                if w == "function" and last == "async" and not line and kind[-1:] == ["async"]:
                    kind[-1] = "asyncfn"
                    end[-1] = pos
                    last, value = "asyncfn", False
                else:
                    if w in _JS_LOOPS:
                        loops[-1] = True
                    if w in ("return", "break", "continue") and astray(w, pos):
                        w = ERROR
                    add(w, a, pos, w in _JS_VALUE_ENDS)
            else:
                add(w if w in context else "IDENT", a, pos, True)
            continue
        if g == "op":
            w = m[g]
            if w[0] == "/" and not value:
                r = _JS_REGEX.match(src, a)
                if r:
                    pos = r.end()
                    add("REGEX" if _js_regex(r.group()) else ERROR, a, pos, True)
                else:
                    add(ERROR, a, a + 1)
                    pos = a + 1
                continue
            if w == "<" and jsx and not value and (c := src[a + 1 : a + 2]) and (c == ">" or c.isalpha() or c in "_$") and not (ts and _generic_arrow(src, a)):
                pos, what, name = jsx_tag(a)
                if what == "open":
                    tags.append(name)
                    stack.append(("kids", False))
                    pos = jsx_run(pos, "")
                elif what == "brace":
                    stack.append(("tag", False))
                    names.append(name)
                    stack.append(("jsx{", False))
                    add("o{", pos, pos + 1)
                    pos += 1
                elif what != "self":
                    add(ERROR, a, pos)
                continue
            if w == "}" and stack and stack[-1][0] == "tpl":
                stack.pop()
                pos, k = template(a + 1, False)
                add(k, a, pos, k == "TPLT")
                if k == "TPLM":
                    stack.append(("tpl", False))
                continue
            pos = m.end()
            if w == "(":
                # after the condition of a statement no value stands
                add(w, a, pos)
                before = kind[-2] if len(kind) > 1 else ""
                stack.append(("(", before not in ("if", "while", "for", "with", "await") if not (len(kind) > 2 and kind[-3] == ".") else True, before if not (len(kind) > 2 and kind[-3] == ".") else ""))
            elif w == "[":
                add(w, a, pos)
                stack.append(("[", True))
            elif w == "{":
                block = last in _JS_BLOCK_BEFORE or last == "" or last == ")"
                if last == "=>" or last == ")" and closed not in _JS_HEADS:
                    sort = "f"
                    loops.append(False)
                else:
                    sort = "b" if last in (")", "else", "do", "try", "finally", "catch", ";", "") else "?"
                add(w, a, pos)
                stack.append(("{", not block, sort))
            elif w in ")]}":
                want = {")": "(", "]": "[", "}": "{"}[w]
                top = stack[-1] if stack else ("", False)
                if top[0] == "jsx{" and w == "}":
                    stack.pop()
                    add("}", a, pos)
                    pos = jsx_run(pos, "")
                    continue
                if top[0] == want:
                    add(w, a, pos, top[1])
                    stack.pop()
                    if w == ")":
                        closed = top[2]
                    elif w == "}" and top[2] == "f":
                        loops.pop()
                else:
                    add(w, a, pos, True)
            elif w in _JS_ASSIGN:
                add("ASG", a, pos)
            elif w in _JS_BINARY:
                add("BIN", a, pos)
            elif w in _JS_JOINS:
                add(_JS_JOINS[w], a, pos)
            elif w == "|":
                add("BAR", a, pos)
            elif w in ("++", "--"):
                add("INC", a, pos, value)
            elif w == "!" and value and ts:
                add(w, a, pos, True)
            else:
                add(w, a, pos)
            continue
        pos = m.end()
        w = m[g]
        if g == "num" and (len(w) > 1 and w[0] == "0" and w[1].isdigit() or "_" in w and _JS_GAPS.search(w)):
            add(ERROR, a, pos)  # octal as of old, refused in modules
        elif g == "str" and "\\" in w and not _JS_TEXT.fullmatch(w):
            add(ERROR, a, pos)
        else:
            add({"num": "NUM", "str": "STR", "priv": "PRIV"}[g], a, pos, True)
    if stack and stack[-1][0] in ("tpl", "kids", "tag", "jsx{"):
        add(ERROR, n, n)
    return t


_GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|\s+extends\b|=)")


def _generic_arrow(src: str, a: int) -> bool:
    return _GENERIC.match(src, a) is not None


# --- Solidity -----------------------------------------------------------------------------------

_SOL_STR = r'"(?:[^"\\\r\n]|\\.)*"|\'(?:[^\'\\\r\n]|\\.)*\''
_SOL = re.compile(
    r"(?P<ws>[ \t\r\n\f﻿]+)|(?P<com>//[^\n\r]*|/\*.*?\*/)"
    r'|(?P<hex>hex(?:"(?:[0-9a-fA-F]{2}(?:_?[0-9a-fA-F]{2})*)?"|\'(?:[0-9a-fA-F]{2}(?:_?[0-9a-fA-F]{2})*)?\'))|(?P<uni>unicode(?:' + _SOL_STR + r"))|(?P<id>[a-zA-Z$_][\w$]*)"
    r"|(?P<num>0x[0-9a-fA-F](?:_?[0-9a-fA-F])*(?![\w$])|(?:\d(?:_?\d)*(?:\.\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE]-?\d(?:_?\d)*)?(?![\w$]))|(?P<str>" + _SOL_STR + ")"
    "|(?P<op>" + _ops("( ) [ ] { } . ; , : ? => -> = |= ^= &= <<= >>= >>>= += -= *= /= %= || && == != < > <= >= | ^ & << >> >>> + - * / % ** ! ~ ++ -- :=") + ")",
    re.S | re.A,
)
SOL_KEYWORDS = _words(
    "abstract as anonymous assembly break calldata case catch constant constructor continue contract default delete do else emit enum event external fallback false for function if immutable import indexed"
    " interface internal is let library mapping memory modifier new override payable pragma private public pure receive return returns storage struct switch true try type unchecked using var view virtual while"
    " error from global revert leave solidity layout transient at"
)
_SOL_TYPE = re.compile(r"(?:address|bool|string|bytes(?:[1-9]|[12]\d|3[0-2])?|u?int(?:8|16|24|32|40|48|56|64|72|80|88|96|104|112|120|128|136|144|152|160|168|176|184|192|200|208|216|224|232|240|248|256)?|u?fixed(?:\d+x\d+)?|byte)\Z")
_SOL_UNIT = _words("wei gwei ether seconds minutes hours days weeks years")
_SOL_ASSIGN = _words("|= ^= &= <<= >>= >>>= += -= *= /= %=")
_SOL_BINARY = _words("|| && == != < > <= >= | ^ & << >> >>> + / % **")


def sol(src: str) -> Tokens:
    t = Tokens()
    pos, n, match = 0, len(src), _SOL.match
    line = False
    while pos < n:
        m = match(src, pos)
        if m is None:
            k, a, pos = ERROR, pos, pos + 1
        else:
            g, a, pos = m.lastgroup, m.start(), m.end()
            if g in ("ws", "com"):
                if g == "com":
                    t.comments.append((a, pos))
                line = line or "\n" in m.group()
                continue
            w = m.group()
            if g == "id":
                k = "TYPE" if _SOL_TYPE.match(w) else "UNIT" if w in _SOL_UNIT else w if w in SOL_KEYWORDS else "IDENT"
            elif g == "op":
                k = "ASG" if w in _SOL_ASSIGN else "BIN" if w in _SOL_BINARY else "INC" if w in ("++", "--") else w
            else:
                k = {"num": "NUM", "hex": "HEX", "uni": "STR", "str": "STR"}[g]
        t.kind.append(k)
        t.begin.append(a)
        t.end.append(pos)
        t.newline.append(line)
        line = False
        if k == "pragma":
            # the rest up to ; is free text
            e = src.find(";", pos)
            if e < 0 or "\n" in src[pos:e] or not src[pos:e].strip():
                continue
            t.kind.append("PRAGMA")
            t.begin.append(pos)
            t.end.append(e)
            t.newline.append(False)
            pos = e
    return t


#: file extension -> (language, lexer)
EXTENSIONS = {
    ".go": ("go", go),
    ".ts": ("ts", lambda s: js(s, True, False)),
    ".tsx": ("ts", lambda s: js(s, True, True)),
    ".js": ("js", lambda s: js(s, False, True)),
    ".jsx": ("js", lambda s: js(s, False, True)),
    ".mjs": ("js", lambda s: js(s, False, True)),
    ".cjs": ("js", lambda s: js(s, False, True)),
    ".sol": ("sol", sol),
}


def extension(path: str | None) -> str | None:
    """The known extension of a path in lower case, else None."""
    if not path:
        return None
    m = re.search(r"\.[^./\\]+$", path)
    e = m.group().lower() if m else None
    return e if e in EXTENSIONS else None
