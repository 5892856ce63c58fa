"""The table-driven parser: one stack while the tables leave one action, several where they don't.

``parse`` reads all tokens of a file and gives the index of the first token that no reading of the
file allows, or None where the whole file is accepted.
"""

from __future__ import annotations

from loomgraph.llm.syntax.tables import END, Tables, tables_for
from loomgraph.parse import lex

#: A token's second kind, for states that can't use its first.
SECOND = {"{": "o{", "function": "functionE", "class": "classE", "asyncfn": "asyncfnE"}
#: After these a line end always ends the statement.
_CUT = frozenset({"return", "break", "continue"})


class _Stack:
    """A linked stack; stacks that come from one fork share their lower part."""

    __slots__ = ("state", "below")

    def __init__(self, state: int, below: _Stack | None):
        self.state, self.below = state, below


def _linked(states: list[int]) -> _Stack:
    top = None
    for s in states:
        top = _Stack(s, top)
    return top


def _feed(tables: Tables, tops: list[_Stack], kind: str) -> tuple[list[_Stack], bool]:
    """All stacks after ``kind``, and whether one accepts; its second kind where the first leads on
    nowhere."""
    second = SECOND.get(kind)
    out, done = _step(tables, tops, kind, second)
    if not out and not done and second is not None:
        out, done = _step(tables, tops, second, None)
    return out, done


def _step(tables: Tables, tops: list[_Stack], kind: str, second: str | None) -> tuple[list[_Stack], bool]:
    action, goto, rules = tables.action, tables.goto, tables.rules
    out: dict[tuple[int, int], _Stack] = {}
    seen: dict[tuple[int, int], _Stack] = {}
    todo = list(tops)
    done = False
    while todo:
        top = todo.pop()
        acts = action[top.state].get(kind)
        if acts is None:
            if second is None:
                continue
            acts = action[top.state].get(second)
            if acts is None:
                continue
        for a in (acts,) if isinstance(acts, int) else acts:
            if a >= 0:
                key = (a, id(top))
                if key not in out:
                    out[key] = _Stack(a, top)
            elif a == -1:
                done = True
            else:
                head, size = rules[-2 - a]
                low = top
                for _ in range(size):
                    low = low.below
                s = goto[low.state].get(head)
                if s is None:
                    continue
                key = (s, id(low))
                if key not in seen:
                    seen[key] = new = _Stack(s, low)
                    todo.append(new)
    return list(out.values()), done


def parse(tables: Tables, toks: lex.Tokens, semicolons: bool) -> int | None:
    """``semicolons``: insert them by JavaScript's rules where a token doesn't fit."""
    action, goto, rules, chains = tables.action, tables.goto, tables.rules, tables.chains
    kinds = toks.kind
    n = len(kinds)
    states, tops = [0], None
    i = 0
    while i <= n:
        kind = kinds[i] if i < n else END
        if semicolons and i:
            before = kinds[i - 1]
            if i < n and toks.newline[i] and toks.loose[i] and (before in _CUT and (i < 2 or kinds[i - 2] not in (".", "?.")) or kind == "INC"):
                tried, _ = _feed(tables, tops or [_linked(states)], "SEMI")
                if tried:
                    tops = tried
            can = i == n or kind == "}" or toks.newline[i] and toks.loose[i]
            if i < n and kind == "}" and not toks.newline[i] and not toks.loose[i]:
                can = False
        else:
            can = False
        if tops is None:
            saved = states[:] if can else None
            second = SECOND.get(kind) if semicolons else None
            while True:
                s = states[-1]
                if second is None and len(states) > 1:
                    below = states[-2]
                    to = chains.get((below, s, kind))
                    if to is None:
                        to, t = s, action[s].get(kind)
                        while t.__class__ is int and t <= -2 and rules[-2 - t][1] == 1 and (g := goto[below].get(rules[-2 - t][0])) is not None:
                            to = g
                            t = action[to].get(kind)
                        chains[below, s, kind] = to
                    if to != s:
                        states[-1] = s = to
                a = action[s].get(kind)
                if second is not None:
                    b = action[s].get(second)
                    if a is None:
                        a = b
                    elif b is not None:
                        a = (a,)  # both kinds may lead on
                if a.__class__ is int:
                    if a >= 0:
                        states.append(a)
                        break
                    if a == -1:
                        return None
                    head, size = rules[-2 - a]
                    if size:
                        del states[-size:]
                    g = goto[states[-1]].get(head)
                    if g is None:
                        a = None
                    else:
                        states.append(g)
                        continue
                if a is None:
                    if not can:
                        return i
                    again, _ = _feed(tables, [_linked(saved)], "SEMI")
                    tops, done = _feed(tables, again, kind)
                    if done:
                        return None
                    if not tops:
                        return i
                    break
                # several actions
                tops, done = _feed(tables, [_linked(states)], kind)
                if done:
                    return None
                if not tops:
                    if not can:
                        return i
                    again, _ = _feed(tables, [_linked(saved)], "SEMI")
                    tops, done = _feed(tables, again, kind)
                    if done:
                        return None
                    if not tops:
                        return i
                break
        else:
            new, done = _feed(tables, tops, kind)
            if done:
                return None
            if not new:
                if not can:
                    return i
                again, _ = _feed(tables, tops, "SEMI")
                new, done = _feed(tables, again, kind)
                if done:
                    return None
                if not new:
                    return i
            tops = new
        if tops is not None and len(tops) == 1:
            states, at = [], tops[0]
            while at is not None:
                states.append(at.state)
                at = at.below
            states.reverse()
            tops = None
        i += 1
    return n


def first_error(path: str, content: str) -> int | None:
    """Line (from 1) of the first token that the grammar asked for by the path's extension refuses;
    None where the file is accepted or the extension is none of the known ones.

    A byte-order mark, carriage returns and a missing last line end are no faults.
    """
    ext = lex.extension(path)
    if ext is None:
        return None
    language, scan = lex.EXTENSIONS[ext]
    toks = scan(content)
    at = parse(tables_for(language), toks, language in ("js", "ts"))
    if at is None:
        return None
    offset = toks.begin[at] if at < len(toks.begin) else len(content)
    return content.count("\n", 0, offset) + 1
