"""Grammar text to parse tables: the LR(0) automaton with lookaheads from FOLLOW sets.

A state may keep several actions for a token; the parser then follows all of them.
"""

from __future__ import annotations

import pkgutil
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

END = "$end"


@dataclass
class Tables:
    """action[state][token]: a number, or a tuple of several.  n >= 0 goes to state n, -1 accepts,
    -2 - r reduces by rule r.  goto[state][symbol]; rules[r] = (symbol, length)."""

    action: list[dict[str, int | tuple[int, ...]]]
    goto: list[dict[str, int]]
    rules: list[tuple[str, int]]
    #: (state below, state, token) -> the state after all reductions by rules of one symbol; filled while parsing
    chains: dict[tuple[int, int, str], int] = field(default_factory=dict)


def read_rules(text: str, flags: frozenset[str]) -> list[tuple[str, tuple[str, ...]]]:
    """Rules in the order of the text; x? gives one rule with and one without x."""
    out: list[tuple[str, tuple[str, ...]]] = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip() if not line.startswith("#") else ""
        if not line:
            continue
        if line[0] == "@" and line.split()[0] in ("@ts", "@js"):
            flag, line = line.split(None, 1)
            if flag[1:] not in flags:
                continue
        head, body = line.split(" = ", 1) if " = " in line else line.split(" =", 1)
        for alt in body.split("|"):
            parts = [("BAR" if x == "BAR" else x) for x in alt.split()]
            choice = [([x[:-1]], []) if len(x) > 1 and x[-1] == "?" else ([x],) for x in parts]
            for pick in product(*choice):
                rule = (head.strip(), tuple(s for p in pick for s in p))
                if rule not in out:
                    out.append(rule)
    return out


def build(rules: list[tuple[str, tuple[str, ...]]], prefer_shift: frozenset[str] = frozenset({"else"})) -> Tables:
    start = rules[0][0]
    rules = [("$start", (start,)), *rules]
    heads: dict[str, list[int]] = {}
    for r, (h, _) in enumerate(rules):
        heads.setdefault(h, []).append(r)
    # nullable, FIRST, FOLLOW
    nullable: set[str] = set()
    grew = True
    while grew:
        grew = False
        for h, b in rules:
            if h not in nullable and all(x in nullable for x in b):
                nullable.add(h)
                grew = True
    first: dict[str, set[str]] = {h: set() for h in heads}
    follow: dict[str, set[str]] = {h: set() for h in heads}
    grew = True
    while grew:
        grew = False
        for h, b in rules:
            size = len(first[h])
            for x in b:
                first[h] |= first[x] if x in heads else {x}
                if x not in nullable:
                    break
            grew |= len(first[h]) > size
    follow["$start"].add(END)
    grew = True
    while grew:
        grew = False
        for h, b in rules:
            tail = follow[h]
            for x in reversed(b):
                if x in heads:
                    size = len(follow[x])
                    follow[x] |= tail
                    grew |= len(follow[x]) > size
                    tail = (tail | first[x]) if x in nullable else first[x]
                else:
                    tail = {x}
    # items (rule, dot); what each nonterminal opens
    opens: dict[str, frozenset[int]] = {}
    for h in heads:
        seen, todo = {h}, [h]
        while todo:
            for r in heads[todo.pop()]:
                b = rules[r][1]
                if b and b[0] in heads and b[0] not in seen:
                    seen.add(b[0])
                    todo.append(b[0])
        opens[h] = frozenset(r for x in seen for r in heads[x])
    states: dict[frozenset[tuple[int, int]], int] = {frozenset({(0, 0)}): 0}
    order = [frozenset({(0, 0)})]
    action: list[dict] = []
    goto: list[dict[str, int]] = []
    at = 0
    while at < len(order):
        kernel = order[at]
        at += 1
        fresh: set[int] = set()
        for r, d in kernel:
            b = rules[r][1]
            if d < len(b) and b[d] in heads:
                fresh |= opens[b[d]]
        items = [*kernel, *((r, 0) for r in fresh if (r, 0) not in kernel)]
        moves: dict[str, set[tuple[int, int]]] = {}
        acts: dict[str, set[int]] = {}
        for r, d in items:
            b = rules[r][1]
            if d < len(b):
                moves.setdefault(b[d], set()).add((r, d + 1))
            elif r == 0:
                acts.setdefault(END, set()).add(-1)
            else:
                for t in follow[rules[r][0]]:
                    acts.setdefault(t, set()).add(-2 - r)
        gotos: dict[str, int] = {}
        for x, k in moves.items():
            key = frozenset(k)
            if key not in states:
                states[key] = len(order)
                order.append(key)
            if x in heads:
                gotos[x] = states[key]
            elif x in prefer_shift:
                acts[x] = {states[key]}
            else:
                acts.setdefault(x, set()).add(states[key])
        action.append({t: next(iter(a)) if len(a) == 1 else tuple(sorted(a)) for t, a in acts.items()})
        goto.append(gotos)
    return Tables(action, goto, [(h, len(b)) for h, b in rules])


@lru_cache(None)
def tables_for(language: str) -> Tables:
    """Tables of go, js, ts or sol from the bundled text."""
    name = "js" if language == "ts" else language
    text = pkgutil.get_data("loomgraph.llm.syntax", f"grammars/{name}.txt").decode("utf-8")
    return build(read_rules(text, frozenset({language})))
