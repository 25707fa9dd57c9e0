"""Regular expressions over bytes to one minimal deterministic automaton: parse, subset construction, minimisation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

Node = tuple


def parse(pattern: str, ignore_case: bool = False) -> Node:
    """Literals, . [..] (..) | ? * + {m} {m,} {m,n} and escapes, of ASCII characters; (?i:..) for either case."""
    tree, at = _either(pattern, 0, ignore_case)
    if at != len(pattern):
        raise ValueError(f"unbalanced pattern {pattern!r}")
    return tree


def _either(p: str, at: int, fold: bool) -> tuple[Node, int]:
    branches, parts = [], []
    while at < len(p) and p[at] != ")":
        if p[at] == "|":
            branches.append(("cat", parts))
            parts, at = [], at + 1
            continue
        if p.startswith("(?i:", at):
            part, at = _either(p, at + 4, True)
            at += 1
        elif p[at] == "(":
            part, at = _either(p, at + 1, fold)
            at += 1
        elif p[at] == "[":
            part, at = _class(p, at + 1, fold)
        else:
            chars, at = _char(p, at)
            part = ("set", _folded(chars, fold))
        while at < len(p) and p[at] in "?*+{":
            low, high, at = _times(p, at)
            part = ("cat", [part] * low + ([("star", part)] if high is None else [("opt", part)] * (high - low)))
        parts.append(part)
    branches.append(("cat", parts))
    return ("alt", branches), at


def _times(p: str, at: int) -> tuple[int, int | None, int]:
    if p[at] != "{":
        return {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[at]] + (at + 1,)
    end = p.index("}", at)
    low, comma, high = p[at + 1 : end].partition(",")
    return int(low), (int(high) if high else None) if comma else int(low), end + 1


def _char(p: str, at: int) -> tuple[frozenset[int], int]:
    if p[at] == ".":
        return frozenset(range(256)) - {10}, at + 1
    if p[at] != "\\":
        return frozenset([ord(p[at])]), at + 1
    if p[at + 1] == "x":
        return frozenset([int(p[at + 2 : at + 4], 16)]), at + 4
    if p[at + 1] == "s":
        return frozenset(b" \t\n\r\f\v"), at + 2
    return frozenset([ord({"n": "\n", "t": "\t", "r": "\r"}.get(p[at + 1], p[at + 1]))]), at + 2


def _class(p: str, at: int, fold: bool) -> tuple[Node, int]:
    negated, chars = p[at] == "^", set()
    at += negated
    while p[at] != "]":
        got, at = _char(p, at) if p[at] != "." else (frozenset(b"."), at + 1)
        if p[at] == "-" and p[at + 1] != "]":
            last, at = _char(p, at + 1)
            got = frozenset(range(min(got), max(last) + 1))
        chars |= got
    chars = _folded(frozenset(chars), fold)
    return ("set", frozenset(range(256)) - chars if negated else chars), at + 1


def _folded(chars: frozenset[int], fold: bool) -> frozenset[int]:
    return chars | frozenset(ord(chr(c).swapcase()) for c in chars if chr(c).isascii() and chr(c).isalpha()) if fold else chars


def width(node: Node) -> int:
    """The length of what node matches; an error unless all its matches have one length."""
    if node[0] == "set":
        return 1
    if node[0] == "cat":
        return sum(map(width, node[1]))
    if node[0] == "alt" and len(found := set(map(width, node[1]))) == 1:
        return found.pop()
    raise ValueError("a trigger needs a fixed length")


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node: Node, start: int) -> int:
        """The state that is reached from start by what node matches."""
        kind, inner = node
        if kind == "set":
            end = self.state()
            self.moves[start].append((inner, end))
            return end
        if kind == "cat":
            for x in inner:
                start = self.add(x, start)
            return start
        first, end = self.state(), self.state()
        self.empty[start].append(first)
        for x in inner if kind == "alt" else [inner]:
            self.empty[self.add(x, first)].append(end if kind != "star" else first)
        if kind != "alt":
            self.empty[first].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def compile_rules(trees: list[Node], search: bool) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Transition arrays (state -> 256 states; state 0 starts) and the rules that each state accepts.

    search: rules may begin at any byte. Else all begin at the first, and a state that reaches no rule has number -1.
    """
    nfa = _Nfa()
    root, accepts = nfa.state(), defaultdict(list)
    for rule, tree in enumerate(trees):
        start = nfa.state()
        nfa.empty[root].append(start)
        accepts[nfa.add(tree, start)].append(rule)
    groups = _byte_groups(s for moves in nfa.moves for s, _ in moves)
    first = nfa.closure([root])
    number, todo, table, rules = {first: 0}, [first], [], []
    while todo:
        now, following = todo, []
        for states in now:
            row = []
            for byte in (g[0] for g in groups):
                to = {t for s in states for chars, t in nfa.moves[s] if byte in chars}
                to = nfa.closure(to | ({root} if search else set()))
                if to not in number:
                    number[to] = len(number)
                    following.append(to)
                row.append(number[to])
            table.append(row)
            rules.append(tuple(sorted(r for s in states for r in accepts.get(s, ()))))
        todo = following
    table, rules = _minimal(table, rules)
    dead = next((s for s, row in enumerate(table) if not rules[s] and set(row) == {s}), None) if not search else None
    of_byte = [0] * 256
    for g, bytes_ in enumerate(groups):
        for b in bytes_:
            of_byte[b] = g
    return [[-1 if row[of_byte[b]] == dead else row[of_byte[b]] for b in range(256)] for row in table], rules


def _byte_groups(sets: Iterable[frozenset[int]]) -> list[list[int]]:
    """Bytes that no set tells apart."""
    distinct = sorted({s for s in sets}, key=sorted)
    groups: dict[tuple, list[int]] = defaultdict(list)
    for b in range(256):
        groups[tuple(b in s for s in distinct)].append(b)
    return list(groups.values())


def _minimal(table: list[list[int]], rules: list[tuple]) -> tuple[list[list[int]], list[tuple]]:
    """Partition refinement from the accepted rules; the start keeps number 0."""
    names: dict = {}
    block = [names.setdefault(r, len(names)) for r in rules]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(table)]
        if len(names) == len(set(block)):
            break
        block = finer
    kept: dict[int, int] = {}
    for s, b in enumerate(finer):
        kept.setdefault(b, s)
    return [[finer[t] for t in table[s]] for s in kept.values()], [rules[s] for s in kept.values()]
