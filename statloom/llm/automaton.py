"""Regular expressions to one minimal deterministic automaton over bytes.

The accepted syntax: literals, ``\\xHH`` and escaped characters, classes ``[...]`` with ranges, groups, ``|``, ``?``, ``*``, ``+``,
``{m}``, ``{m,}`` and ``{m,n}``. ``fold=True`` takes ASCII letters in either case.
"""

from __future__ import annotations

import numpy as np


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1


class _Parser:
    """Recursive descent to a tree: ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, low, high)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def parse(self):
        node = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} at {self.i} of {self.p!r}")
        return node

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("cat", items)

    def repeated(self):
        node = self.atom()
        while self.peek() in ("?", "*", "+", "{"):
            c = self.peek()
            if c == "{":
                close = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : close].partition(",")
                self.i = close + 1
                node = ("rep", node, int(low), None if comma and not high else int(high or low))
            else:
                self.i += 1
                node = ("rep", node, 1 if c == "+" else 0, 1 if c == "?" else None)
        return node

    def char(self) -> int:
        c = self.peek()
        self.i += 1
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("patterns are ASCII; write other bytes as \\xHH")
            return ord(c)
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def either(self, values: set[int]) -> frozenset:
        if self.fold:
            values = values | {v ^ 32 for v in values if chr(v).isascii() and chr(v).isalpha()}
        return frozenset(values)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            negated = self.peek() == "^"
            self.i += negated
            values: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    values |= set(range(low, self.char() + 1))
                else:
                    values.add(low)
            self.i += 1
            values = set(self.either(values))
            return ("set", frozenset(set(range(256)) - values if negated else values))
        return ("set", self.either({self.char()}))


def _build(nfa: _Nfa, node, start: int) -> int:
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((node[1], end))
        return end
    if kind == "cat":
        for x in node[1]:
            start = _build(nfa, x, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for x in node[1]:
            own = nfa.state()
            nfa.eps[start].append(own)
            nfa.eps[_build(nfa, x, own)].append(end)
        return end
    _, inner, low, high = node
    for _ in range(low):
        start = _build(nfa, inner, start)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.eps[start].append(loop)
        nfa.eps[_build(nfa, inner, loop)].append(loop)
        nfa.eps[loop].append(end)
        return end
    end = nfa.state()
    nfa.eps[start].append(end)
    for _ in range(high - low):
        start = _build(nfa, inner, start)
        nfa.eps[start].append(end)
    return end


def _reverse(node):
    if node[0] == "cat":
        return ("cat", [_reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reverse(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", _reverse(node[1]), node[2], node[3])
    return node


class Automaton:
    """``next[s][b]`` is the state after byte ``b``; ``accepts[s]`` the rules that may end there; state 0 starts.

    ``searching=True`` lets a match start at any position, so one pass over a text reports every end of every rule.
    ``next[s]`` has ``dead`` where no rule can match any more.
    """

    def __init__(self, rules: list[tuple[str, bool]], searching: bool, reverse: bool = False):
        nfa = _Nfa()
        root = nfa.state()
        ends: dict[int, int] = {}
        for k, (pattern, fold) in enumerate(rules):
            tree = _Parser(pattern, fold).parse()
            own = nfa.state()
            nfa.eps[root].append(own)
            ends[_build(nfa, _reverse(tree) if reverse else tree, own)] = k
        self._subsets(nfa, root, ends, searching)
        self._minimise()

    def _subsets(self, nfa: _Nfa, root: int, ends: dict[int, int], searching: bool) -> None:
        # bytes that no set tells apart share a class
        sets = {s for m in nfa.moves for s, _ in m}
        marks = [tuple(b in s for s in sets) for b in range(256)]
        classes: dict[tuple, int] = {}
        self.classes = [classes.setdefault(m, len(classes)) for m in marks]
        samples = [self.classes.index(c) for c in range(len(classes))]
        moves = [[[t for s, t in m if b in s] for b in samples] for m in nfa.moves]

        closures: dict[int, frozenset] = {}

        def closure(s: int) -> frozenset:
            if s not in closures:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.eps[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[s] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
            return closures[s]

        start = closure(root)
        index, todo = {start: 0}, [start]
        self.next, self.accepts = [], []
        for state in todo:
            row = []
            for c in range(len(samples)):
                out: set[int] = set(start) if searching else set()
                for s in state:
                    for t in moves[s][c]:
                        out |= closure(t)
                key = frozenset(out)
                if key not in index:
                    index[key] = len(index)
                    todo.append(key)
                row.append(index[key])
            self.next.append(row)
            self.accepts.append(frozenset(ends[s] for s in state if s in ends))
        self.subsets = len(self.next)

    def _minimise(self) -> None:
        """Partition refinement to the coarsest split that accepts and transitions respect."""
        kinds: dict = {}
        block = [kinds.setdefault(a, len(kinds)) for a in self.accepts]
        while True:
            found: dict = {}
            new = [found.setdefault((block[s], *(block[t] for t in self.next[s])), len(found)) for s in range(len(block))]
            if len(found) == len(set(block)):
                break
            block = new
        order: dict[int, int] = {}
        for s in range(len(block)):
            order.setdefault(block[s], s)
        names = {b: i for i, b in enumerate(sorted(order, key=lambda b: (b != block[0], order[b])))}
        rows: list = [None] * len(names)
        accepts: list = [None] * len(names)
        for b, s in order.items():
            rows[names[b]] = [names[block[t]] for t in self.next[s]]
            accepts[names[b]] = self.accepts[s]
        self.accepts = accepts
        self.dead = next((s for s, r in enumerate(rows) if not accepts[s] and all(t == s for t in r)), -1)
        self.next = np.array(rows, np.uint16 if len(rows) < 1 << 16 else np.uint32)[:, self.classes]

    def linked(self) -> list:
        """The start state as a list: entry b is the list of the next state, entry 256 the rules that end there (or ())."""
        rows = [[None] * 257 for _ in self.next]
        for s, row in enumerate(rows):
            row[:256] = [rows[t] for t in self.next[s].tolist()]
            row[256] = tuple(sorted(self.accepts[s]))
        return rows[0]
