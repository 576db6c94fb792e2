"""Deterministic byte automata from regular expressions.

A small regular-expression reader (literals, escapes, classes, groups, ``| ? * + {m,n}``), a
position automaton for any number of tagged expressions, subset construction and minimisation
by partition refinement.  The result is a flat transition array: ``table[state + byte]`` is the
next state (states are multiples of 256).
"""

from __future__ import annotations

from dataclasses import dataclass, field

ALL_BYTES = frozenset(range(256))


@dataclass(frozen=True)
class Node:
    """kind: 'set' (one byte of ``bytes``), 'seq', 'alt' or 'rep' (``low`` to ``high`` times)."""

    kind: str
    parts: tuple = ()
    bytes: frozenset = frozenset()
    low: int = 0
    high: int | None = None


class _Reader:
    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def next(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"unfinished expression: {self.text}")
        self.at += 1
        return c

    def one_of(self, codes: set[int]) -> Node:
        if self.fold:
            codes = codes | {ord(chr(c).swapcase()) for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return Node("set", bytes=frozenset(codes))

    def code(self) -> int:
        c = self.next()
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("expressions are ASCII")
            return ord(c)
        c = self.next()
        if c == "x":
            return int(self.next() + self.next(), 16)
        if c in "tnrfv":
            return {"t": 9, "n": 10, "r": 13, "f": 12, "v": 11}[c]
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return ord(c)

    def klass(self) -> Node:
        outside, codes = self.peek() == "^", set()
        self.at += outside
        while self.peek() != "]":
            low = self.code()
            if self.peek() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.at += 1
                codes |= set(range(low, self.code() + 1))
            else:
                codes.add(low)
        self.at += 1
        return Node("set", bytes=ALL_BYTES - codes) if outside else self.one_of(codes)

    def item(self) -> Node:
        c = self.peek()
        if c == "(":
            self.at += 1
            inner = self.choice()
            if self.next() != ")":
                raise ValueError("unbalanced group")
            return inner
        if c == "[":
            self.at += 1
            return self.klass()
        if c == ".":
            self.at += 1
            return Node("set", bytes=ALL_BYTES - {10})
        return self.one_of({self.code()})

    def row(self) -> Node:
        parts = []
        while self.peek() and self.peek() not in "|)":
            part = self.item()
            while self.peek() and self.peek() in "?*+{":
                c = self.next()
                if c == "{":
                    bounds = ""
                    while self.peek() != "}":
                        bounds += self.next()
                    self.at += 1
                    low, comma, high = bounds.partition(",")
                    part = Node("rep", (part,), low=int(low), high=int(high) if high else None if comma else int(low))
                else:
                    part = Node("rep", (part,), low=int(c == "+"), high=1 if c == "?" else None)
            parts.append(part)
        return Node("seq", tuple(parts))

    def choice(self) -> Node:
        options = [self.row()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.row())
        return options[0] if len(options) == 1 else Node("alt", tuple(options))


def parse(expression: str, fold: bool = False) -> Node:
    """The expression's tree; ``fold`` lets ASCII letters match in either case."""
    reader = _Reader(expression, fold)
    tree = reader.choice()
    if reader.peek():
        raise ValueError(f"unbalanced expression: {expression}")
    return tree


def backwards(node: Node) -> Node:
    parts = tuple(backwards(p) for p in node.parts)
    return Node(node.kind, parts[::-1] if node.kind == "seq" else parts, node.bytes, node.low, node.high)


@dataclass
class _Nfa:
    """Nodes with byte edges and empty edges."""

    edges: list[tuple[frozenset, int] | None] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def node(self) -> int:
        self.edges.append(None)
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree: Node, start: int) -> int:
        """Lay ``tree`` from ``start``; returns its end."""
        if tree.kind == "set":
            end = self.node()
            step = self.node()
            self.empty[start].append(step)
            self.edges[step] = (tree.bytes, end)
            return end
        if tree.kind == "seq":
            for part in tree.parts:
                start = self.add(part, start)
            return start
        if tree.kind == "alt":
            end = self.node()
            for part in tree.parts:
                begin = self.node()
                self.empty[start].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        part, end = tree.parts[0], self.node()
        for _ in range(tree.low):
            start = self.add(part, start)
        if tree.high is None:
            loop = self.node()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(tree.high - tree.low):
                start = self.add(part, start)
                self.empty[start].append(end)
        return end

    def closure(self, nodes) -> frozenset:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]``; ``tags[state >> 8]`` are the expressions accepted there.

    Accepting states are the highest: ``state >= hot`` tests for any acceptance.  ``dead`` is
    the state from which nothing is accepted any more (-1 if there is none).
    """

    table: list[int]
    tags: list[frozenset]
    start: int
    hot: int
    dead: int


def build(trees: list[Node], anywhere: bool) -> Automaton:
    """Minimal automaton of all trees at once; tag i belongs to ``trees[i]``.

    ``anywhere``: a match may begin at any byte (search); otherwise at the first (anchored).
    """
    nfa = _Nfa()
    root, ends = nfa.node(), {}
    for tag, tree in enumerate(trees):
        begin = nfa.node()
        nfa.empty[root].append(begin)
        ends[nfa.add(tree, begin)] = tag
    begin = nfa.closure([root])

    # Subset construction, over classes of bytes that no edge tells apart.
    sets = list({e[0] for e in nfa.edges if e})
    groups: dict[tuple, list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = list(groups.values())
    number, order, steps = {begin: 0}, [begin], []
    for state in order:
        row = []
        moving = [nfa.edges[n] for n in state if nfa.edges[n]]
        for members in classes:
            reached = {end for codes, end in moving if members[0] in codes}
            target = nfa.closure(reached | ({root} if anywhere else set()))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        steps.append(row)
    accepts = [frozenset(ends[n] for n in state if n in ends) for state in order]

    # Minimisation: split blocks until equal blocks step to equal blocks.
    block_of = {tags: i for i, tags in enumerate(dict.fromkeys(accepts))}
    block = [block_of[tags] for tags in accepts]
    while True:
        seen: dict[tuple, int] = {}
        split = [seen.setdefault((block[s], *(block[t] for t in steps[s])), len(seen)) for s in range(len(order))]
        if len(seen) == len(set(block)):
            break
        block = split
    members: dict[int, int] = {}
    for s, b in enumerate(block):
        members.setdefault(b, s)
    ranked = sorted(members, key=lambda b: (bool(accepts[members[b]]), members[b]))
    place = {b: i for i, b in enumerate(ranked)}
    table = [0] * (256 * len(ranked))
    for b in ranked:
        for codes, target in zip(classes, steps[members[b]], strict=True):
            for code in codes:
                table[256 * place[b] + code] = 256 * place[block[target]]
    tags = [accepts[members[b]] for b in ranked]
    dead = next((256 * i for i in range(len(ranked))
                 if not tags[i] and all(t == 256 * i for t in table[256 * i:256 * i + 256])), -1)
    return Automaton(table, tags, 256 * place[block[0]], 256 * sum(not t for t in tags), dead)


def longest(machine: Automaton, data: bytes, start: int) -> int:
    """End of the longest match of an anchored automaton from ``start``; -1 if there is none."""
    table, hot, dead, state, end = machine.table, machine.hot, machine.dead, machine.start, -1
    if state >= hot:
        end = start
    for at in range(start, len(data)):
        state = table[state + data[at]]
        if state >= hot:
            end = at + 1
        elif state == dead:
            break
    return end
