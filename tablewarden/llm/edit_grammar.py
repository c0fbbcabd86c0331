"""The cheapest edits that make a sequence of turns well formed, by min-plus matrices over a grammar.

A row is a symbol: its role's initial (``s``, ``u``, ``a``, else ``o``) and whether it is sound, truncated or must go.
A state says what the last row kept was: nothing (0), system (1), user (2), assistant (3); 0 and 3 may end. A matrix
has, for each pair of states, the least cost of getting from one to the other over a stretch of rows, and the audit
of it, the edits' initials in order: Keep, Rerole, Delete, Insert; of equal costs the audit that is first in ASCII.
Inserts stand before the row that follows them, so no audit of a stretch is a proper beginning of another one: the
order of audits survives joining, and matrices of stretches can be put together in any bracketing.

Re-Pair gives the brackets: the commonest pair of neighbouring symbols becomes a rule, again and again. Each rule has
its matrix, made from those of its two sides, for all conversations. Audits are ropes: a rule's audit points to those
of its sides. Ropes are told apart by length and a 61-bit hash before they are unrolled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Fixed letters of symbols: a role's initial, in upper case if the row is truncated; ``x`` has to go.
ROLES, GONE = "suao", "x"
#: The first letter of rules, the most rules, and the symbols they are learned from at most.
FIRST_RULE, MOST_RULES, SAMPLE_SYMBOLS = 0xE000, 256, 200_000
#: Coded symbols up to which one row of states is carried along, and sequences whose answer is remembered.
CHAIN, KNOWN = 64, 50_000
#: State after a kept or inserted row, by state before.
TO_USER, TO_ASSISTANT, TO_SYSTEM = {0: 2, 1: 2, 3: 2}, {2: 3}, {0: 1}
STATES, ENDS = range(4), (0, 3)

_MODULUS, _BASE = (1 << 61) - 1, 911_382_323
_LEAF = 24


class Rope:
    """A text made of shared parts."""

    __slots__ = ("hash", "length", "parts", "power")

    def __init__(self, parts, length: int, hash_: int, power: int):
        self.parts, self.length, self.hash, self.power = parts, length, hash_, power

    @classmethod
    def of(cls, text: str) -> Rope:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c)) % _MODULUS
        return cls(text, len(text), h, pow(_BASE, len(text), _MODULUS))

    def __add__(self, other: Rope) -> Rope:
        if not other.length:
            return self
        if not self.length:
            return other
        parts = (self, other)
        if self.length + other.length <= _LEAF:
            parts = str(self) + str(other)
        h = (self.hash * other.power + other.hash) % _MODULUS
        return Rope(parts, self.length + other.length, h, self.power * other.power % _MODULUS)

    def __str__(self) -> str:
        out, open_ = [], [self]
        while open_:
            node = open_.pop()
            if isinstance(node.parts, str):
                out.append(node.parts)
            else:
                open_ += reversed(node.parts)
        return "".join(out)

    def same(self, other: Rope) -> bool:
        return self is other or (self.length == other.length and self.hash == other.hash)

    def before(self, other: Rope) -> bool:
        """Whether this text comes first; equal stretches are passed over by their hashes."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a.same(b):
                continue
            if isinstance(a.parts, str) and isinstance(b.parts, str):
                n = min(a.length, b.length)
                if a.parts[:n] != b.parts[:n]:
                    return a.parts < b.parts
                for rest, open_ in ((a.parts[n:], mine), (b.parts[n:], theirs)):
                    if rest:
                        open_.append(Rope.of(rest))
                continue
            for node, open_, first in ((a, mine, a.length >= b.length), (b, theirs, b.length > a.length)):
                split = not isinstance(node.parts, str) and (first or isinstance((b if node is a else a).parts, str))
                open_ += reversed(node.parts) if split else (node,)
        return bool(theirs)


Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1].before(a[1]) else a


def joined(row: tuple[Entry, ...], matrix: Matrix) -> tuple[Entry, ...]:
    """The entries of one starting state over one more stretch."""
    out = []
    for j in STATES:
        least, ways = None, []
        for k in STATES:
            a, b = row[k], matrix[k][j]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if least is None or cost < least:
                least, ways = cost, [(a[1], b[1])]
            elif cost == least:
                ways.append((a[1], b[1]))
        best: Entry = None
        for x, y in ways:
            best = better(best, (least, x + y))
        out.append(best)
    return tuple(out)


def composed(first: Matrix, second: Matrix) -> Matrix:
    return tuple(joined(row, second) for row in first)


def inserts() -> Matrix:
    """The fewest inserts from state to state."""
    out = [[(0, Rope.of("")) if i == j else None for j in STATES] for i in STATES]
    for i in STATES:
        at, n = i, 0
        while (at := TO_USER.get(at, TO_ASSISTANT.get(at))) is not None and out[i][at] is None:
            n += 1
            out[i][at] = (n * INSERT_COST, Rope.of(INSERT * n))
    return tuple(tuple(row) for row in out)


def symbol_matrix(symbol: str) -> Matrix:
    """The edits of one row, with inserts before it."""
    ways: list[list[Entry]] = [[None] * 4 for _ in STATES]

    def way(i: int, j: int, cost: int, edit: str) -> None:
        ways[i][j] = better(ways[i][j], (cost, Rope.of(edit)))

    for i in STATES:
        way(i, i, DELETE_COST, DELETE)
    if symbol != GONE:
        extra = TRUNCATED_COST if symbol.isupper() else 0
        for i, j in {"s": TO_SYSTEM, "u": TO_USER, "a": TO_ASSISTANT}.get(symbol.lower(), {}).items():
            way(i, j, extra, KEEP)
        for i, j in (TO_USER | TO_ASSISTANT).items():
            way(i, j, extra + REROLE_COST, REROLE)
    return composed(inserts(), tuple(tuple(row) for row in ways))


def symbol(role: str, blank: bool, duplicate: bool, truncated: bool) -> str:
    if blank or duplicate:
        return GONE
    kind = role[:1] if role[:1] and role[:1] in "sua" else "o"
    return kind.upper() if truncated else kind


def learn_rules(sequences: Iterable[tuple[str, int]], most: int = MOST_RULES) -> tuple[str, ...]:
    """Re-Pair over sequences and how often each occurs: the pairs of rules in order; rule ``k`` is ``chr(FIRST_RULE + k)``."""
    kept, total = [], 0
    for text, n in sequences:
        if total + len(text) > SAMPLE_SYMBOLS and kept:
            break
        kept.append((text[:SAMPLE_SYMBOLS], n))
        total += len(text)
    rules: list[str] = []
    texts = [t for t, _ in kept]
    times = np.array([n for _, n in kept], np.float64)
    while len(rules) < most:
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        if len(codes) < 2:
            break
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(codes) - 1]
        pairs = codes[:-1] << 21 | codes[1:]
        inner = (codes[:-1] != 10) & (codes[1:] != 10)
        values, at = np.unique(pairs[inner], return_inverse=True)
        if not len(values):
            break
        weight = np.bincount(at, times[owner[inner]])
        best = int(np.argmax(weight))
        if weight[best] < 2:
            break
        pair = chr(int(values[best] >> 21)) + chr(int(values[best] & 0x1FFFFF))
        letter = chr(FIRST_RULE + len(rules))
        rules.append(pair)
        texts = [t.replace(pair, letter) for t in texts]
    return tuple(rules)


class Grammar:
    """The matrices of all symbols and rules, and the cheapest edits of whole sequences."""

    def __init__(self, rules: tuple[str, ...] = ()):
        self.rules = rules
        self.matrices = {s: symbol_matrix(s) for s in [*ROLES, *ROLES.upper(), GONE]}
        for k, (left, right) in enumerate(rules):
            self.matrices[chr(FIRST_RULE + k)] = composed(self.matrices[left], self.matrices[right])
        self.ends = inserts()
        self.known: dict[str, tuple[int, str]] = {}

    def coded(self, symbols: str) -> str:
        for k, pair in enumerate(self.rules):
            if len(symbols) < 2:
                break
            symbols = symbols.replace(pair, chr(FIRST_RULE + k))
        return symbols

    def product(self, code: str) -> Matrix:
        """The matrix of a coded stretch, halved again and again so that ropes stay shallow."""
        level = [self.matrices[c] for c in code]
        while len(level) > 1:
            pairs = [composed(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0]

    def solve(self, symbols: str) -> tuple[int, str]:
        """The least cost and its audit."""
        if (found := self.known.get(symbols)) is not None:
            return found
        row: tuple[Entry, ...] = ((0, Rope.of("")), None, None, None)
        code = self.coded(symbols)
        if len(code) > CHAIN:
            row = joined(row, self.product(code))
        else:
            for c in code:
                row = joined(row, self.matrices[c])
        last = joined(row, self.ends)
        best: Entry = None
        for state in ENDS:
            best = better(best, last[state])
        out = (best[0], str(best[1]))
        if len(symbols) <= CHAIN:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[symbols] = out
        return out


@lru_cache(maxsize=2)
def grammar(rules: tuple[str, ...]) -> Grammar:
    return Grammar(rules)


def inserted(state: int) -> tuple[str, int]:
    """The role an inserted or reroled row takes, and the state after it."""
    return ("assistant", 3) if state == 2 else ("user", 2)


def kept(role: str, state: int) -> int:
    """The state after a kept row."""
    return {"s": TO_SYSTEM, "u": TO_USER, "a": TO_ASSISTANT}[role[:1]][state]
