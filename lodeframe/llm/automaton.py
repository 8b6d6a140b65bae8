"""Regexes over bytes to one minimal deterministic automaton: Thompson's construction, subsets, partition refinement."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from re import _constants as C
from re import _parser

#: States that an automaton may have; more is refused, since it would not fit the tasks' caches.
MOST_STATES = 20_000


class _Builder:
    """A non-deterministic automaton: edges on sets of bytes (as 256-bit integers) and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def bytes_of(self, op, value, fold: bool) -> int:
        if op is C.LITERAL:
            mask = 1 << value
        elif op is C.NOT_LITERAL:
            return ((1 << 256) - 1) ^ self.bytes_of(C.LITERAL, value, fold)
        elif op is C.RANGE:
            mask = sum(1 << b for b in range(value[0], value[1] + 1))
        elif op is C.IN:
            negate = value[0][0] is C.NEGATE
            mask = 0
            for inner in value[1 if negate else 0 :]:
                mask |= self.bytes_of(*inner, fold)
            return ((1 << 256) - 1) ^ mask if negate else mask
        elif op is C.ANY:
            return ((1 << 256) - 1) ^ (1 << 10)
        else:
            raise ValueError(f"rules can't use {op}")
        if fold:
            for b in range(128):
                if mask >> b & 1 and chr(b).isalpha():
                    mask |= 1 << (b ^ 32)
        return mask

    def add(self, items, at: int, fold: bool, reverse: bool) -> int:
        """Reads items from state `at` on; the state behind them."""
        for op, value in reversed(list(items)) if reverse else items:
            if op is C.SUBPATTERN:
                at = self.add(value[3], at, fold or bool(value[1] & re.I), reverse)
            elif op is C.BRANCH:
                end = self.state()
                for way in value[1]:
                    start = self.state()
                    self.empty[at].append(start)
                    self.empty[self.add(way, start, fold, reverse)].append(end)
                at = end
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, inner = value
                for _ in range(low):
                    at = self.add(inner, at, fold, reverse)
                if high is C.MAXREPEAT:
                    start, end = self.state(), self.state()
                    self.empty[at] += [start, end]
                    last = self.add(inner, start, fold, reverse)
                    self.empty[last] += [start, end]
                    at = end
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(inner, at, fold, reverse)
                    self.empty[at].append(end)
                    at = end
            else:
                end = self.state()
                self.edges[at].append((self.bytes_of(op, value, fold), end))
                at = end
        return at


@dataclass(frozen=True)
class Automaton:
    """next[state + byte], with states as multiples of 256; from `accepting` on states accept the rules in rules[state >> 8].

    `start` and `dead` are states; dead is -1 if there is none (a search never dies).
    """

    next: array
    rules: tuple[int, ...]
    accepting: int
    start: int
    dead: int


def compile_rules(patterns: list[str], search: bool = True, reverse: bool = False) -> Automaton:
    """One automaton for all patterns. search: matches may begin anywhere. reverse: reads from the end to the start."""
    nfa = _Builder()
    root = nfa.state()
    if search:
        nfa.edges[root].append(((1 << 256) - 1, root))
    final: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        start = nfa.state()
        nfa.empty[root].append(start)
        final[nfa.add(_parser.parse(pattern), start, False, reverse)] = k

    # bytes that no edge tells apart are one class
    masks = {m for edges in nfa.edges for m, _ in edges}
    signature = [tuple(m >> b & 1 for m in masks) for b in range(256)]
    classes = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    of_byte = [classes[s] for s in signature]
    member = [signature.index(s) for s in classes]

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.edges[x] or x in final)

    subsets = {closure({root}): 0}
    order = list(subsets)
    moves: list[list[int]] = []
    for subset in order:  # grows while it is read
        row = []
        for b in member:
            target = closure({to for x in subset for m, to in nfa.edges[x] if m >> b & 1})
            if target not in subsets:
                subsets[target] = len(order)
                order.append(target)
                if len(order) > MOST_STATES:
                    raise ValueError("the rules need too many states")
            row.append(subsets[target])
        moves.append(row)
    accept = [sum({1 << final[x] for x in subset if x in final}) for subset in order]

    block = {a: i for i, a in enumerate(dict.fromkeys(accept))}
    part = [block[a] for a in accept]
    while True:
        keys = [(part[s], *(part[t] for t in moves[s])) for s in range(len(order))]
        block = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        finer = [block[k] for k in keys]
        if len(block) == len(set(part)):
            break
        part = finer
    count = len(set(part))
    sample = [part.index(p) for p in range(count)]
    ranked = sorted(range(count), key=lambda p: accept[sample[p]] != 0)  # accepting states last
    place = {p: i for i, p in enumerate(ranked)}
    table = array("i", bytes(4 * 256 * count))
    for p in ranked:
        row = [256 * place[part[t]] for t in moves[sample[p]]]
        for b in range(256):
            table[256 * place[p] + b] = row[of_byte[b]]
    rules = tuple(accept[sample[p]] for p in ranked)
    dead = next((256 * place[p] for p in ranked if not accept[sample[p]] and all(part[t] == p for t in moves[sample[p]])), -1)
    return Automaton(table, rules, 256 * sum(r == 0 for r in rules), 256 * place[part[0]], dead)
