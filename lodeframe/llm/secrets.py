"""Secret scans by one combined automaton.

All rules become one minimal automaton that searches everywhere at once; each text is read once, byte by byte, with one
array look-up a byte. Where a rule accepts and no longer would with the next byte, a match ends; a second automaton for
that rule, reading backwards, gives its leftmost start behind the rule's previous match. An exact check of the parts
(lengths) follows. Rows are scanned where they are read; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules


@dataclass(frozen=True)
class Rule:
    """pattern finds a match; of it the last group (or all, without groups) must have `least` characters, else it is dropped."""

    kind: str
    pattern: str
    least: int


#: The three base kinds. Runs of hex digits stand in any word, so their least length is in the pattern.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Kinds that the method adds: private key headers, signed web tokens and some services' tokens, by their public formats.
ADDED = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("hub", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("pay", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 24),
)


class Scanner:
    """Spans of all rules in a text, as (start, kind's place, end) in bytes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.forward = compile_rules([r.pattern for r in rules])
        self.backward = [compile_rules([r.pattern], search=False, reverse=True) for r in rules]
        self.exact = [re.compile(r.pattern.encode()) for r in rules]

    def prepare(self) -> Scanner:
        """Lists are read faster than arrays; made once a task."""
        self.table = self.forward.next.tolist()
        return self

    def ends(self, data: bytes) -> list[list[int]]:
        """Of each rule, where stretches of accepting positions end."""
        table, accepting, rules = self.table, self.forward.accepting, self.forward.rules
        out: list[list[int]] = [[] for _ in self.rules]
        state = self.forward.start
        for at, byte in enumerate(data, 1):
            state = table[state + byte]
            if state >= accepting:
                hit, k = rules[state >> 8], 0
                while hit:
                    if hit & 1:
                        own = out[k]
                        if own and own[-1] == at - 1:
                            own[-1] = at
                        else:
                            own.append(at)
                    hit >>= 1
                    k += 1
        return out

    def start(self, rule: Automaton, data: bytes, end: int, least: int) -> int:
        """The leftmost start, not before least, of a match that ends at end; -1 if there is none."""
        state, found = rule.start, -1
        for at in range(end - 1, least - 1, -1):
            state = rule.next[state + data[at]]
            if state == rule.dead:
                break
            if state >= rule.accepting:
                found = at
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        out = []
        for k, ends in enumerate(self.ends(data)):
            last = 0
            for end in ends:
                start = self.start(self.backward[k], data, end, last)
                if start < 0:
                    continue
                last = end
                match = self.exact[k].fullmatch(data, start, end)
                if match and len(match[match.lastindex or 0]) >= self.rules[k].least:
                    out.append((start, k, end))
        return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> of each base kind, base_sha256 (of the base spans), spans (all).

    A span is kind:start:end in code points, end exclusive; spans are ordered by start, then by the rules' order, and
    joined with commas. Null text counts as empty: no spans. Texts of any length are scanned whole, in one pass. Repeated
    rows are scanned each. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    rules = base + added
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # bounded by the rules
    names = [f"n_{r.kind}" for r in base]

    def one(scanner: Scanner, text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        spans = scanner.spans(data)
        if spans and not data.isascii():
            place = lambda x: len(data[:x].decode("utf-8", "surrogatepass"))
            spans = [(place(s), k, place(e)) for s, k, e in spans]
        said = [(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in spans]
        kinds = [k for k, _ in said]
        own = ",".join(x for k, x in said if k < len(base))
        return (*(kinds.count(k) for k in range(len(base))), hashlib.sha256(own.encode()).hexdigest(), ",".join(x for _, x in said))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = sent.value.prepare()
        for batch in batches:
            rows = [one(scanner, t if isinstance(t, str) else "") for t in batch["text"]]
            out = pd.DataFrame(rows, columns=[*names, "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = ", ".join([f"doc_id {dict(docs.dtypes)[id_col]}", *(f"{n} long" for n in names), "base_sha256 string", "spans string"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
