"""Byte-pair encoding by an automaton over tokens, and decoding by the labels of its arcs.

The automaton begins as one state with an arc back to itself for each character. Merges are put in one after the other, each
by a gadget: for a merge (u, v) the state that u leads to loses its arc v - after u, v can't follow as a token of its own any
more - and every state with an arc u whose target still had an arc v gets an arc uv to where v led, as that state stands
then. What remains accepts the correct tokenizations and nothing else, and every text has just one.

The arc uv leads to a copy of v's state, so a state is kept as the arcs that it has lost and when: a copy shares what was
lost before it was made. An arc uv is made from an arc u, so it is missing wherever u was lost before. That gives all
transitions from tables of the size of the merges, where the arcs spelt out would be states x tokens.

A word is encoded by moving over its characters: a table of tokens' characters proposes arcs that begin at a place, the
automaton tells whether the state there has them. Each place is reached by one arc only; words are walked once a worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import TEXTS, Encoder

#: Words that a worker may hold the ids of, the longest that are walked side by side, how many at a time, and (as a power of
#: two) pairs of state and arc that it remembers.
CACHE_WORDS, WORD_CHARS, SIDE_BY_SIDE, SLOTS = 100_000, 64, 30_000, 20
NEVER = 1 << 60
#: How byte-level vocabularies write a space.
SPACE = "\u0120"


class Automaton:
    """States and tokens have the same numbers (a state is named by the token that leads to it); START is before all text."""

    START, NONE = -2, -1

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        made = {u + v for u, v in merges}
        self.parts: dict[int, tuple[int, int]] = {}  # token -> the arcs that it was made of
        self.born = dict.fromkeys((i for t, i in vocab.items() if len(t) == 1 and t not in made), -1)
        self.copied: dict[int, int] = {}  # token -> the token whose state its own was copied from
        self.unused: set[int] = set()  # tokens that no text has
        self.lost: dict[int, dict[int, int]] = {}  # state -> arc -> the merge by which it lost it
        for k, (u, v) in enumerate(merges):
            self._gadget(k, vocab[u], vocab[v], vocab[u + v])
        self._tables()

    def _gadget(self, k: int, u: int, v: int, uv: int) -> None:
        if any(t not in self.born and t not in self.unused for t in (u, v)) or uv in self.born or uv in self.unused:
            raise ValueError("merges must be of tokens that are made before, each made once")
        if u in self.unused or v in self.unused or not self._has(u, v, k):
            self.unused.add(uv)  # the pair never stands in a text by then, so the merge makes no arc
            return
        self.parts[uv], self.born[uv], self.copied[uv] = (u, v), k, v
        self.lost.setdefault(u, {})[v] = k

    def _when_lost(self, state: int, arc: int) -> int:
        """The merge by which this state, or one that it was copied from before the copy was made, lost the arc."""
        first, until = NEVER, NEVER
        while True:
            k = self.lost.get(state, {}).get(arc, NEVER)
            if k < until:
                first = min(first, k)
            if state not in self.copied:
                return first
            until = min(until, self.born[state])
            state = self.copied[state]

    def _has(self, state: int, arc: int, until: int) -> bool:
        """Whether the state has the arc after the merges before until."""
        while True:
            if self._when_lost(state, arc) < until:
                return False
            if arc not in self.parts:
                return True
            # made from the state's arc of its first part, which must have been there and not gone by that very merge
            until = self.born[arc] + 1
            arc = self.parts[arc][0]

    def _tables(self) -> None:
        """The finished automaton as arrays: of tokens, of lost arcs by state and arc, of the characters of tokens."""
        n = max(self.ids.values()) + 1
        self._born, self._copied, self._first, self._size = np.full(n, NEVER), np.full(n, self.NONE), np.full(n, self.NONE), np.zeros(n, np.int64)
        for t, i in self.ids.items():
            self._size[i] = len(t)
        for i, (u, v) in self.parts.items():
            self._born[i], self._first[i], self._copied[i] = self.born[i], u, v
        rows = sorted((s * n + a, k) for s, arcs in self.lost.items() for a, k in arcs.items())
        self._lost_key, self._lost_at = np.array([[-1, NEVER], *rows], np.int64).T
        letters = sorted({c for t in self.ids for c in t})
        self._letters = np.array([ord(c) for c in letters])
        number, text = {c: k for k, c in enumerate(letters)}, {i: t for t, i in self.ids.items()}
        nodes: dict[int, int] = {}  # node and letter -> node
        self.token = [self.NONE]
        for i in self.born:
            node = 0
            for c in text[i]:
                at = nodes.setdefault(node * len(letters) + number[c], len(self.token))
                if at == len(self.token):
                    self.token.append(self.NONE)
                node = at
            self.token[node] = i
        self._node_key, self._node = np.array(sorted(nodes.items()), np.int64).T if nodes else np.full((2, 1), -1)
        self._token = np.array(self.token)
        self.next, self.number = nodes, number
        self._asked, self._answer = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)

    def has(self, state: int, arc: int) -> bool:
        """A transition of the finished automaton."""
        return state == self.START or self._has(state, arc, NEVER)

    def _lost_many(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        first, until, n = np.full(len(state), NEVER), np.full(len(state), NEVER), len(self._born)
        alive = np.arange(len(state))
        while len(alive):
            key = state * n + arc[alive]
            at = np.minimum(np.searchsorted(self._lost_key, key), len(self._lost_key) - 1)
            k = np.where(self._lost_key[at] == key, self._lost_at[at], NEVER)
            first[alive] = np.minimum(first[alive], np.where(k < until[alive], k, NEVER))
            until[alive] = np.minimum(until[alive], self._born[state])
            state = self._copied[state]
            alive, state = alive[state >= 0], state[state >= 0]
        return first

    def has_many(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """has() for states (START is not among them) and arcs; answers are remembered in a table of fixed size."""
        key = state * len(self._born) + arc
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        ask = np.flatnonzero(self._asked[slot] != key)
        out = self._answer[slot]
        if len(ask):
            held, until, part = np.ones(len(ask), bool), np.full(len(ask), NEVER), arc[ask].copy()
            alive = np.arange(len(ask))
            while len(alive):
                gone = self._lost_many(state[ask[alive]], part[alive]) < until[alive]
                held[alive[gone]] = False
                alive = alive[~gone & (self._first[part[alive]] >= 0)]
                until[alive], part[alive] = self._born[part[alive]] + 1, self._first[part[alive]]
            out[ask] = held
            self._asked[slot[ask]], self._answer[slot[ask]] = key[ask], held
        return out

    def encode(self, word: str) -> list[int]:
        """The labels of the one path that spells the word."""
        n, NONE, letters = len(word), self.NONE, len(self._letters)
        state, begun = [self.START] + [NONE] * n, [0] * (n + 1)
        spelt = [self.number.get(c, -1) for c in word]
        if -1 in spelt:
            raise ValueError("the vocabulary lacks a character")
        for at in range(n):
            here, node = state[at], 0
            for end in range(at, n):
                node = self.next.get(node * letters + spelt[end])
                if node is None:
                    break
                arc = self.token[node]
                if arc != NONE and state[end + 1] == NONE and self.has(here, arc):
                    state[end + 1], begun[end + 1] = arc, at
        out = []
        while n:
            out.append(state[n])
            n = begun[n]
        return out[::-1]

    def encode_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has), by moving over all words side by side, place by place."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        spelt = np.minimum(np.searchsorted(self._letters, points), len(self._letters) - 1)
        if (self._letters[spelt] != points).any():
            raise ValueError("the vocabulary lacks a character")
        slot = np.repeat(np.arange(len(words)), size) + np.arange(len(points))  # a word has a place before each character and one after all
        head = np.cumsum(size + 1) - size - 1
        left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
        # the arcs that tokens' characters propose: from a place, to a place, the token
        at, node, arcs = np.arange(len(points)), np.zeros(len(points), np.int64), []
        for d in range(1, (int(size.max()) if len(size) else 0) + 1):
            key = node * len(self._letters) + spelt[at + d - 1]
            k = np.minimum(np.searchsorted(self._node_key, key), len(self._node_key) - 1)
            good = self._node_key[k] == key
            at, node = at[good], self._node[k[good]]
            ends = np.flatnonzero(self._token[node] >= 0)
            arcs.append((slot[at[ends]], np.full(len(ends), d), self._token[node[ends]]))
            at, node = at[left[at] > d], node[left[at] > d]
            if not len(at):
                break
        state = np.full(len(points) + len(words), self.NONE)
        state[head] = self.START
        if arcs:
            begin, long, token = (np.concatenate(x) for x in zip(*arcs, strict=True))
            place = begin + long - np.repeat(head, size + 1)[begin]
            order = np.lexsort((-long, place))
            begin, long, token, place = begin[order], long[order], token[order], place[order]
            bounds = np.flatnonzero(np.diff(place * (1 << 32) + long, prepend=-1, append=-1))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                end, arc, here = begin[a:b] + long[a], token[a:b], state[begin[a:b]]
                free = state[end] == self.NONE  # one arc leads there, and longer ones were asked before
                end, arc, here = end[free], arc[free], here[free]
                good = here == self.START
                asked = np.flatnonzero(~good)
                good[asked] = self.has_many(here[asked], arc[asked])
                state[end[good]] = arc[good]
        # back from the ends
        word, now, found, step = np.arange(len(words)), head + size, [], 0
        while True:
            more = now > head[word]
            word, now = word[more], now[more]
            if not len(word):
                break
            found.append((word, np.full(len(word), -step), state[now]))
            now, step = now - self._size[state[now]], step + 1
        if not found:
            return np.empty(0, "<u4"), np.zeros(len(words), np.int64)
        word, back, token = (np.concatenate(x) for x in zip(*found, strict=True))
        return token[np.lexsort((back, word))].astype("<u4"), np.bincount(word, minlength=len(words))


class Words(Encoder):
    """packing's way to tell words apart, each distinct one encoded by the automaton; also decodes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer  # for the file's own cuts into words

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kinds = {part: (said.get(part) or {}).get("type") for part in ("normalizer", "pre_tokenizer", "decoder")}
        if kinds != {"normalizer": None, "pre_tokenizer": "ByteLevel", "decoder": "ByteLevel"} or said["model"]["type"] != "BPE":
            raise ValueError("only byte-level vocabularies of merges, without normalisation, are known")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        if any("<|" not in t for t in self.added):
            raise ValueError("added tokens are told by <| in a text")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
        self.automaton = Automaton({t: i for t, i in said["model"]["vocab"].items() if t not in self.added}, pairs)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        labels = {i: bytes(byte[c] for c in t) for t, i in self.automaton.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        sizes = np.zeros(max(labels) + 1, np.int64)
        sizes[list(labels)] = [len(x) for x in labels.values()]
        self.label_size, self.label_end = sizes, np.cumsum(sizes)
        self.labels = np.frombuffer(b"".join(labels.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.end, self.fast, self.known = b"", None, {}
        self.forget()

    def _learn_words(self, some: set[str]) -> None:
        """The ids of words that are not known, as bytes."""
        new = [w for w in some if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(some)
        short = sorted((w for w in new if len(w) <= WORD_CHARS), key=len)
        for at in range(0, len(short), SIDE_BY_SIDE):
            part = short[at : at + SIDE_BY_SIDE]
            ids, counts = self.automaton.encode_many(part)
            data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            self.known.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
        self.known.update((w, np.array(self.automaton.encode(w), "<u4").tobytes()) for w in new if len(w) > WORD_CHARS)

    def learn(self, words: list[str], heads: list[str]) -> None:
        """As packing's: words go through the cuts joined by spaces; what begins with one (shown as SPACE) begins a word."""
        ids, sizes, place = [self.pool], [], len(self.bounds) - 1
        for at in range(0, len(words), SIDE_BY_SIDE):
            part = words[at : at + SIDE_BY_SIDE]
            cut = [w for w, _ in self.cut(" " + " ".join(part))]
            self._learn_words(set(cut))
            own = [self.known[w] for w in cut]
            ids.append(np.frombuffer(b"".join(own), "<u4"))
            begins = np.flatnonzero(np.fromiter((w[0] == SPACE for w in cut), bool, len(cut)))
            sizes.append(np.add.reduceat(np.fromiter(map(len, own), np.int64, len(own)) // 4, begins))
            if len(sizes[-1]) != len(part):
                raise ValueError("the tokenizer does not cut before a word's space")
        for x in self._encode(heads):
            ids.append(np.frombuffer(x, "<u4"))
            sizes.append([len(x) // 4])
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.at = np.append(self.at, np.arange(place, place + len(words)))
        self.heads.update(zip(heads, range(place + len(words), place + len(words) + len(heads)), strict=True))
        self.pool = np.concatenate(ids)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes), dtype=np.int64)])

    def _pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(text, None) between added tokens and ("", id) for these; at one place the longest is taken."""
        at = 0
        while True:
            found = min(((k, -len(t), t) for t in self.added if (k := text.find(t, at)) >= 0), default=None)
            if found is None:
                yield text[at:], None
                return
            yield text[at : found[0]], None
            yield "", self.added[found[2]]
            at = found[0] + len(found[2])

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [[(np.array([added], "<u4").tobytes() if added is not None else [w for w, _ in self.cut(piece)]) for piece, added in self._pieces(text) if piece or added is not None] for text in texts]
        self._learn_words({w for parts in cut for part in parts if isinstance(part, list) for w in part})
        ids = self.known
        return [b"".join(part if isinstance(part, bytes) else b"".join([ids[w] for w in part]) for part in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The labels in a row; bytes that are no text are replaced."""
        arcs = np.frombuffer(ids, "<u4")
        n = self.label_size[arcs]
        place = np.repeat(self.label_end[arcs] - np.cumsum(n), n) + np.arange(n.sum())
        return self.labels[place].tobytes().decode("utf-8", "replace")


@cache
def words(path: str) -> Words:
    """One for each Python worker: the automaton is built once."""
    return Words(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    tokenizer is the path of a byte-level BPE file, which every executor must have; its added tokens are told in texts.
    Null texts count as empty, which have no ids. Texts of any length are encoded whole. Ids, ties and repeated rows do not
    matter: each row is encoded for itself, where it is read. Other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = words(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                ids = coder([t if isinstance(t, str) else "" for t in part["text"]])
                out = pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids]})
                out["decoded_sha256"] = [hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids]
                if with_ids:
                    out["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
                yield out

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """coded with the text of its ids as a further column (of that name, instead of one that is there).

    Null ids give null, no ids an empty text; an id that the vocabulary lacks is an error, as nothing stands for it.
    """

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        coder = words(tokenizer)
        return pd.Series([None if x is None else coder.decode(np.asarray(x, "<u4").tobytes()) for x in column])

    return coded.withColumn(out, text_of(ids_col))
