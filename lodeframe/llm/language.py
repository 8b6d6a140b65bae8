"""Language of code-switched text by a linear-chain conditional random field.

Every word gets a label. A word's features are its affixes and character n-grams (hashed), and its place in a learned
lexicon; labels follow each other by learned transitions. The field is trained by gradient ascent on the conditional
likelihood of sequences that switch language half-way, made of a bounded sample of labelled documents. Prediction sums
the words' posteriors, by forward-backward over the whole text; documents are labelled where they are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounded sample: whole documents per label, by a hash of their ids. Their words are cut into stretches of HALF.
DOCS_PER_LABEL, HALF = 80, 30
#: Texts that are looked at for each that is taken; where these are too few, more are.
MARGIN = 2
#: Hashed features, words of the lexicon per label, words that a task keeps scores of, words labelled at a time.
BUCKETS, LEXICON, CACHE_WORDS, GROUP_WORDS = 1 << 15, 400, 400_000, 400_000
#: Steps of Adam, their size, the weight of the squared parameters, and sequences a step (the next ones in a fixed order).
STEPS, RATE, DECAY, SEQUENCES = 120, 0.1, 1e-5, 1600
UNKNOWN = "und"


def tidy(word: str) -> str:
    """A lower-case word's letters; empty if it has none."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, and where each word's begin. Words have letters.

    n-grams of two and three bytes with marks for both ends, so affixes of one and two are among them; affixes of three;
    then BUCKETS + the word's place in the lexicon, or the one number that stands for all others.
    """
    data = [b"^" + w.encode() + b"$" for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(flat))
    left = np.repeat(ends, sizes) - place  # bytes from here to the word's end
    word = np.repeat(np.arange(len(words)), sizes)
    ids, owners = [], []
    for n, salt in ((2, 17), (3, 40503)):
        ok = place[left >= n]
        h = np.full(len(ok), salt, np.int64)
        for k in range(n):
            h = (h * 257 + flat[ok + k]) & 0x3FFFFFFF
        ids.append((h * 2654435761 >> 7) % BUCKETS)
        owners.append(word[ok])
    for at, salt in ((starts, 7919), (ends - 4, 104729)):
        ok = np.flatnonzero(sizes >= 4)
        h = np.full(len(ok), salt, np.int64)
        for k in range(4):
            h = (h * 257 + flat[at[ok] + k]) & 0x3FFFFFFF
        ids.append((h * 2654435761 >> 7) % BUCKETS)
        owners.append(ok)
    other = len(lexicon)
    ids.append(np.array([BUCKETS + lexicon.get(w, other) for w in words], np.int64))
    owners.append(np.arange(len(words)))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.searchsorted(owners[order], np.arange(len(words)))


def posteriors(emission: np.ndarray, transition: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences that stand one after the other in emission (words x labels, log scores).

    Returns each word's label probabilities, and the expected counts of label pairs. Sequences are walked side by side,
    longest first, and each step handles those that are that long.
    """
    n, labels = emission.shape
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    score = np.exp(emission - emission.max(1, keepdims=True)) if n else emission
    step = np.exp(transition - transition.max())
    forward = np.empty((n, labels))
    for t, m in enumerate(alive):
        at = start[:m] + t
        f = score[at] if t == 0 else (forward[at - 1] @ step) * score[at]
        forward[at] = f / f.sum(1, keepdims=True)
    pairs = np.zeros((labels, labels))
    out = forward.copy()
    back = np.ones((len(size), labels))
    for t in range(len(alive) - 1, 0, -1):
        m = alive[t]
        at = start[:m] + t
        ahead = score[at] * back[:m]
        here = ahead @ step.T
        joint = forward[at - 1][:, :, None] * step[None] * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back[:m] = here / here.sum(1, keepdims=True)
        p = forward[at - 1] * back[:m]
        out[at - 1] = p / p.sum(1, keepdims=True)
    return out, pairs


class Field:
    """Labels, the lexicon's places, feature weights (features x labels) and transitions (labels x labels)."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.lexicon, self.weights, self.transition = labels, lexicon, weights, transition

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, starts = features(words, self.lexicon)
        return np.add.reduceat(self.weights[ids], starts, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not hasattr(self, "_known") or len(self._known) > CACHE_WORDS:
            self._known: dict[str, int] = {}
            self._scores = np.zeros((1, len(self.labels)))  # place 0: words without letters
        known = self._known
        tokens = [(t or "").lower().split() for t in texts]
        new = {w for ws in tokens for w in ws if w not in known}
        if new:
            clean = [(w, tidy(w)) for w in new]
            spelt = [(w, c) for w, c in clean if c]
            known.update((w, 0) for w, c in clean if not c)
            known.update((w, len(self._scores) + i) for i, (w, _) in enumerate(spelt))
            if spelt:
                self._scores = np.concatenate([self._scores, self.emissions([c for _, c in spelt])])
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        order = np.argsort(sizes, kind="stable")
        group: list[int] = []
        for k, i in enumerate(order.tolist()):
            group.append(i)
            if k + 1 == len(order) or sizes[group].sum() + sizes[order[k + 1]] > GROUP_WORDS:
                self._label([j for j in group if sizes[j]], tokens, sizes, out)
                group = []
        return out

    def _label(self, group: list[int], tokens: list[list[str]], sizes: np.ndarray, out: list) -> None:
        if not group:
            return
        at = np.fromiter((self._known[w] for j in group for w in tokens[j]), np.int64)
        own = sizes[group]
        mass, _ = posteriors(self._scores[at], self.transition, own)
        total = np.add.reduceat(mass * (at > 0)[:, None], np.cumsum(own) - own, axis=0)
        for j, row in zip(group, total, strict=True):
            if row.sum() > 0:
                best = int(row.argmax())
                out[j] = (self.labels[best], float(row[best] / row.sum()))


def train(sample: list[tuple[str, str]], steps: int = STEPS, sequences: int = SEQUENCES) -> Field | None:
    """The field of (label, text) rows; None without any that has letters. Rows should come in a fixed order.

    Every word of every row is learned from: a text is cut into stretches, each stretch is followed by one of another
    place, of any language, and the steps go through all of these sequences in turn.
    """
    rows = [(label, [c for w in text.lower().split() if (c := tidy(w))]) for label, text in sample]
    rows = [(label, ws) for label, ws in rows if ws]
    labels = sorted({label for label, _ in rows})
    if not labels:
        return None
    counts = {label: Counter(w for x, ws in rows if x == label for w in ws) for label in labels}
    lexicon = {w: i for i, w in enumerate(dict.fromkeys(w for label in labels for w, n in counts[label].most_common(LEXICON) if n > 1))}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in rows for w in ws))}
    ids, starts = features(list(vocabulary), lexicon)
    owner = np.searchsorted(starts, np.arange(len(ids)), side="right") - 1
    halves = [(labels.index(label), np.array([vocabulary[w] for w in ws[i : i + HALF]])) for label, ws in rows for i in range(0, len(ws), HALF)]
    order = np.random.default_rng(0).permutation(len(halves)).tolist()
    pairs_of = [(halves[i], halves[j]) for i, j in zip(order, order[1:] + order[:1], strict=True)]
    n, dims = len(labels), BUCKETS + len(lexicon) + 1
    params = [np.zeros((dims, n)), np.zeros((n, n))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        some = [pairs_of[k % len(pairs_of)] for k in range((step - 1) * sequences, (step - 1) * sequences + min(sequences, len(pairs_of)))]
        at = np.concatenate([x for pair in some for _, x in pair])
        y = np.repeat([label for pair in some for label, _ in pair], [len(x) for pair in some for _, x in pair])
        sizes = np.array([len(a) + len(b) for (_, a), (_, b) in some])
        inner = np.ones(len(y), bool)
        inner[np.cumsum(sizes) - 1] = False
        seen = np.zeros((n, n))
        np.add.at(seen, (y[inner], y[np.flatnonzero(inner) + 1]), 1)
        words = np.add.reduceat(params[0][ids], starts, axis=0)
        p, pairs = posteriors(words[at], params[1], sizes)
        p[np.arange(len(y)), y] -= 1
        by_word = np.stack([np.bincount(at, p[:, c], len(vocabulary)) for c in range(n)], 1)
        slope = [np.stack([np.bincount(ids, by_word[owner, c], dims) for c in range(n)], 1) / len(y) + DECAY * params[0], (pairs - seen) / len(y) + DECAY * params[1]]
        for k in range(2):
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.99 * second[k] + 0.01 * slope[k] ** 2
            params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(labels, lexicon, *params)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 by 3. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = DOCS_PER_LABEL) -> Field | None:
    """Trains on the whole texts of at most per_label documents of each label, those with the smallest hashes of id and text.

    Texts without a letter teach nothing and take no place. Rows that repeat id and text count once.
    """
    known = docs.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("by"))
    counts = {r[0]: r[1] for r in known.groupBy("label").agg(F.approx_count_distinct("by")).collect()}  # the classes
    sample: list[tuple[str, str]] = []
    share = {label: min(1.0, MARGIN * per_label / n) for label, n in counts.items()}
    while share:
        # hashes are even, so this share of them holds some MARGIN times as many texts as are taken, whatever the table's size
        near = [(F.col("label") == label) & (F.col("by") <= int(-(2**63) + x * (2**64 - 1)) if x < 1 else F.lit(True)) for label, x in share.items()]
        rows = known.where(reduce(or_, near)).dropDuplicates(["label", "by"]).collect()
        short = {}
        for label, x in share.items():
            own = sorted((r.by, r.text) for r in rows if r.label == label)
            if len(own) < per_label and x < 1:
                short[label] = min(1.0, 4 * x)
            else:
                sample += [(label, text) for _, text in own[:per_label]]
        share = short
    return train(sorted(sample, key=lambda r: (hash_of(r[1]), r)))


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode())


def predict(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (share of the words' probability that it has).

    und, with score 0, for null texts and texts without a letter, and for all if nothing could be learned. Equal shares
    go to the first label in order. Texts of any length are labelled whole, in memory that grows with the longest. Repeated
    rows are labelled each; no other column is read, whatever its name. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # bounded by BUCKETS, LEXICON and the labels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            rows = []
            for at in range(0, len(texts), 2000):
                part = texts[at : at + 2000]
                rows += own.predict(part) if own else [(UNKNOWN, 0.0)] * len(part)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """predict() with what fit() learns from docs' own labels: see there for nulls, ties and repeated rows.

    Null labels teach nothing; without any label all rows are und. Held-out rows are labelled, never learned from.
    """
    return predict(docs, fit(docs, id_col, text_col, label_col), id_col, text_col)
