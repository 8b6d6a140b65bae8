"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

The items are the small side: they are indexed on the driver, in groups of ITEM_BYTES of text at most, and each group's
index goes to the tasks; more items mean more passes over the documents, not a larger broadcast. A document is cut
into overlapping passages of words where it is read, each passage is a query, and no row is shuffled.

Every item has a threshold of its own: what BM25 gives a passage that holds the item, less what the words can weigh that
may be missing while SIMILARITY of its shingles are still there. So what is retrieved is a superset of what passes the
check of shingles that follows. Weights are divided by their item's threshold, which makes it 1 for all.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, and the share of an item's shingles that a passage must hold.
SHINGLE, SIMILARITY = 5, 0.8
#: BM25's constants, and rows in a block of a posting list.
K1, B, BLOCK = 1.2, 0.75, 16
#: Text of the items that one index holds.
ITEM_BYTES = 16 << 20
#: How much longer than an item the stretch may be in which its words are looked for.
SLACK = 1.25

_TO_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of all other characters beyond ASCII, in UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_WORDS).split()


def shingles(words: list, n: int = SHINGLE) -> set:
    """Runs of n words; of fewer words the whole; of none nothing."""
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


class ItemIndex:
    """Posting lists of items in blocks, for passages as queries."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, similarity: float = SIMILARITY):
        """items: (id, question, answer) with texts or null; those without words are left out."""
        self.shingle, self.similarity = shingle, similarity
        parts = [(i, words_of(q), words_of(a)) for i, q, a in items]
        parts = [(i, q, a) for i, q, a in parts if q or a]
        self.ids = [i for i, _, _ in parts]
        self.parts = [[s for s in (shingles(q, shingle), shingles(a, shingle)) if s] for _, q, a in parts]
        texts = [q + a for _, q, a in parts]
        self.longest = max((len(t) for t in texts), default=1)
        self.stride = max(shingle, math.ceil(SLACK * self.longest))
        df = Counter(w for t in texts for w in set(t))
        mean = sum(map(len, texts)) / max(1, len(texts))
        self.terms = {w: k for k, w in enumerate(sorted(df))}
        posting: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.thresholds = []
        for d, t in enumerate(texts):
            norm = K1 * (1 - B + B * len(t) / mean)
            weight = {w: math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in Counter(t).items()}
            # of m shingles of a part, m - ceil(similarity * m) may be missing, and as many words with them
            lost = sum(len(s) - math.ceil(similarity * len(s) - 1e-9) for s in self.parts[d])
            heavy = sorted(weight.values(), reverse=True)
            least = max(sum(heavy[lost:]) * (1 - 1e-9), min(heavy) * 0.5)
            self.thresholds.append(least)
            for w, x in weight.items():
                posting[self.terms[w]].append((d, x / least))
        self.docs = [[d for d, _ in p] for p in posting]
        self.weights = [[x for _, x in p] for p in posting]
        self.block_max = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.weights]
        self.block_last = [[x[min(i + BLOCK, len(x)) - 1] for i in range(0, len(x), BLOCK)] for x in self.docs]
        self.bound = [max(x) for x in self.weights]
        # terms are inessential while no item can get half its threshold from them: a passage needs others too
        self.others, self.essential = np.zeros(len(self.ids)), np.append(np.ones(len(self.terms), bool), False)
        for t in sorted(range(len(self.terms)), key=lambda t: -len(self.docs[t])):
            docs, x = np.array(self.docs[t]), np.array(self.weights[t])
            if (self.others[docs] + x <= 0.5).all():
                self.others[docs] += x
                self.essential[t] = False
        sizes = np.array([len(x) for x in self.docs], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.flat_docs = np.array([d for x in self.docs for d in x], np.int64)
        self.flat_weights = np.array([x for w in self.weights for x in w])

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score (in their thresholds) is 1 or more for a passage with these distinct terms."""
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += self.bound[t]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that could hold the item: their maxima bound its score more closely
            total, after = 0.0, None
            for _, at, t in cursors[: pivot + 1]:
                b = bisect_left(self.block_last[t], item, at // BLOCK)
                if b < len(self.block_last[t]):
                    total += self.block_max[t][b]
                    last = self.block_last[t][b]
                    after = last if after is None else min(after, last)
            if total < 1:
                target = max(item, after if after is not None else item) + 1
                if pivot + 1 < len(cursors):
                    target = max(item + 1, min(target, cursors[pivot + 1][0]))
            else:
                target = item
                if cursors[0][0] == item:
                    score = sum(self.weights[t][at] for d, at, t in cursors[: pivot + 1] if d == item)
                    if score >= 1:
                        out.append((item, score * self.thresholds[item]))
                    target = item + 1
            moved = []
            for k, (d, at, t) in enumerate(cursors):
                if k <= pivot and d < target:
                    # whole blocks are skipped by their last items, then the place is looked for inside one
                    docs, b = self.docs[t], bisect_left(self.block_last[t], target, at // BLOCK)
                    if b == len(self.block_last[t]):
                        continue
                    at = bisect_left(docs, target, max(at, b * BLOCK), min((b + 1) * BLOCK, len(docs)))
                    d = docs[at]
                moved.append([d, at, t])
            cursors = moved
        return out

    def search(self, words: list[bytes]) -> dict[int, tuple[float, float, int]]:
        """{item: (score, overlap, first word of the passage)}, of each item the passage with most overlap."""
        if not self.ids:
            return {}
        unknown, n = len(self.terms), len(self.ids)
        ids = np.fromiter((self.terms.get(w, unknown) for w in words), np.int64, len(words))
        at = np.flatnonzero(self.essential[ids])
        if not len(at):
            return {}
        # passage p has the words from p * stride on, two strides of them; so each word is in p and p - 1
        p = at // self.stride
        pairs = np.unique(np.concatenate([p, np.maximum(p - 1, 0)]) * unknown + np.concatenate([ids[at], ids[at]]))
        passage, term = np.divmod(pairs, unknown)
        # what a passage's essential terms give each item, and the most that all others could: below 1, WAND finds nothing
        many = self.ends[term] - self.starts[term]
        place = np.repeat(self.starts[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        keys, back = np.unique(np.repeat(passage, many) * n + self.flat_docs[place], return_inverse=True)
        bounds = np.bincount(back, self.flat_weights[place]) + self.others[keys % n]
        found: dict[int, tuple[float, float, int]] = {}
        for first in np.unique(keys[bounds >= 1] // n).tolist():
            first *= self.stride
            window = np.unique(ids[first : first + 2 * self.stride])
            hits = self.retrieve(window[window < unknown].tolist())
            if not hits:
                continue
            own = words[first : first + 2 * self.stride]
            grams: dict[int, set] = {}
            for item, score in hits:
                overlap = 1.0
                for part in self.parts[item]:
                    n = len(next(iter(part)))
                    if n not in grams:
                        grams[n] = shingles(own, n)
                    overlap = min(overlap, len(part & grams[n]) / len(part))
                if overlap >= self.similarity and (item not in found or overlap > found[item][1]):
                    found[item] = (score, overlap, first)
        return found


def indexes(items: DataFrame, id_col: str, question_col: str, answer_col: str | None, item_bytes: int = ITEM_BYTES) -> Iterator[ItemIndex]:
    """Indexes of groups of items; the groups' sizes are measured, not assumed."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = items.select(F.col(id_col).alias("i"), F.col(question_col).alias("q"), answer.alias("a"))
    size = F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0))
    n = math.ceil((rows.agg(F.sum(size.cast("long"))).first()[0] or 0) / item_bytes)
    for k in range(n):
        group = rows.where(F.pmod(F.xxhash64("i", "q"), F.lit(n)) == k) if n > 1 else rows
        yield ItemIndex([tuple(r) for r in group.orderBy("i", "q").toLocalIterator()])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", question_col: str = "text", answer_col: str | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score (BM25), overlap (0.8 to 1), word (where the
    passage starts).

    A passage holds an item if 0.8 of the five-word shingles of its question, and of its answer if there is one, are in
    it; items of fewer words are one shingle. Null or empty texts hold nothing, items without words are in nothing. An
    item is listed once a document, ties go to the first passage; repeated rows are listed as often as they come. Texts of
    any length are read whole. Other columns are not read. Without documents or items there are no rows.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(items.dtypes)[item_id]}, score double, overlap double, word long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sc = docs.sparkSession.sparkContext
    out = None
    for index in indexes(items, item_id, question_col, answer_col, item_bytes):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for batch in batches:
                hits = [(d, index.ids[i], s, o, w) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if isinstance(t, str) for i, (s, o, w) in sorted(index.search(words_of(t)).items())]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "score", "overlap", "word"])

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", question_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item. Each row is judged for itself, whatever its id.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; texts of any length are read whole. The
    columns' names may be any. Without items all rows stay.
    """
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    for index in indexes(items, item_id, question_col, answer_col):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                clean = [not index.search(words_of(t.as_py())) for t in batch.column(text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
