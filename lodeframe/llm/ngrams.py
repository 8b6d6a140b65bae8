"""Stupid-backoff scores of documents by joins of hash-partitioned n-gram counts.

Documents are read in blocks: a block keeps its words as numbers into its own sorted vocabulary of 64-bit hashes, and is
checkpointed. Of its n-grams (words and word pairs) each block sends every owner, a range of hashes, one row with its
distinct ones, Golomb-coded, and their counts. An owner adds up the counts over all blocks - this is its part of the
n-gram count table - and answers each block with the totals of what that block sent. Blocks join their answers, look up
each n-gram of each document, and sum. An n-gram is one entry of a block's row however often it comes, so no n-gram is hot.

A document is scored by all others: its own counts are taken off the totals, so that it does not vouch for itself. All
counts are kept, and a pair is backed off from only where no other document has it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rice
from ._shared import checkpointed

#: Words of a block, n-grams that an owner should have, and the least number of owners.
BLOCK_WORDS, OWNER_NGRAMS, OWNERS = 1_200_000, 1_000_000, 16
#: The factor of backing off, and what counts for a word that no other document has.
BACKOFF, UNSEEN = 0.4, 0.5
#: Words whose own counts are taken at a time.
COUNTED = 1 << 17
#: Words whose hashes a task keeps.
CACHE_WORDS = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for the words with hashes a, then b."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, ids, sizes, vocabulary, words): texts split at ASCII white space, A-Z lower-cased."""
    hashes, part, number = _Hashes(), TaskContext.get().partitionId(), 0
    ids, sizes, held, words = [], [], [], 0

    def row() -> pd.DataFrame:
        vocabulary, place = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_inverse=True)
        return pd.DataFrame({"block": [(part << 32) | number], "ids": [ids], "sizes": [np.array(sizes, "<i8").tobytes()], "vocabulary": [rice.encode(vocabulary, 64)], "words": [_pack(place.astype("<u4"))], "n": [words]})

    for batch in batches:
        for d, t in zip(batch["doc_id"], batch["text"], strict=True):
            own = t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else []
            if words and words + len(own) > BLOCK_WORDS:
                yield row()
                ids, sizes, held, words, number = [], [], [], 0, number + 1
            ids.append(None if pd.isna(d) else d)
            sizes.append(len(own))
            held.append(np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)))
            words += len(own)
    if ids:
        yield row()


def _ngrams(sizes: bytes, vocabulary: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes, hashes of each with the word before it, whether there is one in its document, documents' sizes."""
    size = np.frombuffer(sizes, "<i8")
    w = rice.decode(vocabulary)[np.frombuffer(zlib.decompress(words), "<u4")]
    inner = np.ones(len(w), bool)
    inner[(np.cumsum(size) - size)[size > 0]] = False
    return w, _pair(np.roll(w, 1), w), inner, size


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """Ranges of equal width of the hashes' first 32 bits; sorted keys stay together."""
    return ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _distinct(w: np.ndarray, pair: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams' sorted hashes, their places for (words, then pairs), and counts."""
    keys, place, counts = np.unique(np.concatenate([w, pair[inner]]), return_inverse=True, return_counts=True)
    return keys, place, counts


def _send(owners: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                keys, _, counts = _distinct(*_ngrams(r.sizes, r.vocabulary, r.words)[:3])
                owner = _owner(keys, owners)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                spans = list(zip(starts, np.append(starts[1:], len(keys)), strict=True))
                yield pd.DataFrame({"owner": owner[starts], "block": r.block, "keys": [rice.encode(keys[a:b], 64) for a, b in spans], "counts": [_pack(counts[a:b].astype("<u4")) for a, b in spans]})

    return run


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """An owner's rows -> for each, the totals of its n-grams over all blocks."""
    keys = [rice.decode(k) for k in rows["keys"]]
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<u4") for c in rows["counts"]])
    table, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, counts, len(table)).astype("<i8")
    ends = np.cumsum([len(k) for k in keys])
    answers = [_pack(totals[place[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
    return pd.DataFrame({"owner": rows["owner"], "block": rows["block"], "totals": answers})


def _own(place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each n-gram comes in its own document; doc is sorted."""
    out, at = np.empty(len(place), np.int64), 0
    while at < len(place):
        end = min(at + COUNTED, len(place))
        end = end if end == len(place) else max(int(np.searchsorted(doc, doc[end], "left")), at)
        end = end if end > at else int(np.searchsorted(doc, doc[at], "right"))  # one document that is longer
        key = (doc[at:end] - doc[at]) * (int(place[at:end].max()) + 1) + place[at:end]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[at:end] = counts[back]
        at = end
    return out


def _score(total: int, backoff: float, unseen: float):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers = answers.sort_values("owner")
        for r in blocks.itertuples(index=False):
            w, pair, inner, size = _ngrams(r.sizes, r.vocabulary, r.words)
            _, place, _ = _distinct(w, pair, inner)
            # owners are ranges of hashes, so their answers in order stand as the sorted hashes do
            totals = np.concatenate([np.frombuffer(zlib.decompress(t), "<i8") for t in answers["totals"]]) if len(w) else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            one = totals[place[: len(w)]] - _own(place[: len(w)], doc)
            two = np.zeros(len(w), np.int64)
            two[inner] = totals[place[len(w) :]] - _own(place[len(w) :], doc[inner])
            others = np.maximum(total - size, 1)[doc]
            found = two > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(found, np.log(two) - np.log(np.roll(one, 1)), np.log(np.maximum(one, unseen)) - np.log(others) + np.where(inner, math.log(backoff), 0.0))
            ends = np.cumsum(size)
            sums = lambda x: np.diff(np.append(0.0, np.cumsum(x))[np.append(0, ends)])  # noqa: B023, E731
            exact = [math.fsum(score[e - n : e]) for e, n in zip(ends, size, strict=True)]
            out.append(pd.DataFrame({"doc_id": list(r.ids), "n_words": size, "n_backoff": sums(inner & ~found).astype(np.int64), "log_score": exact}))
        return pd.concat(out)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF, unseen: float = UNSEEN) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_backoff, log_score (natural log, summed over words), mean_log_score.

    Counts are those of all other rows. A word after another scores c(pair) / c(first) if another row has the pair, else
    backoff * c(word) / N; a row's first word scores c(word) / N. N counts all words of the others; a word that none of
    them has counts as `unseen`. Texts without words, and null ones, score 0 over 0 words, their mean is null. Rows that
    repeat, with the same id or another, are rows like others: each is scored, by its copies too. A text of any length is
    read whole, as one block if it is longer than others. No other column is read. An empty table gives no rows.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = checkpointed(rows.mapInPandas(_blocks, f"block long, ids array<{id_type}>, sizes binary, vocabulary binary, words binary, n long"))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    owners = max(OWNERS, math.ceil(total / OWNER_NGRAMS))
    sent = blocks.drop("ids").mapInPandas(_send(owners), "owner long, block long, keys binary, counts binary")
    answers = sent.groupBy("owner").applyInPandas(_total, "owner long, block long, totals binary")
    schema = f"doc_id {id_type}, n_words long, n_backoff long, log_score double"
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(total, backoff, unseen), schema)
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
