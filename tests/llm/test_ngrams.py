import math
import random
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm import ngrams


def brute(rows, backoff=0.4, unseen=0.5):
    docs = [(d, (t or "").encode().lower().split()) for d, t in rows]
    one = Counter(w for _, ws in docs for w in ws)
    two = Counter(p for _, ws in docs for p in zip(ws, ws[1:], strict=False))
    total = sum(one.values())
    out = []
    for d, ws in docs:
        score, backed = 0.0, 0
        own, pairs = Counter(ws), Counter(zip(ws, ws[1:], strict=False))
        for i, w in enumerate(ws):
            pair = two[ws[i - 1], w] - pairs[ws[i - 1], w] if i else 0
            if pair:
                score += math.log(pair / (one[ws[i - 1]] - own[ws[i - 1]]))
            else:
                score += math.log(max(one[w] - own[w], unseen) / max(total - len(ws), 1)) + (math.log(backoff) if i else 0)
                backed += i > 0
        out.append((d, len(ws), backed, score))
    return out


def test_own_counts():
    rng = random.Random(3)
    doc = sorted(rng.randrange(6) for _ in range(400))
    place = [rng.randrange(9) for _ in range(400)]
    want = [sum(d == e and p == q for e, q in zip(doc, place, strict=True)) for d, p in zip(doc, place, strict=True)]
    for counted in (1, 50, 1000):
        ngrams.COUNTED = counted
        assert ngrams._own(np.array(place), np.array(doc)).tolist() == want
    ngrams.COUNTED = 1 << 17


def test_a_copy_needs_no_backing_off(spark):
    rows = [(1, "one two three"), (2, "one two three"), (3, "four five six"), (4, "alone " * 200_000)]
    got = {r.doc_id: r.n_backoff for r in ngrams.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 199_999}


@pytest.mark.parametrize(("block", "owners"), [(2_000_000, 16), (300, 3)])
def test_scores_equal_brute_force(spark, monkeypatch, block, owners):
    monkeypatch.setattr(ngrams, "OWNERS", owners)
    rng = random.Random(1)
    vocab = ["the"] * 30 + [f"w{i}" for i in range(80)] + ["É", "ß", "A\tb"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 30, 200])))) for i in range(150)] + [(900, None), (901, " \n"), (902, "one"), (902, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if block < 2_000_000:  # tasks read the constant from the module, which they import: small blocks by small partitions
        frame = frame.repartition(11)
    got = sorted((r.doc_id, r.n_words, r.n_backoff, r.log_score, r.mean_log_score) for r in ngrams.score(frame).collect())
    want = sorted(brute(rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[3] - w[3]) < 1e-9 * max(1, abs(w[3])) and (g[4] is None) == (w[1] == 0)


def test_empty_table_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b a b", 1), (3, "b a", 2)], "doc_id int, text string, block int")
    assert sorted((r.doc_id or 0, r.n_words, r.n_backoff) for r in ngrams.score(docs).collect()) == [(0, 4, 2), (3, 2, 0)]
    assert ngrams.score(docs.limit(0)).count() == 0
