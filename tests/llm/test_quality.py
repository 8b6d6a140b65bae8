import random
import zlib

import numpy as np

from lodeframe.llm import quality


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "river", "stone", "walks", "over", "green", "hills"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(3, 200))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:20]) * 3
        docs.append((d, text, "en", d))
        if rng.random() < 0.8:
            labels.append((d, int(good)))
    return docs, labels


def test_held_out_accuracy_and_split(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string, __y long")
    got = quality.scored(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_scores_equal_a_plain_computation(spark):
    docs, labels = corpus(200, 3)
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, k long")
    got = {r.doc_id: r.score for r in quality.scored(rows, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = {d: np.array(quality.statistics(t)) for d, t, *_ in docs}
    parts = {}
    for y in (0, 1):
        a = np.array([x[d] for d, q in labels if q == y and zlib.crc32(str(d).encode()) % 5])
        c = np.cov(a.T, bias=True)
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        parts[y] = (len(a), a.mean(0), np.linalg.inv(c), np.linalg.slogdet(c)[1])
    for d, v in x.items():
        log = [np.log(n) - 0.5 * ld - 0.5 * (v - m) @ inv @ (v - m) for n, m, inv, ld in (parts[0], parts[1])]
        assert abs(got[d] - 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))) < 1e-6


def test_nulls_empty_and_few_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, ""), (4, "z" * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, None), (1, 1)], "doc_id long, quality int")
    assert len(quality.scored(docs, one).collect()) == 5
    assert quality.scored(docs.limit(0), one).count() == 0


def test_filter_keeps_columns_and_rows(spark):
    docs, labels = corpus(300, 4)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, k long")
    kept = quality.keep_good(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == frame.columns
    good = {d for d, t, *_ in docs if "!!" not in t}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & good) > 0.98 * len(good) and len(ids - good) < 5


def test_filter_with_clashing_names_and_few_taught_rows(spark):
    docs, labels = corpus(500, 5)
    rows = [(d, t, "a", "b", "c", 1.0) for d, t, *_ in docs] + [(None, None, "a", "b", "c", 1.0), (docs[0][0], docs[0][1], "a", "b", "c", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __text string, __id string, __y string, __q0 double")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    every, some = (quality.keep_good(frame, marked, labelled=n) for n in (200_000, 150))
    assert every.columns == frame.columns == some.columns
    good = {d for d, t, *_ in docs if "!!" not in t}
    for kept in (every, some):
        ids = [r.doc_id for r in kept.collect()]
        assert len(set(ids) & good) > 0.97 * len(good) and len(set(ids) - good) < 8
    want = {r.doc_id for r in quality.scored(frame, marked).where("score >= 0.3").collect()}
    assert {r.doc_id for r in every.collect()} == want
    assert quality.keep_good(frame, marked.limit(0)).count() == len(rows) and quality.keep_good(frame.limit(0), marked).count() == 0
