import itertools
import random
import zlib

import numpy as np

from lodeframe.llm import language as L

ALPHABETS = {"aa": ["ba", "no", "ti", "ka"], "bb": ["sch", "ung", "ver", "keit"], "cc": ["éau", "ion", "eux", "ré"]}


def words(rng, lang, n):
    return ["".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(list(ALPHABETS))
        rows.append((d, " ".join(words(rng, lang, rng.randrange(2, 60))) + ".", lang))
    return rows


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    sizes, labels = np.array([3, 1, 4]), 3
    e, a = rng.normal(size=(8, labels)), rng.normal(size=(labels, labels))
    p, pairs = L.posteriors(e, a, sizes)
    want, joint = np.zeros_like(p), np.zeros_like(pairs)
    at = 0
    for n in sizes:
        paths = list(itertools.product(range(labels), repeat=int(n)))
        scores = np.array([sum(e[at + i, y] for i, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:], strict=False)) for path in paths])
        prob = np.exp(scores - scores.max())
        prob /= prob.sum()
        for path, q in zip(paths, prob, strict=True):
            for i, y in enumerate(path):
                want[at + i, y] += q
            for x, y in zip(path, path[1:], strict=False):
                joint[x, y] += q
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, joint)


def test_held_out_accuracy(spark):
    rows = corpus()
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {d: x for d, _, x in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words_are_labelled():
    rng = random.Random(4)
    field = L.train([(x, t) for _, t, x in corpus(300, 3)], steps=80)
    first, second = words(rng, "aa", 30), words(rng, "bb", 12)
    tokens = first + second
    p, _ = L.posteriors(field.emissions(tokens), field.transition, np.array([len(tokens)]))
    truth = [0] * 30 + [1] * 12
    assert np.mean(p.argmax(1) == truth) > 0.95
    assert field.predict([" ".join(tokens)])[0][0] == "aa"


def test_nulls_no_letters_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None, "aa", 0.5), (2, "12 34 !!", None, 0.5), (None, "", None, 0.5), (2, "x " * 30_000, "aa", 0.5)], "doc_id long, text string, lang string, score double")
    assert {r.lang_pred for r in L.identify(docs.where("lang is null")).collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0
    field = L.train([("aa", "x x"), ("bb", "schung keit")], steps=20)
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(docs, field).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0)] and got[3][1] == "aa"


def test_whole_texts_are_learned_from():
    """What only stands at the end of long documents is learned too."""
    rng = random.Random(6)
    head = " ".join(words(rng, "cc", 400))
    rows = [(x, f"{head} {' '.join(words(rng, x, 200))}") for _ in range(6) for x in ("aa", "bb")]
    field = L.train(rows, steps=60)
    assert [field.predict([" ".join(words(rng, x, 40))])[0][0] for x in ("aa", "bb")] == ["aa", "bb"]


def test_query_equals_a_plain_computation(spark):
    """identify() as a whole against the same field walked text by text, with the split and the sample chosen in plain code."""
    rows = corpus(90, 8) + [(500, None, "aa"), (501, "12 !", "bb"), (502, "", None), (503, "ba no ti " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    field = L.fit(docs)
    taught = [(x, t) for d, t, x in rows if x and t and zlib.crc32(str(d).encode()) % 3 != 1]
    plain = L.train(sorted(taught, key=lambda r: (L.hash_of(r[1]), r)))
    assert plain.labels == field.labels and np.allclose(plain.weights, field.weights) and np.allclose(plain.transition, field.transition)
    for r in L.identify(docs).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        tokens = (text or "").lower().split()
        scores = np.array([plain.emissions([L.tidy(w)])[0] if L.tidy(w) else np.zeros(len(plain.labels)) for w in tokens])
        if not any(map(L.tidy, tokens)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mass, _ = L.posteriors(scores, plain.transition, np.array([len(tokens)]))
        share = mass[[bool(L.tidy(w)) for w in tokens]].sum(0)
        assert r.lang_pred == plain.labels[share.argmax()] and abs(r.score - share.max() / share.sum()) < 1e-6


def test_labels_whose_texts_are_few_among_empty_rows_are_learned(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, "aa", 30)) if i % 200 == 0 else ("", None, "12 !")[i % 3], "aa") for i in range(4000)]
    rows += [(5000 + i, " ".join(words(rng, "bb", 30)), "bb") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert L.fit(docs).labels == ["aa", "bb"]


def test_rows_that_repeat_count_once(spark):
    """One id with many texts is as many texts; one text that comes again is one."""
    rng = random.Random(10)
    one, two = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    own = [(one, " ".join(words(rng, "aa", 20)), "aa") for _ in range(300)]
    docs = spark.createDataFrame(own + own[:1] * 3000 + [(two, " ".join(words(rng, "bb", 20)), "bb")] * 50, "doc_id long, text string, lang string").repartition(4)
    field = L.fit(docs)
    assert field.labels == ["aa", "bb"] and sum(len(w) > 0 for w in field.lexicon) > 20
