import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import similar


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def groups_of(rows):
    sets, root = {d: grams(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def copies(seed, families=25):
    """Families whose members lie from well below 0.8 to 1, with chains of edits and one large family."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(900_000, None), (900_001, " \n"), (900_002, "a b c"), (900_003, "A b  c"), (900_004, "a b d")]
    for f in range(families):
        last = [word() for _ in range(rng.choice([60, 150, 400]))]
        for k in range(40 if f == 0 else 5):
            rows.append((1000 * f + k, " ".join(last)))
            new = last[:]
            for _ in range(rng.randrange(1, max(3, len(new) // 35))):
                new[rng.randrange(len(new))] = word()
            last = new if f % 2 else last[: len(last)] if k % 3 else new
    return rows


@pytest.mark.parametrize(("seed", "how"), [(0, {}), (1, {"rounds": 1, "block": 3})])
def test_groups_equal_brute_force(spark, seed, how):
    rows = copies(seed)
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    assert {r.doc_id: r.component_id for r in got} == groups_of(rows)


def test_stage_drops_what_three_bits_miss(spark):
    rows = copies(2)
    want = groups_of(rows)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_nothing_and_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert similar.drop_similar(docs).count() == 1
    assert similar.drop_similar(docs.limit(0)).count() == 0


def test_template_below_the_similarity(spark):
    """Many texts with four of five words in common, some of them copied: the template proposes no pairs."""
    rng = random.Random(5)
    template = [f"t{k}" for k in range(80)]
    rows = [(d, " ".join(template + [f"w{rng.randrange(10**9)}" for _ in range(20)])) for d in range(4000)]
    rows += [(10_000 + d, t + " end") for d, t in rows[:4000:100]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == {d: d % 10_000 for d, _ in rows}
    assert time.monotonic() - start < 100


def test_awkward_rows(spark):
    """Null ids, very long texts, repeated rows and columns with names that are used inside."""
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    rows = [(None, "a b c d e f", 1), (None, long + " end", 2), (3, long, 3), (3, long, 3), (3, "g h i j k l", 4), (5, None, 5), (6, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    docs = docs.withColumn("gram", docs.fp).withColumn("root", docs.fp).withColumn("told", docs.fp).withColumn("first", docs.fp)
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.fp for r in kept.collect()) == [1, 3, 4, 5]
    groups = [(r.doc_id, r.component_id) for r in similar.similar_groups(docs).collect()]
    assert sorted(groups, key=str) == sorted([(None, None), (None, 3), (3, 3), (3, 3), (3, 3), (5, 5), (6, 5)], key=str)


def test_simhash_index_comes_first(spark, monkeypatch):
    """Fingerprints are SimHashes of five-word shingles; pairs that the index of byte positions links are verified first."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(30)]
    rows = [(d, t) for d, t in enumerate(texts)] + [(100 + d, t + " end") for d, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r for r in similar.fingerprints(docs, "doc_id", "text", 5).collect()}
    for d, t in rows[:5]:
        h = {xxhash.xxh64_intdigest(" ".join(g).encode()) for g in grams(t)}
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert prints[d].simhash % (1 << 64) == want
    close = {d for d in range(30) if bin((prints[d].simhash ^ prints[100 + d].simhash) % (1 << 64)).count("1") <= 3}
    assert len(close) > 20
    proposed = []
    links = similar.links
    monkeypatch.setattr(similar, "links", lambda *a: proposed.append(links(*a)) or proposed[-1])
    assert {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()} == {d: d % 100 for d, _ in rows}
    found = {frozenset((r.u, r.v)) for r in proposed[0].collect()}
    assert {frozenset((prints[d].simhash, prints[100 + d].simhash)) for d in close} <= found | {frozenset((p.simhash,)) for p in prints.values()}


def test_bitmaps_allow_all_similar_pairs():
    rng = np.random.default_rng(8)
    for n in (1, 3, 100, 511, 513, 900, 4000, 70_000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        sets = [a, np.unique(np.concatenate((a[: len(a) - len(a) // 9], rng.integers(0, 1 << 63, len(a) // 9, np.uint64)))), a[: -(len(a) // 5) or None]]
        sets.append(np.concatenate((a, np.unique(rng.integers(1 << 63, (1 << 64) - 1, len(a) // 4, np.uint64)))))
        sets.append(np.unique(rng.integers(0, 1 << 63, n, np.uint64)))
        marks = [np.frombuffer(similar.parities(s), np.uint64) for s in sets]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(4)))
        near, _ = similar._allowed(marks, np.array([len(s) for s in sets]), i, j, 0.8)
        alike = [5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)]
        assert near[alike].all() and sum(alike) >= 10
        if 100 <= n <= 4000:
            assert not similar._allowed(marks, np.array([len(s) for s in sets]), np.array([0]), np.array([4]), 0.8)[0][0]


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Hundreds of edits of one text that are near to one another, most of them below the similarity."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for d in range(600):
        own = base[:]
        for k in rng.sample(range(160), rng.choice([2, 4, 5, 6])):
            own[k] = f"w{rng.randrange(10**9)}"
        rows.append((d, " ".join(own)))
    pairs, stored = [], similar.checkpointed

    def counted(df):
        out = stored(df)
        if out.columns[:2] == ["u", "v"]:
            pairs.append(out.where(F.col("u").isNotNull()).count())
        return out

    monkeypatch.setattr(similar, "checkpointed", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == groups_of(rows)
    assert 0 < sum(pairs) < 20 * len(rows)
