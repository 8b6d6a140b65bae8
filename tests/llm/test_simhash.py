import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodeframe.llm import similar, simhash


def brute(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups_of(rows):
    fps = {d: brute(t) for d, t in rows}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ärger", "été", "A", " x"]
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.5:
            words = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            if rng.random() < 0.7 and len(words) > 4:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 40, 200, 400])))
        rows.append((d, text if rng.random() < 0.97 else None))
    rows[3] = (3, "One\t two \n\n THREE  four")
    rows[4] = (4, " one two three\x0bfour ")
    return rows


@pytest.mark.parametrize(("seed", "list_rows"), [(0, 2048), (1, 2048), (2, 2)])
def test_groups_equal_brute_force(spark, seed, list_rows):
    rows = corpus(seed)
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), list_rows=list_rows).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == groups_of(rows)


def test_lists_that_are_too_long_are_keyed_again(spark):
    rng = random.Random(5)
    fps = set()
    base = [rng.getrandbits(64) for _ in range(3)]
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, list_rows=3)).collect()}
    label = {x: roots.get(simhash._signed(x), simhash._signed(x)) for x in fps}
    near = {x: x for x in fps}

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                near[find(b)] = find(a)
    same = lambda f: {frozenset(y for y in fps if f(y) == f(x)) for x in fps}
    assert same(lambda x: label[x]) == same(find)


def test_masks_miss_no_pair():
    rng = random.Random(1)
    for bits in (0, 1, 2, 3):
        masks = simhash._first_masks(bits)
        finer = [simhash._finer(masks[0], bits)]
        for _ in range(2000):
            diff = 0
            for _ in range(bits):
                diff |= 1 << rng.randrange(64)
            assert any(not diff & m for m in masks)
            if not diff & masks[0]:
                assert any(not diff & m for m in finer[0])


def test_hash_is_sparks(spark):
    words = "Ünïcode words here".encode()
    row = spark.range(1).select(F.xxhash64(F.lit(words.decode())).alias("h")).first()
    assert np.int64(row.h).view(np.uint64) == xxhash.xxh64_intdigest(words, simhash.SEED)


def test_empty_table_clashing_columns_and_drop(spark):
    rows = [(1, "a b c d", 5, "x"), (2, "A b  c d", 6, "y"), (3, None, 7, "z"), (4, "", 8, "z"), (5, "q r s t u", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    assert simhash.near_groups(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.drop_near(docs).collect()) == [1, 3, 5]
    assert simhash.drop_near(docs).columns == docs.columns


def test_tally_equals_all_pairs(monkeypatch):
    rng = random.Random(11)
    for n, flips, block in ((400, 6, 1 << 18), (700, 3, 2000), (2, 2, 1 << 18)):
        base = [rng.getrandbits(64) for _ in range(3)]
        fps = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(flips + 1))}) for b in base * n}
        values = np.array(sorted(fps), np.uint64)
        monkeypatch.setattr(simhash, "BLOCK_PAIRS", block)
        i, j = simhash._near(values, 3)
        want = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, 1))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_rows_are_told_by_id_and_text(spark):
    a, b = "one two three four five six", "nine eight seven six five four"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (2, b, "z"), (3, "", "u"), (3, None, "v"), (None, a, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, told string")
    for drop in (simhash.drop_near, similar.drop_similar):
        kept = drop(docs)
        assert kept.columns == docs.columns
        got = sorted((r.doc_id, r.text or "") for r in kept.collect())
        assert got == [(1, a), (2, b), (3, "")]


def test_long_texts(spark):
    rows = [(1, "word " * 300_000), (2, "word " * 300_000), (3, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == groups_of(rows)
