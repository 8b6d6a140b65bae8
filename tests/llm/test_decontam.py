import random

from lodeframe.llm import decontam as D


def brute(docs, items, stride=None):
    """All items against whole texts (fine where an item's words stand together), or against passages of two strides."""
    out = set()
    for d, t in docs:
        words = D.words_of(t)
        for at in range(0, len(words) if stride else 1, stride or 1):
            own = {}
            for i, q, a in items:
                parts = [s for s in (D.shingles(D.words_of(q)), D.shingles(D.words_of(a))) if s]
                if not parts or not words:
                    continue
                ok = True
                for s in parts:
                    n = len(next(iter(s)))
                    own.setdefault(n, D.shingles(words[at : at + 2 * stride] if stride else words, n))
                    ok &= len(s & own[n]) >= 0.8 * len(s)
                if ok:
                    out.add((d, i))
    return out


def case(seed, answers):
    rng = random.Random(seed)
    vocab = ["the", "of", "and"] * 8 + [f"w{i}" for i in range(150)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 6, 12, 25, 60])), text(rng.choice([1, 4, 8])) if answers and rng.random() < 0.8 else None) for i in range(40)]
    items += [(900, None, None), (901, "", " ")]
    docs = []
    for d in range(150):
        words = text(rng.randrange(400)).split()
        for second in range(rng.choice([0, 0, 1, 2])):
            _, q, a = items[rng.randrange(40)]
            leak = (q + " " + (a or "")).split()
            kind = rng.random()
            if kind < 0.3 and len(leak) > 10:
                leak = leak[: int(len(leak) * rng.choice([0.5, 0.85, 0.95]))]
            elif kind < 0.5:
                leak[rng.randrange(len(leak))] = "changed"
            elif kind < 0.6:
                leak = [w.upper() + "," for w in leak]
            at = len(words) if second else rng.randrange(len(words) + 1)  # never inside another
            words[at:at] = leak
        docs.append((d, " ".join(words)))
    return docs + [(500, None), (501, "")], items


def found(spark, docs, items, size, answers):
    frame = spark.createDataFrame(items, "item_id int, text string, answer string")
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), frame, answer_col="answer" if answers else None, item_bytes=size).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert len(set(pairs)) == len(pairs) and all(0.8 <= r.overlap <= 1 and r.score > 0 for r in got)
    return set(pairs)


def test_hits_equal_brute_force(spark):
    docs, items = case(0, False)
    for size in (1 << 24, 2000):  # one index, and several
        assert found(spark, docs, items, size, False) == brute(docs, items)
    docs, items = case(1, True)
    assert found(spark, docs, items, 1 << 24, True) == brute(docs, items, D.ItemIndex(items).stride)


def test_wand_finds_what_plain_scoring_finds():
    docs, items = case(3, False)
    index = D.ItemIndex(items)
    for _, text in docs:
        terms = sorted({index.terms[w] for w in D.words_of(text)[:90] if w in index.terms})
        score = {}
        for t in terms:
            for d, x in zip(index.docs[t], index.weights[t], strict=True):
                score[d] = score.get(d, 0) + x
        assert {d for d, _ in index.retrieve(terms)} == {d for d, s in score.items() if s >= 1}


def test_filter_empty_tables_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, None)], "item_id long, text string")
    rows = [(1, "x alpha beta gamma delta epsilon zeta eta y", 1.0), (1, "clean words", 2.0), (None, None, None), (4, "ALPHA beta, gamma: delta epsilon zeta eta", 3.0), (5, "alpha beta gamma", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.score or 0) for r in kept.collect()) == [(0, 0), (1, 2.0), (5, 4.0)]
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()) == [(1, 1), (4, 1)]
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0
    assert D.drop_contaminated(docs, items.limit(0)).count() == 5


def test_blocks_are_skipped_without_loss():
    """Cursors jump over blocks; what is retrieved equals the sums over whole posting lists."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(["common", "often", *(f"r{rng.randrange(400)}" for _ in range(6))]) for _ in range(rng.randrange(5, 30))), None) for i in range(600)]
    index = D.ItemIndex(items)
    for _ in range(60):
        passage = {w for k in rng.sample(range(600), 2) for w in D.words_of(items[k][1])} | {"common", "often"}
        terms = sorted(index.terms[w] for w in passage if w in index.terms)
        sums = {}
        for t in terms:
            for d, x in zip(index.docs[t], index.weights[t], strict=True):
                sums[d] = sums.get(d, 0.0) + x
        got = dict(index.retrieve(terms))
        assert {d for d, x in sums.items() if x > 1 + 1e-9} <= set(got) <= {d for d, x in sums.items() if x > 1 - 1e-9}


def test_very_long_texts(spark):
    filler = " ".join(f"f{i % 977}" for i in range(150_000))
    item = "which river runs past the old stone bridge near the market square in spring"
    docs = [(1, f"{filler} {item} {filler}"), (2, filler), (3, None)]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id int, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(frame, items).collect()] == [(1, 7)]
    assert sorted(r.doc_id for r in D.drop_contaminated(frame, items).collect()) == [2, 3]
