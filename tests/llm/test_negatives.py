import math
import random

import numpy as np
import pytest

negatives = pytest.importorskip("lodeframe.llm.negatives")


def brute(rows, scale=256, best=5, low=80, high=100, every=100):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (i, label, q) in enumerate(kept):
        if i is None or i % every:
            continue
        score = [(sum(a * b for a, b in zip(q, c[2], strict=False)), c[0], c[1]) for c in kept]
        for p, pid, _ in sorted((s for k, s in enumerate(score) if k != at and s[2] == label), key=order)[:best]:
            fits = sorted((s for s in score if s[2] != label and low * p <= 100 * s[0] <= high * p), key=order)[:best]
            out += [(i, pid, rank, n, p, s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(map(str, out))


def said(df):
    return sorted(str((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in df.collect())


def table(n, seed, spread=0.2):
    rng = random.Random(seed)
    hot = [rng.gauss(0.1, spread) for _ in range(64)]
    return [(i, rng.randrange(4), hot if i % 3 == 0 else [rng.gauss(0.05, spread) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("pass_bytes", [16 << 20, 600])
def test_equals_all_pairs(spark, monkeypatch, pass_bytes):
    rows = table(700, 1)
    rows += [(5000, 1, None), (5100, None, [0.1] * 64), (5200, 1, [None] + [0.1] * 63), (5300, 2, [float("nan")] * 64), (5400, 2, [float("-inf")] * 64), (None, 1, [0.1] * 64), (None, 2, [0.1] * 64), (5500, 1, [0.3] * 10), (5600, 0, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, rank int").repartition(3)
    got = said(negatives.mine(df, pass_bytes=pass_bytes))
    assert got and got == brute(rows)


def test_repeated_rows_are_other_rows(spark):
    rows = [(100, 1, [1.0] * 8), (100, 1, [1.0] * 8), (3, 2, [0.9] * 8), (3, 2, [0.9] * 8), (4, 2, [0.95] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert said(negatives.mine(df)) == brute([(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows])


def test_fewer_rows_and_no_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, 1, [1.0])], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0])], schema)).count() == 0
    rows = [(0, 1, [-1.0, 2.0]), (1, 1, [-3.0, 1.0]), (2, 0, [-2.0, 1.0]), (3, 0, [0.0, 0.0])]
    assert said(negatives.mine(spark.createDataFrame(rows, schema))) == brute(rows)
    with pytest.raises(Exception, match="beyond"):
        negatives.mine(spark.createDataFrame([(100, 1, [1e9]), (101, 1, [1.0])], schema)).collect()


def test_ids_that_a_float_does_not_hold(spark):
    big = (1 << 60) + 1
    rows = [(100, 1, [1.0] * 8), (big, 1, [1.0] * 8), (None, 2, [0.9] * 8), (big + 2, 2, [0.9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").coalesce(1)
    assert said(negatives.mine(df)) == brute(rows)


def test_bit_planes_give_inner_products():
    rng = np.random.default_rng(3)
    for low, high in ((-300, 300), (0, 1), (-1, 1), (-(2**19), 2**19), (0, 200)):
        a, c = rng.integers(low, high, (9, 24)), rng.integers(low, high, (300, 24))
        p = negatives.planes(c)
        assert (negatives.whole_rows(p) == c).all() and (negatives.scores(negatives.tables(a), p) == c @ a.T).all()
