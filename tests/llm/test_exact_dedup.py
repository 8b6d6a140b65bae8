import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm import exact_dedup, rice


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    return sorted((d, min(g), len(g), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows for g in [groups[norm(t)]])


def test_rice_round_trip():
    rng = np.random.default_rng(3)
    for n, width in ((0, 20), (1, 64), (5, 3), (1000, 20), (1000, 63), (5000, 40)):
        values = np.unique(rng.integers(0, 2**width - 1, n, np.uint64, endpoint=True))
        assert (rice.decode(rice.encode(values, width)) == values).all()
    assert len(rice.encode(np.arange(0, 4_000_000, 400, dtype=np.uint64), 22)) < 10_000 * 11 / 8 + 10


def test_groups(spark):
    rng = random.Random(2)
    texts = ["a b", "a  b", " a b", "a\tb", "a\n\r b", "", " ", "\t", None, "x" * 50_000, "x" * 50_000 + " ", "é à", "é à", "A b"]
    rows = [(i * 3, rng.choice(texts)) for i in range(400)] + [(5000 + i, f"single {i}") for i in range(200)]
    rng.shuffle(rows)
    for limit in (10**6, 0):
        for parts in (1, 7):
            got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), broadcast_rows=limit).collect()
            assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
            assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a", "r", 0), (1, "a", "s", 0), (2, "a ", "t", 0), (1, "b", "u", 0), (3, "b", "v", 0), (None, "c", "w", 0), (None, "c", "x", 0), (4, "c", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string, keep_id int")
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == sorted(
        [(1, 1, 2, True), (1, 1, 2, False), (2, 2, 1, True), (1, 1, 2, True), (3, 1, 2, False), (0, 4, 3, False), (0, 4, 3, False), (4, 4, 3, True)]
    )
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (1, "b"), (2, "a "), (4, "c")]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_hot_text_is_one_row_from_each_task(spark):
    docs = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(docs).where("group_size > 1").agg(F.count("*").alias("n"), F.min("keep_id").alias("k"), F.max("group_size").alias("s")).first()
    assert tuple(got) == (1000, 0, 1000)
