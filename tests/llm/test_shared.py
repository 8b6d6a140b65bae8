import random

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import _shared, exact_dedup


@pytest.mark.parametrize("limit", [10**6, 0])
def test_rows_with_and_without_members(spark, limit):
    """Broadcast or let through by a bitmap: the same rows, nulls equal, names that clash."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(300)]), rng.choice(["", "a", "b"]), k) for k in range(1000)]
    members = {(rng.choice([None, *range(300)]), rng.choice(["", "a", "b"])) for _ in range(150)}
    df = spark.createDataFrame(rows, "gone0 int, bitmap string, bucket int").repartition(3)
    gone = spark.createDataFrame(sorted(members, key=str), "a long, b string")
    keys = [F.col("gone0"), F.col("bitmap")]
    out = _shared.without(df, gone, keys, len(members), limit)
    assert out.columns == df.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(str(r) for r in rows if r[:2] not in members)
    kept = _shared.among(df, gone, keys, len(members), limit)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[:2] in members)
    single = _shared.once(df, gone, keys, limit).collect()
    assert sorted(str(tuple(r)[:2]) for r in single) == sorted([str(r[:2]) for r in rows if r[:2] not in members] + [str(m) for m in members if any(r[:2] == m for r in rows)])


def test_only_suspects_are_shuffled(spark):
    """Beyond what can be broadcast the join reads few more rows than there are members, whatever the size of the other side."""
    docs = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    gone = docs.where("doc_id % 1000 = 0").select("doc_id")
    maybe, clear = _shared.divided(docs, gone, [F.col("doc_id")], 60)
    assert 60 <= maybe.count() < 120 and maybe.count() + clear.count() == 60_000
    texts = docs.withColumn("text", F.when(F.col("doc_id") % 1000 == 1, "copy").otherwise(F.col("text")))
    assert exact_dedup.drop_exact(texts, broadcast_rows=0).count() == 60_000 - 59


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})

    with pytest.raises(ValueError):
        _shared.checkpoint_folder(Session())


def test_plans_of_components_dont_grow_with_rounds(spark):
    """A chain takes many rounds; neither what they hand on nor the tables that they wrote are left behind."""
    from pathlib import Path

    from lodeframe.llm._shared import checkpoint_folder, checkpointed, components

    ids = [(i * 7919) % 5003 for i in range(5003)]
    roots, edges = None, spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    for _ in range(3):  # as rounds that find more and more pairs do
        known = edges if roots is None else edges.unionAll(roots.toDF("u", "v"))
        roots = checkpointed(components(known))
        size = str(roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        assert len(size) < 600
    assert roots.count() == 5003 and roots.select("root").distinct().count() == 1
    assert components(edges.where("u < 0")).count() == 0
    assert not list(Path(checkpoint_folder(spark).removeprefix("file:")).glob("components-*"))
