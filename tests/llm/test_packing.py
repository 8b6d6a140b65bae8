import random
import zlib

import numpy as np
import pytest

packing = pytest.importorskip("lodeframe.llm.packing")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = [
    None, "", " ", "a", "Hello world", " leading", "trailing ", "two  spaces", "three   spaces\n\n\nlines", "x \n y", "tab\tbed", "it's we'll I'd",
    "é à b c", "a <|endoftext|> b", "x" * 3000, "word " * 3000, "1234 5,678.90 +++ ### &&&", "日本語 テキスト 😀 ok", "a\x1c b", "end\n", "\x85 a \x85b", "line one\nline two | cell | \r\n x",
]


def test_round_trip_equals_the_tokenizer(spark):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "9", "é", ".", "\t", " ", "日"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, PATH, with_ids=True)
    got = {r.doc_id: list(r.ids) for r in packing.unpack(packed).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        assert r.length == len(r.ids) == 1 << r.bucket and r.length <= 2048 and r.offset == 0
        assert r.doc_tokens == len(got[r.doc_id]) and list(r.ids) == got[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_pieces_are_binary():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        p = packing.pieces(n, 2048)
        assert sum(length for _, length in p) == n and all(a + b == c for (a, b), (c, _) in zip(p, p[1:], strict=False))
        assert [length for _, length in p] == sorted((length for _, length in p), reverse=True)


def test_empty_table_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, 1, 2), (7, "a", 1, 2), (7, "a", 1, 2)], "doc_id long, text string, start int, ids int")
    rows = packing.pack(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in rows) == [(0, 0, 1), (7, 0, 2), (7, 0, 2)]
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, longest=1000)


def test_buckets_hold_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate((1, 3, 40, 700, 5000))], "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, PATH, with_ids=True)
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    lengths = {r.bucket: sorted(r.lengths) for r in back.selectExpr("bucket", "size(ids) AS n").groupBy("bucket").agg({"n": "collect_set"}).withColumnRenamed("collect_set(n)", "lengths").collect()}
    assert all(v == [1 << k] for k, v in lengths.items()) and back.count() == packed.count() and 11 in lengths
