import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import search as R

DOC = "doc_id string, doc_type string, title string, aliases array<string>, identifiers array<string>, tags array<string>, summary string, content string"


def docs(spark):
    rows = [
        ("d1", "cwe", "CWE-89: SQL Injection", ["SQLi"], ["CWE-89"], ["sql"], "s", "about injection"), ("d2", "document", "CWE-89", [], [], [], "s", "x"), ("d3", "document", "Other", ["CWE-89"], [], [], "s", "x"),
        ("d4", "document", "SQL Injection", [], [], [], "s", "sql injection text"), ("d5", "document", "Guide", ["SQL Injection"], [], [], "s", "x"), ("d6", "document", "Notes", [], [], [], "s", "a sql injection note"),
        ("d7", "document", "needle", [], [], [], "s", "hay"), ("d8", "document", "hay", [], [], [], "s", "needle in hay hay hay"), ("t2", "document", "same", [], [], [], "s", "tiephrase"), ("t1", "document", "same", [], [], [], "s", "tiephrase"),
    ]
    return spark.createDataFrame(rows, DOC)


def ask(spark, text, k=10, kind=None):
    q = spark.createDataFrame([(1, text)], "query_id int, query string").withColumn("normalized", R.normalize_query(F.col("query")))
    return [(r.doc_id, r.tier, r.score) for r in R.search_keyword(q, docs(spark), k, kind).orderBy("rank").collect()]


def test_query_forms(spark):
    cases = {"CWE-89": "CWE-89", "cwe89": "CWE-89", "cwe 89": "CWE-89", "cwe_89": "CWE-89", "A01-2025": "A01:2025", "a01 2025": "A01:2025", "a1:2025": "A01:2025", "ＳＱＬ  Injection ": "SQL Injection"}
    rows = spark.createDataFrame(list(cases.items()), "q string, want string").select("want", R.normalize_query(F.col("q")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    q = spark.createDataFrame([(1, "XSS, CSRF or IDOR"), (2, "SQL Injection"), (3, "the"), (4, "!!")], "query_id int, query string")
    got = {}
    for r in R.parse_query(q).collect():
        got.setdefault(r.query_id, {}).setdefault(r.clause, []).append(r.phrase)
    assert [sorted(v) for v in got[1].values()] == [["xss"], ["csrf"], ["idor"]] and sorted(got[2][0]) == ["injection", "sql"] and got[3] == {0: ["the"]} and 4 not in got


def test_tiers_and_ties(spark):
    assert [(d, t) for d, t, _ in ask(spark, "CWE89")] == [("d1", 0), ("d2", 1), ("d3", 2)]
    assert [(d, t) for d, t, _ in ask(spark, "SQL Injection")][:2] == [("d4", 1), ("d5", 2)] and {d for d, _, _ in ask(spark, "SQL Injection")} == {"d1", "d4", "d5", "d6"}
    got = ask(spark, "needle")
    assert [d for d, _, _ in got] == ["d7", "d8"] and got[0][2] < got[1][2] < 0
    assert [d for d, _, _ in ask(spark, "tiephrase")] == ["t1", "t2"]
    assert [d for d, _, _ in ask(spark, "cwe89", kind="cwe")] == ["d1"] and len(ask(spark, "SQL Injection", 1)) == 1
    with pytest.raises(ValueError):
        ask(spark, "x", 51)


def test_index_folder(spark, tmp_path):
    d = docs(spark)
    R.write_index(d, str(tmp_path / "ix"), 8)
    index = R.read_index(spark, str(tmp_path / "ix"))
    postings, lengths = R.build_index(d)
    assert index[0].count() == postings.count() and sorted(index[1].collect()) == sorted(lengths.collect())
    q = spark.createDataFrame([(1, "needle"), (2, "sql injection"), (3, "nowhere")], "query_id int, normalized string")
    one, two = (R.search_keyword(q, d, 5, index=i).orderBy("query_id", "rank").collect() for i in (None, index))
    assert one == two and len(one) > 3


def test_dense_parents(spark):
    chunks = spark.createDataFrame([("c1", "A", "t", [1.0, 0.0]), ("c2", "A", "t", [0.9, 0.1]), ("c3", "A", "t", [0.8, 0.2]), ("c4", "B", "t", [0.5, 0.5]), ("c5", "C", "u", [1.0, 0.0]), ("c6", "Z", "t", None)], "chunk_id string, parent_doc_id string, doc_type string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, vector array<float>")
    for size in (1, 1 << 20):
        got = [(r.query_id, r.doc_id, r.chunk_id) for r in R.search_dense(q, chunks, 2, "t", size).orderBy("query_id", "rank").collect()]
        assert got == [(1, "A", "c1"), (1, "B", "c4"), (2, "B", "c4"), (2, "A", "c3")]


def test_fusion_and_diversity(spark):
    ranks = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id int, doc_id string, rank int")
    fused = [r.doc_id for r in R.rrf(ranks("abcd"), ranks("bdea")).orderBy("rank").collect()]
    assert fused[0] == "b" and "a" in fused[:3] and sorted(fused) == list("abcde")
    v = [np.array([1.0, 0, 0]), np.array([1.0, 0, 0]), np.array([0.8, 0.6, 0])]
    assert R.diversify(np.array([1.0, 0.9, 0.5]), v, np.array([1.0, 0, 0]), 2, 0.3) == [0, 2]
    assert R.diversify(np.array([1.0, 1.0]), [None, None], None, 5, 0.7) == [0, 1]
    rows = spark.createDataFrame([(1, i + 1, n, s, x.tolist()) for i, (n, s, x) in enumerate(zip("ABC", (1.0, 0.9, 0.5), v, strict=True))], "query_id int, rank int, doc_id string, score double, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vector array<double>")
    assert [r.doc_id for r in R.mmr(rows, q, 2, 0.3).orderBy("rank").collect()] == ["A", "C"]


def test_hybrid(spark):
    d = docs(spark)
    chunks = d.select(F.concat("doc_id", F.lit("#1")).alias("chunk_id"), F.col("doc_id").alias("parent_doc_id"), "doc_type", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    q = spark.createDataFrame([(1, "needle", "needle", [1.0, 0.5])], "query_id int, query string, normalized string, vector array<float>")
    got = R.search_hybrid(q, d, chunks, 3).orderBy("rank").collect()
    assert len(got) == 3 and [r.rank for r in got] == [1, 2, 3] and all(r.title for r in got)


def test_snippet_and_checks(spark):
    text = " ".join(f"w{i}" for i in range(60)) + " Needle, needle end"
    s = spark.createDataFrame([(text,)], "t string").select(R.snippet(F.col("t"), F.array(F.lit("needle"))).alias("s")).first().s
    assert "<mark>Needle,</mark> <mark>needle</mark> end" in s and s.startswith(" … ") and not s.endswith(" … ")
    q = spark.createDataFrame([("x", 10, None, "keyword"), (" ", 10, None, "keyword"), ("x", 0, None, "keyword"), ("x", 51, None, "dense"), ("x", 5, "nope", "dense"), ("x", 5, "cwe", "odd")], "query string, top_k int, doc_type string, mode string")
    good, bad = R.validate_queries(q)
    assert good.count() == 1 and sorted(r.error for r in bad.collect()) == ["doc_type", "mode", "query", "top_k", "top_k"]


def test_hybrid_shows_what_each_side_found(spark):
    """Vectors are those of the best chunk, and only of what the dense side found; candidates are not cut at 50."""
    d = spark.createDataFrame([(f"D{i:03d}", "document", f"title {i}", [], [], [], f"sum {i}", "needle " * (1 + i % 3)) for i in range(120)], "doc_id string, doc_type string, title string, aliases array<string>, identifiers array<string>, tags array<string>, summary string, content string")
    chunks = spark.createDataFrame([(f"c{i}", f"D{i // 2:03d}", "document", f"s{i}", f"text {i}" if i % 4 else "", [float(i == 7), 1.0]) for i in range(8)], "chunk_id string, parent_doc_id string, doc_type string, section string, content string, vector array<double>")
    q = spark.createDataFrame([(1, "needle", "needle", [1.0, 0.0]), (2, "needle", "needle", None), (3, "absent", "absent", [1.0, 0.0]), (4, "absent", "absent", None)], "query_id int, query string, normalized string, vector array<double>")
    got = R.search_hybrid(q, d, chunks, 30).collect()
    by = {k: {r.doc_id: r for r in got if r.query_id == k} for k in (1, 2, 3, 4)}
    assert (len(by[1]), len(by[2]), len(by[3]), len(by[4])) == (30, 30, 4, 0)
    assert by[3]["D003"].rank == 1 and by[3]["D003"].snippet == "text 7" and by[3]["D003"].matched_section == "s7"
    assert all(r.snippet == f"sum {int(r.doc_id[1:])}" and r.matched_section == "" for r in by[2].values())
    assert by[3]["D000"].snippet in ("sum 0", "text 1") and by[2][min(by[2])].title.startswith("title")
    # 120 candidates of words: beyond the 50 that a user may ask for
    assert len({r.doc_id for r in R.search_hybrid(q.where("query_id = 2"), d, chunks, 100).collect()}) == 100
    with pytest.raises(ValueError):
        R.search_keyword(q, d, 51)
