import pytest
from pyspark.sql import functions as F

from lodeframe.functions import scalars as X


def value(spark, column, **inputs):
    frame = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {t}" for k, t in zip(inputs, ["array<string>" if isinstance(v, list) else "string" for v in inputs.values()], strict=True)))
    return frame.select(column.alias("v")).first().v


def test_severity_and_confidence(spark):
    cases = [
        ("semgrep", "INFO", "info"), ("semgrep", "error", "high"), ("zap", "1", "low"), ("zap", "2", "medium"), ("codeql", "9.0", "critical"), ("codeql", "8.99", "high"), ("codeql", "6.9", "medium"),
        ("codeql", "0.1", "low"), ("codeql", "", "unknown"), ("codeql", "-1", "unknown"), ("codeql", "1e-3", "unknown"), ("codeql", "0", "info"), ("codeql", "1_0", "critical"),
        ("codeql", "nan", "info"), ("codeql", "inf", "unknown"), ("codeql", "9.5f", "unknown"), ("codeql", "11", "unknown"), (" ZAP ", " 4 ", "critical"), ("other", "low", "low"),
    ]
    rows = spark.createDataFrame(cases, "tool string, native string, want string").select("*", X.severity(F.col("tool"), F.col("native")).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []
    cases = [("semgrep", "MEDIUM", "medium"), ("semgrep", "odd", "unknown"), ("zap", "1", "low"), ("zap", "3", "high"), ("codeql", "low", "low"), ("codeql", "", "unknown"), ("x", "false positive", "false_positive")]
    rows = spark.createDataFrame(cases, "tool string, native string, want string").select("*", X.confidence(F.col("tool"), F.col("native")).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []


def test_taxonomies(spark):
    assert value(spark, X.cwe_ids(F.col("a")), a=["cwe-0352 (forged requests)", "external/cwe/cwe-022", "CWE-22", None, "CWE-0", "-7"]) == ["CWE-22", "CWE-352"]
    assert value(spark, X.wasc_ids(F.col("a")), a=["WASC-008", "41", "-1"]) == ["WASC-8", "WASC-41"]
    assert value(spark, X.owasp_categories(F.col("a")), a=["A10:2021 something", "none", "A02:2017 - other"]) == ["OWASP-A02:2017", "OWASP-A10:2021"]
    assert value(spark, X.cwe_ids(F.col("a")), a=["CWE-1000", "CWE-9"]) == ["CWE-9", "CWE-1000"]


@pytest.mark.parametrize(("raw", "want"), [("/home/ci/target-app/books/api/v2/cart.py", "api/v2/cart.py"), ("api/./cart.py", "api/cart.py"), (None, None), ("x/../../y.py", None), ("a\\b//./c", "a/b/c"), ("file:///x/target-app/app/a%20b+c.ts", "a b+c.ts"), ("  ", None)])
def test_paths(spark, raw, want):
    assert value(spark, X.code_path(F.col("p")), p=raw) == want


def test_urls(spark):
    assert value(spark, X.endpoint(F.col("u")), u="https://books.test:8080/cart/items.json?page=2#top") == "/cart/items.json"
    assert value(spark, X.endpoint(F.col("u")), u="https://books.test") == "/" and value(spark, X.endpoint(F.col("u")), u=" ") is None
    assert value(spark, X.urls(F.col("u")), u="see https://docs.test/b), <i>https://docs.test/b</i>") == ["https://docs.test/b"]
    for uri, kept in (
        ("http://books.test:8080/", True), ("http://BOOKS.test:8080/cart?sort=up", True), ("http://books.test.other.test:8080/a?key=k#f", False),
        ("http://books.test:8080@other.test/a?key=k", False), ("https://books.test:8080/a", False), ("http://books.test/a", False), ("http://x:99999/", False),
    ):
        origin = value(spark, X.http_origin(F.col("u")), u=uri)
        assert (origin is not None and tuple(origin) == ("http", "books.test", 8080)) == kept
    clean = lambda u: value(spark, X.sanitized_uri(F.col("u")), u=u)
    assert clean("https://jo:pw@other.test:9443/a/b?key=k&none=&key=again#part") == "https://other.test:9443/a/b?key&none"
    assert clean("http://books.test:8080@other.test/a?key=k") == "http://other.test/a?key" and clean("nope") == "<invalid-uri>"
    assert clean("http://[::1]:8080") == "http://[::1]:8080/"


def test_canonical_hash(spark):
    import hashlib

    fields = {"b": F.lit(2), "a": F.lit("x\x1f/é"), "n": F.lit(None).cast("string")}
    want = '{"a":"x\\u001f/é","b":2,"n":null}'
    assert value(spark, X.canonical_json(fields), d="x") == want
    assert value(spark, X.canonical_sha256("fp", "v1", fields), d="x") == "fp_sha256:v1:" + hashlib.sha256(want.encode()).hexdigest()


def test_names(spark):
    assert value(spark, X.unique_casefold(F.col("a")), a=["Ab", "aB ", "", None, "c"]) == ["Ab", "c"]
    assert value(spark, X.slug(F.col("s")), s="--A b/C!") == "a-b-c"
