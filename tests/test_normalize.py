import json
from pathlib import Path

from pyspark.sql import functions as F

from lodeframe import schemas as S
from lodeframe.operators import correlate as C
from lodeframe.operators import normalize as N
from lodeframe.sources import files
from lodeframe.storage import checkpoint_folder, stored

META = {"run_id": "run_7", "scanned_at": "2025-02-03T04:05:06Z", "target": {"name": "books", "version": "3.2", "base_url": "http://books.test:8080"}}
SEMGREP = {
    "version": "1.1", "results": [{
        "check_id": "rule.a", "path": "./api/orders.py", "start": {"line": 3, "col": 2}, "end": {"line": 3, "col": 9},
        "extra": {"lines": "    run(query)", "message": "m", "severity": "ERROR", "metadata": {"cwe": ["CWE-89: x"], "owasp": "A03:2021", "confidence": "HIGH", "vulnerability_class": ["Second", "First"], "references": ["https://e.test/a."]},
                  "metavars": {"$QUERY": {"abstract_content": "select"}, "$CONN": {}}, "dataflow_trace": {"taint_source": ["CliLoc", [{"path": "a.ts", "start": {"line": 1, "col": 1}}, "req.q"]], "intermediate_vars": [{}, {"location": {"path": "b.ts", "start": {"line": 2}}, "content": "mid"}], "taint_sink": ["CliLoc", [{"path": "c.ts", "start": {"line": 3}}, "sink"]]}},
    }],
}
URIS = [
    "http://books.test:8080/", "http://books.test:8080/catalog?sort=up", "http://books.test.other.test:8080/a?key=k#f", "http://books.test:8080@other.test/b?pin=1",
    "https://books.test:8080/a", "http://books.test/a", "https://jo:pw@other.test:9443/c?key=k&none=&key=again#f",
]
ZAP = {"site": {"alerts": [{"pluginid": "10", "alertRef": "10-1", "riskcode": "3", "confidence": "2", "name": "SQL &amp; more", "desc": "<p>Bad &eacute;</p>", "cweid": "89", "wascid": "19", "instances": [{"uri": u, "method": "get", "param": "q"} for u in URIS]}, {"pluginid": "11"}]}}
SARIF = {
    "version": "2.1.0", "runs": [{
        "tool": {"driver": {"rules": [{"id": "r0", "shortDescription": {"text": "R0"}, "properties": {"security-severity": "9.8", "precision": "very-high", "tags": ["external/cwe/cwe-079"]}}, {"id": "r1", "fullDescription": {"text": "full"}}, {"id": "r1", "fullDescription": {"text": "last"}}]}},
        "artifacts": [{"location": {"uri": "x.ts"}}], "results": [
            {"ruleId": "r0", "ruleIndex": 0, "message": {"text": "msg"}, "locations": [{"physicalLocation": {"artifactLocation": {"index": 0}, "region": {"startLine": 4, "snippet": {"text": "s"}}}}]},
            {"ruleId": "r1", "ruleIndex": 0, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "y.ts"}, "region": {"startLine": 5, "endLine": 6}}}], "partialFingerprints": {"primaryLocationLineHash": "h"}},
            {"ruleId": "gone", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "z.ts"}, "region": {"startLine": 7}}}]},
        ],
    }],
}


def reports(spark, *docs):
    rows = [(f"{tool}/{i}", tool, json.dumps(d) if d is not None else None, json.dumps(META)) for i, (tool, d) in enumerate(docs)]
    return spark.createDataFrame(rows, "report_path string, tool string, doc string, m string").withColumn("meta", F.from_json("m", S.SCAN_META)).drop("m")


def test_three_formats(spark):
    findings, summary = N.normalize_all(reports(spark, ("semgrep", SEMGREP), ("zap", ZAP), ("codeql", SARIF)))
    rows = findings.collect()
    by = {}
    for r in rows:
        by.setdefault(r.tool.name, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"semgrep": 1, "zap": 2, "codeql": 3}
    s = by["semgrep"][0]
    assert (s.severity, s.confidence, s.title, s.cwe_ids, s.owasp_categories, s.references) == ("high", "high", "First", ["CWE-89"], ["OWASP-A03:2021"], ["https://e.test/a"])
    assert s.location.path == "api/orders.py" and s.evidence.quality == "direct" and [m.name for m in s.evidence.matched_contents] == ["$CONN", "$QUERY"]
    flow = s.data_flow[0]
    assert (flow.source.content, [n.content for n in flow.steps], flow.sink.content, flow.sink.step_index) == ("req.q", ["mid"], "sink", 2)
    z = next(r for r in by["zap"] if r.location.endpoint == "/catalog")
    assert z.title == "SQL &amp; more" and z.description == "Bad é" and z.wasc_ids == ["WASC-19"] and z.evidence.request_excerpt == "GET http://books.test:8080/catalog?sort=up (param: q)"
    c = {r.rule.id: r for r in by["codeql"]}
    assert c["r0"].location.path == "x.ts" and c["r0"].severity == "critical" and c["r0"].cwe_ids == ["CWE-79"] and c["r0"].evidence.quality == "direct" and c["r0"].location.end_line == 4
    assert c["r1"].description == "last" and c["gone"].description is None and c["r1"].evidence.quality == "none"
    assert {r.report_path: (r.status, r.raw_count, r.written_count) for r in summary.collect()} == {"semgrep/0": ("success", 1, 1), "zap/1": ("partial", 7, 2), "codeql/2": ("success", 3, 3)}
    good, bad = N.validate(findings, N.finding_checks())
    assert good.count() == 6 and bad.count() == 0


def test_one_unfit_row_fails_its_report_only(spark):
    broken = json.loads(json.dumps(SEMGREP))
    broken["results"].append({"check_id": "x", "path": "y.ts", "start": {"line": 0}})
    findings, summary = N.normalize_all(reports(spark, ("semgrep", broken), ("semgrep", SEMGREP), ("codeql", None)))
    assert findings.count() == 1
    assert [r.status for r in summary.orderBy("report_path").collect()] == ["skipped", "failed", "success"]


def test_scope(spark):
    rows = spark.createDataFrame([(u,) for u in URIS], "uri string")
    kept, out = N.filter_scope(rows, F.lit("http://books.test:8080"))
    assert kept.count() == 2
    r = N.rejected_summary(out.withColumn("report", F.lit(1)), ["report"]).first()
    assert r.uris == ["http://books.test.other.test:8080/a?key", "http://books.test/a", "http://other.test/b?pin", "https://books.test:8080/a", "https://other.test:9443/c?key&none"]
    many = spark.range(101).select(F.lit(1).alias("report"), F.concat(F.lit("http://x"), "id", F.lit(".test/")).alias("uri"))
    r = N.rejected_summary(many, ["report"]).first()
    assert (r.external_count, r.unique_count, len(r.uris), r.truncated) == (101, 101, 100, True)
    for target in (None, " ", "books.test", "ws://books.test:8080"):
        assert N.filter_scope(rows, F.lit(target).cast("string"))[0].count() == 0


def test_first_findings(spark):
    """Of findings that are equal in all but their place the first, numbered among all: groups and members are those of all."""
    alert = lambda k: {"pluginid": str(k % 3), "riskcode": "1", "name": f"n{k % 3}", "cweid": str(k % 5), "instances": [{"uri": f"http://t:3000/p/{i % 2}" if i < 5 else "http://other/x", "method": "get", "param": "q"} for i in range(6)]}
    doc = lambda r: json.dumps({"site": [{"alerts": [alert(k) for k in range(12)]}, {"alerts": [{} if r == 2 else alert(r)]}]})
    meta = '{"run_id": "r", "scanned_at": "2026-01-01T00:00:00Z", "target": {"name": "s", "base_url": "http://t:3000"}}'
    bad = json.dumps({"site": [{"alerts": [{"instances": [{"uri": "http://t:3000/"}]}]}]})
    texts = [(f"zap/{r}", "zap", doc(r), meta) for r in range(4)] + [("zap/bad", "zap", bad, meta)]
    reports = spark.createDataFrame(texts, "report_path string, tool string, doc string, meta string").withColumn("meta", F.from_json("meta", S.SCAN_META))
    findings = N.normalize_all(reports)[0]
    every = C.flat(C.indexed(findings, "finding_id"))
    first = C.flat(N.first_findings(reports))
    rows = lambda df: sorted(map(str, df.collect()))
    assert every.count() == 255 and first.count() < 40 and not first.exceptAll(every).count()
    for old, new in zip(C.build_groups(every), C.build_groups(first), strict=True):
        assert rows(new.select(old.columns)) == rows(old)
    # beyond what may be sent, ids are sorted; and there may be nothing at all
    ids, some = findings.select("finding_id"), first.select("finding_id")
    few, many = N.ranked_among(some, ids, "finding_id"), N.ranked_among(some, ids, "finding_id", 1)
    assert rows(few.select("finding_id", "row_idx")) == rows(many.select("finding_id", "row_idx")) == rows(first.select("finding_id", "row_idx"))
    assert N.first_findings(reports.where("false")).count() == 0


def test_source_context(spark):
    files_ = spark.createDataFrame([("a.ts", "\n".join(f"l{i}" for i in range(1, 15)))], "path string, text string")
    rows = spark.createDataFrame([("code", "a.ts", 7, 8), ("code", "a.ts", 1, 1), ("code", "a.ts", 14, None), ("code", "no.ts", 3, 3)], "kind string, path string, start_line int, end_line int")
    got = {(r.path, r.start_line): r for r in N.attach_source_context(rows, N.source_lines(files_)).collect()}
    r = got["a.ts", 7]
    assert [x.line for x in r.context_before] == [2, 3, 4, 5, 6] and [x.line for x in r.context_after] == [9, 10, 11, 12, 13] and r.source_text == "l7\nl8"
    assert got["a.ts", 1].context_before == [] and got["a.ts", 14].context_after == [] and got["no.ts", 3].source_text is None


def test_source_context_of_many_findings(spark):
    """Windows over the ends of blocks, equal rows, rows that ask for nothing; what findings ask for is sent to no task whole."""
    text = "\n".join(f"l{i}" for i in range(1, 301))
    files_ = spark.createDataFrame([("a.ts", text)], "path string, text string")
    asked = [("code", "a.ts", i, i + n) for i in range(1, 310) for n in (0, 2, 150)] + [("code", "a.ts", 64, 64)] * 3 + [("code", "a.ts", 9, 7), ("http", None, None, None), ("code", None, 3, 3), ("code", "a.ts", 0, 0)]
    rows = spark.createDataFrame(asked, "kind string, path string, start_line int, end_line int")
    out = N.attach_source_context(rows, N.source_lines(files_))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()

    def expected(kind, path, start, end):
        if kind != "code" or path is None or start < 1:
            return (kind, path, start, end, None, None, None)
        window = [x for x in range(max(1, start - 5), max(start, end) + 6) if x <= 300]
        if not window:
            return (kind, path, start, end, None, None, None)
        return (kind, path, start, end, tuple(x for x in window if x < start), tuple(x for x in window if x > end), "\n".join(f"l{x}" for x in window if start <= x <= end))

    lines = lambda xs: None if xs is None else tuple(x.line for x in xs)
    got = [(r.kind, r.path, r.start_line, r.end_line, lines(r.context_before), lines(r.context_after), r.source_text) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*x)) for x in asked)


def test_scope_policy(spark):
    includes = ["api/**", "jobs/*.py", "web/src/**"]
    excludes = ["**/*_test.py", "vendor/", "web/src/generated/"]
    ok = ["api/orders.py", "api/v2/deep/cart.py", "jobs/nightly.py", "web/src/app/main.ts"]
    bad = ["docs/index.md", "api/orders_test.py", "jobs/sub/x.py", "vendor/lib/a.py", "web/src/generated/g.ts", "web/build/main.js"]
    kept, _ = N.scope_policy(spark.createDataFrame([(p,) for p in ok + bad], "path string"), includes, excludes)
    assert sorted(r.path for r in kept.collect()) == sorted(ok)


def test_sources_round_trip(spark, tmp_path):
    for tool, name, doc in (("semgrep", "semgrep.json", SEMGREP), ("zap", "zap.json", [1]), ("codeql", "codeql.sarif", SARIF)):
        (tmp_path / "raw" / tool).mkdir(parents=True)
        (tmp_path / "raw" / tool / name).write_text(json.dumps(doc))
        if tool != "codeql":
            (tmp_path / "raw" / tool / "scan-metadata.json").write_text(json.dumps(META))
    got = {r.tool: r for r in files.read_scan_reports(spark, str(tmp_path / "raw")).collect()}
    assert got["semgrep"].doc and got["semgrep"].meta.target.name == "books" and got["zap"].doc is None and got["codeql"].meta is None
    findings, _ = N.normalize_all(files.read_scan_reports(spark, str(tmp_path / "raw")))
    out = files.write_findings(findings, str(tmp_path), "t1")
    back = files.read_findings_jsonl(spark, out)
    assert back.count() == 1 and back.first().fingerprint == findings.first().fingerprint
    (tmp_path / "bad.jsonl").write_text(json.dumps({"fingerprint": "a", "finding_id": "b"}) + "\n\n{oops\n" + json.dumps({"fingerprint": "a"}) + "\n[1]\n")
    good, bad = files.read_findings_jsonl(spark, str(tmp_path / "bad.jsonl"), "quarantine")
    assert good.count() == 1 and bad.count() == 3
    files.write_findings_parquet(findings, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("tool_name = 'semgrep'").count() == 1


def test_csv_and_canonical_set(spark, tmp_path):
    import pytest

    (tmp_path / "a.csv").write_text('﻿CWE-ID,Name\n1,"two\nlines"\n2,x\n2,y\n0,z\n', encoding="utf-8")
    rows, errors = files.read_csv_checked(spark, str(tmp_path / "a.csv"), ["CWE-ID", "Status"], "CWE-ID")
    assert rows.count() == 4 and rows.where("Name = 'two\nlines'").count() == 1
    assert sorted(r.error for r in errors.collect()) == ["duplicate id", "id", "missing column"]
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "k long, t string")
    first = files.write_canonical(docs, "k", str(tmp_path / "c1"))
    second = files.write_canonical(docs.repartition(7), "k", str(tmp_path / "c2"))
    assert first == second and first["document_count"] == 20
    assert files.read_canonical(spark, str(tmp_path / "c1"), "k long, t string", "k").count() == 20
    docs.limit(3).select("k", "t").write.mode("overwrite").json(str(tmp_path / "c1" / "documents"))
    with pytest.raises(ValueError):
        files.read_canonical(spark, str(tmp_path / "c1"), "k long, t string", "k")


def _reports(spark):
    """Reports of all three tools, with a site and with sites, an alert without instances, results that are no objects."""
    result = {"check_id": "r1", "path": "src/a.ts", "start": {"line": 3}, "extra": {"severity": "ERROR", "metadata": {"cwe": ["CWE-79"]}}}
    semgrep = {"version": "1", "results": [result, result | {"path": "src/}b{.ts", "extra": {"message": 'say "}" \\'}}, None], "errors": []}
    alert = {"pluginid": "7", "name": "A & B", "desc": "<p>x &amp; y</p>", "instances": [{"uri": "http://t/1", "method": "get"}, {"uri": "http://t/2", "evidence": "[}]"}]}
    zap = [{"site": [{"alerts": [alert, {"pluginid": "8"}]}, {"alerts": []}, {"alerts": [alert]}]}, {"site": {"alerts": [alert | {"pluginid": "9"}]}}]
    at = lambda line: [{"physicalLocation": {"artifactLocation": {"index": 0}, "region": {"startLine": line}}}]
    rules = [{"id": "q", "shortDescription": {"text": "Q"}}, {"id": "p"}, {"id": "p", "shortDescription": {"text": "P"}}]
    run = {"tool": {"driver": {"rules": rules}}, "artifacts": [{"location": {"uri": "lib/a.ts"}}], "results": [{"ruleId": "q", "ruleIndex": 0, "locations": at(2)}, {"ruleId": "p", "ruleIndex": 0, "locations": at(5)}, {"ruleId": "z", "locations": at(7)}]}
    docs = [("semgrep", "s", semgrep), ("zap", "z0", zap[0]), ("zap", "z1", zap[1]), ("codeql", "c", {"version": "2.1.0", "runs": [run, run]}), ("codeql", "old", {"version": "2.0.0", "runs": [run]})]
    return spark.createDataFrame([(p, t, json.dumps(d)) for t, p, d in docs], "report_path string, tool string, doc string")


def test_parts_give_the_rows_of_whole_documents(spark):
    reports = _reports(spark)
    text = lambda df: sorted(str(r) for r in df.select("report_path", "tool", *N.RAW).collect())
    whole = [x for flatten in N.TOOLS.values() for x in text(flatten(reports))]
    parts = text(N.flatten_parts(N.document_parts(reports)))
    assert parts == sorted(whole) and len(parts) == 3 + 4 + 2 + 6


def test_reports_in_parts_are_normalised_as_whole_ones(spark):
    meta = F.from_json(F.lit('{"run_id": "r", "scanned_at": "2026-01-01T00:00:00Z", "target": {"name": "shop", "base_url": "http://t"}}'), N.S.SCAN_META)
    reports = _reports(spark).withColumn("meta", meta)
    more = spark.createDataFrame([("broken", "zap", '{"site": ['), ("odd", "semgrep", '{"results": [{"a" 1}]}')], "report_path string, tool string, doc string").withColumn("meta", meta)
    cut = N.document_parts(reports.unionByName(more))
    known = reports.unionByName(more).select("report_path", "tool", (F.col("report_path") != "broken").alias("fit"), "meta")
    a, b = N.normalize_all(reports), N.normalize_parts(cut, known)
    assert sorted(map(str, a[0].collect())) == sorted(map(str, b[0].collect()))
    status = {r.report_path: r.status for r in b[1].collect()}
    assert {r.report_path: r.status for r in a[1].collect()} | {"broken": "skipped", "odd": "skipped"} == status
    assert status["s"] == "failed" and status["z0"] == "success"
    sources = N.source_pointers(b[0])
    assert N.check_provenance(sources, cut).count() == 0
    rules = sorted(r.pointer for r in sources.where("report_path = 'c' AND pointer LIKE '%rules%'").collect())
    assert rules == [f"/runs/{k}/tool/driver/rules/{i}" for k in (0, 1) for i in (0, 2)]


def test_pointers_are_resolved_in_the_raw_text(spark):
    doc = {"version": "1", "results": [{"a/b": {"m~n": [1, None]}, "": {"x": 0}, "it's \"q\"": 1, "n": 5}, "text", None], "paths": {"0": ["p"], "scanned": []}}
    parts = N.document_parts(spark.createDataFrame([("r", "semgrep", json.dumps(doc))], "report_path string, tool string, doc string"))
    good = ["", "/version", "/results", "/results/0", "/results/2", "/results/0/a~1b/m~0n/1", "/results/0//x", "/results/0/it's \"q\"", "/paths/0/0", "/paths/scanned"]
    bad = [None, "results", "/", "/results/3", "/results/00", "/results/-", "/results/0/a/b", "/results/0/a~1b/m~0n/2", "/results/0/a~1b/m~0n/01", "/results/0/n/0", "/results/1/0", "/results/2/x", "/paths/scanned/0", "/results/1e0", "/other"]
    asked = spark.createDataFrame([("r", p) for p in good + bad] + [("absent", "/results/0")], "report_path string, pointer string")
    lost = {(r.report_path, r.pointer) for r in N.check_provenance(asked, parts).collect()}
    assert lost == {("r", p) for p in bad} | {("absent", "/results/0")}


def test_text_lines(spark, tmp_path):
    """A tree by its lines, in byte ranges: what whole texts hold, however the files are cut; blank files are left out."""
    texts = {"a/x 1+.txt": "one\n\n  two\r\nthree é\n" * 400, "a/b/y.txt": "no end", "blank.txt": " \n\t\n", "empty.txt": "", "z.md": "other\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = files.read_text_lines(spark, str(tmp_path), "*.txt")
        assert lines.rdd.getNumPartitions() > 4  # more than there are files
        got = sorted((r.path.rsplit("/", 1)[1], r.value) for r in lines.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = files.read_text_tree(spark, str(tmp_path), "*.txt").collect()
    assert got == sorted((r.path.rsplit("/", 1)[1], line) for r in whole for line in r.text.removesuffix("\n").split("\n"))


def test_compressed_findings_and_tables(spark, tmp_path):
    """Findings as compressed lines are read in the same way; what is stored takes a small part of what a checkpoint takes."""
    rows = spark.range(0, 20000, 1, 2).select(F.sha2((F.col("id") % 50).cast("string"), 256).alias("fingerprint"), F.concat(F.lit("fnd"), "id").alias("finding_id"))
    size = lambda at: sum(f.stat().st_size for f in Path(at).rglob("*") if f.is_file())
    plain, packed = files.write_findings(rows, str(tmp_path), "a"), files.write_findings(rows, str(tmp_path), "b", "gzip")
    kind = "fingerprint string, finding_id string"
    assert files.read_findings_jsonl(spark, packed, schema=kind).exceptAll(files.read_findings_jsonl(spark, plain, schema=kind)).count() == 0
    assert files.read_findings_jsonl(spark, packed, schema=kind).count() == 20000 and size(packed) * 4 < size(plain)
    at = checkpoint_folder(spark).removeprefix("file:")
    before = size(at)
    table = stored(rows)
    assert table.exceptAll(rows).count() == 0 and table.count() == 20000 and (size(at) - before) * 4 < size(plain)
