"""Queries on findings: normalisation, correlation, groups."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import scalars as X
from lodeframe.operators import correlate as C
from lodeframe.operators import evaluate as E
from lodeframe.operators import groups as A
from lodeframe.operators import normalize as N
from lodeframe.plans.adapters import RAW_FINDINGS, SMALL_FINDINGS, load, shaped
from lodeframe.sources import files as S
from lodeframe.storage import checkpoint_folder, checkpointed, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}
_RAW = f"WITH raw AS ({RAW_FINDINGS})"
_SMALL = f"WITH RECURSIVE small AS ({SMALL_FINDINGS})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return shaped(spark, d, RAW_FINDINGS)


def small_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = shaped(spark, d, SMALL_FINDINGS)
    return rows.withColumns({"cwe_ids": F.array("cwe"), "flow": F.when(F.col("node").isNotNull(), F.array("node"))}).drop("cwe", "node")


_SEVERITY = """CASE tool WHEN 'semgrep' THEN CASE trim(native_severity) WHEN 'ERROR' THEN 'high' WHEN 'Warning' THEN 'medium' WHEN 'INFO' THEN 'info' ELSE 'unknown' END
  WHEN 'zap' THEN CASE native_severity WHEN '0' THEN 'info' WHEN '1' THEN 'low' WHEN '2' THEN 'medium' WHEN '3' THEN 'high' WHEN '4' THEN 'critical' ELSE 'unknown' END
  ELSE CASE WHEN CAST(native_severity AS DOUBLE) > 10 THEN 'unknown' WHEN CAST(native_severity AS DOUBLE) >= 9 THEN 'critical' WHEN CAST(native_severity AS DOUBLE) >= 7 THEN 'high'
    WHEN CAST(native_severity AS DOUBLE) >= 4 THEN 'medium' WHEN CAST(native_severity AS DOUBLE) > 0 THEN 'low' ELSE 'info' END END"""
_CONFIDENCE = """CASE tool WHEN 'semgrep' THEN lower(native_confidence) WHEN 'codeql' THEN CASE native_confidence WHEN 'very-high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'unknown' END
  ELSE CASE native_confidence WHEN '0' THEN 'false_positive' WHEN '1' THEN 'low' WHEN '2' THEN 'medium' WHEN '3' THEN 'high' WHEN '4' THEN 'confirmed' ELSE 'unknown' END END"""


@query(f"{_RAW} SELECT tool, {_SEVERITY} AS severity, count(*) AS n FROM raw GROUP BY 1, 2")
def n7_severity(spark, d):
    return raw(spark, d).groupBy("tool", X.severity(F.col("tool"), F.col("native_severity")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"{_RAW} SELECT tool, {_CONFIDENCE} AS confidence, count(*) AS n FROM raw GROUP BY 1, 2")
def n8_confidence(spark, d):
    return raw(spark, d).groupBy("tool", X.confidence(F.col("tool"), F.col("native_confidence")).alias("confidence")).agg(F.count("*").alias("n"))


@query(f"{_RAW} SELECT row_idx, CASE WHEN cwe_text = 'none' THEN 'CWE-77' WHEN CAST(substr(cwe_text, 6) AS INT) < 77 THEN 'CWE-' || substr(cwe_text, 6) || ',CWE-77' END AS cwe, 'OWASP-A03:2021,OWASP-A0' || CAST(row_idx % 9 + 1 AS STRING) || ':2025' AS owasp FROM raw")
def n9_taxonomies(spark, d):
    rows = raw(spark, d)
    cwe = X.cwe_ids(F.array("cwe_text", F.lit("external/cwe/cwe-077"), F.lit("-5"), F.lit(None).cast("string")))
    owasp = X.owasp_categories(F.array(F.concat(F.lit("a0"), F.col("row_idx") % 9 + 1, F.lit(" : 2025 x")), F.lit("A3_2021"), F.lit("bad")))
    return rows.select("row_idx", F.array_join(cwe, ",").alias("cwe"), F.array_join(owasp, ",").alias("owasp"))


@query(f"{_RAW} SELECT row_idx, 'src/r' || CAST(row_idx % 500 AS STRING) || '.ts' AS path, CASE WHEN row_idx % 500 = 7 THEN NULL ELSE 'lib/r' || CAST(row_idx % 500 AS STRING) || '.ts' END AS marked FROM raw")
def n6_code_path(spark, d):
    rows = raw(spark, d)
    name = F.regexp_extract("path_raw", "r([0-9]+)", 1)
    marked = F.concat(F.lit("file:///w%20x/target-app\\app/lib/"), F.when(name == "7", "../").otherwise("./"), F.lit("r"), name, F.lit(".ts"))
    return rows.select("row_idx", X.code_path(F.col("path_raw")).alias("path"), X.code_path(marked).alias("marked"))


@query(r"""SELECT page_id, regexp_extract(lower(url), '^(https?)://', 1) AS scheme, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host,
  CAST(CASE WHEN regexp_extract(url, '^https?://[^/:?#]+:([0-9]+)', 1) <> '' THEN CAST(regexp_extract(url, '^https?://[^/:?#]+:([0-9]+)', 1) AS BIGINT) WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS BIGINT) AS port,
  CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS endpoint FROM pages""")
def n12_n15_url_parts(spark, d):
    rows = load(spark, d, "pages").select("page_id", X.http_origin(F.col("url")).alias("o"), X.endpoint(F.col("url")).alias("endpoint"))
    return rows.select("page_id", "o.scheme", "o.host", F.col("o.port").cast("long").alias("port"), "endpoint")


@query(r"""SELECT page_id, regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END ||
  CASE WHEN contains(url, '?') THEN '?' || array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1]))), '&') ELSE '' END AS uri FROM pages""")
def n14_sanitized_uri(spark, d):
    return load(spark, d, "pages").select("page_id", X.sanitized_uri(F.concat(F.col("url"), F.lit(""))).alias("uri"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(url || ' see http://a.test/x. and https://b.test/y;', 'https?://[^\s<>''"\)]+'), lambda u: rtrim(u, '.,;:')))), ' ') AS urls FROM pages""")
def n11_urls(spark, d):
    text = F.concat("url", F.lit(" see http://a.test/x. and https://b.test/y;"))
    return load(spark, d, "pages").select("page_id", F.array_join(X.urls(text), " ").alias("urls"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS text FROM pages""")
def n10_plain_text(spark, d):
    return load(spark, d, "pages").select("page_id", N.plain_text(F.col("html")).alias("text"))


@query(f"""{_RAW}, t AS (SELECT row_idx % 4 AS b, CASE WHEN row_idx % 3 = 0 THEN uri ELSE 'https://u:p@x' || CAST(row_idx % 150 AS STRING) || '.test/a?b=' || CAST(row_idx AS STRING) || '&a=1#f' END AS uri FROM raw)
  SELECT CAST(b AS BIGINT) AS b, count(*) AS external_count, count(DISTINCT string_split(uri, '?')[1]) AS unique_count, count(DISTINCT string_split(uri, '?')[1]) > 100 AS truncated,
  'https://' || min(regexp_extract(uri, '@([^/]+)', 1)) || '/a?a&b' AS first_uri FROM t WHERE uri LIKE 'https%' GROUP BY b""")
def n13_scope(spark, d):
    uri = F.when(F.col("row_idx") % 3 == 0, F.col("uri")).otherwise(F.concat(F.lit("https://u:p@x"), F.col("row_idx") % 150, F.lit(".test/a?b="), F.col("row_idx"), F.lit("&a=1#f")))
    _, out = N.filter_scope(raw(spark, d).select((F.col("row_idx") % 4).alias("b"), uri.alias("uri")), F.lit("http://t:3000"))
    rows = N.rejected_summary(out, ["b"])
    return rows.select("b", "external_count", "unique_count", "truncated", F.element_at("uris", 1).alias("first_uri"))


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Raw findings in the shape that fingerprints and group keys read."""
    r = raw(spark, d)
    http = F.col("tool") == "zap"
    none = F.lit(None).cast("string")
    return r.select(
        "row_idx", "tool", "scan_type", "native_severity", "native_confidence", F.lit("shop").alias("target_name"), "rule_id", F.when(http & (F.col("row_idx") % 2 == 0), F.concat("rule_id", F.lit("-1"))).alias("rule_reference"),
        F.when(~http, X.code_path(F.col("path_raw"))).alias("path"), F.when(~http, F.col("start_line")).alias("start_line"), F.lit(None).cast("int").alias("start_column"), F.when(~http, F.col("start_line")).alias("end_line"),
        F.when(http, X.endpoint(F.col("uri"))).alias("endpoint"), F.when(http, F.lit("GET")).alias("method"), F.when(http, F.col("parameter")).alias("parameter"), X.cwe_ids(F.array("cwe_text")).alias("cwe_ids"),
        F.when((F.col("tool") == "semgrep") & (F.col("row_idx") % 2 == 0), F.concat(F.lit("nf"), F.col("row_idx") % 1000)).alias("native_fp"), F.when(F.col("row_idx") % 4 == 1, F.concat(F.lit("lh"), F.col("row_idx") % 900)).alias("line_hash"), none.alias("column_fp"),
    )


_FP = """CASE WHEN tool = 'zap' THEN '{"alert_ref":' || CASE WHEN row_idx % 2 = 0 THEN '"' || rule_id || '-1"' ELSE 'null' END || ',"endpoint":"/p/' || CAST(row_idx % 50 AS STRING) || '","method":"GET","parameter":"' || parameter || '","plugin_id":"' || rule_id || '","target":"shop","tool":"zap"}'
  WHEN tool = 'semgrep' AND row_idx % 2 = 0 THEN '{"native_fingerprint":"nf' || CAST(row_idx % 1000 AS STRING) || '","path":"' || path || '","rule_id":"' || rule_id || '","target":"shop","tool":"semgrep"}'
  WHEN tool = 'semgrep' THEN '{"path":"' || path || '","rule_id":"' || rule_id || '","start_column":null,"start_line":' || CAST(start_line AS STRING) || ',"target":"shop","tool":"semgrep"}'
  WHEN row_idx % 4 = 1 THEN '{"path":"' || path || '","primary_location_line_hash":"lh' || CAST(row_idx % 900 AS STRING) || '","rule_id":"' || rule_id || '","start_column":null,"target":"shop","tool":"codeql"}'
  ELSE '{"end_line":' || CAST(start_line AS STRING) || ',"path":"' || path || '","rule_id":"' || rule_id || '","start_column":null,"start_line":' || CAST(start_line AS STRING) || ',"target":"shop","tool":"codeql"}' END"""
_GRP = """'{"canonical_endpoint":' || CASE WHEN tool = 'zap' THEN '"/p/' || CAST(row_idx % 50 AS STRING) || '"' ELSE 'null' END || ',"cwe_ids":[' || CASE WHEN cwe_text = 'none' THEN '' ELSE '"CWE-' || substr(cwe_text, 6) || '"' END || '],"fallback_rule_id":' ||
  CASE WHEN tool <> 'zap' AND cwe_text = 'none' THEN '"' || rule_id || '"' ELSE 'null' END || ',"location":{"path":' || CASE WHEN tool = 'zap' THEN 'null,"start_line":null' ELSE '"' || path || '","start_line":' || CAST(start_line AS STRING) END || '},"method":' ||
  CASE WHEN tool = 'zap' THEN '"GET","parameter":"' || parameter || '","rule_reference":"' || rule_id || CASE WHEN row_idx % 2 = 0 THEN '-1"' ELSE '"' END ELSE 'null,"parameter":null,"rule_reference":null' END || ',"target":"shop"}'"""
_KEYED = f"{_RAW}, k AS (SELECT *, 'src/r' || CAST(row_idx % 500 AS STRING) || '.ts' AS path FROM raw), f AS (SELECT row_idx, tool, scan_type, cwe_text, 'fp_sha256:v1:' || sha256({_FP}) AS fingerprint, 'grp_sha256:v1:' || sha256({_GRP}) AS group_key FROM k)"


@query(f"{_KEYED} SELECT row_idx, fingerprint, group_key FROM f")
def n16_n17_n18_keys(spark, d):
    return keyed(spark, d).select("row_idx", N.fingerprint().alias("fingerprint"), N.group_key().alias("group_key"))


@query(f"{_KEYED} SELECT tool, count(*) AS written, count(DISTINCT fingerprint) AS fingerprints, count(*) - count(DISTINCT fingerprint) AS collisions FROM f GROUP BY tool")
def n26_summary_counts(spark, d):
    return N.summary_counts(keyed(spark, d).withColumn("fingerprint", N.fingerprint()), "tool")


@query(f"""{_RAW} SELECT tool, CASE tool WHEN 'zap' THEN CASE WHEN row_idx % 3 = 0 THEN 'direct' WHEN row_idx % 3 = 1 THEN 'inferred' ELSE 'none' END WHEN 'semgrep' THEN CASE WHEN row_idx % 2 = 0 THEN 'direct' ELSE 'none' END
  ELSE CASE WHEN row_idx % 2 = 0 THEN 'direct' WHEN row_idx % 5 = 0 THEN 'enriched' WHEN row_idx % 3 = 0 THEN 'inferred' ELSE 'none' END END AS quality, count(*) AS n FROM raw GROUP BY 1, 2""")
def n19_quality(spark, d):
    i = F.col("row_idx")
    related = F.when(i % 3 == 0, F.array(F.struct(F.lit(1).alias("id")))).otherwise(F.array().cast("array<struct<id:int>>"))
    rows = raw(spark, d).select("tool", F.when(i % 2 == 0, "x").alias("snippet"), F.when(i % 3 == 0, "x").alias("matched"), F.when(i % 3 == 1, "x").alias("note"), (i % 5 == 0).alias("has_context"), related.alias("related"), F.lit(None).cast("array<int>").alias("flow"))
    return rows.groupBy("tool", N.evidence_quality().alias("quality")).agg(F.count("*").alias("n"))


def at_rest(reports: DataFrame) -> DataFrame:
    """Derived reports, stored and spread as files are."""
    return stored(reports)


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """What reports are made of, each report's in one place, before their texts are made there."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def zap_reports(spark: SparkSession, d: str) -> DataFrame:
    """Raw documents, stored as reports are: one report per 500 orders, lines as instances; every other report has one site, not a list."""
    li = dealt(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.floor(F.col("l_orderkey") / 500).alias("rep")), "rep")
    uri = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("http://other/x"), "l_suppkey")).otherwise(F.concat(F.lit("http://t:3000/p/"), F.col("l_orderkey") % 50))
    inst = F.struct(uri.alias("uri"), F.lit("get").alias("method"), F.concat(F.lit("q"), F.col("l_linenumber")).alias("param"))
    alerts = li.groupBy("rep", "l_orderkey").agg(F.collect_list(inst).alias("instances"))
    alert = F.struct(F.concat(F.lit("1000"), F.col("l_orderkey") % 7).alias("pluginid"), (F.col("l_orderkey") % 4).cast("string").alias("riskcode"), F.concat(F.lit("alert "), F.col("l_orderkey") % 9).alias("name"), (F.col("l_orderkey") % 300).cast("string").alias("cweid"), "instances")
    docs = alerts.groupBy("rep").agg(F.collect_list(alert).alias("alerts"))
    site = F.struct("alerts")
    doc = F.when(F.col("rep") % 2 == 0, F.to_json(F.struct(F.array(site).alias("site")))).otherwise(F.to_json(F.struct(site.alias("site"))))
    meta = F.from_json(F.lit('{"run_id": "r", "scanned_at": "2026-08-05T00:00:00Z", "target": {"name": "shop", "base_url": "http://t:3000"}}'), N.S.SCAN_META)
    return at_rest(docs.select(F.concat(F.lit("zap/"), "rep").alias("report_path"), F.lit("zap").alias("tool"), doc.alias("doc"), meta.alias("meta")))


@query("""SELECT 'zap/' || CAST(l_orderkey // 500 AS STRING) AS report_path, '1000' || CAST(l_orderkey % 7 AS STRING) AS rule_id, count(*) AS n, count(DISTINCT l_linenumber) AS parameters FROM lineitem GROUP BY 1, 2""")
def n2_flatten_zap(spark, d):
    return N.flatten_zap(zap_reports(spark, d)).groupBy("report_path", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("parameter").alias("parameters"))


@query("""SELECT 'zap/' || CAST(l_orderkey // 500 AS STRING) AS report_path, 'zap' AS tool, CASE WHEN count(*) > count(*) FILTER (l_suppkey % 5 <> 0) THEN 'partial' ELSE 'success' END AS status, count(*) AS raw_count, count(*) FILTER (l_suppkey % 5 <> 0) AS written_count FROM lineitem GROUP BY 1""")
def n25_normalize_all_summary(spark, d):
    return N.normalize_all(zap_reports(spark, d))[1]


@query("""SELECT severity, cwe, count(*) AS n, count(DISTINCT endpoint) AS endpoints FROM (SELECT CASE l_orderkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity,
  CASE WHEN l_orderkey % 300 = 0 THEN '' ELSE 'CWE-' || CAST(l_orderkey % 300 AS STRING) END AS cwe, l_orderkey % 50 AS endpoint FROM lineitem WHERE l_suppkey % 5 <> 0) GROUP BY 1, 2""")
def n31_findings(spark, d):
    findings, _ = N.normalize_all(zap_reports(spark, d))
    return findings.groupBy("severity", F.array_join("cwe_ids", ",").alias("cwe")).agg(F.count("*").alias("n"), F.count_distinct("location.endpoint").alias("endpoints"))


@query("""SELECT count(*) AS findings, count(*) FILTER (l_orderkey % 50 NOT IN (7, 8, 9)) AS valid, count(*) FILTER (l_orderkey % 50 = 7) AS severity, count(*) FILTER (l_orderkey % 50 = 8) AS fingerprint, count(*) FILTER (l_orderkey % 50 = 9) AS location, count(*) FILTER (l_orderkey % 50 = 3) AS unresolved FROM lineitem WHERE l_suppkey % 5 <> 0""")
def n22_n24_valid_and_proven(spark, d):
    reports = zap_reports(spark, d)
    at = lambda n: F.col("location.endpoint") == f"/p/{n}"
    findings = stored(N.normalize_all(reports)[0])
    spoilt = findings.withColumns({"severity": F.when(at(7), "odd").otherwise(F.col("severity")), "fingerprint": F.when(at(8), F.upper("fingerprint")).otherwise(F.col("fingerprint")), "location": F.when(at(9), F.col("location").withField("uri", F.lit(None).cast("string"))).otherwise(F.col("location"))})
    good, bad = N.validate(spoilt, N.finding_checks())
    source = F.col("raw_sources")[0]
    pointer = F.when(at(3), F.concat(source["json_pointer"], F.lit("0/x"))).otherwise(source["json_pointer"])
    lost = N.check_provenance(findings.select(source["report_path"].alias("report_path"), pointer.alias("pointer")), stored(N.document_parts(reports)))
    each = findings.select(F.lit("findings").alias("k")).unionAll(good.select(F.lit("valid"))).unionAll(bad.select("error")).unionAll(lost.select(F.lit("unresolved")))
    n = lambda k: F.count_if(F.col("k") == k).alias(k)
    return each.agg(*map(n, ("findings", "valid", "severity", "fingerprint", "location", "unresolved")))


def semgrep_reports(spark: SparkSession, d: str) -> DataFrame:
    o = dealt(load(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 1000).alias("rep")), "rep")
    k = F.col("o_orderkey")
    node = lambda p: F.concat(F.lit('["CliLoc", [{"path": "src/'), k % 9, F.lit('.ts", "start": {"line": 3, "col": 2}}, "'), F.lit(p), F.lit('"]]'))
    doc = F.concat(
        F.lit('{"check_id": "rule-'), k % 11, F.lit('", "path": "src/'), k % 40, F.lit('.ts", "start": {"line": '), k % 60 + 1, F.lit(', "col": 1}, "extra": {"severity": "ERROR", "lines": "x", "metadata": {"cwe": '),
        F.when(k % 2 == 0, F.concat(F.lit('["CWE-'), k % 30 + 1, F.lit(': text"]'))).otherwise(F.concat(F.lit('"CWE-'), k % 30 + 1, F.lit('"'))), F.lit(', "vulnerability_class": ["Zed", "Abc"]}'),
        F.when(k % 3 == 0, F.concat(F.lit(', "dataflow_trace": {"taint_source": '), node("src"), F.lit(', "intermediate_vars": [{"location": {"path": "a.ts", "start": {"line": 5}}, "content": "mid"}, {}], "taint_sink": '), node("snk"), F.lit("}"))).otherwise(F.lit("")), F.lit("}}"),
    )
    docs = o.groupBy("rep").agg(F.concat(F.lit('{"results": ['), F.array_join(F.collect_list(doc), ","), F.lit("]}")).alias("doc"))
    meta = F.from_json(F.lit('{"run_id": "r", "scanned_at": "2026-08-05T00:00:00Z", "target": {"name": "shop"}}'), N.S.SCAN_META)
    return at_rest(docs.select(F.concat(F.lit("semgrep/"), "rep").alias("report_path"), F.lit("semgrep").alias("tool"), "doc", meta.alias("meta")))


@query("""SELECT 'rule-' || CAST(o_orderkey % 11 AS STRING) AS rule_id, 'CWE-' || CAST(o_orderkey % 30 + 1 AS STRING) AS cwe, 'Abc' AS title, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS flows, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS steps FROM orders GROUP BY 1, 2""")
def n1_n20_semgrep(spark, d):
    rows = N.flatten_semgrep(semgrep_reports(spark, d))
    return rows.groupBy("rule_id", F.array_join(X.cwe_ids(F.col("cwe_raw")), ",").alias("cwe"), "title").agg(F.count("*").alias("n"), F.count("flow").alias("flows"), F.sum(F.coalesce(F.size(F.col("flow")[0]["steps"]), F.lit(0)).cast("long") * F.when(F.col("flow").isNotNull(), 1).otherwise(0)).alias("steps"))


def sarif_reports(spark: SparkSession, d: str) -> DataFrame:
    o = dealt(load(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 1000).alias("rep")), "rep")
    k = F.col("o_orderkey")
    node = lambda n: F.concat(F.lit('{"location": {"physicalLocation": {"artifactLocation": {"uri": "lib/n'), n, F.lit('.ts"}, "region": {"startLine": '), k % 9 + n, F.lit('}}, "message": {"text": "step"}}}'))
    thread = F.concat(F.lit(', "codeFlows": [{"threadFlows": [{"locations": ['), F.array_join(F.transform(F.sequence(F.lit(1), k % 4 + 1), node), ", "), F.lit("]}]}]"))
    res = F.concat(
        F.lit('{"ruleId": "r'), k % 6, F.lit('", "ruleIndex": '), F.when(k % 4 == 0, 0).otherwise(k % 6), F.lit(', "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {'),
        F.when(k % 2 == 0, F.concat(F.lit('"uri": "src/'), k % 20, F.lit('.ts"'))).otherwise(F.concat(F.lit('"index": '), k % 2)), F.lit('}, "region": {"startLine": '), k % 50 + 1, F.lit("}}}]"), F.when(k % 5 == 0, thread).otherwise(F.lit("")), F.lit("}"),
    )
    rules = ", ".join(f'{{"id": "r{i}", "shortDescription": {{"text": "Rule {i}"}}, "properties": {{"security-severity": "{i * 2}.0", "precision": "high", "tags": ["external/cwe/cwe-0{i + 1}"]}}}}' for i in range(5))
    head = '{"version": "2.1.0", "runs": [{"tool": {"driver": {"rules": [' + rules + ']}}, "artifacts": [{"location": {"uri": "lib/a.ts"}}, {"location": {"uri": "lib/b.ts"}}], "invocations": [{"toolExecutionNotifications": ['
    parse = F.transform(F.sequence(F.lit(1), F.col("rep") % 4 + 1), lambda n: F.concat(F.lit('{"descriptor": {"id": "js/Parse-error"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "z'), n % 3, F.lit('.ts"}}}]}')))
    lost = F.array_repeat(F.lit('{"descriptor": {"id": "js/extraction-error"}, "locations": []}'), (F.col("rep") % 3).cast("int"))
    docs = o.groupBy("rep").agg(F.array_join(F.collect_list(res), ",").alias("res"))
    docs = docs.select("rep", F.concat(F.lit(head), F.array_join(F.concat(parse, lost), ", "), F.lit(']}], "results": ['), "res", F.lit("]}]}")).alias("doc"))
    return at_rest(docs.select(F.concat(F.lit("codeql/"), "rep").alias("report_path"), F.lit("codeql").alias("tool"), "doc"))


@query("""SELECT 'r' || CAST(o_orderkey % 6 AS STRING) AS rule_id, CASE WHEN o_orderkey % 6 < 5 THEN 'Rule ' || CAST(o_orderkey % 6 AS STRING) END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'src/' || CAST(o_orderkey % 20 AS STRING) || '.ts' ELSE 'lib/b.ts' END AS path, count(*) AS n, count(*) FILTER (o_orderkey % 6 = 5) AS missing FROM orders GROUP BY 1, 2, 3""")
def n3_n4_n5_sarif(spark, d):
    return N.sarif_results(sarif_reports(spark, d)).groupBy("rule_id", "title", F.col("path_raw").alias("path")).agg(F.count("*").alias("n"), F.count_if("missing_rule").alias("missing"))


@query("""SELECT o_orderkey % 9 AS start, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 4 > 0) AS flows, CAST(sum(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 > 0 THEN o_orderkey % 4 - 1 ELSE 0 END) AS BIGINT) AS steps,
  min(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 > 0 THEN 'lib/n1.ts:' || CAST(o_orderkey % 9 + 1 AS STRING) || '>lib/n' || CAST(o_orderkey % 4 + 1 AS STRING) || '.ts' END) AS first FROM orders GROUP BY 1""")
def n20_thread_flows(spark, d):
    rows = N.flatten_sarif(sarif_reports(spark, d)).select(F.col("start_line").alias("s"), F.col("flow")[0].alias("f"), "report_path", "pointer", "path_raw")
    # a result's order key is not in it; what it is by 9 is: of its flow's first line, or for others not at all
    flows = rows.where("f is not null").select((F.col("f.source.line") - 1).cast("long").alias("start"), F.size("f.steps").cast("long").alias("n"), F.concat("f.source.path", F.lit(":"), "f.source.line", F.lit(">"), "f.sink.path").alias("way"))
    return flows.groupBy("start").agg(F.count("*").alias("flows"), F.sum("n").alias("steps"), F.min("way").alias("first"))


@query("""SELECT 'codeql/' || CAST(o_orderkey // 1000 AS STRING) AS report_path, o_orderkey // 1000 % 3 AS extraction_errors, o_orderkey // 1000 % 4 + 1 AS parse_errors, least(o_orderkey // 1000 % 4 + 1, 3) AS files FROM orders GROUP BY ALL""")
def n27_sarif_diagnostics(spark, d):
    return N.sarif_diagnostics(sarif_reports(spark, d))


@query(f"""{_RAW}, f AS (SELECT row_idx, 'f' || CAST(row_idx % 20 AS STRING) AS path, start_line AS s FROM raw)
  SELECT row_idx, CAST(CASE WHEN s > 80 THEN 86 - s ELSE least(5, s - 1) END AS BIGINT) AS before, CAST(greatest(0, least(5, 80 - s)) AS BIGINT) AS after, CASE WHEN s <= 80 THEN 'line ' || CAST(s AS STRING) ELSE '' END AS own FROM f WHERE s - 5 <= 80""")
def n21_source_context(spark, d):
    files = raw(spark, d).select(F.concat(F.lit("f"), F.col("row_idx") % 20).alias("path")).distinct().withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("line "), i)), "\n"))
    rows = raw(spark, d).select("row_idx", F.lit("code").alias("kind"), F.concat(F.lit("f"), F.col("row_idx") % 20).alias("path"), "start_line", F.lit(None).cast("int").alias("end_line"))
    out = N.attach_source_context(rows, N.source_lines(files)).where("context_before is not null")
    return out.select("row_idx", F.size("context_before").cast("long").alias("before"), F.size("context_after").cast("long").alias("after"), F.col("source_text").alias("own"))


@query(f"{_RAW} SELECT CAST(row_idx AS BIGINT) AS row_idx FROM raw WHERE row_idx % 500 BETWEEN 100 AND 199 AND NOT row_idx % 500 % 10 = 5")
def n28_scope_policy(spark, d):
    rows = raw(spark, d).select("row_idx", X.code_path(F.col("path_raw")).alias("path"))
    return N.scope_policy(rows, ["src/r1??.ts", "lib/**"], ["**/r*5.ts", "node_modules/"])[0].select("row_idx")


@query("SELECT 'zap/' || CAST(l_orderkey // 500 AS STRING) AS report_path, 'zap' AS tool, 'scanned_at' AS error FROM lineitem WHERE l_orderkey // 500 % 2 = 0 GROUP BY 1")
def n29_metadata_errors(spark, d):
    reports = zap_reports(spark, d)
    odd = F.regexp_extract("report_path", "([0-9]+)$", 1).cast("int") % 2 == 0
    return N.validate_scan_metadata(reports.withColumn("meta", F.col("meta").withField("scanned_at", F.when(odd, "yesterday").otherwise(F.col("meta.scanned_at")))))


@query(f"{_RAW} SELECT row_idx, 'fnd_' || substr(sha256('rep' || CAST(row_idx % 9 AS STRING) || '|/results/' || CAST(row_idx AS STRING)), 1, 32) AS finding_id FROM raw")
def n30_finding_id(spark, d):
    return raw(spark, d).select("row_idx", N.finding_id(F.concat(F.lit("rep"), F.col("row_idx") % 9), F.concat(F.lit("/results/"), "row_idx")).alias("finding_id"))


@query(f"""{_RAW} SELECT row_idx, '$A' || CAST(row_idx % 7 AS STRING) || '=;$Z=' || rule_id AS names, CASE row_idx % 3 WHEN 0 THEN '' WHEN 1 THEN 'about ' || rule_id || '@' || 'src/r' || CAST(row_idx % 500 AS STRING) || '.ts:' || CAST(start_line AS STRING)
  ELSE 'about ' || rule_id || '@' || 'src/r' || CAST(row_idx % 500 AS STRING) || '.ts:' || CAST(start_line AS STRING) || ';@lib/x.ts:3' END AS related FROM raw""")
def n23_matched_and_related(spark, d):
    i, r = F.col("row_idx"), raw(spark, d)
    metavars = F.from_json(F.concat(F.lit('{"$Z": {"abstract_content": "'), "rule_id", F.lit('"}, "$A'), i % 7, F.lit('": {}}')), "map<string,struct<abstract_content:string>>")
    kind = "struct<id:int,message:struct<text:string>,physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>"
    first = F.concat(F.lit('{"id": 1, "message": {"text": "about '), "rule_id", F.lit('"}, "physicalLocation": {"artifactLocation": {"uri": "'), "path_raw", F.lit('"}, "region": {"startLine": '), "start_line", F.lit("}}}"))
    second = F.lit(', {"physicalLocation": {"artifactLocation": {"uri": "./lib/x.ts"}, "region": {"startLine": 3}}}')
    related = F.from_json(F.concat(F.lit("["), F.when(i % 3 > 0, first).otherwise(""), F.when(i % 3 == 2, second).otherwise(""), F.lit("]")), f"array<{kind}>")
    names = F.transform(N.matched_contents(metavars), lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["content"], F.lit(""))))
    about = F.transform(N.related_context(related), lambda x: F.concat(F.coalesce(x["message"], F.lit("")), F.lit("@"), x["path"], F.lit(":"), x["line"]))
    return r.select("row_idx", F.array_join(names, ";").alias("names"), F.array_join(about, ";").alias("related"))


_WORDS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: len(w) > 1), lambda w: CASE WHEN w IN ('sql', 'sqli', 'database', 'query') THEN ['sql', 'sqli', 'database', 'query'] WHEN w IN ('redirect', 'url', 'open-redirect') THEN ['redirect', 'url', 'open-redirect'] WHEN w IN ('xss', 'scripting') THEN ['xss', 'scripting'] WHEN w IN ('path', 'traversal', 'directory') THEN ['path', 'traversal', 'directory'] ELSE [w] END)))"


@query(f"{_SMALL} SELECT row_idx, array_to_string(list_sort({_WORDS}), ' ') AS keywords FROM small")
def c1_title_keywords(spark, d):
    return small_findings(spark, d).select("row_idx", F.array_join(F.array_sort(C.title_keywords(F.col("title"))), " ").alias("keywords"))


_PAIRS = f"""{_SMALL}, w AS (SELECT *, list_filter({_WORDS}, lambda x: x <> 'check') AS kw FROM small),
p AS (SELECT a.row_idx AS a_idx, b.row_idx AS b_idx, a.cwe AS cwe_overlap, list_has_any(a.kw, b.kw) AS t, CASE WHEN a.kind = 'code' AND b.kind = 'code' THEN a.path = b.path WHEN a.kind = 'http' AND b.kind = 'http' THEN a.endpoint = b.endpoint ELSE false END AS same,
  CASE WHEN a.kind <> b.kind THEN contains(lower(coalesce(a.node, b.node)), lower(coalesce(a.parameter, b.parameter))) ELSE false END AS prm, a.scan_type <> b.scan_type AS cr
  FROM w a JOIN w b ON a.cwe = b.cwe AND a.row_idx < b.row_idx)"""


@query(f"""{_PAIRS} SELECT a_idx, b_idx, cwe_overlap, t AS is_title_similar, cr AND prm AS is_param_match, NOT (cr AND (t OR prm OR same)) AND same AS is_route_match, CASE WHEN cr AND (prm OR t) THEN 'high' ELSE 'medium' END AS confidence
  FROM p WHERE (cr AND (t OR prm OR same)) OR same OR t""")
def c2_c3_c4_pairs(spark, d):
    return C.correlate_pairs(small_findings(spark, d)).withColumn("cwe_overlap", F.array_join("cwe_overlap", ",")).drop("reason")


_MERGED = f"""{_PAIRS}, cl AS (SELECT row_idx, min(row_idx) OVER (PARTITION BY group_key) AS cluster_idx FROM small),
e AS (SELECT DISTINCT greatest(x.cluster_idx, y.cluster_idx) AS i, least(x.cluster_idx, y.cluster_idx) AS j FROM p JOIN cl x ON x.row_idx = a_idx JOIN cl y ON y.row_idx = b_idx WHERE ((cr AND (t OR prm OR same)) OR same OR t) AND x.cluster_idx <> y.cluster_idx),
r(i, m) AS (SELECT DISTINCT cluster_idx, cluster_idx FROM cl UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.m), f AS (SELECT i AS cluster_idx, min(m) AS founder FROM r GROUP BY i)"""


@query(f"{_SMALL} SELECT row_idx, min(row_idx) OVER (PARTITION BY group_key) AS cluster_idx FROM small")
def c5_initial_clusters(spark, d):
    return C.initial_clusters(small_findings(spark, d)).select("row_idx", "cluster_idx")


@query(f"{_MERGED} SELECT cluster_idx, founder FROM f")
def c6_merge_clusters(spark, d):
    return C.merge_clusters(C.initial_clusters(small_findings(spark, d)))


_GROUPS = f"""{_MERGED}, m AS (SELECT * FROM (SELECT s.*, cl.cluster_idx, f.founder, row_number() OVER (PARTITION BY f.founder, fingerprint ORDER BY cl.cluster_idx, s.row_idx) AS rn FROM small s JOIN cl USING (row_idx) JOIN f USING (cluster_idx)) WHERE rn = 1),
q AS (SELECT founder, cwe FROM (SELECT founder, cwe, row_number() OVER (PARTITION BY founder ORDER BY count(*) DESC, min(cluster_idx * 100000 + row_idx)) AS rn FROM m GROUP BY founder, cwe) WHERE rn = 1),
g AS (SELECT founder, count(*) AS size, CASE WHEN bool_or(scan_type = 'SAST') AND bool_or(scan_type = 'DAST') THEN 'sast_dast_suspected' WHEN count(DISTINCT tool) > 1 AND bool_or(scan_type = 'SAST') THEN 'multi_sast' WHEN bool_or(scan_type = 'DAST') THEN 'dast_only' ELSE 'sast_only' END AS correlation_type FROM m GROUP BY founder)"""


@query(f"""{_GROUPS} SELECT 'grp_' || lower(replace(q.cwe, '-', '')) || '_' || CASE WHEN row_number() OVER (ORDER BY founder) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY founder) AS STRING), 3, '0') ELSE CAST(row_number() OVER (ORDER BY founder) AS STRING) END AS group_id,
  founder, q.cwe AS primary_cwe, correlation_type, size FROM g JOIN q USING (founder)""")
def c7_c8_c10_c12_groups(spark, d):
    return C.build_groups(small_findings(spark, d))[0].select("group_id", "founder", "primary_cwe", "correlation_type", "size")


@query(f"""{_KEYED}, g AS (SELECT group_key, CASE WHEN bool_or(scan_type = 'SAST') AND bool_or(scan_type = 'DAST') THEN 'sast_dast_suspected' WHEN count(DISTINCT tool) > 1 AND bool_or(scan_type = 'SAST') THEN 'multi_sast' WHEN bool_or(scan_type = 'DAST') THEN 'dast_only' ELSE 'sast_only' END AS correlation_type,
  count(DISTINCT fingerprint) AS members FROM f GROUP BY group_key) SELECT correlation_type, count(*) AS n_groups, CAST(sum(members) AS BIGINT) AS n_members FROM g GROUP BY 1""")
def c9_correlation_type(spark, d):
    # findings are stored between normalisation and grouping, as a user would store them
    rows = checkpointed(keyed(spark, d).select("row_idx", "tool", "scan_type", N.fingerprint().alias("fingerprint"), N.group_key().alias("group_key")))
    first = C.dedup_in_group(C.initial_clusters(rows).withColumn("founder", F.col("cluster_idx")))
    kinds = C.correlation_type(first).join(first.groupBy("founder").agg(F.count("*").alias("m")), "founder")
    return kinds.groupBy("correlation_type").agg(F.count("*").alias("n_groups"), F.sum("m").alias("n_members"))


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all lines and orders, normalised from two kinds of reports, numbered by their ids; of findings that groups
    cannot tell apart the first. Groups and members are those of all findings."""
    return checkpointed(C.flat(N.first_findings(zap_reports(spark, d).unionByName(semgrep_reports(spark, d)))))


@query()
def c5_c12_groups_of_all_findings(spark, d):
    groups, members = C.build_groups(all_findings(spark, d))
    return groups.select("group_id", "founder", "primary_cwe", "correlation_type", "size")


@query()
def a2_payloads_of_all_findings(spark, d):
    groups, members = C.build_groups(all_findings(spark, d))
    context = members.select("group_id", F.explode("cwe_ids").alias("doc_id")).distinct().withColumn("rank", F.lit(1))
    return A.analysis_payload(members, context, 500).select("group_id", "part", F.length("payload").alias("chars"))


@query(f"{_SMALL} SELECT count(DISTINCT fingerprint) AS input_count, count(DISTINCT fingerprint) FILTER (CAST(substr(fingerprint, 3) AS INT) % 3 <> 0) AS covered_count, count(DISTINCT fingerprint) FILTER (CAST(substr(fingerprint, 3) AS INT) % 3 = 0) AS missing_count, false AS is_complete FROM small")
def c11_coverage(spark, d):
    rows = small_findings(spark, d)
    return C.coverage(rows, rows.where(F.substring("fingerprint", 3, 9).cast("int") % 3 != 0))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Report entries: one per small finding."""
    r = small_findings(spark, d)
    i = F.col("row_idx")
    level = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (i % 4 + 1).cast("int"))
    conf = F.element_at(F.array(*map(F.lit, ("confirmed", "false_positive", "low"))), (i % 3 + 1).cast("int"))
    return r.select("row_idx", "finding_id", "fingerprint", F.concat(F.lit("grp_"), i % 70).alias("group_id"), "tool", "scan_type", "title", level.alias("severity"), conf.alias("confidence"), F.when(i % 9 == 0, "error").otherwise("success").alias("status"), F.when(i % 2 == 0, "multi_sast").otherwise("sast_only").alias("correlation_type"), F.when(i % 50 == 0, "key [REDACTED_EMAIL]").otherwise("plain").alias("note"))


@query()
def a1_kb_context(spark, d):
    """Groups of small findings, with titles that hold words of the documents, ask all documents."""
    from lodeframe.plans.texts import corpus

    words = load(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.substring_index("text", " ", 1).alias("word"))
    m = small_findings(spark, d).join(words, "row_idx").withColumns({"group_id": F.concat(F.lit("grp_"), F.col("row_idx") % 70), "cluster_idx": F.col("row_idx"), "title": F.col("word")})
    return A.kb_context(m, corpus(spark, d)).select("group_id", F.col("rank").cast("long").alias("rank"), "doc_id")


@query(f"{_SMALL}, m AS (SELECT 'grp_' || CAST(row_idx % 70 AS STRING) AS group_id, row_idx, cwe, title FROM small) SELECT DISTINCT group_id, cwe AS query FROM m UNION SELECT group_id, arg_min(title, row_idx) FROM m GROUP BY group_id")
def a1_context_queries(spark, d):
    m = small_findings(spark, d).withColumns({"group_id": F.concat(F.lit("grp_"), F.col("row_idx") % 70), "cluster_idx": F.col("row_idx")})
    return A.context_queries(m).distinct()


@query(f"{_SMALL} SELECT 'grp_' || CAST(row_idx % 70 AS STRING) AS group_id, CAST(0 AS BIGINT) AS part, count(*) AS findings, CAST(0 AS BIGINT) AS leaks FROM small GROUP BY 1")
def a2_payload(spark, d):
    m = small_findings(spark, d).withColumns({"group_id": F.concat(F.lit("grp_"), F.col("row_idx") % 70), "cluster_idx": F.col("row_idx"), "title": F.concat("title", F.lit(" a.b@c.com"))})
    context = m.select("group_id", F.lit(1).alias("rank"), F.lit("doc").alias("doc_id")).distinct()
    p = A.analysis_payload(m, context)
    return p.select("group_id", "part", F.json_array_length(F.get_json_object("payload", "$.findings")).cast("long").alias("findings"), F.when(F.col("payload").contains("@c.com"), 1).otherwise(0).cast("long").alias("leaks"))


@query(f"""{_SMALL} SELECT 'grp_' || CAST(row_idx % 70 AS STRING) AS group_id, CAST(row_idx AS BIGINT) AS idx, fingerprint, tool, 'analysis_' || md5('grp_' || CAST(row_idx % 70 AS STRING) || '_' || fingerprint || '_' || CAST(row_idx AS STRING)) AS analysis_id, CASE WHEN row_idx % 2 = 0 THEN 'high' ELSE 'unknown' END AS severity, 'confirmed' AS confidence FROM small""")
def a3_repair_entries(spark, d):
    m = small_findings(spark, d).withColumns({"group_id": F.concat(F.lit("grp_"), F.col("row_idx") % 70), "cluster_idx": F.col("row_idx"), "severity": F.lit("low")})
    none = F.lit(None).cast("string")
    raw_entries = m.select("group_id", F.col("row_idx").alias("idx"), "finding_id", none.alias("fingerprint"), none.alias("tool"), none.alias("scan_type"), F.lit("bad").alias("analysis_id"), F.when(F.col("row_idx") % 2 == 0, "Rather HIGH").otherwise("?").alias("severity"), F.lit("It is confirmed, high").alias("confidence"), none.alias("correlation_type"), none.alias("cwe"))
    return A.repair_entries(raw_entries, m).select("group_id", "idx", "fingerprint", "tool", "analysis_id", "severity", "confidence")


@query(f"{_SMALL} SELECT fingerprint, 'analysis_' || md5('fallback_' || fingerprint || '_0') AS analysis_id, count(*) AS n FROM small WHERE CAST(substr(fingerprint, 3) AS INT) % 3 = 0 GROUP BY 1, 2")
def a4_a5_fallback_entries(spark, d):
    e = entries(spark, d)
    out = A.fallback_entries(e, e.where(F.substring("fingerprint", 3, 9).cast("int") % 3 != 0))
    good, _ = N.validate(out, A.entry_checks())
    return good.groupBy("fingerprint", "analysis_id").agg(F.count("*").alias("n"))


@query(f"""{_SMALL}, e AS (SELECT * FROM small WHERE row_idx % 6 <> 5) SELECT 'status' AS what, CASE WHEN row_idx % 9 = 0 THEN 'error' ELSE 'success' END AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'correlation_type', CASE WHEN row_idx % 2 = 0 THEN 'multi_sast' ELSE 'sast_only' END, count(*) FROM e GROUP BY 2
  UNION ALL SELECT 'total', 'findings', count(*) FROM small UNION ALL SELECT 'total', 'groups', count(DISTINCT row_idx % 70) FROM small UNION ALL SELECT 'total', 'entries', count(*) FROM e
  UNION ALL SELECT 'coverage', 'input_count', count(DISTINCT fingerprint) FROM small UNION ALL SELECT 'coverage', 'covered_count', count(DISTINCT fingerprint) FROM e UNION ALL SELECT 'coverage', 'missing_count', (SELECT count(DISTINCT fingerprint) FROM small) - count(DISTINCT fingerprint) FROM e""")
def a6_summary(spark, d):
    e = entries(spark, d)
    return A.analysis_summary(e.where("row_idx % 6 <> 5"), e, e)


@query(f"{_SMALL} SELECT 'grp_' || CAST(row_idx % 70 AS STRING) AS group_id, min(row_idx) AS first_seen, arg_min(title, row_idx) AS title, ['critical', 'high', 'medium', 'low'][min(row_idx) % 4 + 1] AS severity, ['confirmed', 'false_positive', 'low'][min(row_idx) % 3 + 1] AS confidence, count(*) AS members FROM small GROUP BY 1")
def a7_matrix(spark, d):
    e = entries(spark, d)
    return A.severity_matrix(e, e)


@query(f"{_SMALL} SELECT count(*) AS entries, count(DISTINCT row_idx % 70) AS groups, count(*) FILTER (row_idx % 3 = 0) AS confirmed, count(*) FILTER (row_idx % 3 = 1) AS false_positives, count(*) FILTER (row_idx % 50 = 0) AS redacted, CAST(0 AS BIGINT) AS injections FROM small")
def a8_kpis(spark, d):
    return A.report_kpis(entries(spark, d))


@query(f"{_SMALL} SELECT 'grp_' || CAST(row_idx % 70 AS STRING) AS group_id, min(row_idx) AS first FROM small GROUP BY 1 HAVING bool_or(row_idx % 4 = 1) ORDER BY 2 LIMIT 10 OFFSET 10")
def a9_page(spark, d):
    return A.page_groups(entries(spark, d), "high", 2, 10)


@query(f"{_SMALL} SELECT row_idx AS step, row_number() OVER (PARTITION BY row_idx % 7, tool, row_idx % 11 ORDER BY row_idx) > 2 AS blocked FROM small")
def a10_repeat_calls(spark, d):
    i = F.col("row_idx")
    return A.flag_repeat_calls(small_findings(spark, d).select((i % 7).alias("group_id"), i.alias("step"), "tool", (i % 11).cast("string").alias("args"))).select("step", "blocked")


@query(f"""{_SMALL}, t AS (SELECT DISTINCT cwe, endpoint FROM small WHERE endpoint IS NOT NULL), g AS (SELECT row_idx, 'CWE-' || CAST(row_idx % 80 AS STRING) AS cwe, CASE WHEN row_idx % 4 = 0 THEN 'ALL' ELSE '/p/' || CAST(row_idx % 19 AS STRING) END AS endpoint FROM small)
  SELECT count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.cwe = g.cwe AND (g.endpoint = 'ALL' OR t.endpoint = g.endpoint))) AS matched, count(*) AS total, round(count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.cwe = g.cwe AND (g.endpoint = 'ALL' OR t.endpoint = g.endpoint))) / count(*), 4) AS recall FROM g""")
def e4_ground_truth(spark, d):
    f = small_findings(spark, d)
    i = F.col("row_idx")
    truth = f.select(i.alias("ground_truth_id"), F.when(i % 4 == 0, "ALL").otherwise(F.concat(F.lit("/p/"), i % 19)).alias("endpoint"), F.lit("GET").alias("method"), F.concat(F.lit("CWE-"), i % 80).alias("primary_cwe_id"))
    return E.ground_truth_recall(truth, f.where("endpoint is not null").withColumn("method", F.lit("GET")))


def laid_out(spark: SparkSession, reports: DataFrame, at: str) -> str:
    """Reports (run, tool, name, body) as files <at>/raw/<run>/<tool>/<name>. Writers choose their own names, so the files,
    one a folder, are moved to theirs afterwards; there are as many as reports, not as rows."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reports.repartition(width, "run", "tool", "name").write.partitionBy("run", "tool", "name").text(f"{at}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in reports.select("run", "tool", "name").distinct().toLocalIterator():
        folder = f"{at}/raw/{r.run}/{r.tool}"
        fs.mkdirs(path(folder))
        (part,) = (s.getPath() for s in fs.listStatus(path(f"{at}/parts/run={r.run}/tool={r.tool}/name={r.name}")))
        fs.rename(part, path(f"{folder}/{r.name}"))
    return f"{at}/raw"


@query("""WITH z AS (SELECT DISTINCT l_orderkey // 500 AS rep FROM lineitem) SELECT 'zap/zap.json' AS report_path, 'zap' AS tool, count(*) AS reports, count(*) FILTER (rep % 5 <> 1) AS documents, count(*) FILTER (rep % 3 = 0) AS sidecars FROM z WHERE rep % 7 <> 2
  UNION ALL SELECT 'zap', 'zap', count(*), 0, count(*) FILTER (rep % 3 = 0) FROM z WHERE rep % 7 = 2""")
def s1_scan_reports(spark, d):
    """Reports and sidecars as files of many runs: some documents are lists, some sidecars lack their target or time, some
    reports are not there."""
    rows = zap_reports(spark, d).select(F.regexp_extract("report_path", "([0-9]+)$", 1).cast("long").alias("run"), "tool", "doc")
    body = F.when(F.col("run") % 5 == 1, F.concat(F.lit("["), "doc", F.lit("]"))).otherwise(F.col("doc"))
    said = F.to_json(F.struct(F.concat(F.lit("r"), "run").alias("run_id"), F.when(F.col("run") % 3 == 1, "").otherwise("2025-01-01T00:00:00Z").alias("scanned_at"), F.struct(F.when(F.col("run") % 3 == 2, "").otherwise("shop").alias("name")).alias("target")))
    both = rows.where("run % 7 <> 2").select("run", "tool", F.lit("zap.json").alias("name"), body.alias("body")).unionAll(rows.select("run", "tool", F.lit("scan-metadata.json"), said))
    found = S.read_scan_reports(spark, laid_out(spark, checkpointed(both), f"{checkpoint_folder(spark)}/reports-{uuid.uuid4().hex}"))
    return found.groupBy("report_path", "tool").agg(F.count("*").alias("reports"), F.count("doc").alias("documents"), F.count("meta").alias("sidecars"))


@query("""WITH z AS (SELECT 'zap' AS tool, CAST(l_orderkey // 500 AS STRING) AS run, l_suppkey % 5 <> 0 AS kept, false AS rule FROM lineitem UNION ALL SELECT 'semgrep', CAST(o_orderkey // 1000 AS STRING), true, false FROM orders UNION ALL SELECT 'codeql', CAST(o_orderkey // 1000 AS STRING), true, o_orderkey % 6 < 5 FROM orders)
  SELECT tool, run, CASE WHEN count(*) > count(*) FILTER (kept) THEN 'partial' ELSE 'success' END AS status, count(*) AS raw_count, count(*) FILTER (kept) AS written_count, count(*) FILTER (kept) + count(*) FILTER (rule) AS sources, 0::BIGINT AS unresolved FROM z GROUP BY tool, run""")
def s1_n24_n25_reports_in_parts(spark, d):
    """Reports as files, read in byte ranges, cut into their results there, normalised; every raw source of a finding is then
    looked up in the files' own text."""
    at = f"{checkpoint_folder(spark)}/parts-{uuid.uuid4().hex}"
    made = {"zap": zap_reports, "semgrep": semgrep_reports, "codeql": sarif_reports}
    all_parts, all_reports = [], []
    for tool, make in made.items():
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        make(spark, d).select(F.regexp_extract("report_path", "([0-9]+)$", 1).alias("run"), "doc").repartition(width, "run").write.partitionBy("run").text(f"{at}/{tool}")
        parts, reports = S.read_report_parts(spark, f"{at}/{tool}", tool, N.PARTS[tool], "*.txt")
        all_parts.append(parts)
        all_reports.append(reports)
    parts, reports = stored(reduce(DataFrame.unionAll, all_parts)), reduce(DataFrame.unionAll, all_reports)
    meta = F.from_json(F.lit('{"run_id": "r", "scanned_at": "2026-08-05T00:00:00Z", "target": {"name": "shop", "base_url": "http://t:3000"}}'), N.S.SCAN_META)
    findings, summary = N.normalize_parts(parts, reports.withColumn("meta", meta))
    findings = stored(findings)
    sources = findings.select(F.explode("raw_sources.report_path").alias("report_path")).groupBy("report_path").agg(F.count("*").alias("sources"))
    lost = N.check_provenance(N.source_pointers(findings), parts).groupBy("report_path").agg(F.count("*").alias("lost"))
    every = summary.join(sources, "report_path", "left").join(lost, "report_path", "left")
    return every.select("tool", F.regexp_extract("report_path", "run=([0-9]+)", 1).alias("run"), "status", "raw_count", "written_count", "sources", F.coalesce("lost", F.lit(0)).cast("long").alias("unresolved"))


@query("""WITH o AS (SELECT o_orderkey AS k, count(*) OVER (PARTITION BY o_orderkey // 4000) AS n FROM orders)
  SELECT k % 7 AS kind, count(*) AS pointers, count(*) FILTER (CASE k % 7 WHEN 0 THEN k % 2000 < n WHEN 1 THEN k % 2000 < n AND k % 4 < 2 WHEN 4 THEN k % 2000 < n WHEN 6 THEN true ELSE false END) AS resolved FROM o GROUP BY 1""")
def n24_json_pointers(spark, d):
    """Pointers of many kinds into reports: indexes out of range or with leading zeros, escaped and empty keys, values that
    are null, ways through texts, pointers to what is no element."""
    k = F.col("o_orderkey")
    o = load(spark, d, "orders").select("o_orderkey", F.floor(k / 4000).alias("rep"))
    one = '{"check_id": "r", "extra": {"a/b": {"m~n": ["}", {"x": 1}]}, "": null}}'
    docs = o.groupBy("rep").agg(F.concat(F.lit('{"version": "1", "results": ['), F.array_join(F.array_repeat(F.lit(one), F.count("*").cast("int")), ", "), F.lit("]}")).alias("doc"))
    parts = stored(N.document_parts(at_rest(docs.select(F.concat(F.lit("s/"), "rep").alias("report_path"), F.lit("semgrep").alias("tool"), "doc"))))
    i = (k % 2000).cast("string")
    way = lambda *x: F.concat(F.lit("/results/"), *x)
    pointer = (
        F.when(k % 7 == 0, way(i)).when(k % 7 == 1, way(i, F.lit("/extra/a~1b/m~0n/"), k % 4)).when(k % 7 == 2, way(i, F.lit("/extra/a/b"))).when(k % 7 == 3, way(F.lit("0"), i))
        .when(k % 7 == 4, way(i, F.lit("/extra/"))).when(k % 7 == 5, way(i, F.lit("/check_id/x"))).otherwise("/version")
    )
    asked = o.select(F.concat(F.lit("s/"), "rep").alias("report_path"), pointer.alias("pointer"), (k % 7).alias("kind"))
    lost = N.check_provenance(asked, parts)
    each = asked.select("kind", F.lit(1).alias("x")).unionAll(lost.select("kind", F.lit(0)))
    return each.groupBy("kind").agg(F.count_if(F.col("x") == 1).alias("pointers"), (F.count_if(F.col("x") == 1) - F.count_if(F.col("x") == 0)).alias("resolved"))


@query("""SELECT 'good' AS what, 'zap' AS tool, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 0 UNION ALL SELECT 'good', 'semgrep', count(*) FROM orders UNION ALL SELECT 'parquet', 'semgrep', count(*) FROM orders
  UNION ALL SELECT 'bad', '', count(*) + count(*) FILTER (o_orderkey % 4 = 0) + count(*) FILTER (o_orderkey % 8 = 0) FROM orders WHERE o_orderkey % 2 = 0""")
def s2_s6_findings_round_trip(spark, d):
    """All findings written as lines and as Parquet; among the lines some that are no findings."""
    at = f"{checkpoint_folder(spark)}/findings-{uuid.uuid4().hex}"
    findings = stored(N.normalize_all(zap_reports(spark, d).unionByName(semgrep_reports(spark, d)))[0])
    lines = S.write_findings(findings, at, "one", "gzip")
    k = F.col("o_orderkey")
    spoilt = load(spark, d, "orders").where(k % 2 == 0).select(F.explode(F.array_compact(F.array(F.concat(F.lit('{"fingerprint": "'), k, F.lit('"}')), F.when(k % 4 == 0, F.concat(F.lit("{oops "), k)), F.when(k % 8 == 0, F.concat(F.lit("["), k, F.lit("]")))))).alias("value"))
    spoilt.unionAll(load(spark, d, "orders").select(F.lit("  "))).write.mode("append").text(lines)
    good, bad = S.read_findings_jsonl(spark, lines, "quarantine")
    S.write_findings_parquet(findings, f"{at}/parquet")
    written = spark.read.parquet(f"{at}/parquet").where("tool_name = 'semgrep'")
    count = lambda what, tool, df: df.groupBy(F.lit(what).alias("what"), tool.alias("tool")).agg(F.count("*").alias("n"))
    return count("good", F.col("tool.name"), good).unionAll(count("bad", F.lit(""), bad)).unionAll(count("parquet", F.col("tool_name"), written))
