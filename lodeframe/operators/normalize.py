"""Reports of three scanners to findings: flatten, look up, filter, normalise, prove, assemble, summarise."""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe import schemas as S
from lodeframe.functions import scalars as X
from lodeframe.sources.json_parts import Cutter
from lodeframe.storage import BROADCAST_ROWS, checkpointed, fresh, numbered, small, stored

VERSION = "1.0.0"
#: How raw sources name the three formats, and a rule's place.
FORMATS = {"semgrep": "semgrep-json", "codeql": "codeql-sarif", "zap": "zap-json"}
RULE_FORMAT = "codeql-sarif-rule"
#: What is cut out of each format's documents, by paths to arrays.
PARTS = {
    "semgrep": {"result": [("results",)]},
    "zap": {"alert": [("site", "*", "alerts"), ("site", "alerts")], "instance": [("site", "*", "alerts", "*", "instances"), ("site", "alerts", "*", "instances")]},
    "codeql": {"result": [("runs", "*", "results")], "rule": [("runs", "*", "tool", "driver", "rules")], "artifact": [("runs", "*", "artifacts")]},
}
#: Alerts, which hold texts, that may be sent to all tasks.
BROADCAST_ALERTS = 20_000
#: Characters of the longest report for which results stay where their report is read.
WHOLE_REPORT = 16 << 20
#: What a raw row has of its place in its report.
PLACE = ("report_path", "pointer", "position", "rule_pointer")
#: Lines of a file that are gathered in one row, for context.
CONTEXT_BLOCK = 64


def _texts(raw: Column) -> Column:
    """A field that holds one text or a list of texts, read as text."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _rows(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return df.select("report_path", "tool", *[fields.get(k, _none(t)).cast(t).alias(k) for k, t in RAW.items()])


#: What all three formats are flattened to, one row per result.
RAW = {
    "pointer": "string", "position": "bigint", "fit": "boolean", "rule_id": "string", "rule_reference": "string", "rule_name": "string",
    "native_severity": "string", "native_confidence": "string", "title": "string", "description": "string", "solution": "string",
    "categories": "array<string>", "cwe_raw": "array<string>", "owasp_raw": "array<string>", "wasc_raw": "array<string>", "reference_text": "array<string>",
    "kind": "string", "path_raw": "string", "artifact_index": "int", "run": "int", "rule_index": "int", "start_line": "int", "start_column": "int",
    "end_line": "int", "end_column": "int", "uri": "string", "method": "string", "parameter": "string", "snippet": "string", "matched": "string",
    "note": "string", "attack": "string", "native_fp": "string", "line_hash": "string", "column_fp": "string", "rule_pointer": "string",
    "matched_contents": "array<struct<name:string,content:string>>", "related": "array<struct<id:int,message:string,path:string,line:int>>",
    "flow": f"array<{S.FLOW}>",
}


def _node(step: Column, path: Column, line: Column, column: Column, content: Column, message: Column) -> Column:
    positive = lambda c: F.when(c.cast("int") >= 1, c.cast("int"))
    values = {"path": X.code_path(path), "line": positive(line), "column": positive(column), "content": X.text_or_null(content), "message": X.text_or_null(message)}
    node = F.struct(step.cast("int").alias("step_index"), *[v.alias(k) for k, v in values.items()])
    # in a list of one, so that each value is made once
    return F.try_element_at(F.filter(F.array(node), lambda n: F.coalesce(*[n[k].cast("string") for k in values]).isNotNull()), F.lit(1))


def matched_contents(metavars: Column) -> Column:
    """A map of variables to an array by name; contents may be null."""
    return F.array_sort(F.transform(F.map_entries(metavars), lambda e: F.struct(e["key"].alias("name"), e["value"]["abstract_content"].alias("content"))))


def related_context(related: Column) -> Column:
    """Related locations, each with id, message, path and line."""
    return F.transform(related, lambda r: F.struct(r["id"].alias("id"), r["message"]["text"].alias("message"), X.code_path(r["physicalLocation"]["artifactLocation"]["uri"]).alias("path"), r["physicalLocation"]["region"]["startLine"].alias("line")))


def _taint_flow(trace: Column) -> Column:
    """N20 for the first tool: source, the steps that are not empty, sink; without source or sink there is no flow."""

    def end(raw: Column, step: Column) -> Column:
        at = lambda p: F.get_json_object(raw, p)
        return _node(step, at("$[1][0].path"), at("$[1][0].start.line"), at("$[1][0].start.col"), at("$[1][1]"), _none("string"))

    raw = F.coalesce(trace["intermediate_vars"], F.array().cast("array<struct<location:struct<path:string,start:struct<line:int,col:int>>,content:string>>"))
    nodes = F.filter(F.transform(raw, lambda v: _node(F.lit(0), v["location"]["path"], v["location"]["start"]["line"], v["location"]["start"]["col"], v["content"], _none("string"))), lambda n: n.isNotNull())
    steps = F.transform(nodes, lambda n, i: n.withField("step_index", (i + 1).cast("int")))
    def flow(own: Column) -> Column:
        source, sink = end(trace["taint_source"], F.lit(0)), end(trace["taint_sink"], F.size(own) + 1)
        return F.struct(F.lit("taint").alias("kind"), F.lit("semgrep").alias("engine"), source.alias("source"), own.alias("steps"), sink.alias("sink"))

    # lists of one, so that steps and nodes are made once
    whole = F.filter(F.transform(F.array(steps), lambda own: F.array(flow(own))), lambda f: f[0]["source"].isNotNull() & f[0]["sink"].isNotNull())
    return F.when(trace["taint_source"].isNotNull() & trace["taint_sink"].isNotNull(), F.try_element_at(whole, F.lit(1)))


def _thread_flows(flows: Column) -> Column:
    """N20 for the third tool: of each thread flow the first node is the source, the last the sink, steps keep their index."""
    threads = F.flatten(F.transform(flows, lambda f: f["threadFlows"]))

    def one(thread: Column) -> Column:
        at = lambda loc: loc["location"]["physicalLocation"]
        nodes = F.filter(F.transform(thread["locations"], lambda loc, i: _node(i, at(loc)["artifactLocation"]["uri"], at(loc)["region"]["startLine"], at(loc)["region"]["startColumn"], at(loc)["region"]["snippet"]["text"], loc["location"]["message"]["text"])), lambda n: n.isNotNull())
        size = F.size(nodes)
        steps = F.when(size > 2, F.slice(nodes, F.lit(2), F.greatest(size - 2, F.lit(0)))).otherwise(F.array().cast(f"array<{S.NODE}>"))
        return F.when(size >= 2, F.struct(F.lit("path").alias("kind"), F.lit("codeql").alias("engine"), F.try_element_at(nodes, F.lit(1)).alias("source"), steps.alias("steps"), F.try_element_at(nodes, F.lit(-1)).alias("sink")))

    kept = F.filter(F.transform(threads, one), lambda f: f.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def flatten_semgrep(reports: DataFrame) -> DataFrame:
    """One row per result; a result needs a rule, a path and a start line of 1 or more to be fit."""
    return _semgrep_rows(reports.where("tool = 'semgrep'").withColumn("d", F.from_json("doc", S.SEMGREP)).select("report_path", "tool", F.posexplode("d.results").alias("i", "r")))


def _semgrep_rows(r: DataFrame) -> DataFrame:
    """Of (report_path, tool, i, r): results and their places."""
    x, m = F.col("r.extra"), F.col("r.extra.metadata")
    classes = X.sorted_unique(_texts(m["vulnerability_class"]))
    return _rows(r, {
        "pointer": F.concat(F.lit("/results/"), "i"), "position": F.col("i"), "rule_id": X.text_or_null(F.col("r.check_id")), "path_raw": F.col("r.path"),
        "fit": X.text_or_null(F.col("r.check_id")).isNotNull() & X.code_path(F.col("r.path")).isNotNull() & (F.coalesce(F.col("r.start.line"), F.lit(0)) >= 1),
        "rule_name": F.col("r.check_id"), "native_severity": x["severity"], "native_confidence": m["confidence"], "title": F.try_element_at(classes, F.lit(1)),
        "description": x["message"], "solution": x["fix"], "categories": _texts(m["category"]), "cwe_raw": _texts(m["cwe"]), "owasp_raw": _texts(m["owasp"]),
        "reference_text": _texts(m["references"]), "kind": F.lit("code"), "start_line": F.col("r.start.line"), "start_column": F.col("r.start.col"),
        "end_line": F.coalesce(F.col("r.end.line"), F.col("r.start.line")), "end_column": F.col("r.end.col"), "snippet": x["lines"], "native_fp": X.text_or_null(x["fingerprint"]),
        "matched_contents": matched_contents(x["metavars"]), "flow": _taint_flow(x["dataflow_trace"]),
    })


def zap_alerts(reports: DataFrame) -> DataFrame:
    """Alerts with their places; a site may be one object or a list of them."""
    raw = F.get_json_object("doc", "$.site")
    many = F.ltrim(raw).startswith("[")
    sites = F.when(many, F.from_json(raw, f"array<{S.ZAP_SITE}>")).otherwise(F.array(F.from_json(raw, S.ZAP_SITE)))
    d = reports.where("tool = 'zap'").select("report_path", "tool", F.when(many, True).otherwise(False).alias("listed"), F.posexplode(sites).alias("s", "site"))
    return d.select("report_path", "tool", "listed", "s", F.posexplode("site.alerts").alias("a", "alert"))


def flatten_zap(reports: DataFrame) -> DataFrame:
    """One row per instance; plugin and URI are required; other information falls back to the alert's."""
    alerts = zap_alerts(reports).withColumns({"description": plain_text(F.col("alert.desc")), "solution": plain_text(F.col("alert.solution"))})
    return _zap_rows(alerts.select("*", F.posexplode("alert.instances").alias("i", "n")))


def _zap_rows(r: DataFrame) -> DataFrame:
    """Of (report_path, tool, listed, s, a, alert, description, solution, i, n): instances with their alerts, and places."""
    a, n = F.col("alert"), F.col("n")
    site = F.when(F.col("listed"), F.concat(F.lit("/site/"), "s")).otherwise(F.lit("/site"))
    plugin = X.text_or_null(a["pluginid"])
    return _rows(r, {
        "pointer": F.concat(site, F.lit("/alerts/"), "a", F.lit("/instances/"), "i"), "position": (F.col("s").cast("bigint") * 10**6 + F.col("a")) * 10**6 + F.col("i"), "rule_id": plugin,
        "rule_reference": X.text_or_null(a["alertRef"]), "rule_name": F.coalesce(X.text_or_null(a["name"]), X.text_or_null(a["alert"])), "fit": plugin.isNotNull() & X.text_or_null(n["uri"]).isNotNull(),
        "native_severity": a["riskcode"], "native_confidence": a["confidence"], "title": X.text_or_null(a["name"]), "description": F.col("description"), "solution": F.col("solution"),
        "cwe_raw": F.array(a["cweid"]), "wasc_raw": F.array(a["wascid"]), "reference_text": F.array(a["reference"]), "kind": F.lit("http"), "uri": X.text_or_null(n["uri"]),
        "method": F.upper(X.text_or_null(n["method"])), "parameter": X.text_or_null(n["param"]), "matched": X.text_or_null(n["evidence"]),
        "note": F.coalesce(X.text_or_null(n["otherinfo"]), X.text_or_null(a["otherinfo"])), "attack": X.text_or_null(n["attack"]),
    })


def sarif_runs(reports: DataFrame) -> DataFrame:
    d = reports.where("tool = 'codeql'").withColumn("d", F.from_json("doc", S.SARIF)).where("d.version = '2.1.0'")
    return d.select("report_path", "tool", F.posexplode("d.runs").alias("run", "r"))


def flatten_sarif(reports: DataFrame) -> DataFrame:
    """One row per result of each run; the first location counts. N4 and N5 add rules and artifacts."""
    return _sarif_rows(sarif_runs(reports).select("report_path", "tool", "run", F.posexplode("r.results").alias("i", "x")))


def _sarif_rows(r: DataFrame) -> DataFrame:
    """Of (report_path, tool, run, i, x): results and their places."""
    at = F.try_element_at(F.col("x.locations"), F.lit(1))["physicalLocation"]
    region = at["region"]
    prints = F.coalesce(F.col("x.partialFingerprints"), F.create_map().cast("map<string,string>"))
    return _rows(r, {
        "pointer": F.concat(F.lit("/runs/"), "run", F.lit("/results/"), "i"), "position": F.col("run").cast("bigint") * 10**6 + F.col("i"), "run": F.col("run"), "rule_id": X.text_or_null(F.col("x.ruleId")),
        "rule_index": F.col("x.ruleIndex"), "fit": X.text_or_null(F.col("x.ruleId")).isNotNull() & (F.coalesce(region["startLine"], F.lit(0)) >= 1), "description": F.col("x.message.text"),
        "kind": F.lit("code"), "path_raw": X.text_or_null(at["artifactLocation"]["uri"]), "artifact_index": at["artifactLocation"]["index"], "start_line": region["startLine"],
        "start_column": region["startColumn"], "end_line": F.coalesce(region["endLine"], region["startLine"]), "end_column": region["endColumn"],
        "snippet": F.coalesce(X.text_or_null(region["snippet"]["text"]), X.text_or_null(at["contextRegion"]["snippet"]["text"])),
        "line_hash": X.text_or_null(F.try_element_at(prints, F.lit("primaryLocationLineHash"))), "column_fp": X.text_or_null(F.try_element_at(prints, F.lit("primaryLocationStartColumnFingerprint"))),
        "related": related_context(F.col("x.relatedLocations")), "flow": _thread_flows(F.col("x.codeFlows")),
    })


def attach_rule_descriptor(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results (report_path, run, rule_index, rule_id) with columns rule of rules (report_path, run, index, id, rule).

    The rule at the index counts if it has the result's id; else the last one with that id; rule is null without any.
    rule_place is the index of the rule that counts.
    """
    by_place = rules.select("report_path", "run", F.col("index").alias("rule_index"), F.col("id").alias("at_id"), F.col("rule").alias("at_rule"))
    by_id = rules.groupBy("report_path", "run", F.col("id").alias("rule_id")).agg(F.max_by("rule", "index").alias("id_rule"), F.max("index").alias("id_place"))
    out = results.join(by_place, ["report_path", "run", "rule_index"], "left").join(by_id, ["report_path", "run", "rule_id"], "left")
    here = F.col("at_id") == F.col("rule_id")
    own = {"rule": F.when(here, F.col("at_rule")).otherwise(F.col("id_rule")), "rule_place": F.when(here, F.col("rule_index")).otherwise(F.col("id_place"))}
    return out.withColumns(own).drop("at_id", "at_rule", "id_rule", "id_place")


def resolve_artifact_uri(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """path_raw, or else the URI of the artifact (report_path, run, artifact_index, artifact_uri) that is pointed to."""
    return results.join(artifacts, ["report_path", "run", "artifact_index"], "left").withColumn("path_raw", F.coalesce("path_raw", "artifact_uri")).drop("artifact_uri")


def sarif_results(reports: DataFrame) -> DataFrame:
    """N3 to N5 in one: results with the title, severity, precision, tags and description of their rules."""
    runs = sarif_runs(reports)
    rules = runs.select("report_path", "run", F.posexplode("r.tool.driver.rules").alias("index", "rule")).withColumn("id", F.col("rule.id"))
    artifacts = runs.select("report_path", "run", F.posexplode("r.artifacts").alias("artifact_index", "a")).select("report_path", "run", "artifact_index", F.col("a.location.uri").alias("artifact_uri"))
    return _looked_up(flatten_sarif(reports), rules, artifacts)


def _looked_up(results: DataFrame, rules: DataFrame, artifacts: DataFrame) -> DataFrame:
    rows = resolve_artifact_uri(attach_rule_descriptor(results, rules), artifacts)
    p = F.col("rule.properties")
    filled = {
        "rule_name": p["name"], "title": X.text_or_null(F.col("rule.shortDescription.text")), "native_severity": p["security-severity"], "native_confidence": p["precision"],
        "cwe_raw": F.filter(p["tags"], lambda t: t.rlike("(?i)cwe")), "categories": p["tags"], "description": F.coalesce(X.text_or_null(F.col("description")), X.text_or_null(F.col("rule.fullDescription.text"))),
        "fit": F.col("fit") & X.code_path(F.col("path_raw")).isNotNull(),
        "rule_pointer": F.when(F.col("rule_place").isNotNull(), F.concat(F.lit("/runs/"), "run", F.lit("/tool/driver/rules/"), "rule_place")),
    }
    return rows.withColumns(filled).withColumn("missing_rule", F.col("rule").isNull()).select("report_path", "tool", *RAW, "missing_rule")


def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def unescape(c: Column) -> Column:
    """HTML entities decoded; there are some two thousand names, so this is an Arrow batch, and only for texts with &."""
    decode = F.pandas_udf(_unescape, "string").asNondeterministic()  # so that it is not moved into lambdas
    return F.when(c.contains("&"), decode(F.when(c.contains("&"), c))).otherwise(c)


def plain_text(c: Column) -> Column:
    """Entities decoded, tags and control characters to spaces, white space collapsed; blank texts are null."""
    text = F.regexp_replace(F.regexp_replace(unescape(c), "<[^>]+>", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return X.text_or_null(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def filter_scope(instances: DataFrame, target: Column, uri: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Rows whose URI has the target's origin, and the others; an unfit target rejects all."""
    mine, theirs = X.http_origin(F.col(uri)), X.http_origin(target)
    rows = instances.withColumn("in_scope", F.coalesce(mine == theirs, F.lit(False)))
    return rows.where("in_scope").drop("in_scope"), rows.where("not in_scope").drop("in_scope")


def rejected_summary(rejected: DataFrame, by: list[str], uri: str = "uri", most: int = 100) -> DataFrame:
    """Per `by` the rejected rows, how many distinct cleaned URIs, the first `most` of those, whether some are not shown.

    Distinct URIs are ranked in windows, so only those that are shown are gathered.
    """
    each = rejected.select(*by, X.sanitized_uri(F.col(uri)).alias("u")).groupBy(*by, "u").agg(F.count("*").alias("n"))
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("u")))
    out = ranked.groupBy(*by).agg(F.sum("n").alias("external_count"), F.count("*").alias("unique_count"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("u")))).alias("uris"))
    return out.withColumn("truncated", F.col("unique_count") > most)


def fingerprint() -> Column:
    """Over the columns of RAW and target_name, path, endpoint; absent keys and null keys differ."""
    common = {"target": F.col("target_name"), "tool": F.col("tool")}
    code = common | {"rule_id": F.col("rule_id"), "path": F.col("path")}
    lines = {"start_line": F.col("start_line")}
    column = {"start_column": F.col("start_column")}
    own = {"native_fingerprint": F.col("native_fp")}
    hashed, printed = {"primary_location_line_hash": F.col("line_hash")}, {"primary_location_start_column_fingerprint": F.col("column_fp")}
    both = lines | {"end_line": F.col("end_line")}
    fp = X.json_text  # the text by case, then one hash
    has = lambda c: F.col(c).isNotNull()
    zap = common | {"plugin_id": F.col("rule_id"), "alert_ref": F.col("rule_reference"), "method": F.col("method"), "endpoint": F.col("endpoint"), "parameter": F.col("parameter")}
    text = (
        F.when(F.col("tool") == "zap", fp(zap))
        .when((F.col("tool") == "semgrep") & has("native_fp"), fp(code | own))
        .when(F.col("tool") == "semgrep", fp(code | lines | column))
        .when(has("line_hash") & has("column_fp"), fp(code | hashed | printed))
        .when(has("line_hash"), fp(code | hashed | column))
        .when(has("column_fp"), fp(code | both | printed))
        .otherwise(fp(code | both | column))
    )
    return X.sha256_of("fp", "v1", text)


def group_key() -> Column:
    """One payload for all tools; a rule id counts only for code without a CWE."""
    http = F.col("tool") == "zap"
    place = F.struct(F.when(~http, F.col("path")).alias("path"), F.when(~http, F.col("start_line")).alias("start_line"))
    return X.canonical_sha256("grp", "v1", {
        "target": F.col("target_name"), "cwe_ids": F.col("cwe_ids"), "location": place, "method": F.when(http, F.col("method")), "canonical_endpoint": F.when(http, F.col("endpoint")),
        "parameter": F.when(http, F.col("parameter")), "fallback_rule_id": F.when(~http & (F.size("cwe_ids") == 0), F.col("rule_id")),
        "rule_reference": F.when(http, F.coalesce("rule_reference", "rule_id")),
    })


def evidence_quality() -> Column:
    """From snippet, matched, note, context, related and flow."""
    context = F.col("has_context")
    codeql = F.when(F.col("snippet").isNotNull(), "direct").when(context, "enriched").when((F.size("related") > 0) | F.col("flow").isNotNull(), "inferred").otherwise("none")
    zap = F.when(F.col("matched").isNotNull(), "direct").when(F.col("note").isNotNull(), "inferred").otherwise("none")
    return F.when(F.col("tool") == "zap", zap).when(F.col("tool") == "semgrep", F.when(F.col("snippet").isNotNull(), "direct").otherwise("none")).otherwise(codeql)


def attach_source_context(findings: DataFrame, source_lines: DataFrame, radius: int = 5) -> DataFrame:
    """context_before, context_after and the matched lines from source_lines (path, line, content).

    A range join as an equal one: lines are gathered in blocks, and a finding asks for the few blocks that its window of
    lines is in; its columns go with it, so equal findings stay apart. Both sides are sorted: how many blocks are asked for
    is not in Spark's estimates, by which it would send all of them to all tasks. Paths must be relative.
    """
    rid, block, xs, own = fresh(findings, "rid", "block", "xs", "own")
    start, stop = F.col("start_line"), F.coalesce("end_line", "start_line")
    asks = F.coalesce((F.col("kind") == "code") & F.col("path").isNotNull() & (start >= 1), F.lit(False))
    low, high = F.greatest(start - radius, F.lit(1)), F.greatest(stop, "start_line") + radius
    of = lambda line: F.floor(line / CONTEXT_BLOCK).cast("int")
    asked = findings.where(asks).withColumn(rid, F.monotonically_increasing_id()).withColumn(block, F.explode(F.sequence(of(low), of(high))))
    blocks = source_lines.groupBy("path", of(F.col("line")).alias(block)).agg(F.collect_list(F.struct("line", "content")).alias(xs))
    near = F.filter(xs, lambda x: x["line"].between(low, high))
    got = asked.hint("merge").join(blocks, ["path", block], "left").select(rid, F.struct(*findings.columns).alias(own), F.coalesce(near, F.array().cast(blocks.schema[xs].dataType)).alias(xs))
    each = got.groupBy(rid).agg(F.first(own).alias(own), F.array_sort(F.flatten(F.collect_list(xs))).alias(xs)).select(f"{own}.*", F.when(F.size(xs) > 0, F.col(xs)).alias(xs))
    side = lambda cond: F.filter(xs, cond)
    told = each.select(
        *findings.columns, side(lambda x: x["line"] < start).alias("context_before"), side(lambda x: x["line"] > stop).alias("context_after"),
        F.array_join(F.transform(side(lambda x: x["line"].between(start, stop)), lambda x: x["content"]), "\n").alias("source_text"),
    )
    none = {"context_before": told.schema["context_before"].dataType, "context_after": told.schema["context_after"].dataType, "source_text": "string"}
    return told.unionByName(findings.where(~asks).select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line, content) of whole texts (path, text)."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "content")).select("path", (F.col("at") + 1).cast("int").alias("line"), "content")


def validate(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all checks, and the others with the name of the first check that fails, in the given order."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda n: n.isNotNull())
    rows = df.withColumn("error", F.try_element_at(failed, F.lit(1)))
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def finding_checks() -> dict[str, Column]:
    c = F.col
    code, http = c("location.kind") == "code", c("location.kind") == "http"
    return {
        "finding_id": c("finding_id").rlike("^fnd_[0-9a-f]{32}$"), "fingerprint": c("fingerprint").rlike("^fp_sha256:v1:[0-9a-f]{64}$"), "group_key": c("group_key").rlike("^grp_sha256:v1:[0-9a-f]{64}$"),
        "severity": c("severity").isin("unknown", *X.SEVERITIES), "confidence": c("confidence").isin("unknown", *X.CONFIDENCES), "cwe_ids": F.forall("cwe_ids", lambda x: x.rlike("^CWE-[1-9][0-9]*$")) & (F.size(F.array_distinct("cwe_ids")) == F.size("cwe_ids")),
        "location": (code & c("location.path").isNotNull() & (c("location.start_line") >= 1)) | (http & c("location.uri").isNotNull()), "quality": c("evidence.quality").isin("direct", "enriched", "inferred", "none"),
        "target": c("target.name").isNotNull(), "scan": c("scan.run_id").isNotNull() & c("scan.scanned_at").isNotNull(),
    }


def document_parts(reports: DataFrame) -> DataFrame:
    """(report_path, tool, kind, pointer, text) of reports held as whole texts (doc), cut as sources.json_parts cuts files.

    A document whose containers are not closed has no parts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, tool, doc in zip(batch["report_path"], batch["tool"], batch["doc"], strict=True):
                if not isinstance(doc, str) or tool not in PARTS:
                    continue
                cutter = Cutter({p: kind for kind, paths in PARTS[tool].items() for p in paths}, path, 0, False, [])
                rows = cutter.add(doc.encode()) + cutter.rest(False)
                if not cutter.level and not cutter.inside:
                    yield pd.DataFrame([(path, tool, kind, pointer, text) for _, _, kind, pointer, text, _ in rows], columns=["report_path", "tool", "kind", "pointer", "text"])

    return reports.select("report_path", "tool", "doc").mapInPandas(run, "report_path string, tool string, kind string, pointer string, text string")


def resolved(document: Column, tokens: Column) -> Column:
    """The value that JSON pointer tokens (escaped) lead to in a VARIANT, as a VARIANT; null where they lead nowhere. An index
    has no leading zeros; a JSON null is a value."""
    plain = F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def step(at: Column, token: Column) -> Column:
        index = F.when(token.rlike("^(?:0|[1-9][0-9]{0,8})$"), token.cast("int") + 1)
        return F.coalesce(F.try_element_at(at.try_cast("array<variant>"), index), F.try_element_at(at.try_cast("map<string,variant>"), token))

    return F.aggregate(plain, document, step)


def check_provenance(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of findings (report_path, pointer) whose pointer leads nowhere in the raw report.

    parts are what the reports' own text holds (json_parts or document_parts). A pointer is followed to the longest part that
    it goes through, which is a join of texts; the rest of it is resolved in that part's VARIANT. No document is held whole.
    """
    keys = findings.select("report_path", "pointer").where("pointer = '' OR startswith(pointer, '/')").distinct()
    tokens = F.split("pointer", "/", -1)  # the first is empty
    begins = F.explode(F.sequence(F.lit(1), F.size(tokens)))
    ways = keys.withColumn("n", begins).withColumn("part", F.array_join(F.slice(tokens, F.lit(1), F.col("n")), "/"))
    own = parts.select("report_path", F.col("pointer").alias("part"))
    longest = checkpointed(ways.join(own, ["report_path", "part"], "left_semi").groupBy("report_path", "pointer").agg(F.max("n").alias("n")))
    whole = longest.where(F.col("n") == F.size(tokens)).select("report_path", "pointer")
    rest = longest.where(F.col("n") < F.size(tokens)).withColumn("part", F.array_join(F.slice(tokens, F.lit(1), F.col("n")), "/"))
    texts = rest.join(parts.select("report_path", F.col("pointer").alias("part"), "text"), ["report_path", "part"])
    found = resolved(F.try_parse_json("text"), F.slice(tokens, F.col("n") + 1, F.size(tokens) - F.col("n")))
    inside = texts.where(found.isNotNull()).select("report_path", "pointer")
    return findings.join(whole.unionAll(inside).distinct(), ["report_path", "pointer"], "left_anti")


def source_pointers(findings: DataFrame) -> DataFrame:
    """(report_path, pointer) of all raw sources of findings, rules included, once each."""
    return findings.select(F.explode("raw_sources").alias("s")).select(F.col("s.report_path").alias("report_path"), F.col("s.json_pointer").alias("pointer")).distinct()


def finding_id(report_path: Column, pointer: Column) -> Column:
    """Stable, from where the finding stands."""
    return F.concat(F.lit("fnd_"), F.substring(F.sha2(F.concat_ws("|", report_path, pointer), 256), 1, 32))


def assemble_findings(rows: DataFrame, normalized_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Raw rows with the columns of scan metadata (meta) to the FINDING schema."""
    tool = F.col("tool")
    r = rows.withColumns({"target_name": F.col("meta.target.name"), "path": X.code_path(F.col("path_raw")), "endpoint": F.when(F.col("kind") == "http", X.endpoint(F.col("uri"))), "cwe_ids": X.cwe_ids(F.col("cwe_raw"))})
    for name, kind in (("has_context", "boolean"), ("context_before", f"array<{S.CONTEXT_LINE}>"), ("context_after", f"array<{S.CONTEXT_LINE}>")):
        if name not in r.columns:
            r = r.withColumn(name, F.lit(False) if kind == "boolean" else _none(kind))
    r = r.withColumns({"fingerprint": fingerprint(), "group_key": group_key(), "quality": evidence_quality()})
    excerpt = F.concat_ws(" ", "method", "uri")
    excerpt = F.when(F.col("kind") == "http", F.when(F.col("parameter").isNotNull(), F.concat(excerpt, F.lit(" (param: "), "parameter", F.lit(")"))).otherwise(excerpt))
    refs = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("reference_text", F.array().cast("array<string>")), lambda t: X.urls(F.coalesce(t, F.lit("")))))))
    c, st = F.col, F.struct
    kinds = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    out = r.select(
        F.lit("1.0").alias("schema_version"), finding_id(c("report_path"), c("pointer")).alias("finding_id"), "fingerprint", "group_key",
        st(tool.alias("name"), c("meta.cli_version").alias("version"), F.when(c("kind") == "http", "DAST").otherwise("SAST").alias("scan_type")).alias("tool"),
        st(c("meta.run_id").alias("run_id"), c("meta.pipeline_run_id").alias("pipeline_run_id"), c("meta.scanned_at").alias("scanned_at")).alias("scan"),
        st(*[c(f"meta.target.{n}").alias(n) for n in ("name", "version", "commit_sha", "base_url")]).alias("target"),
        st(c("rule_id").alias("id"), c("rule_reference").alias("reference_id"), c("rule_name").alias("name"), "native_severity", "native_confidence").alias("rule"),
        X.text_or_null(c("title")).alias("title"), X.text_or_null(c("description")).alias("description"), X.severity(tool, c("native_severity")).alias("severity"),
        X.confidence(tool, c("native_confidence")).alias("confidence"), X.text_or_null(c("solution")).alias("solution"), X.sorted_unique(c("categories")).alias("categories"), "cwe_ids",
        X.owasp_categories(F.coalesce(c("owasp_raw"), c("categories"))).alias("owasp_categories"), X.wasc_ids(c("wasc_raw")).alias("wasc_ids"), refs.alias("references"),
        st("kind", "path", "start_line", "start_column", "end_line", "end_column", "uri", "endpoint", "method", "parameter").alias("location"),
        st("kind", "snippet", "context_before", "context_after", "matched_contents", c("related").alias("related_context"), excerpt.alias("request_excerpt"), c("matched").alias("matched_evidence"),
           c("note").alias("context_note"), c("attack").alias("attack_payload"), "quality", F.when(c("quality") != "none", F.concat_ws(":", "report_path", "pointer")).alias("provenance"),
           F.lit(False).alias("redacted"), F.lit(False).alias("truncated")).alias("evidence"),
        c("flow").alias("data_flow"), st(F.lit(VERSION).alias("normalizer_version"), F.lit(normalized_at).alias("normalized_at")).alias("normalization"),
        F.array_compact(F.array(st(kinds[tool].alias("format"), "report_path", c("pointer").alias("json_pointer")), F.when(c("rule_pointer").isNotNull(), st(F.lit(RULE_FORMAT).alias("format"), "report_path", c("rule_pointer").alias("json_pointer"))))).alias("raw_sources"),
    )
    return out


#: The registry: a format's name to what flattens it.
TOOLS = {"semgrep": flatten_semgrep, "codeql": sarif_results, "zap": flatten_zap}


def normalize_all(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of all reports (report_path, tool, doc, meta), and a summary row per report.

    One unfit row fails its whole report, whose rows all go; other reports are not touched. Instances outside a target's
    origin are counted and dropped. A report without a document or sidecar is skipped.
    """
    rows, known = _whole_rows(reports)
    return _normalized(rows, known)


def _whole_rows(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows of reports held as whole texts, and (report_path, tool, read, meta). A report is one row until it is parsed,
    so the results of long ones are dealt out before the rest is done."""
    ready = reports.where("doc is not null and meta is not null")
    rows = reduce(DataFrame.unionByName, [flatten(ready).select("report_path", "tool", *RAW) for flatten in TOOLS.values()])
    if (ready.agg(F.max(F.length("doc"))).first()[0] or 0) > WHOLE_REPORT:
        rows = rows.repartition(int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions")), "report_path", "pointer")
    return rows, reports.select("report_path", "tool", F.col("doc").isNotNull().alias("read"), "meta")


def _place(name: str) -> Column:
    return F.regexp_extract("pointer", f"/{name}/([0-9]+)", 1).try_cast("int")


def flatten_parts(parts: DataFrame) -> DataFrame:
    """N1 to N5 for parts (report_path, tool, kind, pointer, text): the same rows as of whole documents, however large those are."""
    of = lambda tool, kind: parts.where((F.col("tool") == tool) & (F.col("kind") == kind))
    read = lambda tool, kind, schema, name: of(tool, kind).select("report_path", "tool", "pointer", F.from_json("text", schema).alias(name))
    semgrep = _semgrep_rows(read("semgrep", "result", S.SEMGREP_RESULT, "r").select("report_path", "tool", _place("results").alias("i"), "r"))
    # an alert's texts are cleaned once, then joined to its instances
    alerts = read("zap", "alert", S.ZAP_ALERT, "alert").withColumns({"description": plain_text(F.col("alert.desc")), "solution": plain_text(F.col("alert.solution"))})
    alerts = checkpointed(alerts.withColumnRenamed("pointer", "alert_pointer").drop("tool"))
    n = read("zap", "instance", S.ZAP_INSTANCE, "n").withColumn("alert_pointer", F.regexp_replace("pointer", "/instances/[0-9]+$", ""))
    n = n.withColumns({"listed": F.col("pointer").rlike("^/site/[0-9]"), "s": F.coalesce(_place("site"), F.lit(0)), "a": _place("alerts"), "i": _place("instances")})
    zap = _zap_rows(n.join(small(alerts, alerts.count(), BROADCAST_ALERTS), ["report_path", "alert_pointer"]))
    known = of("codeql", "").where(F.from_json("text", "version string")["version"] == "2.1.0").select("report_path")
    run = lambda kind, schema, name: read("codeql", kind, schema, name).join(known, "report_path", "left_semi").withColumn("run", _place("runs"))
    results = _sarif_rows(run("result", S.SARIF_RESULT, "x").withColumn("i", _place("results")))
    rules = run("rule", S.SARIF_RULE, "rule").withColumn("index", _place("rules")).select("report_path", "run", "index", "rule", F.col("rule.id").alias("id"))
    artifacts = run("artifact", S.SARIF_ARTIFACT, "a").select("report_path", "run", _place("artifacts").alias("artifact_index"), F.col("a.location.uri").alias("artifact_uri"))
    sarif = _looked_up(results, rules, artifacts)
    return reduce(DataFrame.unionByName, [x.select("report_path", "tool", *RAW) for x in (semgrep, sarif, zap)])


def normalize_parts(parts: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """normalize_all() for reports of any size: parts as in flatten_parts, reports (report_path, tool, fit, meta).

    A report whose containers are not closed, or with a part that is not JSON, counts as not read: it is skipped.
    """
    bad = parts.where(F.try_parse_json("text").isNull() | ((F.col("kind") == "") & ~F.ltrim("text").startswith("{"))).select("report_path").distinct().withColumn("bad", F.lit(True))
    known = checkpointed(reports.join(bad, "report_path", "left").select("report_path", "tool", (F.col("fit") & F.col("bad").isNull()).alias("read"), "meta"))
    ready = parts.join(small(known, known.count()).where("read and meta is not null").select("report_path"), "report_path", "left_semi")
    return _normalized(flatten_parts(ready), known)


def _in_scope(rows: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw rows with meta and in_scope, parsed once and stored; those of reports without unfit rows, in scope)."""
    # a target's origin is read once a report, an instance's once a row
    targets = checkpointed(reports.where("read and meta is not null").select("report_path", "meta", X.http_origin(F.col("meta.target.base_url")).alias("origin")))
    o = F.col("origin")
    host = F.when(o["host"].contains(":"), F.concat(F.lit("["), o["host"], F.lit("]"))).otherwise(o["host"])
    targets = targets.withColumn("begins", F.concat(o["scheme"], F.lit("://"), host, F.lit(":"), o["port"], F.lit("/")))
    rows = rows.join(small(targets, targets.count()), "report_path")
    rows = rows.withColumn("fit", F.col("fit") & ((F.col("tool") != "zap") | F.col("origin").isNotNull()))
    # most URIs begin with their target's origin, spelt out; others are taken apart
    in_scope = F.when(F.col("uri").startswith(F.col("begins")), True).otherwise(F.coalesce(X.http_origin(F.col("uri")) == o, F.lit(False)))
    rows = rows.withColumn("in_scope", (F.col("tool") != "zap") | in_scope).drop("origin", "begins")
    rows = stored(rows)
    # reports with unfit rows are counted first, so that all other rows stay where they are
    failed = checkpointed(rows.where("not fit").select("report_path").distinct())
    n = failed.count()
    kept = rows.join(small(failed, n), "report_path", "left_anti") if n else rows
    return rows, kept.where("in_scope")


def first_findings(reports: DataFrame) -> DataFrame:
    """normalize_all() for what looks at findings but not at how often they come: of findings that are equal in all but their
    place the one with the least finding_id, with row_idx, its place among all findings by finding_id, from 0.

    Rows are told apart before their texts are made and hashed; all that is done for every row is its finding_id.
    """
    rows = _in_scope(*_whole_rows(reports))[1]
    named = rows.withColumn("first_id", finding_id(F.col("report_path"), F.col("pointer")))
    same = [c for c in rows.columns if c not in (*PLACE, "fit", "in_scope")]
    first = named.groupBy(*same).agg(F.min(F.struct("first_id", *PLACE)).alias("first"))
    findings = checkpointed(assemble_findings(first.select(*same, *[f"first.{c}" for c in PLACE])))
    return ranked_among(findings, named.select(F.col("first_id").alias("finding_id")), "finding_id")


def ranked_among(some: DataFrame, every: DataFrame, name: str, sent_rows: int = BROADCAST_ROWS) -> DataFrame:
    """some with row_idx: how many texts in the one column of every are less than some's own; every has all of some's, once.

    A few are sent to all tasks, which count what is below them; else every is sorted into ranges and numbered.
    """
    n = some.count()
    if n > sent_rows:
        return some.join(numbered(every, [], name).select(name, (F.col("at") - 1).alias("row_idx")), name)
    # as bytes, whose order is that of Spark's texts; none ends in a zero byte, which NumPy would drop
    bounds = np.array(sorted(r[0].encode() for r in some.select(name).collect()), dtype=bytes)
    sent = some.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = sent.value, np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            texts = np.array([t.encode() for t in batch.column(0).to_pylist()], dtype=bytes)
            counts += np.bincount(np.searchsorted(own, texts, side="right"), minlength=len(counts))
        below = np.cumsum(counts)[:-1]
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in own.tolist()], pa.string()), pa.array(below)], names=[name, "row_idx"])

    places = every.mapInArrow(run, f"{name} string, row_idx long").groupBy(name).agg(F.sum("row_idx").alias("row_idx"))
    return some.join(small(checkpointed(places), n), name)


def _normalized(rows: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is the same for reports of any size; reports (report_path, tool, read, meta)."""
    rows, kept = _in_scope(rows, reports)
    findings = assemble_findings(kept)
    counts = rows.groupBy("report_path").agg(F.count("*").alias("raw_count"), F.count_if("in_scope").alias("in_scope_count"), F.count_if(F.expr("not fit")).alias("unfit_count"))
    status = F.when(~F.col("read") | F.col("meta").isNull(), "skipped").when(F.col("unfit_count") > 0, "failed").when(F.col("raw_count") > F.col("in_scope_count"), "partial").otherwise("success")
    summary = reports.join(counts, "report_path", "left").select("report_path", "tool", status.alias("status"), F.coalesce("raw_count", F.lit(0)).alias("raw_count"), F.when(status.isin("failed", "skipped"), 0).otherwise(F.coalesce("in_scope_count", F.lit(0))).alias("written_count"))
    return findings, summary


def summary_counts(findings: DataFrame, by: str | Column) -> DataFrame:
    """Rows, distinct fingerprints and collisions (rows beyond the first of a fingerprint)."""
    return findings.groupBy(by).agg(F.count("*").alias("written"), F.count_distinct("fingerprint").alias("fingerprints"), (F.count("*") - F.count_distinct("fingerprint")).alias("collisions"))


def sarif_diagnostics(reports: DataFrame) -> DataFrame:
    """Per report the extraction and parse errors among tool notifications, and the files that they name."""
    n = sarif_runs(reports).select("report_path", F.explode("r.invocations").alias("v")).select("report_path", F.explode("v.toolExecutionNotifications").alias("n"))
    kind = F.lower(F.col("n.descriptor.id"))
    each = n.select("report_path", kind.alias("kind"), F.explode_outer("n.locations").alias("at"))
    files = F.count_distinct("at.physicalLocation.artifactLocation.uri")
    counts = n.groupBy("report_path").agg(F.count_if(kind.contains("extraction")).alias("extraction_errors"), F.count_if(kind.contains("parse")).alias("parse_errors"))
    return counts.join(each.groupBy("report_path").agg(files.alias("files")), "report_path")


def glob_regex(patterns: list[str]) -> str:
    """Anchored alternatives of gitignore-style globs: **/ any folders, ** anything, * within a name, ? one character."""
    out = []
    for p in patterns:
        text = "".join("\x00" if x == "**/" else "\x01" if x == "**" else x for x in _glob_parts(p.lstrip("/")))
        body = "".join({"\x00": "(?:.*/)?", "\x01": ".*", "*": "[^/]*", "?": "[^/]"}.get(ch, "\\" + ch if ch in ".+()[]{}^$|\\" else ch) for ch in text)
        out.append(body + (".*" if p.endswith("/") else ""))
    return "^(?:" + "|".join(out) + ")$" if out else "^(?!)"


def _glob_parts(p: str) -> list[str]:
    parts, i = [], 0
    while i < len(p):
        size = 3 if p.startswith("**/", i) else 2 if p.startswith("**", i) else 1
        parts.append(p[i : i + size])
        i += size
    return parts


def scope_policy(paths: DataFrame, includes: list[str], excludes: list[str], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Paths that an include and no exclude matches, and the others."""
    ok = F.coalesce(F.col(path).rlike(glob_regex(includes)) & ~F.col(path).rlike(glob_regex(excludes)), F.lit(False))
    return paths.where(ok), paths.where(~ok)


def validate_scan_metadata(reports: DataFrame) -> DataFrame:
    """One row per report and failed check of its sidecar (meta)."""
    m = "meta."
    checks = {
        "meta": F.col("meta").isNotNull(), "run_id": X.text_or_null(F.col(m + "run_id")).isNotNull(), "target": X.text_or_null(F.col(m + "target.name")).isNotNull(),
        "scanned_at": F.col(m + "scanned_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"), "document": F.ltrim("doc").startswith("{"),
        "base_url": (F.col("tool") != "zap") | X.http_origin(F.col(m + "target.base_url")).isNotNull(), "path": F.col(m + "report_path").isNull() | (F.col(m + "report_path") == F.col("report_path")),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    return reports.select("report_path", "tool", F.explode(failed).alias("error"))
