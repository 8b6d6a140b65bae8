"""Audit records, risk, bursts, approvals and trace spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import guard as G
from lodeframe.functions.scalars import strip

#: Approval states, markers that are counted with their labels (two of them are never written by masking),
#: payload categories of medium risk, allowed methods.
APPROVALS = ("NOT_REQUIRED", "PENDING", "APPROVED", "REJECTED", "TIMED_OUT")
MARKERS = (
    ("[REDACTED_EMAIL]", "EMAIL"), ("[REDACTED_PASSWORD]", "PASSWORD"), ("[REDACTED_SECRET]", "SECRET_TOKEN"), ("[REDACTED_PHONE]", "PHONE"),
    ("[REDACTED_NATIONAL_ID]", "NATIONAL_ID"), ("[REDACTED_CREDIT_CARD]", "CREDIT_CARD"), ("[REDACTED_DB_URI]", "DATABASE_URI"),
)
PROBES = ("special_chars", "query_param_injection", "sql_injection_probes", "cross_site_scripting_probes")
METHODS = ("GET", "POST", "OPTIONS")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def audit_records(raw: DataFrame) -> DataFrame:
    """Raw (AUDIT_IN) to masked audit rows with a guardrails struct. Injection is tested on the unmasked body."""
    empty = F.create_map().cast("map<string,string>")
    kind = raw.schema["request_headers"].dataType
    body = F.coalesce("response_body_snippet", F.lit(""))
    rows = raw.select(
        "timestamp", F.coalesce(strip(F.col("endpoint")), F.lit("/")).alias("endpoint"), F.coalesce(F.upper(strip(F.col("method"))), F.lit("UNKNOWN")).alias("method"),
        F.coalesce("status_code", F.lit(0)).alias("status_code"), F.bround("duration_ms", 2).alias("duration_ms"),
        F.when(F.upper(strip(F.col("approval_status"))).isin(*APPROVALS), F.upper(strip(F.col("approval_status")))).otherwise("NOT_REQUIRED").alias("approval_status"),
        G.mask_value(F.coalesce("request_headers", empty), kind).alias("request_headers"), G.mask_value(F.coalesce("response_headers", empty), kind).alias("response_headers"),
        G.mask_text(body).alias("response_body_snippet"), G.injection_pattern(body).isNotNull().alias("injected"),
    )
    both = F.concat(F.col("response_body_snippet"), F.lit("\n"), F.to_json("request_headers"))
    rows = rows.withColumn("seen", both)
    counts = [occurrences(F.col("seen"), m) for m, _ in MARKERS]
    types = F.array_sort(F.array_compact(F.array(*[F.when(n > 0, label) for n, (_, label) in zip(counts, MARKERS, strict=True)])))
    guardrails = F.struct(
        F.col("seen").contains("[REDACTED").alias("redaction_applied"), types.alias("redacted_types"), sum(counts[1:], counts[0]).alias("redaction_count"),
        F.col("injected").alias("prompt_injection_detected"), F.when(F.col("injected"), "SUSPICIOUS_INJECTION_DETECTED").otherwise("NONE").alias("prompt_injection_risk"),
    )
    return rows.withColumn("guardrails", guardrails).drop("seen", "injected")


def request_risk(requests: DataFrame) -> DataFrame:
    """Method, payload_category, burst_count, oversized_payload -> risk_level, risk_factors, requires_approval, purpose."""
    method = F.coalesce(F.upper(strip(F.col("method"))), F.lit("UNKNOWN"))
    n = F.greatest(F.coalesce("burst_count", F.lit(1)), F.lit(1))
    big = F.coalesce("oversized_payload", F.lit(False))
    factors = F.array_compact(F.array(
        F.when(big, "oversized_payload"), F.when(n > 20, "burst_over_limit"), F.when(method == "POST", "writing_method"),
        F.when((n > 5) & (n <= 20), "burst"), F.when(F.lower(strip(F.col("payload_category"))).isin(*PROBES), "probing_payload"),
    ))
    level = F.when(big | (n > 20), "HIGH").when(F.size(factors) > 0, "MEDIUM").otherwise("LOW")
    purpose = F.when(big, "expect 413").when(n > 1, "expect 429").when(method == "POST", "audited write").when(method == "OPTIONS", "preflight").otherwise("read")
    return requests.withColumns({"risk_factors": factors, "risk_level": level, "requires_approval": level != "LOW", "purpose": purpose})


def method_policy(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with an allowed method, and for the others an audit row with status 405."""
    ok = F.coalesce(F.upper(strip(F.col("method"))).isin(*METHODS), F.lit(False))
    return requests.where(ok), requests.where(~ok).withColumn("status_code", F.lit(405))


def burst_stats(requests: DataFrame, by: str, order: str = "idx") -> DataFrame:
    """Per burst the counts by status, 429s, the place from 1 of the first 429, the last status, the total duration.

    Counts by status come first, so a burst of any length is a few rows from each task.
    """
    per = requests.groupBy(by, "status_code").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.sum("duration_ms").alias("ms"))
    out = per.groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status_code", "n")))).alias("status_counts"), F.coalesce(F.sum(F.when(F.col("status_code") == 429, F.col("n"))), F.lit(0)).alias("count_429"),
        F.min(F.when(F.col("status_code") == 429, F.col("first"))).alias("first_429"), F.max_by("status_code", "last").alias("last_status"), F.sum("ms").alias("total_ms"), F.sum("n").alias("requests"),
    )
    return out


def audit_view(audit: DataFrame, status_class: int | None = None, approval: str | None = None, n: int = 15) -> DataFrame:
    """The newest n rows of a class of statuses (2, 4, 5) and an approval state."""
    rows = audit if status_class is None else audit.where(F.floor(F.col("status_code") / 100) == status_class)
    rows = rows if approval is None else rows.where(F.col("approval_status") == approval)
    return rows.orderBy(F.col("timestamp").desc()).limit(n)


def approval_outcomes(actions: DataFrame, as_of: Column, timeout: int = 120) -> DataFrame:
    """One row of counts. Remaining seconds are cut to whole ones, so pending actions end after timeout - 1 seconds."""
    left = F.floor(F.lit(timeout) - (as_of - F.col("created")))
    status = F.when((F.col("status") == "PENDING") & (left <= 0), "TIMED_OUT").otherwise(F.col("status"))
    rows = actions.withColumn("outcome", status)
    return rows.agg(F.count_if(F.expr("outcome = 'PENDING'")).alias("pending"), F.count_if(F.expr("outcome = 'APPROVED'")).alias("approved"), F.count_if(F.expr("outcome in ('REJECTED', 'TIMED_OUT')")).alias("rejected"), F.count("*").alias("total"))


def span_records(raw: DataFrame) -> DataFrame:
    """Spans (start_time, end_time as ISO text or times) with UTC texts, duration_ms and masked inputs."""
    start, end = F.col("start_time").cast("timestamp"), F.col("end_time").cast("timestamp")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ms = F.greatest(F.bround((F.unix_micros(end) - F.unix_micros(start)) / 1000, 2), F.lit(0.0))
    group = F.when(F.col("group_id").startswith("grp_"), F.col("group_id")).otherwise(F.concat(F.lit("grp_"), F.coalesce("group_id", F.lit("general"))))
    return raw.withColumns({
        "duration_ms": ms, "start_time": iso(start), "end_time": iso(end), "group_id": group, "step_index": F.greatest(F.coalesce("step_index", F.lit(0)), F.lit(0)),
        "name": F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.col("run_type")), "inputs": G.mask_text(F.col("inputs")),
    })


def span_view(spans: DataFrame, run_type: str | None = None, status: str | None = None, n: int = 15) -> DataFrame:
    """The newest n spans of a type and a status, compared in lower case."""
    rows = spans if run_type is None else spans.where(F.lower("run_type") == run_type.lower())
    rows = rows if status is None else rows.where(F.lower("status") == status.lower())
    return rows.orderBy(F.col("start_time").desc()).limit(n)


def token_usage(spans: DataFrame) -> DataFrame:
    """Token sums by trace and group."""
    return spans.groupBy("trace_id", "group_id").agg(*[F.coalesce(F.sum(f"token_usage.{k}"), F.lit(0)).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")])
