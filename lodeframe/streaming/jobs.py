"""Structured Streaming jobs over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe import schemas as S
from lodeframe.operators.logs import audit_records

#: Requests a minute by class of caller.
LIMITS = {"agent": 20, "guest": 60, "user": 100}


def stream_audit(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Raw audit JSON lines that arrive in folder -> masked Parquet in out; stateless, exactly once by the checkpoint."""
    raw = spark.readStream.schema(S.AUDIT_IN).option("maxFilesPerTrigger", 1000).json(folder)
    writer = audit_records(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_rate(audit: DataFrame, limit: int = LIMITS["agent"], minutes: int = 1, late: str = "2 minutes") -> DataFrame:
    """Requests and 429s per endpoint and minute of event time, flagged above the limit; state ends with the watermark."""
    counted = audit.withWatermark("ts", late).groupBy("endpoint", F.window("ts", f"{minutes} minutes")).agg(F.count("*").alias("requests"), F.count_if(F.expr("status_code = 429")).alias("count_429"))
    return counted.select("endpoint", F.col("window.start").alias("minute"), "requests", "count_429", (F.col("requests") > limit).alias("over_limit"))


def stream_dedup(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first finding of each fingerprint; a fingerprint is remembered for the delay."""
    return findings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_approvals(requests: DataFrame, decisions: DataFrame, timeout: int = 120, late: str = "1 minute") -> DataFrame:
    """T4: requests (action_id, ts) with the decision (action_id, status, decided) that comes in time; else TIMED_OUT.

    An outer interval join: a request is given up when both watermarks are past its limit.
    """
    r = requests.withWatermark("ts", late).select("action_id", "ts")
    d = decisions.withWatermark("decided", late).select(F.col("action_id").alias("d_id"), "status", "decided")
    on = (F.col("action_id") == F.col("d_id")) & (F.col("decided") >= F.col("ts")) & (F.col("decided") <= F.col("ts") + F.expr(f"interval {timeout} seconds"))
    return r.join(d, on, "leftOuter").select("action_id", "ts", F.coalesce("status", F.lit("TIMED_OUT")).alias("outcome"))
