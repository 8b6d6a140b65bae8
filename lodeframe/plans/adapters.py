"""The driver's tables in the shapes that the operators read; portable SQL, so the oracles repeat it as common tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw findings from orders: integer arithmetic only.
RAW_FINDINGS = """
SELECT o_orderkey AS row_idx,
  CASE o_custkey % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'codeql' ELSE 'zap' END AS tool,
  CASE o_custkey % 3 WHEN 2 THEN 'DAST' ELSE 'SAST' END AS scan_type,
  CASE o_custkey % 3 WHEN 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN ' Warning ' WHEN 2 THEN 'INFO' ELSE 'odd' END
    WHEN 1 THEN CAST(o_orderkey % 12 AS STRING) || '.5' ELSE CAST(o_orderkey % 6 AS STRING) END AS native_severity,
  CASE o_custkey % 3 WHEN 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' ELSE 'Medium' END
    WHEN 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'very-high' WHEN 1 THEN 'medium' ELSE 'x' END ELSE CAST(o_orderkey % 6 AS STRING) END AS native_confidence,
  './src//r' || CAST(o_orderkey % 500 AS STRING) || '.ts' AS path_raw,
  CASE WHEN o_custkey % 7 = 0 THEN 'none' ELSE 'CWE-0' || CAST(o_custkey % 40 + 1 AS STRING) END AS cwe_text,
  CAST(o_orderkey % 90 + 1 AS INT) AS start_line,
  'http://t:3000/p/' || CAST(o_orderkey % 50 AS STRING) || '?q=1' AS uri,
  'q' || CAST(o_orderkey % 3 AS STRING) AS parameter,
  'rule-' || CAST(o_custkey % 25 AS STRING) AS rule_id,
  o_orderpriority AS priority
FROM orders"""

#: Fewer findings, from customer, with small blocks, for pairs and merges.
SMALL_FINDINGS = """
SELECT c_custkey AS row_idx, 'fnd' || CAST(c_custkey AS STRING) AS finding_id, 'fp' || CAST(c_custkey % 1200 AS STRING) AS fingerprint,
  'g' || CAST(c_custkey % 700 AS STRING) AS group_key,
  CASE c_custkey % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'codeql' ELSE 'zap' END AS tool,
  CASE c_custkey % 3 WHEN 2 THEN 'DAST' ELSE 'SAST' END AS scan_type,
  CASE c_custkey % 3 WHEN 2 THEN 'http' ELSE 'code' END AS kind,
  CASE c_custkey % 5 WHEN 0 THEN 'SQL Injection w' WHEN 1 THEN 'Database query w' WHEN 2 THEN 'Open Redirect w' WHEN 3 THEN 'URL check w' ELSE 'Cross-site Scripting w' END
    || CAST(c_custkey % 89 AS STRING) AS title,
  'CWE-' || CAST(c_custkey % 61 AS STRING) AS cwe,
  CASE c_custkey % 3 WHEN 2 THEN NULL ELSE 'r' || CAST(c_custkey % 23 AS STRING) || '.ts' END AS path,
  CASE c_custkey % 3 WHEN 2 THEN '/p/' || CAST(c_custkey % 19 AS STRING) ELSE NULL END AS endpoint,
  CASE c_custkey % 3 WHEN 2 THEN 'prm' || CAST(c_custkey % 11 AS STRING) || 'x' ELSE NULL END AS parameter,
  CASE c_custkey % 3 WHEN 2 THEN NULL ELSE 'req.body.PRM' || CAST(c_custkey % 13 AS STRING) || 'x' END AS node
FROM customer"""

#: Audit input from events.
AUDIT = """
SELECT event_id, ts, user_id, '/e/' || CAST(user_id % 20 AS STRING) AS endpoint,
  CASE event_type WHEN 'click' THEN 'get' WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'put' ELSE 'OPTIONS' END AS method,
  CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 201 WHEN 'signup' THEN 429 ELSE 200 END AS INT) AS status_code,
  value AS duration_ms, props,
  CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'approved' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'odd' ELSE 'NOT_REQUIRED' END AS approval_status
FROM events"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the table that it names after FROM, without views that stay behind."""
    name = sql.rsplit("FROM ", 1)[1].split()[0]
    rows = spark.sql(sql.rsplit("FROM ", 1)[0] + "FROM {t}", t=load(spark, sf_dir, name))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def epoch_seconds(ts: Column) -> Column:
    """Seconds of the wall-clock time since 1970, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
