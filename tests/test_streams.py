from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeframe.plans import events


@pytest.fixture
def a_partition_a_file(spark):
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{k}", "100000")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_rate_counts_all_rows_of_many_files_out_of_order(spark, tmp_path, a_partition_a_file):
    start = datetime(2026, 1, 1)
    # 160 files; every file spans its own hour, hours in no order
    rows = [(20 * f + i, start + timedelta(hours=f * 37 % 160, minutes=2 * i), i, "signup" if i % 4 == 0 else "click", 1.0, "{}") for f in range(160) for i in range(20)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    table.repartitionByRange(160, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() > 100
    got = events.t2_stream_rate(spark, str(tmp_path)).agg(F.sum("requests").alias("n"), F.sum("count_429").alias("refused")).first()
    assert (got.n, got.refused) == (3200, 800)
