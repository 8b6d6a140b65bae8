"""Where intermediate results go that executors must be able to lose: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a few dozen bytes that may be broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A folder of this machine only where none is set and all executors are on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the folder that checkpoints are in, for what is large: a checkpoint keeps rows as they are
    in memory, with all columns in every row, and takes ten times the disk. As with a checkpoint, its plan ends here."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have; Spark's names are told without regard to case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def numbered(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """rows with `at` (instead of one that is there), counted from 1 within each `by`, in an order that tells all rows apart.

    Rows are sorted into ranges and counted there, then the sizes of a group's earlier ranges are added: a group of any
    size is spread over tasks. The sizes are one row for each range and group.
    """
    place, inside, before = fresh(rows, "range_of_rows", "inside", "before")
    parts = checkpointed(rows.repartitionByRange(*by, *order).withColumn(place, F.spark_partition_id()))
    sizes = parts.groupBy(*by, place).agg(F.count("*").alias(inside))
    ahead = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, place, F.coalesce(F.sum(inside).over(ahead), F.lit(0)).alias(before))
    count = F.row_number().over(Window.partitionBy(*by, place).orderBy(*order))
    return parts.withColumn(inside, count).join(offsets, [*by, place]).withColumn("at", F.col(inside) + F.col(before)).drop(inside, before, place)
