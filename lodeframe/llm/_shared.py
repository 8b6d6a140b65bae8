"""What several operators of this subpackage share: shared-folder checkpoints, size-checked broadcasts, components."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes that may be broadcast (some 20 MB at most); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Files of a checkpoint for each core, and shuffle partitions that may be one file beyond that.
FILES_A_CORE, MERGED = 4, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A folder of this machine only where none is set and all
    executors are on this machine, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder. Small parts cost more to write and to list than they give, so there are
    at most FILES_A_CORE files for each core, or one for each MERGED shuffle partitions where those are many: what a task
    reads stays bounded. Its partitions are worked on one after the other, so it needs no more memory. Where executors come
    and go, cores can't be counted and every partition is a file.
    """
    checkpoint_folder(df.sparkSession)
    return _fewer(df).checkpoint()


def _fewer(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return df
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(FILES_A_CORE * sc.defaultParallelism, width // MERGED))


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in the shared folder, in as few files as a checkpoint.

    A checkpoint keeps the size that was estimated for its plan, and a join's estimate is the product of its sides. In a
    loop of joins that number gets millions of digits, which fill the driver's memory and take it seconds for each plan.
    A table has the size of its files. It is to be removed() when nothing reads it any more.
    """
    _fewer(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like that which df doesn't have; Spark's names are told without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def _bitmaps(members: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): one bit for the hash of each row of members, in rows of 4 KB."""
    slot = F.pmod(F.xxhash64(*members.columns), F.lit(bits)) + 1
    return members.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def divided(df: DataFrame, members: DataFrame, keys: list[Column], rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of df that may be in members (whose columns keys stand for), and those that are surely not.

    A bitmap of 16 bits a member, 32 MB at most (then more rows may be), goes to all tasks, so the second part is never
    shuffled. Both parts read df.
    """
    bits = 1 << min(28, max(20, math.ceil(math.log2(16 * max(1, rows)))))
    slot = F.pmod(F.xxhash64(*(k.cast(members.schema[c].dataType) for k, c in zip(keys, members.columns, strict=True))), F.lit(bits)) + 1
    bucket, bitmap = fresh(df, "bucket"), fresh(df, "bitmap")
    maps = F.broadcast(checkpointed(_bitmaps(members, bits)).toDF(bucket, bitmap))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    joined = df.join(maps, F.bitmap_bucket_number(slot) == F.col(bucket), "left")
    return joined.where(held).select(*df.columns), joined.where(~held).select(*df.columns)


def _same(keys: list[Column], names: list[str]) -> Column:
    """Only the first key can be null: each null-safe comparison computes its key twice."""
    first, *rest = (k == F.col(n) if i else k.eqNullSafe(F.col(n)) for i, (k, n) in enumerate(zip(keys, names, strict=True)))
    return reduce(and_, rest, first)


def without(df: DataFrame, members: DataFrame, keys: list[Column], rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df that are not in members, by keys of which the first may be null and is equal to null then.

    Of rows (members' count) within the limit members go to all tasks; beyond it only those rows of df are shuffled that a
    bitmap of members lets through.
    """
    names = [fresh(df, f"gone{i}") for i in range(len(keys))]
    gone, same = members.toDF(*names), _same(keys, names)
    if rows <= limit:
        return df.join(F.broadcast(gone), same, "left_anti")
    maybe, clear = divided(df, members, keys, rows)
    return clear.unionAll(maybe.join(gone, same, "left_anti"))


def among(df: DataFrame, members: DataFrame, keys: list[Column], rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df that are in members; moved as in without()."""
    names = [fresh(df, f"kept{i}") for i in range(len(keys))]
    kept, same = members.toDF(*names), _same(keys, names)
    if rows <= limit:
        return df.join(F.broadcast(kept), same, "left_semi")
    return divided(df, members, keys, rows)[0].join(kept, same, "left_semi")


def once(df: DataFrame, members: DataFrame, keys: list[Column], limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, with one row only for each of members (distinct, checkpointed); all other rows as they are."""
    rows = members.count()
    if not rows:
        return df
    names = [fresh(df, f"key{i}") for i in range(len(keys))]
    some = among(df, members, keys, rows, limit).withColumns(dict(zip(names, keys, strict=True)))
    return without(df, members, keys, rows, limit).unionAll(some.dropDuplicates(names).drop(*names))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected graph given as (u, v) bigint pairs; root is one node of each component.

    Rounds of contraction: every node joins its smallest neighbour, edges are renamed to what their ends joined, loops go.
    Ends are compared by a hash of theirs, so chains shrink by a constant factor a round whatever their order. Each round
    is a groupBy with map-side combining and joins; each is written to the shared folder, edges as a table of their own,
    removed when the next is there. No row reaches the driver.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("by"), F.col(c).alias("node"))
    spark = edges.sparkSession
    folder = f"{checkpoint_folder(spark)}/components-{uuid.uuid4().hex}"
    edges = written(edges.where("u <> v").select("u", "v").distinct(), f"{folder}/0")
    maps: list[DataFrame] = []
    while edges.take(1):
        both = edges.union(edges.select("v", "u"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        best = checkpointed(best.select(F.col("u").alias("node"), F.least("best", rank("u")).getField("node").alias("root")))
        maps.append(best)
        at_u = best.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        at_v = best.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = edges.join(at_u, "u").join(at_v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        edges = written(left, f"{folder}/{len(maps)}")
        removed(spark, f"{folder}/{len(maps) - 1}")
    removed(spark, folder)
    if not maps:
        return spark.createDataFrame([], edges.schema).toDF("node", "root")

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        """first, its roots followed through second."""
        onward = second.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        return first.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))

    return reduce(then, maps)
