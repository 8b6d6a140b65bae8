"""Documents to training sequences: quality, exact dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever
their names. Null and empty texts are documents without words; texts of any length are read whole; an empty table gives an
empty one. Rows are told by id and text, so ids that repeat with other texts lose nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import decontam, exact_dedup, packing, quality, similar
from lodeframe.llm._shared import checkpoint_folder, table
from lodeframe.llm.queries import tokenizer_path

#: Rows of whole texts that go to Python at a time, in every stage; it bounds the workers' memory, not what is done.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones. Repeated rows get one score; empty texts and null ids are scored."""
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id, null last; of rows that repeat it one. Null and empty texts are equal."""
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id, null last.

    Texts without words are one group. Of several texts of the smallest id, and of repeated rows, one stays.
    """
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return similar.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged for itself. Texts without words hold nothing and stay."""
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece; a text without words is its end id. Each row is packed."""
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again.

    With a folder that a failed run left, stages that it finished are not run again. Without one, a stage's output goes as
    soon as the next is written.
    """
    own = folder or f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(own).getFileSystem(spark._jsc.hadoopConfiguration())
    before = spark.conf.get(BATCH_SETTING)
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (name, stage) in enumerate(STAGES):
            if not files.exists(path(f"{own}/{name}/_SUCCESS")):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{own}/{name}")
            if k and not folder:
                files.delete(path(f"{own}/{STAGES[k - 1][0]}"), True)
            docs = spark.read.parquet(f"{own}/{name}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
