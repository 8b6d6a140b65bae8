"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. One scan gives each row a 64-bit fingerprint and the SHA-256 of its normalised text; these few bytes a row are
   checkpointed with the number of the scan's partition, the sender.
2. A sender cuts its fingerprints to log2(rows) + 12 bits, sorts them, and sends each owner (a range of fingerprints)
   one Golomb-coded block of its distinct values, with a bit for those that it holds twice.
3. An owner decodes its blocks, finds the values that are there more than once and answers each sender with a bitmap.
4. The senders' marked rows are the suspects. Only their texts move (beyond what can be broadcast, a bitmap of the suspects
   keeps all other texts where they are): they are grouped by their bytes, combined before the shuffle, so a group of any
   size is one row from each task. False suspects end up alone and stay.

A sender's state is a few bytes for each row of one scan partition; an owner's is bounded by OWNER_ROWS on average.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rice
from ._shared import BROADCAST_ROWS, among, checkpointed, once, small, without

#: Fingerprints that an owner should have, and the least number of owners.
OWNER_ROWS, OWNERS = 500_000, 16
#: Bits beyond log2(rows): one false suspect in some thousand rows.
SPARE_BITS = 12


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Only runs that are not one plain space are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _cut(fingerprints: np.ndarray, bits: int) -> np.ndarray:
    return fingerprints.astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)


def _owner(values: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Ranges of equal width, so that sorted values stay together."""
    return (values.astype(np.float64) * (owners / 2.0**bits)).astype(np.int64)


def _blocks(bits: int, owners: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for sender, rows in batch.groupby("sender"):
                held.setdefault(int(sender), []).append(_cut(rows["fingerprint"].to_numpy(), bits))
        for sender, parts in held.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            owner = _owner(values, bits, owners)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            ends = np.append(starts[1:], len(values))
            yield pd.DataFrame({
                "owner": owner[starts],
                "sender": sender,
                "block": [rice.encode(values[a:b], bits) for a, b in zip(starts, ends, strict=True)],
                "twice": [np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(starts, ends, strict=True)],
            })

    return send


def _answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """An owner's blocks, one of each sender -> a bitmap for each: held elsewhere too, or twice there."""
    values = [rice.decode(b) for b in blocks["block"]]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(v)].astype(bool) for t, v in zip(blocks["twice"], values, strict=True)]
    distinct, senders = np.unique(np.concatenate(values), return_counts=True)
    shared = distinct[senders > 1]
    marks = [np.packbits(np.isin(v, shared, assume_unique=True) | t).tobytes() for v, t in zip(values, twice, strict=True)]
    return pd.DataFrame({"owner": blocks["owner"], "sender": blocks["sender"], "marks": marks})


def _marked(bits: int, owners: int):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        cut = _cut(rows["fingerprint"].to_numpy(), bits)
        values = np.unique(cut)
        owner, suspect = _owner(values, bits, owners), np.zeros(len(values), bool)
        for at, marks in zip(answers["owner"], answers["marks"], strict=True):
            own = slice(*np.searchsorted(owner, [at, at + 1]))
            suspect[own] = np.unpackbits(np.frombuffer(marks, np.uint8))[: own.stop - own.start]
        return rows.loc[suspect[np.searchsorted(values, cut)], ["row", "doc_id", "sha"]]

    return mark


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id of the rows with an equal normalised text. Null text counts as empty. A null doc_id
    comes after all others; keep_id is null only if all of a group are. Of rows that repeat a doc_id with its text, all
    are counted and one is kept. Texts of any length are compared whole. Other columns are not read, whatever their names.
    An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    keyed = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    prints = keyed.select(
        "doc_id",
        F.xxhash64("norm").alias("fingerprint"),
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.spark_partition_id().alias("sender"),
        F.monotonically_increasing_id().alias("row"),
    )
    prints = checkpointed(prints)  # from here on a row's sender and number are stored facts
    n = prints.count()
    bits = min(64, max(1, math.ceil(math.log2(n + 1))) + SPARE_BITS)
    owners = max(OWNERS, math.ceil(n / OWNER_ROWS))

    blocks = prints.select("sender", "fingerprint").mapInPandas(_blocks(bits, owners), "owner long, sender int, block binary, twice binary")
    answers = blocks.groupBy("owner").applyInPandas(_answer, "owner long, sender int, marks binary")
    suspects = prints.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(_marked(bits, owners), f"row long, doc_id {id_type.simpleString()}, sha binary")
    suspects = checkpointed(suspects)
    m = suspects.count()

    # the suspects' texts, by their bytes
    texts = among(keyed, suspects.select("doc_id").distinct(), [F.col("doc_id")], m, broadcast_rows)
    groups = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    first = suspects.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).getField("row").alias("first"))
    groups = small(groups.join(first, "sha"), m, broadcast_rows)

    return prints.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("row").alias("row_id"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the smallest id.

    Rows are told by id and text, so ids that repeat with other texts lose nothing; a row that repeats a kept one goes.
    """
    groups = checkpointed(exact_groups(docs, id_col, text_col, broadcast_rows).where("not kept"))
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = groups.where(~again).select("doc_id", "text_sha256").distinct()
    keys = [F.col(id_col), F.sha2(normalised(F.col(text_col)), 256)]
    kept = without(docs, gone, keys, groups.count(), broadcast_rows)
    return once(kept, checkpointed(groups.where(again).select("doc_id", "text_sha256").distinct()), keys, broadcast_rows)
