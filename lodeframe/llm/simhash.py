"""SimHash near-duplicates: an inverted index over fingerprint bytes, filtered by counts of shared bytes, then verified.

Two 64-bit fingerprints that differ in at most `bits` bits share at least 8 - bits of their 8 bytes. Lists by single bytes
have N / 256 rows and would grow with the square of the input. So lists are first made selective by what the guaranteed
count implies: of five bytes shared among eight, three lie in one half, so the eight triples within the halves (24-bit
keys) miss no pair. Only distinct fingerprints are indexed: copies are one row.

Inside a list, the remaining bytes have postings by position and value. They are walked to tally the shared bytes of each
pair; pairs that reach the guaranteed minimum, and only those, are verified by their differing bits. A list of two is
compared in the query itself, one of up to LIST_ROWS in one task, which gives at most one row a member: what hangs
together points to one of it. A list of more rows is keyed again by more bits: pairs in it must agree on a further part
of the remaining bits, until no more than 13 bits are free, so that a list has 8,192 distinct fingerprints at most. This
is exact: no list is capped, no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import checkpointed, components, once, without

#: Of XXH64, as Spark's own xxhash64 has it.
SEED = 42
#: Distinct fingerprints that one list may have before it is keyed again.
LIST_ROWS = 2048
#: Pairs that are tallied at a time.
BLOCK_PAIRS = 1 << 18
#: Shingles that are held as bits at a time.
CHUNK = 1 << 16
ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits that are set in over half the shingles' hashes; A-Z are lower-cased, words end at ASCII white space."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(w) - words] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, told, fp) per row: a hash that tells texts of one id, and the fingerprint, as signed 64-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [_signed(fingerprint(t if isinstance(t, str) else None, words)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "told": batch["told"], "fp": fps})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("told"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, told long, fp long")


def _byte(i: int) -> int:
    return 0xFF << (8 * i)


def _first_masks(bits: int) -> list[int]:
    """Sets of byte positions such that any pair that shares 8 - bits bytes agrees on one of them."""
    shared = 8 - bits
    if shared == 5:
        halves = (range(4), range(4, 8))
        return [sum(map(_byte, c)) for half in halves for c in combinations(half, 3)]
    return [sum(map(_byte, c)) for c in combinations(range(8), shared)]


def _finer(mask: int, bits: int) -> list[int]:
    """mask with more bits, so that any pair that agrees on mask and differs in at most `bits` agrees on one of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(np.array(free), bits + 1)
    return [mask | sum(1 << int(i) for i in part) for part in parts]


def _near(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct values: places i < j of the pairs that differ in at most `bits` bits.

    Postings of each byte position are walked for a block of values at a time to tally the bytes that pairs share; of the
    pairs with 8 - bits or more the differing bits are counted.
    """
    n = len(values)
    cols = values.view(np.uint8).reshape(n, 8)
    step = max(1, BLOCK_PAIRS // n)
    common = [p for p in range(8) if (cols[:, p] == cols[0, p]).all()]  # as the list's key, in all pairs
    postings = []
    for p in range(8):
        if p not in common:
            order = np.argsort(cols[:, p], kind="stable")
            sizes = np.bincount(cols[:, p], minlength=256)
            postings.append((p, order, np.cumsum(sizes) - sizes, sizes))
    us, vs = [], []
    for at in range(0, n, step):
        m = min(step, n - at)
        tally = np.full(m * n, len(common), np.uint8)
        for p, order, starts, sizes in postings:
            own = cols[at : at + m, p]
            many = sizes[own]
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - starts[own], many)
            tally[np.repeat(np.arange(m) * n, many) + order[place]] += 1  # a pair stands once in a position's postings
        i, j = np.divmod(np.flatnonzero(tally >= 8 - bits), n)
        i, j = i[i + at < j] + at, j[i + at < j]
        near = np.bitwise_count(values[i] ^ values[j]) <= bits
        us.append(i[near])
        vs.append(j[near])
    return np.concatenate(us), np.concatenate(vs)


def _linked(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what hangs together: each member and the smallest place of its own."""
    root = np.arange(len(values))
    i, j = _near(values, bits)
    while True:
        before = root.copy()
        np.minimum.at(root, j, root[i])
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            moved = np.flatnonzero(root != np.arange(len(root)))
            return moved, root[moved]


def _lists(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u, v = [], []
            for fps in batch["fps"]:
                values = np.unique(np.asarray(fps, np.int64).view(np.uint64))
                i, j = _linked(values, bits)
                u.append(values[i].view(np.int64))
                v.append(values[j].view(np.int64))
            yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    return run


def _shared_bytes(a: Column, b: Column) -> Column:
    diff = a.bitwiseXOR(b)
    return sum((F.when(diff.bitwiseAND(F.lit(_signed(_byte(i)))) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(classes: DataFrame, bits: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """(u, v): for distinct fingerprints (fp), pairs that lie in one group; each group of linked ones is connected by them."""
    spark: SparkSession = classes.sparkSession
    masks = _first_masks(bits)
    keyed = classes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = checkpointed(keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
        near = (_shared_bytes(F.col("u"), F.col("v")) >= 8 - bits) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
        two = sizes.where((F.col("n") == 2) & near).select("u", "v")
        few = np.bitwise_count(np.array([~m & ALL for m in masks], np.uint64)).max() <= 13
        some = F.col("n") > 2 if few else F.col("n").between(3, list_rows)
        lists = keyed.join(sizes.where(some).select("mask", "key"), ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        here = two.unionAll(lists.select("fps").mapInPandas(_lists(bits), "u long, v long"))
        found = here if found is None else found.unionAll(here)
        if few or not sizes.where(F.col("n") > list_rows).take(1):
            return found
        # what is left are long lists: their rows are keyed by finer masks, a table of fixed size
        finer = {m: _finer(m, bits) for m in masks}
        masks = sorted({x for f in finer.values() for x in f})
        steps = spark.createDataFrame([(_signed(m), [_signed(x) for x in f]) for m, f in finer.items()], "mask long, finer array<long>")
        long = sizes.where(F.col("n") > list_rows).select("mask", "key").join(F.broadcast(steps), "mask")
        keyed = checkpointed(keyed.join(long, ["mask", "key"]).select("fp", F.explode("finer").alias("mask")).distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, list_rows: int) -> DataFrame:
    """(doc_id, told, fp, first) per row of docs; first is the struct (null, doc_id, told) of the least row reachable."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "told"))
    classes = checkpointed(prints.groupBy("fp").agg(least.alias("first")))
    roots = checkpointed(components(links(classes.select("fp"), bits, list_rows)))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("least"))
    linked = rooted.join(smallest, "root").select("fp", "least")
    # stored, so that both sides of the last join are plain exchanges and a fingerprint with very many rows can be split
    ids = checkpointed(classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")))
    return prints.join(ids, "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts link if their fingerprints differ in `bits` bits at most (3 or fewer keep the index selective). Null text counts
    as empty: no words, fingerprint zero, which links like any other. Texts of any length are read whole. Repeated rows
    are returned as often as they come. A null doc_id is never a component_id unless all of a component are null. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    rows = _grouped(docs, id_col, text_col, words, bits, list_rows)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def first_rows(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of docs one row for each group in grouped (doc_id, told, first, as many rows as docs), with all its columns.

    Rows are told by id and text, so an id that repeats with another text loses nothing; of rows that repeat the first of
    a group, one stays.
    """
    grouped = checkpointed(grouped.select("doc_id", "told", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("told") == F.col("first.told"))).alias("stays")))
    keys = [F.col(id_col), F.xxhash64(F.col(text_col))]
    gone = checkpointed(grouped.where("not stays").select("doc_id", "told").distinct())
    again = checkpointed(grouped.where("stays").groupBy("doc_id", "told").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "told"))
    return once(without(docs, gone, keys, gone.count()), again, keys)


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group that hangs together the one with the smallest id.

    Rows without words share the fingerprint zero and so are one group. Null ids stay only where a whole group has none;
    of several texts with the smallest id one stays. Rows are told as in first_rows(). An empty table gives no rows.
    """
    return first_rows(docs, _grouped(docs, id_col, text_col, words, bits, list_rows), id_col, text_col)
