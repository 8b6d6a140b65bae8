"""Hard negatives by exact inner products, scored with the method of four Russians.

Components are whole numbers. Candidates are written once, in chunks, as bit planes: a byte holds one bit of eight
dimensions. An anchor has, for each eight dimensions, a table of the sums of all 256 subsets of its components. A score is
then the table entries that a candidate's bytes point at, added up plane by plane with a shift between them; the highest
plane counts negatively. Anchors go to tasks in passes of bounded size and are scored in blocks against all candidates; a
task keeps only the best few rows of each anchor, so what is shuffled does not grow with the pairs.

There are two scans a pass: the first finds the positives, the second the negatives in each positive's range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed
from .clusters import whole

SCALE, EVERY, BEST = 256, 100, 5
#: Vectors of a chunk, candidates and anchors scored at a time, bytes of anchors that a pass sends to tasks.
CHUNK, TILE, BLOCK, PASS_BYTES = 4096, 256, 512, 16 << 20
#: Whole numbers beyond this would make scores that, with a place in a chunk, are no longs.
LIMIT = 1 << 20
LOW = -(1 << 62)
STORED = "chunk long, known int, ids array<long>, labels array<long>, groups int, bits int, planes binary"


def planes(q: np.ndarray) -> np.ndarray:
    """bits x groups x rows, as bytes: dimension d is bit d % 8 of group d // 8; the last plane is the sign (two's complement)."""
    bits = max(int(q.max(initial=0)), -1 - int(q.min(initial=0))).bit_length() + 1
    shifted = (q.T[None] >> np.arange(bits)[:, None, None]) & 1  # bits x dims x rows
    return np.packbits(shifted.astype(np.uint8).reshape(bits, q.shape[1] // 8, 8, len(q)), axis=2, bitorder="little")[:, :, 0]


def whole_rows(p: np.ndarray) -> np.ndarray:
    """The numbers of planes() again, rows x dims."""
    flat = np.unpackbits(p[:, :, None], axis=2, bitorder="little").reshape(len(p), -1, p.shape[2]).astype(np.int64)
    weight = 1 << np.arange(len(p))
    weight[-1] = -weight[-1]
    return np.tensordot(weight, flat, 1).T


def tables(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: the sums of all subsets of each eight components, each from one with a bit less."""
    parts = anchors.reshape(len(anchors), -1, 8).transpose(1, 2, 0)
    out = np.zeros((parts.shape[0], 256, len(anchors)), anchors.dtype)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, bit, None]
    return out


def scores(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    """candidates x anchors; groups that one side lacks count as zeros."""
    out = np.empty((p.shape[2], table.shape[2]), table.dtype)
    groups = min(p.shape[1], len(table))
    for at in range(0, len(out), TILE):
        total = np.zeros((min(TILE, len(out) - at), out.shape[1]), table.dtype)
        entry = np.empty_like(total)
        for k in range(len(p) - 1, -1, -1):
            if k < len(p) - 1:
                np.left_shift(total, 1, out=total)
            for g in range(groups):
                np.take(table[g], p[k, g, at : at + TILE], axis=0, out=entry, mode="clip")
                total += entry
            if k == len(p) - 1:
                np.negative(total, out=total)
        out[at : at + TILE] = total
    return out


def stored_planes(rows: DataFrame) -> DataFrame:
    """Rows of STORED, of (vec_id, label, q); a chunk's vectors are in order of their ids, those known first, then null ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def chunk(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("vec_id", kind="stable", na_position="last")
            long = max(8, -(-max(map(len, part["q"])) // 8) * 8)
            q = np.zeros((len(part), long), np.int64)
            for i, x in enumerate(part["q"]):
                q[i, : len(x)] = x
            if max(int(q.max()), -int(q.min())) >= LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling; scores would not fit a long")
            p = planes(q)
            row = [0, int(part["vec_id"].notna().sum()), part["vec_id"].fillna(0).tolist(), part["label"].tolist(), p.shape[1], p.shape[0], p.tobytes()]
            return pd.DataFrame([row], columns=["chunk", "known", "ids", "labels", "groups", "bits", "planes"])

        for batch in batches:
            # ids come as text: with nulls among them they would be floats, which do not hold them all
            held.append(batch.assign(vec_id=pd.array([None if x is None else int(x) for x in batch["vec_id"]], "Int64")))
            while sum(map(len, held)) >= CHUNK:
                all_ = pd.concat(held)
                yield chunk(all_.iloc[:CHUNK])
                held = [all_.iloc[CHUNK:]]
        if sum(map(len, held)):
            yield chunk(pd.concat(held))

    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("long").alias("label"), "q")
    return named.mapInPandas(run, STORED).withColumn("chunk", F.monotonically_increasing_id())


def _opened(row) -> np.ndarray:
    return np.frombuffer(row.planes, np.uint8).reshape(row.bits, row.groups, len(row.ids))


def _anchors(stored: DataFrame, every: int) -> DataFrame:
    """(chunk, place, vec_id, label, q) of the rows whose id is divisible by every."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = np.flatnonzero(row.ids[: row.known] % every == 0).tolist()
                q = whole_rows(_opened(row)[:, :, own]) if own else []
                yield pd.DataFrame([(row.chunk, i, int(row.ids[i]), int(row.labels[i]), v) for i, v in zip(own, q, strict=True)], columns=["chunk", "place", "vec_id", "label", "q"])

    return stored.mapInPandas(run, "chunk long, place int, vec_id long, label long, q array<long>")


class Sent:
    """The anchors of a pass: whole numbers as a matrix, ids, labels, where they are stored; later their positives' scores."""

    def __init__(self, rows: list):
        long = max(len(r.q) for r in rows)
        self.q = np.zeros((len(rows), long), np.int64)
        for i, r in enumerate(rows):
            self.q[i, : len(r.q)] = r.q
        self.ids, self.labels, self.chunk, self.place = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label", "chunk", "place"))
        self.positives = np.full((len(rows), 0), LOW)


def _ranked(score: np.ndarray, ids: np.ndarray, null: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each row, by score from the highest, then id, null last."""
    order = np.lexsort((ids, null, -score), axis=-1)[..., :best]
    return tuple(np.take_along_axis(x, order, -1) for x in (score, ids, null))


def _found(stored: DataFrame, sent, best: int, low: int, high: int) -> DataFrame:
    """(anchor, slot, score, id) of a task's best: those of the same label if positives aren't known yet, else for each of
    them (slot) the best of other labels with low * positive <= 100 * score <= high * positive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Sent = sent.value
        m, slots = len(own.ids), max(1, own.positives.shape[1])
        top = tuple(np.full((m, slots, best), x, kind) for x, kind in ((LOW, np.int64), (0, np.int64), (True, bool)))
        for batch in batches:
            for row in batch.itertuples():
                p = _opened(row)
                n = p.shape[2]
                ids, null, labels = row.ids, np.arange(n) >= row.known, row.labels
                place_bits = n.bit_length()
                for at in range(0, m, BLOCK):
                    part = slice(at, min(m, at + BLOCK))
                    bound = int(np.abs(own.q[part]).sum(1).max()) << p.shape[0]
                    table = tables(own.q[part].astype(np.int32 if bound < 2**31 else np.int64))
                    key = scores(table, p).T.astype(np.int64)
                    key = (key << place_bits) | (n - 1 - np.arange(n))  # of equal scores the earlier place is higher
                    same = own.labels[part, None] == labels[None]
                    here = np.flatnonzero(own.chunk[part] == row.chunk)
                    if own.positives.shape[1]:
                        key[same] = LOW
                        key = -np.sort(-key, axis=1)
                        picks = []
                        for s in range(slots):
                            positive = own.positives[part, s]
                            # places in the sorted row where the range begins; a bound of 100ths is rounded inwards
                            most, least = high * positive // 100, -(-low * positive // 100)
                            begin = (key > ((most << place_bits) | (2**place_bits - 1))[:, None]).sum(1)
                            k = begin[:, None] + np.arange(best)
                            value = np.where(k < n, np.take_along_axis(key, np.minimum(k, n - 1), 1), LOW)
                            picks.append(np.where((value != LOW) & (positive != LOW)[:, None] & (value >> place_bits >= least[:, None]), value, LOW))
                        new = np.stack(picks, 1)
                    else:
                        key[~same] = LOW
                        key[here, own.place[part][here]] = LOW
                        new = (np.partition(key, n - best, axis=1)[:, n - best :] if n > best else key)[:, None]
                    where = np.where(new == LOW, 0, n - 1 - (new & (2**place_bits - 1)))
                    fresh = (np.where(new == LOW, LOW, new >> place_bits), ids[where], null[where])
                    merged = _ranked(*(np.concatenate([t[part], x], axis=-1) for t, x in zip(top, fresh, strict=True)), best)
                    for t, x in zip(top, merged, strict=True):
                        t[part] = x
        a, s, k = np.nonzero(top[0] != LOW)
        score, ids, null = (t[a, s, k] for t in top)
        yield pd.DataFrame({"anchor": a.astype(np.int32), "slot": s.astype(np.int32), "score": score, "id": pd.arrays.IntegerArray(ids, null)})

    rows = stored.mapInPandas(run, "anchor int, slot int, score long, id long")
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)


def mine(
    rows: DataFrame, positives: int = BEST, negatives: int = BEST, low: int = 80, high: int = 100, every: int = EVERY, scale: int = SCALE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose integer id is divisible by every. An anchor's positives are its best other rows of the same
    label; for each, the best rows of other labels whose score is at least low and at most high hundredths of its own.
    Higher scores come first, ties go to the smaller id, null ids last. Rows with a null label, a null vector or a null, NaN
    or infinite component take no part; a shorter vector counts as if zeros followed. A row that repeats is another row: it
    may be a positive of its copy, and each copy of an anchor is an anchor. Null ids are never anchors. Components beyond
    2**20 after scaling are an error. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    stored = checkpointed(stored_planes(some.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole(vec_col, scale).alias("q"))))
    anchors = checkpointed(_anchors(stored, every))
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("long")).first()
    spark, parts = rows.sparkSession, []
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    passes = -(-size["n"] * size["long"] * 8 // pass_bytes)
    for k in range(passes):
        own = anchors.where(F.pmod(F.xxhash64("chunk", "place"), F.lit(passes)) == k).collect() if passes > 1 else anchors.collect()
        if not own:
            continue
        sent = Sent(own)
        first = _found(stored, spark.sparkContext.broadcast(sent), positives, low, high).collect()
        if not first:
            continue
        sent.positives = np.full((len(own), positives), LOW)
        for r in first:
            sent.positives[r["anchor"], r["rank"] - 1] = r["score"]
        found = _found(stored, spark.sparkContext.broadcast(sent), negatives, low, high)
        names = [(r["anchor"], r["rank"] - 1, int(sent.ids[r["anchor"]]), r["id"], r["score"]) for r in first]
        told = spark.createDataFrame(names, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        parts.append(found.join(F.broadcast(told), ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
