"""k-means over whole numbers, by dictionaries of subvectors.

Vectors are dealt out to chunks of some thousands. In a chunk every block of dimensions has a dictionary of its distinct
subvectors, and a vector is one code for each block: nothing is lost, copies cost one entry. A round computes the exact
distance of every distinct subvector to each centroid's part once and adds up a vector's partial distances by its codes.
Chunks are written once and read each round; what a round gives back is counts and sums of each cluster, a few kilobytes
whatever the input, so the centroids, which are as few, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import checkpointed

SCALE, CLUSTERS, ROUNDS, SEED, DIMS = 1024, 8, 10, 3, 64
#: Vectors of a chunk, and the widths of blocks that are tried; the one with the least work a round is taken.
CHUNK, WIDTHS = 8192, (1, 2, 4, 8, 16)
#: Whole numbers beyond this would make distances that are no longs.
LIMIT = 1 << 27


def kept(rows: DataFrame, vec_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """The rows whose vector has that many components, none null, NaN or infinite."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size(vec_col) == dims) & F.coalesce(fine, F.lit(False)))


def whole(vec_col: str, scale: int) -> F.Column:
    """floor(scale * x) for each component, x as double; beyond a long it is an error."""
    return F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kinds = (np.uint8, np.uint16, np.int16, np.int32) if low >= 0 else (np.int8, np.int16, np.int32)
    return x.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def encoded(q: np.ndarray) -> tuple[int, list[np.ndarray], np.ndarray]:
    """(width, a dictionary for each block, codes: blocks x vectors) of whole vectors, exactly.

    Work of a width: the distances of all entries, and one lookup for each vector and block.
    """
    n, dims = q.shape
    best = None
    for width in (w for w in WIDTHS if dims % w == 0):
        found = []
        for at in range(0, dims, width):
            part = np.ascontiguousarray(q[:, at : at + width])
            entry = part[:, 0] if width == 1 else part.view(np.dtype((np.void, part.dtype.itemsize * width)))[:, 0]
            _, first, code = np.unique(entry, return_index=True, return_inverse=True)
            found.append((part[first], code))
        work = sum(len(d) for d, _ in found) * width + n * len(found)
        if best is None or work < best[0]:
            best = work, width, found
    _, width, found = best
    return width, [_narrow(d) for d, _ in found], _narrow(np.stack([c for _, c in found]))


def decoded(width: int, dictionaries: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    return np.concatenate([d.astype(np.int64)[c] for d, c in zip(dictionaries, codes, strict=True)], axis=1)


CHUNKS = "ids {0}, width int, kinds string, sizes array<int>, dictionaries binary, codes binary"


def chunks(rows: DataFrame, id_col: str, q_col: str, dims: int) -> DataFrame:
    """Rows of CHUNKS, one for each CHUNK vectors of a partition; q_col has whole numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def chunk(part: pd.DataFrame) -> pd.DataFrame:
            q = np.array(part["q"].tolist(), np.int64).reshape(len(part), dims)
            if q.size and max(int(q.max()), -int(q.min())) >= LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling; distances would not fit a long")
            width, dictionaries, codes = encoded(q)
            kinds = ",".join([codes.dtype.str, *(d.dtype.str for d in dictionaries)])
            row = [part["id"].tolist(), width, kinds, [len(d) for d in dictionaries], b"".join(d.tobytes() for d in dictionaries), codes.tobytes()]
            return pd.DataFrame([row], columns=["ids", "width", "kinds", "sizes", "dictionaries", "codes"])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= CHUNK:
                all_ = pd.concat(held)
                yield chunk(all_.iloc[:CHUNK])
                held = [all_.iloc[CHUNK:]]
        if sum(map(len, held)):
            yield chunk(pd.concat(held))

    id_type = rows.schema[id_col].dataType
    named = rows.select(F.col(id_col).alias("id"), F.col(q_col).alias("q"))
    return named.mapInPandas(run, CHUNKS.format(T.ArrayType(id_type).simpleString()))


def opened(row) -> tuple[int, list[np.ndarray], np.ndarray]:
    """(width, dictionaries, codes) of a row of CHUNKS."""
    kind, *kinds = row.kinds.split(",")
    out, at = [], 0
    for n, k in zip(row.sizes, kinds, strict=True):
        d = np.frombuffer(row.dictionaries, k, n * row.width, at).reshape(n, row.width)
        out.append(d)
        at += d.nbytes
    return row.width, out, np.frombuffer(row.codes, kind).reshape(len(out), -1)


def nearest(width: int, dictionaries: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; equal distances go to the smaller number."""
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for b, (entries, code) in enumerate(zip(dictionaries, codes, strict=True)):
        part = np.zeros((len(entries), len(centroids)), np.int64)
        for k in range(width):
            part += (entries[:, k, None].astype(np.int64) - centroids[None, :, b * width + k]) ** 2
        total += part[code]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(total)), cluster]


def _sums(width: int, dictionaries: list[np.ndarray], codes: np.ndarray, cluster: np.ndarray, n: int) -> np.ndarray:
    """Sums of each cluster's vectors: how often each entry comes in a cluster, times the entry."""
    out = np.zeros((n, width * len(dictionaries)), np.int64)
    for b, (entries, code) in enumerate(zip(dictionaries, codes, strict=True)):
        times = np.bincount(cluster * len(entries) + code, minlength=n * len(entries)).reshape(n, -1)
        out[:, b * width : (b + 1) * width] = times @ entries.astype(np.int64)
    return out


def _totals(stored: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
    """(vectors, distances, componentwise sums) of each cluster, over all chunks; exact, as decimals."""
    n, dims = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, inertia, sums = [0] * n, [0] * n, np.zeros((n, dims), object)
        for batch in batches:
            for row in batch.itertuples():
                parts = opened(row)
                cluster, distance = nearest(*parts, centroids)
                sums += _sums(*parts, cluster, n)
                for c in range(n):
                    own = distance[cluster == c]
                    count[c], inertia[c] = count[c] + len(own), inertia[c] + sum(own.tolist())
        yield pd.DataFrame([(c, "n", str(count[c])) for c in range(n)] + [(c, "d", str(inertia[c])) for c in range(n)] + [(c, str(k), str(sums[c, k])) for c in range(n) for k in range(dims)], columns=["c", "what", "x"])

    rows = stored.drop("ids").mapInPandas(run, "c int, what string, x string").groupBy("c", "what").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    got = {(r.c, r.what): int(r.x) for r in rows}
    return [got.get((c, "n"), 0) for c in range(n)], [got.get((c, "d"), 0) for c in range(n)], [[got.get((c, str(k)), 0) for k in range(dims)] for c in range(n)]


def cluster(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row for each kept row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows whose vector is null, of another length or with a null, NaN or infinite component are left out. Centroids start as
    the vectors with the smallest sha256 of "seed:vec_id" (a null id is an empty text; of equal ids the smaller vector
    first); with fewer vectors there are fewer centroids. Ties of distance go to the smaller cluster. Repeated rows count as
    often as they come, and are returned so. Components beyond 2**27 after scaling are an error. Other columns are not
    read, whatever their names. A table without such vectors gives no rows.
    """
    fine = kept(rows, vec_col, dims).select(F.col(id_col).alias("vec_id"), whole(vec_col, scale).alias("q"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r.q for r in fine.select("q", hashed.alias("by")).orderBy("by", "q").limit(clusters).collect()]
    schema = f"vec_id {fine.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    stored = checkpointed(chunks(fine, "vec_id", "q", dims))
    centroids = np.array(first, np.int64)
    if int(np.abs(centroids).max()) >= LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} after scaling; distances would not fit a long")
    for _ in range(rounds):
        count, _, sums = _totals(stored, centroids)
        centroids = np.array([[s // m for s in row] if m else old for m, row, old in zip(count, sums, centroids.tolist(), strict=True)], np.int64)
    _, inertia, _ = _totals(stored, centroids)
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    final = centroids

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own, distance = nearest(*opened(row), final)
                out = pd.DataFrame({"vec_id": pd.Series(list(row.ids), dtype=object), "cluster": own.astype(np.int32), "distance": distance})
                out["cluster_inertia"], out["inertia"], out["centroid_sha256"] = [inertia[c] for c in own], sum(inertia), [names[c] for c in own]
                yield out

    return stored.mapInPandas(assign, schema)
