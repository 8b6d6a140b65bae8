"""Quality by a regularised quadratic discriminant over transformed document statistics.

One pass over the texts gives each document a few numbers; class means and covariances come from sums of those and of
their products over all labelled rows (one aggregation, combined before its shuffle). The covariances are shrunk to their
diagonals and factored once; a score is the logistic of the difference of the two Mahalanobis log densities and the prior,
written as column arithmetic with the inverted Cholesky factors as constants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed, fresh, small

#: Names of the statistics, in the order of `statistics`.
STATISTICS = ("words", "upper", "marks", "stops", "lines", "distinct", "repeats", "length", "bars")
#: Characters with which every share is smoothed, so that short texts lie near the middle.
SMOOTH = 100.0
#: Weight of the diagonal in a class covariance, and what is added to each variance.
SHRINK, RIDGE = 0.1, 1e-3
#: A score from here on is label 1.
THRESHOLD = 0.3
#: Labelled rows that keep_good() learns from, by a hash of their ids: all, or about that many. scored() takes all.
LABELLED = 200_000


def statistics(text: str | None) -> list[float]:
    """Of the UTF-8 bytes: counts of kinds, as log shares; of the words: how many differ, how many repeat the one before."""
    data = (text or "").encode()
    n = len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=128) if n else np.zeros(128, np.int64)
    stops = count[44] + count[46]
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum() - stops
    words = data.split()
    k, distinct = len(words), len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    share = lambda x: float(np.log((x + SMOOTH * 0.02) / (n + SMOOTH)))
    return [
        float(np.log1p(k)),
        share(count[65:91].sum()),
        share(marks),
        share(stops),
        share(count[10]),
        float(np.log((distinct + 1 + SMOOTH * 0.1) / (k + 1 + SMOOTH * 0.15))),
        float(np.log((repeats + 1) / (k + 21))),
        (n + 1 + SMOOTH) / (k + 1 + SMOOTH / 6),
        share(count[124]),
    ]


def names_in(docs: DataFrame) -> list[str]:
    """Columns for the statistics, by names that docs doesn't have."""
    return [fresh(docs, f"__q{i}") for i in range(len(STATISTICS))]


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """docs' columns in keep, and the statistics of its text in columns of names_in(docs)."""
    names, quoted = names_in(docs), [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*quoted).schema
    for name in names:
        schema = schema.add(name, "double")
    n = len(keep)
    source = docs.select(*quoted, F.col(text_col).alias(fresh(docs, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n)
            x = np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))
            columns = [batch.column(i) for i in range(n)] + [pa.array(x[:, i]) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverted Cholesky factors and log terms; None stands for a constant score."""

    means: tuple | None
    factors: tuple | None
    offset: float

    def score(self, names: list[str]) -> Column:
        """The probability of label 1 from the statistics in these columns."""
        if self.means is None:
            return F.lit(self.offset)

        def distance(mean: np.ndarray, factor: np.ndarray) -> Column:
            x = [F.col(c) - float(m) for c, m in zip(names, mean, strict=True)]
            rows = [reduce(Column.__add__, (x[j] * float(factor[i, j]) for j in range(i + 1))) for i in range(len(x))]
            return reduce(Column.__add__, (r * r for r in rows))

        zero, one = (distance(m, f) for m, f in zip(self.means, self.factors, strict=True))
        margin = (zero - one) * 0.5 + self.offset
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(margin, F.lit(500.0)), F.lit(-500.0))))


def marks(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, y) of labels (doc_id, label): of several labels of a document their mean, from 0.5 on as 1; null ones don't count."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))


def fit(stats: DataFrame, marked: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """The discriminant from all rows of stats (doc_id, statistics) that are marked; the caller leaves out held-out rows.

    Without rows of both classes (three of each at least) the score is the share of label 1, or 0.5 without any.
    """
    d = len(STATISTICS)
    q = [F.col(c) for c in stats.columns[1:]]
    sums = [F.sum(x) for x in q] + [F.sum(q[i] * q[j]) for i in range(d) for j in range(i + 1)]
    rows = stats.join(marked, "doc_id").groupBy("y").agg(F.count("*"), *sums).collect()  # two rows
    by = {r[0]: np.array(r[1:], np.float64) for r in rows}
    n = {y: by[y][0] if y in by else 0.0 for y in (0, 1)}
    if min(n.values()) < 3:
        return Discriminant(None, None, n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    means, factors, logs = [], [], []
    for y in (0, 1):
        mean = by[y][1 : d + 1] / n[y]
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = by[y][d + 1 :] / n[y]
        second = np.tril(second) + np.tril(second, -1).T
        cov = second - np.outer(mean, mean)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        logs.append(float(np.log(n[y]) - np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(means), tuple(factors), logs[1] - logs[0])


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text is divisible by 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null text counts as empty; empty texts get a score.

    Texts of any length are read whole. Repeated rows are scored each. Null ids are scored, never learned from. No other
    column of docs is read, whatever its name. An empty table gives no rows.
    """
    stats = checkpointed(with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"]))
    model = fit(stats.where(~held_out()), marks(labels.select(F.col(id_col).alias("doc_id"), "quality")))
    out = stats.select("doc_id", held_out().alias("held_out"), model.score(stats.columns[1:]).cast("double").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, labelled: int = LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold.

    Learns from about `labelled` marked rows at most, so that all others go through Python once. Null and empty texts,
    repeated rows and null ids are scored like others, texts of any length whole. Names of docs' columns may be any. An
    empty table gives no rows; without labels all rows score 0.5.
    """
    marked = checkpointed(marks(labels.select(F.col(id_col).alias("doc_id"), "quality")).where(~held_out()))
    n = marked.count()
    if n > labelled:  # hashes are even, so this share of them holds about that many rows
        marked = checkpointed(marked.where(F.xxhash64("doc_id") <= int(-(2**63) + labelled / n * (2**64 - 1))))
        n = marked.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    taught = rows.join(small(marked.select("doc_id"), n, 2 * labelled), "doc_id", "left_semi")
    model = fit(with_statistics(taught, "text", ["doc_id"]), marked)
    return with_statistics(docs, text_col, docs.columns).where(model.score(names_in(docs)) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
