"""Batch search: queries x corpus by BM25, by vectors, or by both, fused and diversified.

Queries are (query_id, query, ...). Documents have doc_id, doc_type, title, aliases, identifiers (array), tags, summary,
content. Lower BM25 scores are better, they are negative.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.operators.kb import DOC_TYPES
from lodeframe.storage import BROADCAST_ROWS, checkpointed, small, stored

#: Columns with their weights; words that part clauses, and words that are left out of them.
WEIGHTS = {"title": 6.0, "aliases": 5.0, "identifiers": 5.0, "tags": 3.0, "summary": 2.0, "content": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PARTING = r"(?iu)\s+(?:hoặc|or|hay|và|va|and|với|voi|cùng|cung)\s+|,\s*"
CONNECTIVES = ("và", "va", "and", "với", "voi", "cùng", "cung", "trong", "của", "cua", "the", "in", "for", "with", "to", "of")
MODES = ("keyword", "dense", "hybrid")
#: Bytes of query vectors that go out for one pass over the chunks, and queries that are compared with a batch at a time.
SENT_BYTES, COMPARED = 256 << 20, 1024


def _normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    cwe = re.compile(r"\b(?:cwe[\s_-]*)?cwe[\s_-]?(\d+)\b", re.I)
    owasp = re.compile(r"\b(?:owasp[\s_-]*)?a0?(\d{1,2})[\s:_-]+(\d{4})\b", re.I)

    def one(q: str | None) -> str | None:
        if q is None:
            return None
        q = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", q)).strip()
        q = cwe.sub(lambda m: f"CWE-{int(m[1])}", q)
        return owasp.sub(lambda m: f"A{int(m[1]):02d}:{m[2]}", q)

    for queries in batches:
        yield queries.map(one)


def normalize_query(c: Column) -> Column:
    """NFKC, single spaces, CWE-n and Ann:yyyy in their usual form. Unicode forms have no Spark function."""
    return F.pandas_udf(_normal, "string")(c)


def parse_query(queries: DataFrame, query: str = "query") -> DataFrame:
    """R2: (query_id, clause, phrase_pos, phrase): clauses are alternatives, all phrases of one must be there.

    Connectives go unless nothing else is in a clause. Queries without a token give no rows: they are rejected.
    """
    clauses = queries.select("query_id", F.posexplode(F.split(query, PARTING)).alias("clause", "text"))
    tokens = F.regexp_extract_all("text", F.lit(r"(?i)CWE-\d+|A\d{2}:\d{4}|[A-Za-z0-9]+"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~F.lower(t).isin(*CONNECTIVES))
    rows = clauses.select("query_id", "clause", F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(tokens)).alias("phrase_pos", "phrase"))
    return rows.withColumn("phrase", F.lower("phrase"))


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (doc_id, col, term, pos), lengths (doc_id, tokens)). Texts are cut into tokens once, which are stored."""
    kinds = dict(docs.dtypes)
    text = lambda c: F.array_join(c, " \x1f ") if kinds[c].startswith("array") else F.col(c)
    cols = F.array(*[F.struct(F.lit(c).alias("col"), _tokens(text(c)).alias("tokens")) for c in WEIGHTS if c in kinds])
    cut = stored(docs.select("doc_id", cols.alias("cols")))
    rows = cut.select("doc_id", F.explode("cols").alias("x"))
    postings = rows.select("doc_id", "x.col", F.posexplode("x.tokens").alias("pos", "term"))
    return postings, cut.select("doc_id", F.aggregate("cols", F.lit(0), lambda n, x: n + F.size(x["tokens"])).alias("tokens"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """An index of docs as tables: postings parted by a hash of the term, and lengths. A term's bucket is sorted by
    terms and may be several files."""
    postings, lengths = build_index(docs)
    spread = postings.withColumns({"bucket": _bucket(buckets), "buckets": F.lit(buckets)}).repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term")
    spread.write.mode("overwrite").option("compression", "zstd").partitionBy("buckets", "bucket").parquet(f"{folder}/postings")
    lengths.write.mode("overwrite").parquet(f"{folder}/lengths")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What write_index wrote. Searches read the buckets of their terms only."""
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")


def phrase_hits(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """(phrase, doc_id, col, tf) for distinct phrases: their terms stand one after the other in one column."""
    each = phrases.select("phrase").distinct().withColumn("terms", _tokens(F.col("phrase")))
    terms = each.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("k", "term"))
    if "bucket" in postings.columns:
        buckets = postings.select("buckets").first()
        terms = terms.withColumn("bucket", _bucket(buckets[0] if buckets else 1))
        wanted = [r[0] for r in terms.select("bucket").distinct().collect()]  # numbers below the count of buckets
        postings = postings.where(F.col("bucket").isin(wanted))
    # postings are cut down to the queries' terms before anything is shuffled, if those are few enough to be sent
    terms = small(terms, terms.count(), BROADCAST_ROWS)
    found = postings.join(terms.drop("bucket"), "term").select("phrase", "n", "doc_id", "col", (F.col("pos") - F.col("k")).alias("at"))
    whole = found.groupBy("phrase", "n", "doc_id", "col", "at").agg(F.count("*").alias("m")).where("m = n")
    return whole.groupBy("phrase", "doc_id", "col").agg(F.count("*").alias("tf"))


def match_docs(clauses: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, doc_id) with all phrases of a clause, from phrase_hits."""
    found = hits.select("phrase", "doc_id").distinct()
    want = clauses.select("query_id", "clause", "phrase").distinct()
    need = want.groupBy("query_id", "clause").agg(F.count("*").alias("need"))
    got = want.join(found, "phrase").groupBy("query_id", "clause", "doc_id").agg(F.count("*").alias("got"))
    return got.join(need, ["query_id", "clause"]).where("got = need").select("query_id", "doc_id").distinct()


def bm25(clauses: DataFrame, postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all matches: Okapi BM25 of weighted frequencies over the query's distinct phrases."""
    stats = lengths.agg(F.count("*").alias("docs"), F.avg("tokens").alias("mean"))  # one row
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    clauses = checkpointed(clauses)
    found = checkpointed(phrase_hits(clauses, postings))
    hits = found.groupBy("phrase", "doc_id").agg(F.sum(F.col("tf") * F.try_element_at(weight, F.col("col"))).alias("f"))
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    one = hits.join(df, "phrase").join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    part = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("tokens") / F.col("mean")))
    scored = one.select("phrase", "doc_id", part.alias("part"))
    want = clauses.select("query_id", "phrase").distinct()
    total = want.join(scored, "phrase").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return total.join(match_docs(clauses, found), ["query_id", "doc_id"])


def search_keyword(queries: DataFrame, docs: DataFrame, top_k: int = 10, doc_type: str | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Queries (query_id, normalized) -> (query_id, rank, doc_id, tier, score); index as read_index gives it, or made here.

    Order: tier (0 identifier, 1 title, 2 alias, 3 else), owner of an identifier-shaped query, score, doc_id.
    """
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    return _keyword(queries, docs, top_k, doc_type, index)


def _keyword(queries: DataFrame, docs: DataFrame, top_k: int, doc_type: str | None, index: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """The same for any top_k: candidates of a hybrid search may be more than a user may ask for."""
    postings, lengths = index or build_index(docs)
    scored = bm25(parse_query(queries, "normalized"), postings, lengths)
    names = docs.select("doc_id", "doc_type", "title", "aliases", "identifiers")
    names = names if doc_type is None else names.where(F.col("doc_type") == doc_type)
    q = F.lower("normalized")
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    tier = F.when(F.array_contains(lower("identifiers"), q), 0).when(F.lower("title") == q, 1).when(F.array_contains(lower("aliases"), q), 2).otherwise(3)
    owner = F.when(F.col("normalized").rlike("^CWE-[0-9]") & (F.col("doc_type") == "cwe"), 0).when(F.col("normalized").rlike("^A[0-9]{2}:[0-9]{4}$") & (F.col("doc_type") == "owasp_category"), 0).otherwise(1)
    rows = scored.join(queries.select("query_id", "normalized"), "query_id").join(names, "doc_id").withColumns({"tier": tier, "owner": owner})
    w = Window.partitionBy("query_id").orderBy("tier", "owner", F.round("score", 9), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", "tier", "score")


def snippet(content: Column, terms: Column, size: int = 24) -> Column:
    """The densest window of `size` words around hits, earliest first, hits marked."""
    words = F.split(F.coalesce(content, F.lit("")), r"\s+")
    hit = lambda w: F.coalesce(F.arrays_overlap(_tokens(w), terms), F.lit(False))
    marks = F.transform(words, lambda w: F.when(hit(w), 1).otherwise(0))
    starts = F.filter(F.transform(marks, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    dense = F.transform(starts, lambda i: F.struct((-F.aggregate(F.slice(marks, i + 1, F.lit(size)), F.lit(0), lambda a, b: a + b)).alias("n"), i.alias("at")))
    at = F.coalesce(F.array_min(dense)["at"], F.lit(0))
    shown = F.transform(F.slice(words, at + 1, F.lit(size)), lambda w: F.when(hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return F.concat(F.when(at > 0, " … ").otherwise(""), F.array_join(shown, " "), F.when(F.size(words) > at + size, " … ").otherwise(""))


def search_dense(queries: DataFrame, chunks: DataFrame, top_k: int = 10, doc_type: str | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Queries (query_id, vector) x chunks (chunk_id, parent_doc_id, doc_type, vector) -> (query_id, rank, doc_id, score,
    chunk_id): the best min(max(5 k, 20), 200) chunks by cosine, then the best chunk of each parent.

    Queries are sent to the tasks, sent_bytes of them for each pass over the chunks. A batch keeps only its best chunks of
    each query, so that is all that is shuffled.
    """
    most = min(max(5 * top_k, 20), 200)
    rows = (chunks if doc_type is None else chunks.where(F.col("doc_type") == doc_type)).select("chunk_id", "parent_doc_id", "vector")
    sc = chunks.sparkSession.sparkContext
    kinds = dict(queries.dtypes) | {"parent": dict(chunks.dtypes)["parent_doc_id"], "chunk": dict(chunks.dtypes)["chunk_id"]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk']}, doc_id {kinds['parent']}, score double"
    size = queries.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0
    n = max(1, -(-size // sent_bytes))
    parts = []
    for k in range(n):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).select("query_id", "vector").toPandas()
        if own.empty and (parts or k + 1 < n):
            continue
        matrix = np.array(own["vector"].tolist(), np.float64).reshape(len(own), -1 if len(own) else 0)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True) if len(own) else 1
        sent = sc.broadcast((own["query_id"].tolist(), matrix / np.where(norm == 0, 1, norm)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for batch in batches:
                batch = batch[batch["vector"].notna()]
                if not len(batch) or not len(ids):
                    continue
                v = np.array(batch["vector"].tolist(), np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = (v / np.where(size == 0, 1, size)).T
                for at in range(0, len(ids), COMPARED):
                    scores = q[at : at + COMPARED] @ v
                    keep = min(most, scores.shape[1])
                    if keep < scores.shape[1]:  # all that tie with the last one stay
                        last = np.partition(scores, -keep, axis=1)[:, -keep]
                        i, j = np.nonzero(scores >= last[:, None])
                    else:
                        i, j = (x.ravel() for x in np.indices(scores.shape))
                    yield pd.DataFrame({"query_id": [ids[at + x] for x in i], "chunk_id": batch["chunk_id"].to_numpy()[j], "doc_id": batch["parent_doc_id"].to_numpy()[j], "score": scores[i, j]})

        parts.append(rows.mapInPandas(run, schema))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionAll(p)
    best = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    score = F.round("score", 9)
    top = hits.withColumn("score", score).withColumn("n", best(["query_id"], [F.desc("score"), F.col("chunk_id")])).where(F.col("n") <= most)
    parents = top.withColumn("n", best(["query_id", "doc_id"], [F.desc("score"), F.col("chunk_id")])).where("n = 1")
    return parents.withColumn("rank", best(["query_id"], [F.desc("score"), F.col("doc_id")])).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", "score", "chunk_id")


def rrf(sparse: DataFrame, dense: DataFrame, k: int = 60, w_sparse: float = 1.0, w_dense: float = 1.0) -> DataFrame:
    """(query_id, rank, doc_id, score) of two ranked lists; ties keep the order of the sparse list, then the dense one."""
    a = sparse.select("query_id", "doc_id", F.lit(0).alias("source"), "rank", (w_sparse / (k + F.col("rank"))).alias("s"))
    b = dense.select("query_id", "doc_id", F.lit(1).alias("source"), "rank", (w_dense / (k + F.col("rank"))).alias("s"))
    fused = a.unionAll(b).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.min(F.struct("source", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first")
    return fused.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "doc_id", "score")


def diversify(scores: np.ndarray, vectors: list[np.ndarray | None], query: np.ndarray | None, top_k: int, lam: float) -> list[int]:
    """Greedy maximal marginal relevance; the first wins ties; documents without a vector are like none."""
    low, span = scores.min(), scores.max() - scores.min()
    rel = (scores - low) / (span if span > 0 else 1.0)
    unit = [v / n if v is not None and (n := np.linalg.norm(v)) > 0 else None for v in vectors]
    q = query / n if query is not None and (n := np.linalg.norm(query)) > 0 else None
    cos = np.array([float(v @ q) if v is not None and q is not None else np.nan for v in unit])
    first = rel + np.nan_to_num(cos)
    rel = np.where(np.isnan(cos), rel, cos)
    chosen, rest = [], list(range(len(scores)))
    while rest and len(chosen) < top_k:
        if not chosen:
            best = max(rest, key=lambda i: (first[i], -i))
        else:
            like = lambda i: max((float(unit[i] @ unit[j]) for j in chosen if unit[i] is not None and unit[j] is not None), default=0.0)
            best = max(rest, key=lambda i: (lam * rel[i] - (1 - lam) * like(i), -i))
        chosen.append(best)
        rest.remove(best)
    return chosen


def mmr(candidates: DataFrame, queries: DataFrame, top_k: int = 10, lam: float = 0.7) -> DataFrame:
    """Candidates (query_id, rank, doc_id, score, vector), at most some 200 a query -> (query_id, rank, doc_id)."""
    kinds = dict(candidates.dtypes)

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank").reset_index(drop=True)
        vectors = [np.array(v) if v is not None else None for v in own["vector"]]
        q = own["q"].iloc[0]
        got = diversify(own["score"].to_numpy(float), vectors, np.array(q) if q is not None else None, top_k, lam)
        return pd.DataFrame({"query_id": own["query_id"].iloc[0], "rank": range(1, len(got) + 1), "doc_id": own["doc_id"].iloc[got].to_numpy()})

    rows = candidates.join(queries.select("query_id", F.col("vector").alias("q")), "query_id", "left")
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, rank int, doc_id {kinds['doc_id']}")


def search_hybrid(queries: DataFrame, docs: DataFrame, chunks: DataFrame, top_k: int = 10, doc_type: str | None = None, lam: float = 0.7, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score, matched_section, snippet, and the document's columns).

    max(20, 4 k) candidates of R5 and of R7 each are fused (R8), cut to as many and diversified (R9). Only what the dense side
    found has a vector, that of its best chunk, whose section and content are shown; other documents show their summary.
    Queries without a vector, or without words, have one side only. chunks may have section and content.
    """
    n = max(20, 4 * top_k)
    dense = checkpointed(search_dense(queries.where(F.col("vector").isNotNull()), chunks, n, doc_type))
    fused = checkpointed(rrf(_keyword(queries, docs, n, doc_type, index), dense).where(F.col("rank") <= n))
    own = lambda c, name: (F.col(c) if c in chunks.columns else F.lit(None).cast("string")).alias(name)
    hit = chunks.select("chunk_id", "vector", own("section", "matched_section"), own("content", "chunk_text"))
    hits = checkpointed(hit.join(small(dense.select("query_id", "doc_id", "chunk_id"), dense.count()), "chunk_id").drop("chunk_id"))
    chosen = mmr(fused.join(hits.select("query_id", "doc_id", "vector"), ["query_id", "doc_id"], "left"), queries, top_k, lam)
    told = chosen.join(fused.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]).join(hits.drop("vector"), ["query_id", "doc_id"], "left")
    whole = told.join(docs, "doc_id")
    snippet_of = F.when(F.coalesce("chunk_text", F.lit("")) != "", F.col("chunk_text")).otherwise(F.col("summary"))
    return whole.withColumns({"snippet": snippet_of, "matched_section": F.coalesce("matched_section", F.lit(""))}).select("query_id", "rank", "doc_id", "score", "matched_section", "snippet", *[c for c in docs.columns if c != "doc_id"])


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good queries, bad ones with their first error): query, top_k, doc_type, mode."""
    from lodeframe.operators.normalize import validate

    return validate(queries, {"query": F.trim("query") != "", "top_k": F.col("top_k").between(1, 50), "doc_type": F.col("doc_type").isNull() | F.col("doc_type").isin(*DOC_TYPES), "mode": F.col("mode").isin(*MODES)})
