"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clusters, decontam, exact_dedup, language, negatives, ngrams, packing, pii, quality, secrets, simhash
from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("row_id")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ngrams.score(table(spark, sf_dir, "documents"))
    return scores.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", shifted))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_chat": op3_chat,
        "op4_lm_score": op4_lm_score,
        "op5_quality": op5_quality,
        "op6_secrets": op6_secrets,
        "op7_packing": op7_packing,
        "op8_language": op8_language,
        "op9_simhash": op9_simhash,
        "op10_pii": op10_pii,
        "op11_bpe": op11_bpe,
        "op12_clusters": op12_clusters,
        "op13_hard_negatives": op13_hard_negatives,
    }


def _clusters_sql() -> str:
    """The rounds one after the other: nearest centroids, then floors of the means, empty clusters as before."""
    fine = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    q = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
    near = "SELECT v.vec_id, v.q, CAST(min(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 8 + c.c) AS BIGINT) AS d FROM v, c{} c GROUP BY v.vec_id, v.q"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, {q} AS q FROM embeddings WHERE {fine})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 8))",
    ]
    for k in range(10):
        steps += [
            f"a{k} AS MATERIALIZED ({near.format(k)})",
            f"m{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT d % 8 AS c, unnest(q) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY c, i)",
            f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.q, c{k}.q) AS q FROM c{k} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM m{k} GROUP BY c) m ON m.c = c{k}.c)",
        ]
    return f"""WITH {", ".join(steps)}, a10 AS MATERIALIZED ({near.format(10)})
        SELECT vec_id, CAST(d % 8 AS INTEGER) AS cluster, d // 8 AS distance, CAST(sum(d // 8) OVER (PARTITION BY d % 8) AS BIGINT) AS cluster_inertia,
               CAST(sum(d // 8) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.q, ',')) AS centroid_sha256
        FROM a10 JOIN c10 ON c10.c = d % 8"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)""",
        "op3_chat": r"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
            c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(31) || text || chr(30), '' ORDER BY i) AS s FROM t GROUP BY conv_id),
            k AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.n > c.n AND starts_with(b.s, c.s)) GROUP BY n, s)
            SELECT conv_id, CAST((i - 1) // 1024 AS BIGINT) AS part, n AS n_turns, copies,
                   string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY i) AS text
            FROM t JOIN k USING (conv_id) GROUP BY ALL""",
        "op4_lm_score": r"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
            p AS (SELECT doc_id, i, len(ws) AS m, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM i),
            o AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS ow, count(*) OVER (PARTITION BY doc_id, p, w) AS ob FROM p),
            t AS (SELECT *, lag(ow) OVER (PARTITION BY doc_id ORDER BY i) AS op FROM o),
            u AS (SELECT w, count(*) AS c FROM t GROUP BY w), n AS (SELECT count(*) AS n FROM t),
            b AS (SELECT p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY p, w),
            s AS (SELECT t.doc_id, count(*) AS n_words, sum(CASE WHEN t.p IS NOT NULL AND b.c = ob THEN 1 ELSE 0 END) AS n_backoff,
                  fsum(CASE WHEN b.c > ob THEN ln(b.c - ob) - ln(f.c - op)
                       ELSE ln(greatest(u.c - ow, 0.5)) - ln(greatest(n.n - m, 1)) + CASE WHEN t.p IS NULL THEN 0 ELSE ln(0.4) END END) AS x
                  FROM t JOIN u ON u.w = t.w CROSS JOIN n LEFT JOIN b ON b.p = t.p AND b.w = t.w LEFT JOIN u f ON f.w = t.p GROUP BY t.doc_id)
            SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, CAST(coalesce(s.n_backoff, 0) AS BIGINT) AS n_backoff,
                   round(coalesce(s.x, 0.0), 3) AS log_score, round(s.x / s.n_words, 6) AS mean_log_score
            FROM d LEFT JOIN s USING (doc_id)""",
        "op12_clusters": _clusters_sql(),
        "op13_hard_negatives": r"""
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
            s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
                FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
            p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
            n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
                FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
            SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    }
