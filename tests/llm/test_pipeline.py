"""The pipeline against a plain version of every stage, on its predecessor's output, with awkward rows among the documents."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from lodeframe.llm import decontam, quality


def tables(spark, folder):
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("ri", "sto", "wal", "gre", "hil", "mar", "fen") for b in ("ver", "ne", "king", "en", "ls", "sh", "ow", "ing")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(20)) for i in range(6)]
    rows = []
    for d in range(240):
        kind = rng.random()
        if rows and kind < 0.15:
            body = rows[rng.randrange(len(rows))][1] or ""
            body = rng.choice([body, body.replace(" ", "\t ", 3)])
        elif rows and kind < 0.35:
            words = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
            body = " ".join(words)
        elif kind < 0.5:
            body = " ".join(w.upper() + "!!" for w in text(12).split())
        elif kind < 0.6:
            body = f"{text(30)} {items[rng.randrange(6)][1]} {text(30)}"
        else:
            body = text(rng.choice([40, 90, 200]))
        rows.append((d, body))
    rows += [(500, None), (501, ""), (7, "another text of id seven " + text(60)), (None, text(50)), (502, text(60_000)), (rows[9][0], rows[9][1])]
    labels = [(d, int("!!" not in (t or ""))) for d, t in rows if d is not None and d < 240 and rng.random() < 0.8]
    frame = [(d, t, "en", "s", k, "clash", 1.5) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long, told string, __q0 double").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def least(rows):
    return min(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_of_groups(rows, alike):
    """Ids and texts that stay, one of each group."""
    groups = []
    for r in rows:
        own = [g for g in groups if any(alike(r, s) for s in g)]
        groups = [g for g in groups if not any(g is o for o in own)] + [[r, *(s for g in own for s in g)]]
    return sorted(str((least(g).doc_id, norm(least(g).text))) for g in groups)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages_equal_plain_versions(spark, tmp_path):
    items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    said = lambda rows: sorted(str((r.doc_id, norm(r.text))) for r in rows)
    source = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()

    # quality: a plain discriminant from the labelled rows that are not held out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()}
    x = [np.array(quality.statistics(r.text)) for r in source]
    parts = {}
    for y in (0, 1):
        a = np.array([v for v, r in zip(x, source, strict=True) if labels.get(r.doc_id) == y and zlib.crc32(str(r.doc_id).encode()) % 5])
        c = np.cov(a.T, bias=True)
        parts[y] = (len(a), a.mean(0), 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c)))
    log = lambda v, y: np.log(parts[y][0]) - 0.5 * np.linalg.slogdet(parts[y][2])[1] - 0.5 * (v - parts[y][1]) @ np.linalg.inv(parts[y][2]) @ (v - parts[y][1])
    good = [r for v, r in zip(x, source, strict=True) if 1 / (1 + np.exp(np.clip(log(v, 0) - log(v, 1), -500, 500))) >= 0.3]
    assert said(out["quality"]) == said(good) and 0 < len(good) < len(source)

    # exact: of equal normalised texts the smallest id
    assert said(out["exact_dedup"]) == kept_of_groups(out["quality"], lambda r, s: norm(r.text) == norm(s.text))

    # near: of each group at 0.8 of the five-word shingles the smallest id
    sets = {(r.doc_id, r.text): grams(r.text) for r in out["exact_dedup"]}
    near = lambda r, s: 5 * len((a := sets[r.doc_id, r.text]) & (b := sets[s.doc_id, s.text])) >= 4 * len(a | b)
    assert said(out["simhash_dedup"]) == kept_of_groups(out["exact_dedup"], near)
    assert len(out["simhash_dedup"]) < len(out["exact_dedup"]) < len(out["quality"])

    # decontamination: no stretch of the text holds 0.8 of an item's shingles
    def clean(t):
        own = decontam.shingles(decontam.words_of(t))
        return all(len((s := decontam.shingles(decontam.words_of(q))) & own) < 0.8 * len(s) for _, q in items)

    assert said(out["decontamination"]) == said([r for r in out["simhash_dedup"] if clean(r.text)])
    assert len(out["decontamination"]) < len(out["simhash_dedup"])

    # packing: the pieces of each row hold its tokens
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = sorted(str((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1)) for r in out["decontamination"])
    assert sorted(str((r.doc_id, r.doc_tokens)) for r in out["packing"] if r.start == 0) == want
    assert sum(r.length for r in out["packing"]) == sum(r.doc_tokens for r in out["packing"] if r.start == 0)

    # run() gives the same rows, goes on where a run stopped, and leaves the session as it was
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    said = lambda rows: sorted(str((r.doc_id, r.start, r.length, r.ids_crc32)) for r in rows)
    assert said(corpus_pipeline.run(spark, str(tmp_path), str(tmp_path)).collect()) == said(out["packing"])
    assert said(corpus_pipeline.run(spark, str(tmp_path)).collect()) == said(out["packing"])
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == before


def test_no_documents(spark, tmp_path):
    tables(spark, str(tmp_path / "some"))
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path / "some")).count() == 0
