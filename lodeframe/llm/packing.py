"""Packing by power-of-two decomposition: each document's ids are cut into pieces of 2**k, and each piece is a sequence.

Pieces of one length form a bucket, so batches of one bucket need no padding and no sequence crosses documents. There is
no shuffle: a document is tokenised and cut where it is read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a Python worker may hold, the longest of them, texts handled at a time, chunks tokenised as one text, chunks
#: of each call that are compared with the tokenizer's own ids, and words whose ids are gathered at a time.
CACHE_CHUNKS, CHUNK_CHARS, TEXTS, JOINED, COMPARED, GATHERED = 200_000, 256, 500, 4000, 8, 1 << 17
#: A fixed value: how byte-level BPE of this public kind cuts texts.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = " It's 1,234 words; we'll tokenize them_all... été Ärger 日本語 😀 ### &&& |a|b|\nnext LINE\tTAB x=y+z (1999) ~~ \u00ad"


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers.

    The tokenizer cuts texts before a space that a word follows, whatever stands around; so texts are cut there first
    and each distinct chunk is tokenised once; words are told apart and their ids put together in Arrow and NumPy, not
    one by one. Texts with other runs of white space are given to the tokenizer whole. Chunks go through a faster
    implementation of the same vocabulary where the file is of that kind; some of every call are compared.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        self.fast = self._fast(path)
        self.forget()

    def _fast(self, path: str):
        """(encoding, bytes of each id), or None if it would not give the tokenizer's ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        # byte-level vocabularies write each byte as a printable character: itself, or those from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"] for t in said.get("added_tokens", [])}
        try:
            ranks = {bytes(of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in added}
            fast = tiktoken.Encoding("chunks", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
            if fast.encode_ordinary(PROBE) != self.tokenizer.encode(PROBE, add_special_tokens=False).ids:
                return None
        except (KeyError, TypeError, ValueError):
            return None
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(t) for t in ranks]
        return fast, sizes

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """words follow a space, their places are in at; heads begin a text. The ids of a place are pool[bounds[place] :
        bounds[place + 1]]; place 0 has none."""
        self.words, self.at = pa.array([], pa.large_string()), np.empty(0, np.int64)
        self.heads: dict[str, int] = {}
        self.pool, self.bounds = np.empty(0, "<u4"), np.zeros(2, np.int64)

    def learn(self, words: list[str], heads: list[str]) -> None:
        """Words are joined to texts of many, whose ids are shared out by their bytes."""
        ids, sizes, place = [self.pool], [], len(self.bounds) - 1
        if self.fast:
            fast, length = self.fast
            some = [" " + w for w in words[:: max(1, len(words) // COMPARED)]]
            if [np.array(fast.encode_ordinary(c), "<u4").tobytes() for c in some] != self._encode(some):
                raise ValueError("two implementations of the tokenizer's file give different ids")
            for at in range(0, len(words), JOINED):
                part = words[at : at + JOINED]
                own = np.array(fast.encode_ordinary(" " + " ".join(part)), "<u4")
                ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy() + 1)
                ids.append(own)
                sizes.append(np.diff(np.searchsorted(np.cumsum(length[own]), ends) + 1, prepend=0))
        for x in self._encode(heads if self.fast else [" " + w for w in words] + heads):
            ids.append(np.frombuffer(x, "<u4"))
            sizes.append([len(x) // 4])
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.at = np.append(self.at, np.arange(place, place + len(words)))
        self.heads.update(zip(heads, range(place + len(words), place + len(words) + len(heads)), strict=True))
        self.pool = np.concatenate(ids)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes), dtype=np.int64)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each with the end id."""
        plain = [i for i, t in enumerate(texts) if t and t[0] != " " and t[-1] != " " and "  " not in t and "<|" not in t]
        out = self._plain([texts[i] for i in plain]) if plain else []
        found = {i: ids for i, ids in zip(plain, out, strict=True) if ids is not None}
        whole = [i for i in range(len(texts)) if i not in found]
        found.update(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
        return [found[i] + self.end for i in range(len(texts))]

    def _plain(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts whose words stand between single spaces; None if cutting there could give others."""
        if len(self.words) + len(self.heads) > CACHE_CHUNKS:
            self.forget()
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        told = cut.flatten().dictionary_encode()
        words, first = told.dictionary, cut.offsets.to_numpy()[:-1]
        code = told.indices.to_numpy()
        heads = [t[: t.find(" ")] if " " in t else t for t in texts]
        # a word that starts or ends with white space would be cut otherwise next to others
        good = lambda w: len(w) < CHUNK_CHARS and w.strip() == w
        strings = lambda x: x.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in strings(words.filter(pc.is_null(pc.index_in(words, self.words)))) if good(w)]
        fresh = [w for w in dict.fromkeys(heads) if w not in self.heads and good(w)]
        if new or fresh:
            self.learn(new, fresh)
        place = np.append(self.at, 0)[pc.fill_null(pc.index_in(words, self.words), -1).to_numpy()]
        at = place[code]
        at[first] = [self.heads.get(h, 0) for h in heads]
        size = np.diff(self.bounds)
        data = []
        for k in range(0, len(at), GATHERED):
            part = at[k : k + GATHERED]
            n = size[part]
            data.append(self.pool[np.repeat(self.bounds[part] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        data = b"".join(data)
        ends = 4 * np.cumsum(np.add.reduceat(size[at], first))
        spoilt = np.logical_or.reduceat(at == 0, first)
        return [None if x else data[a:b] for x, a, b in zip(spoilt.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, which keeps what it has learned for its next tasks."""
    return Encoder(path, end_id)


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of n ids: as many of the longest as fit, then the binary digits of the rest from the highest."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        out.append((at, length))
        at += length
    return out


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset, and ids if asked for.

    tokenizer is the path of its file, which every executor must have. longest is a power of two. A piece is a sequence
    of its own, so offset is 0. Null and empty texts give the end id alone. Texts of any length are packed whole. Ids, ties
    and repeated rows do not matter: each row is packed for itself. Other columns are not read. An empty table gives no rows.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, end_id)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                rows = []
                for doc, ids in zip(part["doc_id"], encode([t if isinstance(t, str) else "" for t in part["text"]]), strict=True):
                    n = len(ids) // 4
                    for start, length in pieces(n, longest):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(own), n, length.bit_length() - 1, *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *(["ids"] if with_ids else [])]
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = out["doc_id"].astype(batch["doc_id"].dtype)
                yield out

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Parquet, parted by bucket: a reader of one folder gets sequences of one length, which batch without padding. There is
    no shuffle; a task adds to each bucket what it has packed."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def unpack(packed: DataFrame) -> DataFrame:
    """The round trip of pack(with_ids=True): each document's ids in order, without cutting marks; one row per document."""
    parts = F.array_sort(F.collect_list(F.struct("start", "ids")))
    return packed.groupBy("doc_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
