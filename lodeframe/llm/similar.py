"""Near copies by the similarity of their five-word shingles: SimHash, its index of byte positions, verification, and an exact join.

The method is that of op9 (simhash.py) on five-word shingles: SimHash fingerprints of 64 bits, lists by byte positions, a
tally of shared bytes, pairs of at most three differing bits. What it proposes is verified by the shingles themselves, so
nothing below the similarity is linked. Most of a family of close copies then hangs together, however large it is.

At a similarity of 0.8 some 15 % of a SimHash's bits differ, whatever its width; no set of bit positions is then both
shared by nearly all such pairs and selective. So an exact join follows, which loses no pair: of two texts at 0.8 each has
one of the other's first fifth (and one more) of shingles, in any order of all shingles. The order is from rare to frequent,
so a template comes last and proposes nothing. Any order is right; frequencies, which only make it fast, are from some texts.

Texts of different groups with such a shingle in common are compared by bitmaps: a bit for each hash value, which tells
whether an odd number of the text's shingles has it. Bits that differ are no more than shingles that differ, so a pair with
too many of them is surely below the similarity. The closest of those left are verified first, and what they link needs no
more. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, checkpointed, components, divided, small
from .simhash import first_rows, links, majority

WORDS, SIMILARITY = 5, 0.8
#: Differing bits of two SimHashes that are linked, as op9 has it.
BITS = 3
#: Members of a list that one task compares with as many.
BLOCK = 1024
#: Rounds before all pairs that are left, in which the closest partner of a member is verified, then the closest MORE, and so on.
ROUNDS, MORE = 2, 8
#: Rows of lists that go to Python together, about; places of pairs that are compared at a time.
DEALT_ROWS, PLACES = 8192, 1 << 18
#: Frequent shingles that the driver holds at most (4 MB), and the part of the texts, one in so many, that they are counted in.
FREQUENT, COUNTED = 1 << 18, 32
#: Bits of a text's bitmap, at least and at most; between them one or two for each shingle.
NARROW, WIDE = 512, 1 << 16
#: Rows that may be broadcast in each of the rounds, which come in close succession: fewer than elsewhere, since the driver
#: builds each table that is sent; beyond it adaptive execution isn't to send them either.
SENT = 20_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; A-Z are lower-cased, words end at ASCII white space, a shorter text is one shingle."""
    w = (text or "").encode().lower().split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))], np.uint64))


def name(grams: np.ndarray) -> int:
    """Of a set of shingles, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 42)).view(np.int64))


def parities(grams: np.ndarray) -> bytes:
    """A bit for each of a power of two of hash values: whether an odd number of the set has it."""
    width = min(WIDE, max(NARROW, 1 << (len(grams) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def frequent(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come most often in one of COUNTED texts, sorted, and how often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"grams": [shingles(t if isinstance(t, str) else None, words).view(np.int64) for t in batch["text"]]})

    texts = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)
    some = texts.mapInPandas(run, "grams array<long>").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    some = checkpointed(some.where("n > 1").withColumn("level", F.floor(8 * F.log2("n"))))
    total, least = 0, None
    # levels are few; those that fit together are held, a sort for the first so many would hold as many for each task
    for level, rows in sorted(some.groupBy("level").count().collect(), reverse=True):
        total += rows
        if total > FREQUENT:
            break
        least = level
    often = some.where(F.lit(False) if least is None else F.col("level") >= least).select("gram", "n").toArrow()
    names, counts = often["gram"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(names)
    return names[order], counts[order]


def rarest(grams: np.ndarray, similarity: float, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a similar text must have one among its own."""
    first = len(grams) - math.ceil(similarity * len(grams) - 1e-9) + 1
    if not len(names):
        return grams[:first]
    at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
    return grams[np.argsort(np.where(names[at] == grams, counts[at], 0), kind="stable")[:first]]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, told, fp, size, simhash, parity, rare) per row: a hash that tells texts of one id, the name of its set, its
    shingles' number, SimHash and bitmap, and the rarest of them."""
    names, counts = frequent(docs, text_col, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                grams = shingles(t if isinstance(t, str) else None, words)
                bits = int(np.uint64(majority(grams)).view(np.int64))
                rows.append((name(grams), len(grams), bits, parities(grams), rarest(grams, similarity, names, counts).view(np.int64)))
            out = pd.DataFrame(rows, columns=["fp", "size", "simhash", "parity", "rare"])
            out.insert(0, "told", batch["told"].array)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("told"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, told long, fp long, size long, simhash long, parity binary, rare array<long>")


def _sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(fp, grams) of members (fp, first); their texts are read again. Beyond a broadcast a bitmap of them keeps other texts
    from being shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fp, t in zip(batch["fp"], batch["text"], strict=True):
                grams = shingles(t if isinstance(t, str) else None, words)
                if name(grams) == fp:  # an id may come again with another text
                    rows.append((fp, grams.view(np.int64)))
            yield pd.DataFrame(rows, columns=["fp", "grams"])

    count = members.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if count > BROADCAST_ROWS:
        texts = divided(texts, members.select("first"), [F.col("id")], count)[0]
    found = texts.join(small(members, count), F.col("id").eqNullSafe(F.col("first"))).select("fp", "text").mapInPandas(run, "fp long, grams array<long>")
    return checkpointed(found.dropDuplicates(["fp"]))


def _near(classes: DataFrame) -> DataFrame:
    """(u, v): classes (fp, simhash) that the SimHash index links, and those of one SimHash with the least of them."""
    least = checkpointed(classes.groupBy("simhash").agg(F.min("fp").alias("fp")))
    same = classes.join(least.select("simhash", F.col("fp").alias("to")), "simhash").where("fp > to").select(F.col("to").alias("u"), F.col("fp").alias("v"))
    linked = links(least.select(F.col("simhash").alias("fp")), BITS)
    for end in ("u", "v"):
        at = least.select(F.col("simhash").alias(end), F.col("fp").alias(f"{end}_fp"))
        linked = linked.join(at, end)
    return same.unionAll(linked.select(F.least("u_fp", "v_fp"), F.greatest("u_fp", "v_fp"))).distinct()


def _shared(prints: DataFrame) -> DataFrame:
    """(gram, fp, size) of the rarest shingles that more than one row has, and a few others.

    Only counts of them are shuffled; a bitmap of those that come again keeps the rest where they are.
    """
    each = prints.select(F.explode("rare").alias("gram"), "fp", "size")
    again = each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    rows = prints.agg(F.sum(F.size("rare"))).first()[0] or 0
    return divided(each, again, [F.col("gram")], rows // 8)[0].distinct()


def _lists(rare: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Blocks (gram, lo, hi) of (fp, size, parity, block) to be compared.

    Members of the largest group that a gram has are not compared with one another. Grams with the same members are one.
    """
    each = rare.groupBy("gram", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("a"), F.sum(F.xxhash64("fp", F.lit(1)).cast("decimal(20,0)")).alias("b"))
    whole = each.groupBy("gram").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.sum("b").alias("b"))
    lists = checkpointed(whole.where("n > most.n").groupBy("n", "a", "b").agg(F.min(F.struct("gram", "most")).alias("one")).select("n", "one.gram", "one.most"))
    few, many = F.ceil((F.col("n") - F.col("most.n")) / block).cast("int"), F.ceil(F.col("most.n") / block).cast("int")
    large, place = F.col("root") == F.col("most.root"), F.xxhash64("fp")
    own = rare.join(F.broadcast(lists) if lists.count() <= SENT else lists.hint("merge"), "gram").join(members.select("fp", "parity"), "fp")
    own = own.withColumn("block", F.when(large, few + F.pmod(place, many)).otherwise(F.pmod(place, few)).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(large, few).otherwise(few + many) - 1)))
    return checkpointed(dealt.select("gram", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "size", "parity", "block"))


def _allowed(marks: list[np.ndarray], size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j): whether bitmaps allow the similarity, and the share of their shingles that surely differ."""
    widths, differ = np.array([len(m) for m in marks]), np.zeros(len(i), np.int64)
    places, stacks = np.empty(len(marks), np.int64), {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        places[at], stacks[w] = np.arange(len(at)), np.stack([marks[k] for k in at])
    for w in stacks:
        for x in (w // 2, w, 2 * w):  # sizes that are allowed differ by less than half
            p = np.flatnonzero((widths[i] == w) & (widths[j] == x))
            for p in np.array_split(p, len(p) * w // PLACES + 1) if len(p) else ():
                a, b = stacks[w][places[i[p]]], stacks[x][places[j[p]]]
                a, b = (m if m.shape[1] <= min(w, x) else m[:, : min(w, x)] ^ m[:, min(w, x) :] for m in (a, b))
                differ[p] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    both = size[i] + size[j]
    return (1 + similarity) * differ <= (1 - similarity) * both + 1e-9, differ / both


def _closest(similarity: float, most: int):
    """Of blocks: (u, v) for pairs of different groups that sizes and bitmaps allow, of each member's so many as are closest;
    (gram, lo, hi) of the blocks that have more."""

    def run(table: pa.Table) -> pa.Table:
        fp, root, size, block, gram, lo, hi = (table[c].to_numpy() for c in ("fp", "root", "size", "block", "gram", "lo", "hi"))
        order = np.lexsort((fp, hi, lo, gram))
        fp, root, size, block, gram, lo, hi = (c[order] for c in (fp, root, size, block, gram, lo, hi))
        marks = [np.frombuffer(p, np.uint64) for p in table["parity"].take(pa.array(order)).to_pylist()]
        starts = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        many = np.diff(np.concatenate((starts, [len(fp)])))
        first, times = np.repeat(starts, many), np.repeat(many, many)
        u, v, left = [], [], []
        at, ends = 0, np.cumsum(times)
        while at < len(fp):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
            i = np.repeat(np.arange(at, to), times[at:to])
            j = np.arange(len(i)) - np.repeat(ends[at:to] - times[at:to] - (ends[at - 1] if at else 0), times[at:to]) + first[i]
            may = (root[i] != root[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))
            may &= similarity * np.maximum(size[i], size[j]) <= np.minimum(size[i], size[j]) + 1e-9
            i, j = i[may], j[may]
            near, far = _allowed(marks, size, i, j, similarity)
            i, j, far = i[near], j[near], far[near]
            order = np.lexsort((fp[j], far, i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            left.append(np.unique(first[i[place >= most]]))
            i, j = i[place < most], j[place < most]
            u.append(np.minimum(fp[i], fp[j]))
            v.append(np.maximum(fp[i], fp[j]))
            at = to
        u, v, left = np.concatenate(u), np.concatenate(v), np.unique(np.concatenate(left))
        pairs = np.unique(np.stack([u, v], 1), axis=0)
        none = pa.nulls(len(left), pa.int64()), pa.nulls(len(pairs), pa.int64())
        ends = [pa.concat_arrays([pa.array(pairs[:, k]), none[0]]) for k in (0, 1)]
        return pa.table([*ends, *[pa.concat_arrays([none[1], pa.array(c[left].astype(np.int64))]) for c in (gram, lo, hi)]], ["u", "v", "gram", "lo", "hi"])

    return run


def _joined(roots: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
    """roots (node, root) after these pairs. What hangs together so far is a star, so later rounds have little to contract."""
    if not pairs.take(1):
        return roots
    known = pairs if roots is None else pairs.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return checkpointed(components(known))


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of their fp, which is fp itself where it hangs together with no other."""
    if roots is None:
        return rows.withColumn("root", F.col("fp"))
    now = roots.select(F.col("node").alias("fp"), F.col("root").alias("now"))
    return rows.join(now.hint("merge"), "fp", "left").withColumn("root", F.coalesce("now", "fp")).drop("now")


def similar_roots(docs: DataFrame, prints: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, similarity: float, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame | None:
    """(node, root) of those classes (fp, first, simhash, parity) that hang together by proposed pairs that the shingles confirm."""

    def verified(pairs: DataFrame) -> DataFrame:
        """Those with a Jaccard similarity of at least that."""
        pairs = checkpointed(pairs)
        count = pairs.count()
        ends = pairs.select(F.col("u").alias("fp")).unionAll(pairs.select("v")).distinct()
        ends = checkpointed(classes.select("fp", "first").join(ends.hint("merge") if count > SENT else F.broadcast(ends), "fp"))
        sets = _sets(docs, ends, id_col, text_col, words)
        few = F.broadcast(pairs) if count <= SENT else pairs.hint("merge")
        a = sets.join(few, F.col("fp") == F.col("u")).select("u", "v", F.col("grams").alias("a"))
        b = sets.join(few, F.col("fp") == F.col("v")).select("u", "v", F.col("grams").alias("b"))
        common = F.size(F.array_intersect("a", "b"))
        return checkpointed(a.join(b, ["u", "v"]).where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"))

    roots = _joined(None, verified(_near(classes)))
    rare = checkpointed(_rooted(_shared(prints), roots))
    dealt = _lists(rare, classes, block)
    for most in [*(MORE**k for k in range(rounds)), 1 << 62]:
        shares = F.lit(dealt.count() // DEALT_ROWS + docs.sparkSession.sparkContext.defaultParallelism)
        share = F.pmod(F.xxhash64("gram", "lo", "hi"), shares)
        found = _rooted(dealt, roots).groupBy(share.alias("share")).applyInArrow(_closest(similarity, most), "u long, v long, gram long, lo long, hi long")
        found = checkpointed(found)
        roots = _joined(roots, verified(found.where("u is not null").select("u", "v").distinct()))
        left = found.where("u is null").select("gram", "lo", "hi")
        if not left.take(1):
            break
        dealt = checkpointed(dealt.join(left.hint("merge"), ["gram", "lo", "hi"]))
    return roots


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, how: dict) -> DataFrame:
    """(doc_id, told, first) per row of docs; first is the struct (null, doc_id, told) of the least row reachable."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, words, similarity))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "told"))
    classes = checkpointed(prints.groupBy("fp").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("simhash", "parity")]))
    roots = similar_roots(docs, prints, classes.select("fp", F.col("least.doc_id").alias("first"), "simhash", "parity"), id_col, text_col, words, similarity, **how)
    rooted = _rooted(classes.select("fp", "least"), roots)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("first"))
    ids = checkpointed(rooted.join(smallest, "root").select("fp", "first"))
    return prints.select("doc_id", "told", "fp").join(ids, "fp").select("doc_id", "told", "first")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, **how: int) -> DataFrame:
    """One row per row of docs: doc_id, component_id (smallest doc_id reachable by pairs of that similarity or more).

    Null text counts as empty; rows without words are one group. Texts of any length are read whole. Repeated rows are
    returned as often as they come. A null doc_id is never a component_id unless all of a component are null. Other columns
    are not read, whatever their names. An empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col, words, similarity, how).select("doc_id", F.col("first.doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, **how: int) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the one with the smallest id.

    Null ids stay only where a whole group has none; of several texts with the smallest id one stays. Rows are told by id
    and text: an id that repeats with another text loses nothing, a row that repeats a kept one goes.
    """
    return first_rows(docs, _grouped(docs, id_col, text_col, words, similarity, how), id_col, text_col)
