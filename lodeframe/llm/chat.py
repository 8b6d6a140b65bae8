"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which are then rendered.

Turn k of a conversation gets a rolling hash of its turns 1..k (128 bits: two running exclusive-ors of hashes of number,
role and text). A conversation whose last hash is a proper prefix hash of another is a snapshot and goes by an anti-join;
of equal conversations the smallest conv_id stays. Hashes are grouped, with map-side combining, before they are joined, so
a first turn that everyone sends is one row. All of this is done on narrow rows, with two hashes in place of each text.
Windows run over stretches of STRETCH turn numbers, whose totals are added up in a second step, so no conversation has to
fit in one task. Texts are read a second time, and only turns of conversations that stay are moved, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, small

#: Turn numbers in a stretch, and turns in one rendered part.
STRETCH, PART = 1024, 1024


def hashed(conversations: DataFrame, *more: str) -> DataFrame:
    """(conv_id, turn, role, h, g, ...): two hashes for the text, and the columns in more. Null roles and texts are empty."""
    text = F.coalesce("text", F.lit(""))
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g"), *more)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role"), F.col("h")]


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, h, ...) with a number from 1 in each conversation (at), and its count of turns (n).

    Turns are ordered by turn (nulls last), ties by role, then by the text's hash, so equal rows only are in no order.
    """
    rows = turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(2**62)))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy(*_order())))
    sizes = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("conv_id").orderBy("stretch")
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.sum("m").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))
    return inside.join(sizes, same).withColumn("at", F.col("before") + F.col("k")).drop("c", "s", "before", "k")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, at, n, a, b): the rolling hashes of numbered turns."""
    own = rows.select("conv_id", "stretch", "at", "n", F.xxhash64("at", "role", "h").alias("x"), F.xxhash64("g", "role", "at").alias("y"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("at")
    run = own.select("conv_id", "stretch", "at", "n", F.bit_xor("x").over(inside).alias("x"), F.bit_xor("y").over(inside).alias("y"))
    totals = own.groupBy("conv_id", "stretch").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    ahead = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.bit_xor("x").over(ahead), F.lit(0)).alias("u"), F.coalesce(F.bit_xor("y").over(ahead), F.lit(0)).alias("v"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))
    return run.join(totals, same).select("conv_id", "at", "n", F.col("x").bitwiseXOR(F.col("u")).alias("a"), F.col("y").bitwiseXOR(F.col("v")).alias("b"))


def maximal(rows: DataFrame) -> DataFrame:
    """(keep, turns, copies): of numbered turns, the conversations that are no proper prefix of another, equal ones once."""
    hashes = checkpointed(prefixes(rows))
    whole = hashes.where(F.col("at") == F.col("n")).groupBy("n", "a", "b").agg(F.min("conv_id").alias("keep"), F.count("*").alias("copies"))
    proper = hashes.where(F.col("at") < F.col("n")).select(F.col("at").alias("n"), "a", "b").distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("keep", F.col("n").alias("turns"), "copies")


def render(conversations: DataFrame, part: int = PART) -> DataFrame:
    """One row per kept conversation and part of it: conv_id, part, n_turns, copies, text.

    A turn is "<|role|>", a line feed, its text, a line feed, "<|end|>", a line feed; "<|" inside texts and roles becomes
    "< |", so no text can end a turn. A part has at most `part` turns; most conversations have part 0 alone, and the parts
    of one in order hold all of it. Null roles and texts count as empty. Rows with a null conv_id are one conversation.
    copies counts equal conversations. Repeated rows are turns like others. Texts of any length are moved whole. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    keep = checkpointed(maximal(numbered(hashed(conversations))))
    few = small(keep, keep.count())
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = hashed(conversations, F.concat(F.lit("<|"), safe("role"), F.lit("|>\n"), safe("text"), F.lit("\n<|end|>\n")).alias("piece"))
    own = turns.join(few, F.col("conv_id").eqNullSafe(F.col("keep"))).drop("g", "keep")

    def joined(rows: DataFrame, *order: str) -> DataFrame:
        pieces = F.array_sort(F.collect_list(F.struct(*order, "piece")))
        grouped = rows.groupBy("conv_id", "part", "turns", "copies").agg(pieces.alias("pieces"))
        return grouped.select("conv_id", "part", F.col("turns").alias("n_turns"), "copies", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))

    # what has one part needs no numbers; the number of a turn in a longer one tells its part
    short = own.where(F.col("turns") <= part).withColumns({"part": F.lit(0).cast("long"), "late": F.col("turn").isNull()})
    out = joined(short, "late", "turn", "role", "h")
    if keep.where(F.col("turns") > part).take(1):
        long = numbered(own.where(F.col("turns") > part)).withColumn("part", F.floor((F.col("at") - 1) / part))
        out = out.unionAll(joined(long, "at"))
    return out
