"""Chat formatting by multi-party perspective rotation; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.staging import stage

CHUNK = 256  # turns of one rendered piece
CONTEXT = ("system",)  # roles that frame a dialogue and never take part
ORDER = ("turn", "role", "text")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: 0, 1, .. in each dialogue by turn (null first), role and text.

    Rows are ordered by ranges over dialogues and turns together, so that a dialogue of any
    length, or of one turn number only, is spread over tasks; a row's place is its place in its
    range and the counts of the dialogue's earlier ranges.
    """
    by = [F.col("conv_id"), *map(F.col, ORDER), F.col("tie")]
    laid = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    laid = stage(laid.drop("tie").withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = laid.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    out = laid.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return out.select("conv_id", *ORDER, (F.col("at") - F.col("first") + F.col("earlier")).alias("place"))


def rendered(pieces: DataFrame, people: DataFrame, context: tuple[str, ...]) -> DataFrame:
    """Every piece from every participant's side; mask places count from the piece's start."""
    sides = pieces.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    me = F.col("participant")
    head = lambda t: F.when(t["role"] == me, F.lit("<|im_start|>assistant\n")).when(t["role"].isin(*context), F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"))).otherwise(F.concat(F.lit("<|im_start|>user name="), t["role"], F.lit("\n")))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit("<|im_end|>\n")).alias("body"), (t["role"] == me).alias("own")))
    sides = sides.select("conv_id", "participant", "chunk", parts.alias("parts"))

    def places(sizes: Column) -> Column:
        ends = F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
        return F.filter(F.arrays_zip(F.col("parts").alias("p"), ends.alias("end")), lambda z: z["p"]["own"])

    sizes = F.transform("parts", lambda p: (F.char_length(p["head"]) + F.char_length(p["body"])).cast("long"))
    own = F.get(F.transform(F.array(sizes), places), F.lit(0))  # sizes are worked out once, not for every turn
    return sides.select(
        "conv_id",
        "participant",
        "chunk",
        F.size("parts").cast("long").alias("n_turns"),
        F.transform(own, lambda z: F.struct((z["end"] - F.char_length(z["p"]["body"])).alias("from"), (z["end"] - 1).alias("to"))).alias("own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
    )


def rotate(conversations: DataFrame, chunk: int = CHUNK, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Every dialogue from every participant's side: conv_id, participant, chunk, n_turns, n_own, rendered, mask, n_chars, first_char.

    The participant speaks as ``assistant``, others as users with their name, context roles as
    themselves.  ``mask`` lists start-end (code points, end exclusive) of what the participant
    says, end mark included.  A dialogue of more than ``chunk`` turns is rendered in pieces of
    ``chunk`` turns, numbered: joined in order they are the one rendering, in which ``first_char``
    is a piece's start and the mask's places count.  So no row or task holds an unbounded dialogue.

    Turns go by turn (null first), then role, then text; repeated rows are turns of their own.
    A null role is ``unknown``, a null text empty, a null conv_id one dialogue.  Marks inside a
    text are broken by a blank.  Dialogues with context roles only have no rows.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    roles = stage(rows.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n")))
    people = roles.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("participant"))
    long = stage(roles.groupBy(F.col("conv_id").alias("l")).agg(F.sum("n").alias("n")).where(F.col("n") > chunk).select("l"))
    is_long = F.col("conv_id").eqNullSafe(F.col("l"))
    turns = F.array_sort(F.collect_list(F.struct(*ORDER))).alias("turns")
    short = rows.join(long, is_long, "left_anti").groupBy("conv_id").agg(turns).withColumn("chunk", F.lit(0).cast("long"))
    out = rendered(short, people, context).withColumn("first_char", F.lit(0).cast("long"))
    if not long.isEmpty():
        pieces = numbered(rows.join(long, is_long, "left_semi")).withColumn("chunk", F.floor(F.col("place") / chunk)).groupBy("conv_id", "chunk").agg(turns)
        sides = stage(rendered(pieces, people, context))
        before = Window.partitionBy("conv_id", "participant").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sides.select("conv_id", "participant", "chunk", F.char_length("rendered").cast("long").alias("n"))
        starts = stage(sizes.select(F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_char")))
        sides = sides.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("chunk") == F.col("k")))
        out = out.unionByName(sides.drop("c", "p", "k"))
    span = lambda s: F.concat_ws("-", (s["from"] + F.col("first_char")).cast("string"), (s["to"] + F.col("first_char")).cast("string"))
    return out.select(
        "conv_id",
        "participant",
        "chunk",
        "n_turns",
        F.size("own").cast("long").alias("n_own"),
        "rendered",
        F.array_join(F.transform("own", span), ",").alias("mask"),
        F.char_length("rendered").cast("long").alias("n_chars"),
        "first_char",
    )
