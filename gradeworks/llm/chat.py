"""Chat logs collapsed to maximal conversations and rendered, in DataFrame functions only.

A service that logs the whole conversation after each turn leaves many snapshots, each a prefix of the
next. Every turn gets the hash of its conversation up to there: the exclusive or of 128 bits made of
position, role and text of each turn. A conversation whose last hash is the hash of a longer one at that
place is a snapshot and goes (anti-join); of equal conversations the one with the smallest id stays.

Turns are worked on in blocks of ``BLOCK`` turn numbers, so no window, group or rendered row holds more than
one block of a conversation; only block sums are added up per conversation. Copies of a conversation meet
as pre-aggregated hashes.

Defined results: rows that repeat conversation, turn, role and text count once; turns of one number are ordered
by hash; a null turn number comes first, in a block of its own; a null role is ``unknown`` and a null text is
empty when rendered, but both differ from their spelled-out forms in comparison; rows of null conversation id
are one conversation; an empty table gives an empty table. Only the named columns are read, so other columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.session import write_table

BLOCK = 1024


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition &= a[n].eqNullSafe(b[n])
    return condition


def _hashes() -> list[Column]:
    parts = [F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    return [F.xxhash64(*parts).alias("g"), F.xxhash64(F.lit(1), *parts).alias("h")]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv``, ``at`` (turns so far) and ``a``, ``b`` (128 bits of them) for every turn, with the
    conversation's ``n`` turns; ``turns`` has conv, block, turn, g and h."""
    rows = turns.select("conv", "block", "turn", "g", "h").distinct()
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("conv").orderBy("block")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("conv").alias("c_conv"), F.col("block").alias("c_block"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"),
        F.sum("c").over(Window.partitionBy("conv")).alias("n"))
    inner = Window.partitionBy("conv", "block").orderBy("turn", "g", "h")
    ranked = rows.withColumn("rank", F.row_number().over(inner)).join(
        sizes, F.col("conv").eqNullSafe(F.col("c_conv")) & F.col("block").eqNullSafe(F.col("c_block")))
    ranked = ranked.withColumn("at", F.col("rank") + F.col("base"))
    marked = ranked.select("conv", "block", "at", "n", F.xxhash64("at", "g", "h").alias("x"),
                           F.xxhash64("h", "at", "g").alias("y"))
    running = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = write_table(marked.select(
        "conv", "block", "at", "n", F.bit_xor("x").over(running).alias("x"), F.bit_xor("y").over(running).alias("y")),
        "chat-turns")
    sums = marked.groupBy("conv", "block").agg(F.max_by("x", "at").alias("x"), F.max_by("y", "at").alias("y"))
    before = sums.select(
        F.col("conv").alias("c_conv"), F.col("block").alias("c_block"),
        *[F.coalesce(F.bit_xor(k).over(earlier), F.lit(0).cast("long")).alias(f"before_{k}") for k in "xy"])
    return marked.join(
        before, F.col("conv").eqNullSafe(F.col("c_conv")) & F.col("block").eqNullSafe(F.col("c_block"))).select(
        "conv", "at", "n", F.col("x").bitwiseXOR(F.col("before_x")).alias("a"),
        F.col("y").bitwiseXOR(F.col("before_y")).alias("b"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv`` and ``copies`` of the conversations that no longer one begins with."""
    last = prefixes.filter(F.col("at") == F.col("n")).groupBy("at", "a", "b").agg(
        F.min("conv").alias("conv"), F.count("*").alias("copies"))
    inside = prefixes.filter(F.col("at") < F.col("n")).select("at", "a", "b").distinct()
    return last.join(inside, ["at", "a", "b"], "left_anti").select("conv", "copies")


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", block: int = BLOCK) -> DataFrame:
    """``conv``, ``part`` (block of turns), ``n_turns``, ``copies`` and rendered ``text`` of every maximal
    conversation."""
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long"))
    rows = rows.select("conv", "block", "turn", "role", "text", *_hashes())
    kept = maximal(prefix_hashes(rows)).withColumnRenamed("conv", "kept_conv")
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), safe, F.lit("<|im_end|>\n"))
    said = rows.join(kept, F.col("conv").eqNullSafe(F.col("kept_conv"))).select(
        "conv", "block", "copies", F.struct("turn", "g", "h", line.alias("line")).alias("said"))
    parts = said.groupBy("conv", "block").agg(
        F.first("copies").alias("copies"), F.sort_array(F.collect_set("said")).alias("lines"))
    return parts.select(
        F.col("conv").alias(conv), F.col("block").alias("part"), F.size("lines").cast("long").alias("n_turns"), "copies",
        F.array_join(F.col("lines.line"), "").alias(text))
