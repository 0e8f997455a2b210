"""Chat formatting: collapse cumulative snapshots of one conversation, then render what is left.

A log often holds a conversation again after each turn, so that one entry begins another. Every
turn gets two 64-bit hashes of its number, role and text; their running exclusive or over the turns of a
conversation, one step a turn, is the rolling hash of each of its prefixes. A conversation whose hash over
all its turns is a shorter prefix's hash of another one is dropped by an anti-join; of equal conversations
one stays. Both sides of the join are made distinct first, with map-side combine, so a first turn or a
conversation that much of the log shares is one key. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.durable import Scratch

#: Rendered form of a turn; roles and texts are put in as they are.
TURN_HEAD, TURN_TAIL = "<|{}|>\n", "\n<|end|>\n"


_TURN = ["late", "turn", "role", "text"]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, i, role, text): the turns of each conversation, i from 1 in order.

    Rows of one conversation are ordered by turn (null last), role and text (null first); rows that
    repeat a turn, role and text are one turn. Rows with a null conv_id belong to none and are left.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    in_turn = Window.partitionBy("conv_id").orderBy(*_TURN)
    again = F.lit(True)
    for c in _TURN:
        again = again & F.col(c).eqNullSafe(F.lag(c).over(in_turn))
    fresh = rows.withColumn("fresh", (F.row_number().over(in_turn) == 1) | ~again).where("fresh")
    return fresh.select("conv_id", F.row_number().over(in_turn).alias("i"), "role", "text")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, copies): conversations that begin no longer one; of equal ones the smallest conv_id.

    turns: array of (i, role, text) in order; copies: how many conversations of the log are equal to it, itself
    included. Turns are compared by place, role and text; their numbers only set the order.
    """
    rows = numbered_turns(turns)
    whole, upto = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("i")
    own = [F.xxhash64(F.lit(salt), "i", F.col("role").isNull(), "role", F.col("text").isNull(), "text") for salt in ("a", "b")]
    hashed = rows.select("conv_id", "i", own[0].alias("a"), own[1].alias("b"))
    rolled = hashed.select(
        "conv_id", "i", F.max("i").over(whole).alias("n"),
        *(F.bit_xor(c).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"key_{c}") for c in ("a", "b")),
    )
    rolled = Scratch(turns.sparkSession, "chat").save(rolled, "prefixes")  # 32 bytes a turn
    full = rolled.where("i = n").groupBy("i", "key_a", "key_b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = rolled.where("i < n").select("i", "key_a", "key_b").distinct()
    stay = full.join(prefixes, ["i", "key_a", "key_b"], "left_anti").select("conv_id", "copies")
    kept = rows.join(stay, "conv_id")
    return kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "role", "text"))).alias("turns"), F.first("copies").alias("copies"))


def render(turns: Column) -> Column:
    """One string: each turn's head with its role (null: unknown), its text (null: empty) and its tail."""
    head, tail = TURN_HEAD.split("{}")
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit(head), F.coalesce(t["role"], F.lit("unknown")), F.lit(tail), F.coalesce(t["text"], F.lit("")), F.lit(TURN_TAIL)),
        ),
        "",
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, text): every maximal conversation of ``turns``, rendered whole.

    ``turns`` has conv_id, turn, role, text; other columns are not read. An empty table gives an
    empty result; a conversation of one empty turn is rendered as that turn.
    """
    kept = maximal_conversations(turns)
    return kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", render(F.col("turns")).alias("text"))
