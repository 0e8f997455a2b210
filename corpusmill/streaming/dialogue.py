"""Dialogue state per conversation, kept by a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.streaming.windows import read_stream, run_to_table

_STATE = "n_turns long, questions long, last_turn long, last_role string"
_OUT = f"conv_id long, {_STATE}"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, questions, last, role = state.get if state.exists else (0, 0, -1, None)
    for rows in frames:
        rows = rows.sort_values("turn")
        n, questions = n + len(rows), questions + int(rows["text"].fillna("").str.contains("?", regex=False).sum())
        if rows["turn"].iloc[-1] > last:
            last, role = int(rows["turn"].iloc[-1]), rows["role"].iloc[-1]
    state.update((n, questions, last, role))
    yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "questions": [questions], "last_turn": [last], "last_role": [role]})


def dialogue_states(turns: DataFrame) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) -> the state of each conversation whenever it changes; four values a conversation."""
    return turns.groupBy("conv_id").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def streamed_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each conversation after the whole table went through the stream."""
    from pyspark.sql import functions as F

    states = run_to_table(dialogue_states(read_stream(spark, path)), "update")
    return states.groupBy("conv_id").agg(F.max_by(F.struct("n_turns", "questions", "last_turn", "last_role"), "n_turns").alias("s")).select("conv_id", "s.*")
