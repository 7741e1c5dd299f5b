"""Conversation log queries: history projection and the newest assistant message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPOKEN = ("user", "assistant")


def conversation_history(messages: DataFrame, conv_id: int | None = None) -> DataFrame:
    """Only user and assistant turns, in order; optionally of one conversation."""
    turns = messages.where(F.col("role").isin(*SPOKEN))
    if conv_id is not None:
        turns = turns.where(F.col("conv_id") == conv_id)
    return turns.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


def latest_assistant_message(messages: DataFrame) -> DataFrame:
    """One row: the last assistant turn of the newest conversation, NULL if it has none.

    A single aggregate with partial combination: rows compare by conversation, then spoken-by-assistant, turn.
    """
    order = F.struct("conv_id", (F.col("role") == "assistant").alias("spoken"), "turn")
    newest = messages.agg(F.max_by(F.struct("conv_id", "turn", "role", "text"), order).alias("m"))
    said = F.col("m.role") == "assistant"
    return newest.select(
        F.col("m.conv_id").alias("conv_id"),
        F.when(said, F.col("m.turn")).alias("turn"),
        F.when(said, F.col("m.text")).alias("text"),
    )
