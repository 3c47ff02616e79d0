"""Tables that grow with use: feedback on messages and chat histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feedback_latest(events: DataFrame) -> DataFrame:
    """One row per message: the feedback given last.

    ``events`` has (message_id, feedback, ts, event_id); the event id settles equal
    times. The maximum is taken before the shuffle too, so a message with very many
    events costs no more than any other.
    """
    return (
        events.groupBy("message_id")
        .agg(F.max(F.struct("ts", "event_id", "feedback")).alias("last"))
        .select("message_id", "last.feedback", "last.ts", "last.event_id")
    )


def append_turns(history: DataFrame, exchanges: DataFrame) -> DataFrame:
    """History with one exchange appended per conversation: the user turn, then the answer.

    ``history`` has (conv_id, turn, role, text), ``exchanges`` (conv_id, question,
    answer). Histories stay rows ordered by ``turn``; they are never gathered.
    """
    ends = history.groupBy("conv_id").agg((F.max("turn") + 1).alias("next"))
    start = F.coalesce("next", F.lit(0).cast("bigint"))

    def turn(number: Column, role: str, text: str) -> Column:
        return F.struct(number.alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text"))

    exchange = F.array(turn(start, "user", "question"), turn(start + 1, "assistant", "answer"))
    new = exchanges.join(ends, "conv_id", "left").select("conv_id", F.inline(exchange))
    return history.select("conv_id", "turn", "role", "text").unionByName(new)


def chat_history(*turn_tables: DataFrame) -> DataFrame:
    """Union of turn tables as (conv_id, turn, role, content)."""
    columns = ["conv_id", "turn", "role", F.col("text").alias("content")]
    history = turn_tables[0].select(*columns)
    for table in turn_tables[1:]:
        history = history.unionByName(table.select(*columns))
    return history
